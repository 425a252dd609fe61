"""Helpers shared by the corpus operators: table access, Arrow batches, checkpoints, hashing."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import cut, drop_dir  # noqa: F401

# Python workers live on between tasks; freed buffers go back to the system instead of staying in Arrow's own pool
pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Give free heap pages back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def free(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more, shuffle files of the executors with it."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


#: Text handled at a time inside one Arrow batch, so that memory does not follow the row count of a batch.
CHUNK_BYTES = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
    trim()


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list]]:
    """``chunks`` of an Arrow column of texts with the texts of each range; the others stay as they are, so that a batch is
    never there as Python objects as a whole."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    till = np.cumsum(size)
    start = 0
    while start < len(size):
        done = int(till[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(till, done + limit, side="right")))
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end
    trim()


def map_columns(df: DataFrame, columns: list[str], fn: Callable[..., dict], schema: str | T.StructType) -> DataFrame:
    """``fn(*lists) -> {name: list}`` over chunks of the named columns; returns only the columns of ``schema``."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            for a, b, texts in pieces(batch.columns[-1]):
                out = fn(*(c.slice(a, b - a).to_pylist() for c in batch.columns[:-1]), texts)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select([F.col(f"`{c}`") for c in columns]).mapInArrow(run, fields)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")) % n


def crc_of(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


#: Bytes that part words: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x = x * _MIX2
    x ^= x >> np.uint64(31)
    return x


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each ended by a newline, and the offsets where they start (with the end)."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=off[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), off


def words(texts: list[str | None], lower: bool = True, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes not in ``gaps``; by default ``[^\\x20\\x09-\\x0D]+``) of all texts: 64-bit hashes, byte
    starts, byte ends, first word of each text (with the end), and the bytes. With ``lower`` A-Z count as a-z."""
    data, off = joined(texts)
    if lower:
        data = LOWER[data]
    gap = gaps[data]
    before = np.empty(len(gap), bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    first = np.searchsorted(starts, off)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, first, data
    with np.errstate(over="ignore"):
        n = ends - starts
        h = np.zeros(len(starts), np.uint64)
        lanes = eights(data)
        live, at, left = np.arange(len(starts)), starts.copy(), n.copy()
        while len(live):  # eight bytes of each word at a time
            part = lanes[at]
            cut_ = np.minimum(left, 8)
            part = part & _MASKS[cut_]
            h[live] = mix((h[live] ^ part) * _MUL + cut_.astype(np.uint64))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return h, starts, ends, first, data


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one little-endian number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for r in range(8):
        part = padded[r : r + len(data) // 8 * 8 + 8]
        part = part[: len(part) // 8 * 8].view("<u8")
        out[r::8] = part[: len(out[r::8])]
    return out


_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of ``k`` words inside each text, a shorter text's whole sequence counting as one; with
    the window each text starts at (and the end)."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.empty(0, np.uint64), at
    with np.errstate(over="ignore"):
        doc = np.repeat(np.arange(len(n)), count)
        start = np.arange(at[-1]) - at[doc] + first[doc]
        size = np.minimum(n[doc], k)
        out = np.zeros(at[-1], np.uint64)
        for j in range(k):
            inside = size > j
            if inside.all():
                out = mix(out * _MUL + h[start + j] + np.uint64(j + 1))
            else:
                w = np.flatnonzero(inside)
                out[w] = mix(out[w] * _MUL + h[start[w] + j] + np.uint64(j + 1))
    return out, at
