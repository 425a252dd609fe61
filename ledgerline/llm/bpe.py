"""Byte-level BPE encoding and decoding over a segment tree.

Every match of the split pattern is merged on its own. The leaves of a segment tree stand for the piece's byte
positions and hold ``rank * size + position`` of the pair that starts there, so the root is the pair of least rank, the
leftmost of equals. A merge rewrites three leaves (the merged position, its live left neighbour and the swallowed
position) and walks their paths to the root. Short pieces go through a forest of such trees, one per row of a numpy
array; long ones through one tree each. Only distinct pieces are merged; what they gave is kept in a bounded cache.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Pieces kept per worker; when there are more the cache starts afresh.
CACHE_PIECES = 400_000
#: Pieces of more bytes than this get a tree of their own.
FOREST_BYTES = 32
_NONE = np.int64(1) << np.int64(60)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def split_pattern(pattern: str) -> regex.Pattern:
    """The split pattern, with ``\\s`` meaning Unicode white space, as in the library's own engine."""
    return regex.compile(re.sub(r"\\s", r"\\p{White_Space}", re.sub(r"\[\^\\s", r"[^\\p{White_Space}", pattern)))


class SegmentTreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.pattern = split_pattern(pattern)
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.values = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int64, len(pairs))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.cache: dict[str, bytes] = {}

    # one piece, one tree
    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids = [int(self.single[b]) for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        none, get = int(_NONE), self.pairs.get
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                low = tree[2 * k] if tree[2 * k] <= tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        def weigh(i: int) -> int:
            j = after[i]
            r = get(ids[i] << 20 | ids[j]) if j < n else None
            return none if r is None else r * width + i

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i] = rank
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, weigh(i))
            if before[i] >= 0:
                put(before[i], weigh(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], -1)

    # many pieces of at most ``width`` bytes, a tree in each row
    def merge_forest(self, pieces: list[bytes], width: int) -> list[bytes]:
        m = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, m)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        rows = np.repeat(np.arange(m), lens)
        cols = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
        ids = np.full((m, width + 1), -1, np.int64)
        ids[rows, cols] = self.single[data]
        tree = np.full((m, 2 * width), _NONE, np.int64)
        r = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, width)
        tree[:, width:] = np.where(r >= 0, r * width + np.arange(width), _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.broadcast_to(np.arange(1, width + 2), (m, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()
        alive = ids >= 0

        def put(row, i, value):
            k = width + i
            tree[row, k] = value
            k = k >> 1
            while k[0]:  # all leaves are equally deep
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])
                k = k >> 1

        def weigh(row, i):
            j = np.minimum(after[row, i], width)
            r = self._rank(ids[row, i], ids[row, j])
            return np.where(r >= 0, r * width + i, _NONE)

        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            top = tree[live, 1]
            rank, i = top // width, top % width
            j = after[live, i]
            ids[live, i] = rank
            k = after[live, j]
            after[live, i] = k
            before[live, np.minimum(k, width)] = i
            alive[live, j] = False
            put(live, j, _NONE)
            put(live, i, weigh(live, i))
            b = before[live, i]
            has = np.flatnonzero(b >= 0)
            if len(has):
                put(live[has], b[has], weigh(live[has], b[has]))
            live = live[tree[live, 1] < _NONE]
        flat = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, pieces) -> None:
        """Put the encodings of pieces that the cache lacks into it."""
        cache, ranks = self.cache, self.ranks
        byte, by_width = {}, {8: [], 16: [], FOREST_BYTES: []}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            whole = ranks.get(raw)
            if whole is not None:
                cache[p] = whole.to_bytes(4, "little")
            elif len(raw) > FOREST_BYTES:
                cache[p] = np.array(self.merge_long(raw), "<u4").tobytes()
            else:
                byte[p] = raw
                by_width[8 if len(raw) <= 8 else 16 if len(raw) <= 16 else FOREST_BYTES].append(p)
        for width, group in by_width.items():
            for a in range(0, len(group), 20_000):
                part = group[a : a + 20_000]
                cache.update(zip(part, self.merge_forest([byte[p] for p in part], width), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as the empty text."""
        pieces = [self.pattern.findall(x) if x else [] for x in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache = self.cache
        self.learn([p for p in set().union(*pieces) if p not in cache])
        return [b"".join([cache[p] for p in x]) for x in pieces]

    def decode_batch(self, ids: list[bytes]) -> list[bytes]:
        get = self.bytes_of.__getitem__
        return [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in ids]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, decode: bool = False) -> DataFrame:
    """(id, n_tokens long, ids binary[, decoded binary]) for every row, whole texts.

    ids are little-endian unsigned 32-bit integers. Null and empty texts give no ids. Rows are kept one for one: null or
    repeated ids stay as they are, an empty table gives an empty one, other columns are not read, whatever their names.
    """
    path = path or public_tokenizers.path(RANKS_FILE)

    def run(keys, texts):
        bpe = tokenizer(path, pattern)
        ids = bpe.encode_batch(texts)
        out = {id_col: keys, "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
        return out | ({"decoded": bpe.decode_batch(ids)} if decode else {})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, decoded binary): the bytes that packed ids stand for; null ids count as none."""
    path = path or public_tokenizers.path(RANKS_FILE)

    def run(keys, ids):
        return {id_col: keys, "decoded": tokenizer(path, pattern).decode_batch([x or b"" for x in ids])}

    return map_columns(encoded, [id_col, ids_col], run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), decode=True))
