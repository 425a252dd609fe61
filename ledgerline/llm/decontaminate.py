"""Benchmark decontamination by greedy string tiling.

Words of a document and of a test item that share a seed (``MIN_MATCH`` words in a row) are tiled: running Karp-Rabin
hashes find the longest stretches that neither side has used, these are marked, and again with shorter stretches down
to ``MIN_MATCH``. The share of the item's words under tiles does not depend on their order, so a passage put together
anew is found as well as a verbatim one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, shingles, table, words

#: Words of a seed, and of the shortest tile.
MIN_MATCH = 5
#: A document is contaminated by an item when its tiles cover at least this share of the item's words.
COVERAGE = 0.5
#: Characters of benchmark text in one broadcast index; a larger benchmark is searched block by block.
BLOCK_CHARS = 32_000_000
_PRIME = (1 << 61) - 1
_BASE = 1_000_003
_FILTER_BITS = 20


def _prefix_hashes(w: list[int]) -> list[int]:
    out, h = [0], 0
    for x in w:
        h = (h * _BASE + x + 1) % _PRIME
        out.append(h)
    return out


def _window_hashes(h: list[int], s: int) -> list[int]:
    power = pow(_BASE, s, _PRIME)
    return [(y - x * power) % _PRIME for x, y in zip(h, h[s:], strict=False)]


def _matches(item: np.ndarray, doc: np.ndarray, hi: list[int], hd: list[int], used_i: np.ndarray, used_d: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked common stretches of at least ``s`` words, found by Karp-Rabin hashes of ``s``-word windows. The
    places of a window in the document are handled together, so that repeated words cost an array, not a loop."""
    free_i, free_d = _runs(used_i), _runs(used_d)
    windows = defaultdict(list)
    for d, key in enumerate(_window_hashes(hd, s)):
        if free_d[d] >= s:
            windows[key].append(d)
    places = {key: np.array(d) for key, d in windows.items()}
    found = []
    for i, key in enumerate(_window_hashes(hi, s)):
        if free_i[i] < s or key not in places:
            continue
        at = places[key]
        if i and not used_i[i - 1]:
            before = np.maximum(at - 1, 0)
            at = at[(at == 0) | used_d[before] | (doc[before] != item[i - 1])]  # the others are part of a longer one
        for d in at.tolist():
            most = int(min(free_i[i], free_d[d]))
            other = np.flatnonzero(item[i : i + most] != doc[d : d + most])
            n = int(other[0]) if len(other) else most
            if n >= s:
                found.append((n, i, d))
    return found


def _runs(used: np.ndarray) -> np.ndarray:
    """How many unmarked words there are in a row from each place on."""
    marked = np.flatnonzero(used)
    places = np.arange(len(used))
    following = np.searchsorted(marked, places)
    return np.where(following < len(marked), marked[np.minimum(following, max(len(marked) - 1, 0))] if len(marked) else len(used), len(used)) - places


def tiles(item: list[int], doc: list[int], shortest: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (length, place in item, place in doc), longest first; of equal
    lengths the earliest in the item, then in the document."""
    shortest = min(shortest, len(item))
    if not shortest:
        return []
    hi, hd = _prefix_hashes(item), _prefix_hashes(doc)
    a, b = (np.array([x & 0xFFFFFFFFFFFFFFFF for x in w], np.uint64) for w in (item, doc))
    used_i, used_d = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out, s = [], max(shortest, min(len(a), 4 * shortest))
    while True:
        found = sorted(_matches(a, b, hi, hd, used_i, used_d, s), key=lambda x: (-x[0], x[1], x[2]))
        if found and found[0][0] > 2 * s:
            s = found[0][0]
            continue
        again = False
        for n, i, d in found:
            if used_i[i : i + n].any() or used_d[d : d + n].any():
                again = True  # what is left of it may still be long enough
                continue
            used_i[i : i + n] = True
            used_d[d : d + n] = True
            out.append((n, i, d))
        if again:
            continue
        if s <= shortest:
            return out
        s = max(shortest, s // 2)


#: Words here are runs of letters and digits, whatever their case, so that marks around a passage do not hide it.
_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(texts: list[str | None]):
    return words([x.lower() if x and not x.isascii() else x for x in texts], gaps=_GAPS)


class Index:
    """Seeds of a block of test items. Items with equal words share an entry; items without words are left out."""

    def __init__(self, items: list[tuple], shortest: int = MIN_MATCH):
        self.shortest = shortest
        by_words: dict[tuple, list] = defaultdict(list)
        for item, text in items:
            h, *_ = _words([text])
            if len(h):
                by_words[tuple(h.tolist())].append(item)
        self.items = [(list(w), ids) for w, ids in sorted(by_words.items())]
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for n, (w, _) in enumerate(self.items):
            k = min(shortest, len(w))
            s, _ = shingles(np.array(w, np.uint64), np.array([0, len(w)]), k)
            for x in s.tolist():
                seeds[k][x].add(n)
        for k, own in seeds.items():
            keys = np.array(sorted(own), np.uint64)
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_length[k] = (keys, [sorted(own[x]) for x in keys.tolist()], maybe)

    def find(self, texts: list[str | None], coverage: float = COVERAGE) -> list[tuple[int, object, int, int, float]]:
        """(row, item, words under tiles, tiles, coverage) of every item a text contains."""
        h, _, _, first, _ = _words(texts)
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, (keys, owners, maybe) in self.by_length.items():
            s, at = shingles(h, first, k)
            spot = np.flatnonzero(maybe[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            place = np.searchsorted(keys, s[spot])
            place[place == len(keys)] = 0
            ok = keys[place] == s[spot]
            spot, place = spot[ok], place[ok]
            row = np.searchsorted(at, spot, side="right") - 1
            for x, p, r in zip(spot.tolist(), place.tolist(), row.tolist(), strict=True):
                # a text of fewer than k words is one window, which no seed of k words equals
                for n in owners[p]:
                    hits[r, n].append(x - int(at[r]))
        out = []
        for (r, n), spots in sorted(hits.items()):
            item, ids = self.items[n]
            if len(set(spots)) + self.shortest - 1 < coverage * len(item) / max(1, self.shortest):
                continue  # a tile of t words has t - shortest + 1 seeds, so these cover too little
            # only the neighbourhood of seeds can hold tiles
            base, reach, size = int(first[r]), self.shortest, int(first[r + 1] - first[r])
            keep = np.zeros(size, bool)
            for x in set(spots):
                keep[x : x + reach] = True
            idx = np.flatnonzero(keep)
            doc: list[int] = []
            for j, x in enumerate(idx.tolist()):
                if j and idx[j - 1] + 1 != x:
                    doc.append(-j)  # a border that equals no word
                doc.append(int(h[base + x]))
            found = tiles(item, doc, self.shortest)
            under = sum(t[0] for t in found)
            if under >= coverage * len(item):
                out += [(r, i, under, len(found), under / len(item)) for i in ids]
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark as indexes of bounded size."""
    chars = benchmark.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    n = chars // BLOCK_CHARS + 1
    for b in range(n):
        part = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64(text_col), F.lit(n)) == b)
        yield Index([(r[0], r[1]) for r in part.select(id_col, text_col).filter(F.col(text_col).isNotNull()).collect()])


def contaminations(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched_words long, n_tiles long, coverage double): one row per document and test item it
    contains; clean documents have none.

    Words are runs of letters and digits (any byte beyond ASCII counts as a letter), lower-cased. Items of fewer than ``MIN_MATCH`` words must occur whole. Null
    and empty texts or items match nothing; repeated rows give repeated rows, equal items a row each; empty tables give
    an empty one; other columns are not read.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", benchmark.schema["item_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("matched_words", "n_tiles")], T.StructField("coverage", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    out = None
    for index in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, _, texts in pieces(batch.column(1)):
                    found = shared.value.find(texts, coverage)
                    cols = [[ids[a + x[0]] for x in found], *[[x[i] for x in found] for i in range(1, 5)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns, without a shuffle. Rows with null or empty texts or
    null ids hold none and stay, repeated rows stay or go together; empty tables drop nothing; columns of any name are kept."""
    at = docs.columns.index("text")
    for index in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for a, b, texts in pieces(batch.column(at)):
                    bad = {x[0] for x in shared.value.find(texts, coverage)}
                    yield batch.slice(a, b - a).filter(pa.array([i not in bad for i in range(b - a)], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
