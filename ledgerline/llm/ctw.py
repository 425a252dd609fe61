"""Language-model scores by context-tree weighting, beside a unigram base.

A byte is eight binary decisions along a tree of its high bits. Each decision has, for every context of 0 to ``DEPTH``
preceding bytes, counts of zeros and ones gathered from all training texts, and a Krichevsky-Trofimov estimate from
them. A context node's weighted probability is half its own estimate and half the product of its children's; the
weights that follow mix the estimates of all depths into one prediction. Every context of the training texts is kept.

N-grams are first counted where the hash of the whole n-gram puts them. From the merged counts come the contexts that are
more than one place should hold, the trunk; each subtree that hangs on it is a unit, mixed in one place, and
units are dealt out by hash, so that a frequent context is split as deep as it takes. Of each unit only sums reach the
trunk, which the driver weighs and broadcasts.

Words and n-grams travel as packed arrays and stay distributed: frequent ones (a bounded number) are broadcast with
their counts or mixed probabilities, the others are looked up where their counts lie. Both ways give the same value, so
that the bound decides what travels, not what is learned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, cut, mix, pieces, table, trim, words

DEPTH = 5
#: N-grams at least as frequent as one in so many bytes are broadcast with their probabilities.
GRAM_BITS = 20
#: A context that weighs more than this, and than one in 2 ** TRUNK_BITS of all, is split. It weighs as much as it has
#: n-grams, and as often as those occur that are not broadcast, since so often they are asked for.
UNIT_WEIGHT = 1 << 16
TRUNK_BITS = 13
#: N-grams whose units are mixed at a time.
MIX_GRAMS = 100_000
#: Words at least as frequent as one in so many tokens are broadcast.
FREQUENT_BITS = 20
#: Characters of text per group in the exchange, and the fewest and most groups.
GROUP_CHARS = 8_000_000
MIN_GROUPS, MAX_GROUPS = 32, 1 << 16
#: Characters of text coded at a time.
CHUNK = 1_000_000
#: Questions a task holds before it sends them off, or before it answers them.
ASK = 1_000_000
#: Entries a task holds before it merges them, and distinct ones before it sends them off.
HOLD = 2_000_000
END = 0xFF
_END_WORD = np.uint64(0x656E642D6F662D74)
_COUNT = np.dtype([("key", "<u8"), ("n", "<u8")])
_LOGP = np.dtype([("key", "<u8"), ("logp", "<f8")])
_ASK = np.dtype([("key", "<u8"), ("row", "<u8"), ("more", "<u4")])
_SUM = np.dtype([("place", "<u2"), ("below", "<f8"), ("n", "<f8")])


def byte_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with A-Z lower-cased as bytes, each after ``DEPTH`` end bytes and closed by one; starts, and ends past it."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    pad = bytes([END]) * DEPTH
    data = LOWER[np.frombuffer(pad + pad.join(raw) + pad, np.uint8)]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = DEPTH + np.concatenate([[0], np.cumsum(n + DEPTH)[:-1]])
    return data, starts, starts + n + 1


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code of every byte and end, the bytes of its context from the latest on and then itself, so that the n-grams
    of a context are a range; and the number of each text's."""
    data, starts, ends = byte_stream(texts)
    n = len(data)
    code = data[DEPTH:].astype(np.uint64)
    for back in range(1, DEPTH + 1):
        code |= data[DEPTH - back : n - back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
    real = np.ones(n, bool)
    for i in range(DEPTH - 1):  # of the end bytes between texts only the first is coded
        real[np.minimum(ends + i, n - 1)] = False
    return code[real[DEPTH:]], ends - starts


def _context(codes: np.ndarray, depth: int) -> np.ndarray:
    """The latest ``depth`` bytes of each code's context."""
    return codes >> np.uint64(8 * (DEPTH + 1 - depth)) if depth else np.zeros(len(codes), np.uint64)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the first of each text (with the end); end tokens are not among them."""
    h, _, _, first, _ = words(texts)
    return h, first


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[start], np.add.reduceat(c, start) if len(k) else c


def _packed(k: np.ndarray, c: np.ndarray) -> np.ndarray:
    rows = np.empty(len(k), _COUNT)
    rows["key"], rows["n"] = k, c
    return rows


def _dealt(kind: int, rows: np.ndarray, g: np.ndarray):
    """(kind, g, bytes) of packed rows, by group and in their order."""
    if not len(g):
        return
    order = np.argsort(g, kind="stable")
    rows, g = rows[order], g[order]
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    for a, b in zip(at, np.r_[at[1:], len(g)], strict=True):
        yield kind, int(g[a]), rows[a:b].tobytes()


class _Tally:
    """Counts by key, merged whenever many are held."""

    def __init__(self, kind: int, groups: int):
        self.kind, self.groups = kind, groups
        self.keys, self.counts, self.size, self.limit = [], [], 0, HOLD

    def hold(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys), self.counts.append(counts.astype(np.uint64))
        self.size += len(keys)
        if self.size > self.limit:
            k, c = self.merged()
            self.keys, self.counts, self.size = [k], [c], len(k)
            self.limit = max(HOLD, 2 * len(k))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return _merge(self.keys, self.counts)

    def add(self, keys: np.ndarray, counts: np.ndarray):
        """What has to leave, because too many distinct keys are held, as dealt rows."""
        self.hold(keys, counts)
        if self.limit > HOLD:
            yield from self.rest()

    def rest(self):
        if self.keys:
            k, c = self.merged()
            self.keys, self.counts, self.size, self.limit = [], [], 0, HOLD
            yield from _dealt(self.kind, _packed(k, c), mix(k) % np.uint64(self.groups))


WORDS, GRAMS, ASKED, TEXTS, ASKED_GRAMS = 0, 1, 2, 3, 4
_NAMES, _TYPES = ("kind", "g", "data"), (pa.int32(), pa.int32(), pa.binary())


def _batch(rows, names=_NAMES, types=_TYPES):
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], list(names))


def _gather(train: DataFrame, groups: int) -> DataFrame:
    """(kind, g, data, n, v): all word counts and n-gram counts of the training texts, dealt by hash; n sums the counts,
    v counts the keys."""

    def run(batches):
        w, g, docs = _Tally(WORDS, groups), _Tally(GRAMS, groups), 0
        for batch in batches:
            docs += batch.num_rows
            for _, _, texts in pieces(batch.column(0), CHUNK):
                out = [*w.add(*np.unique(_tokens(texts)[0], return_counts=True)), *g.add(*np.unique(_codes(texts)[0], return_counts=True))]
                if out:
                    yield _batch(out)
        if docs:
            yield _batch([*w.add(np.array([_END_WORD]), np.array([docs])), *w.rest(), *g.rest()])

    def add(batches):
        own: dict[tuple[int, int], _Tally] = {}
        for batch in batches:
            for kind, g, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(d, _COUNT)
                own.setdefault((g, kind), _Tally(kind, groups)).hold(rows["key"], rows["n"])
        for (g, kind), tally in sorted(own.items()):
            k, c = tally.merged()
            yield _batch([(kind, g, _packed(k, c).tobytes(), int(c.sum()), len(k))], (*_NAMES, "n", "v"), (*_TYPES, pa.int64(), pa.int64()))
        trim()

    dealt = train.select("text").mapInArrow(run, "kind int, g int, data binary")
    return cut(dealt.repartitionById(groups, "g").mapInArrow(add, "kind int, g int, data binary, n long, v long"))


# estimates


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    x = x.astype(np.float64)
    for _ in range(6):
        small = x < 7
        shift = shift - np.where(small, np.log(x), 0)
        x = np.where(small, x + 1, x)
    inv = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv / 1260))


_LG_HALF = 0.5723649429247001
# for counts below its length
_LG = np.stack([_lgamma(np.arange(1 << 12) + 0.5) - _LG_HALF, _lgamma(np.arange(1 << 12) + 1.0)])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - 2 * _LG_HALF - _lgamma(n0 + n1 + 1.0)


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """``log_kt`` of whole numbers, small ones by table."""
    a, b = n0.astype(np.int64), n1.astype(np.int64)
    n = a + b
    small = n < _LG.shape[1]
    out = np.empty(len(n))
    out[small] = _LG[0][a[small]] + _LG[0][b[small]] - _LG[1][n[small]]
    out[~small] = log_kt(n0[~small], n1[~small])
    return out


def _stay(own: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """The weight of a node's own estimate in its weighted probability."""
    return np.minimum(np.exp(np.minimum(own - weighted, 0.6931471805599453)) / 2, 1.0)


# the trunk


class Trunk:
    """Contexts that are split, by depth and in order; the one of no bytes is always there."""

    def __init__(self, contexts: list[np.ndarray]):
        self.at = [np.zeros(1, np.uint64), *contexts]
        self.start = np.cumsum([0, *map(len, self.at)])

    def depths(self, codes: np.ndarray) -> np.ndarray:
        """How many bytes of context name each code's unit: one more than its longest context in the trunk."""
        out = np.ones(len(codes), np.int64)
        live = np.arange(len(codes))
        for d, own in enumerate(self.at[1:], 1):
            if not len(own) or not len(live):
                break
            c = _context(codes[live], d)
            i = np.searchsorted(own, c)
            i[i == len(own)] = 0
            live = live[own[i] == c]
            out[live] = d + 1
        return out

    def groups(self, codes: np.ndarray, depths: np.ndarray, groups: int) -> np.ndarray:
        unit = codes >> (8 * (DEPTH + 1 - depths)).astype(np.uint64)
        return mix(unit * np.uint64(8) + depths.astype(np.uint64)) % np.uint64(groups)

    def parents(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Numbers of the contexts that units of ``depth`` bytes hang on; ``keys``: context of the unit and a byte."""
        return self.start[depth - 1] + np.searchsorted(self.at[depth - 1], keys >> np.uint64(16))


def _weights(rows: np.ndarray, least_gram: int) -> np.ndarray:
    return 1 + np.where(rows["n"] < least_gram, rows["n"], 0).astype(np.int64)


def _trunk(merged: DataFrame, least_gram: int) -> Trunk:
    """The contexts that weigh more than a unit may. A hash deals n-grams evenly, so that a heavy one shows in many groups;
    one that none of them names is not split, which only concerns the size of a unit."""
    grams = merged.filter(F.col("kind") == GRAMS).select("data")

    def weigh(batches):
        for batch in batches:
            yield _batch([(int(_weights(np.frombuffer(d, _COUNT), least_gram).sum()),) for d in batch.column(0).to_pylist()], ("w",), (pa.int64(),))

    total = grams.mapInArrow(weigh, "w long").agg(F.sum("w").alias("w")).first()["w"] or 0
    most = max(UNIT_WEIGHT, total >> TRUNK_BITS)

    def run(batches):
        for batch in batches:
            out = []
            for d in batch.column(0).to_pylist():
                rows = np.frombuffer(d, _COUNT)
                w = _weights(rows, least_gram)
                least = max(1, most * int(w.sum()) // total // 8)
                for depth in range(1, DEPTH):
                    c = _context(rows["key"], depth)  # merged keys are in order
                    at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                    sums = np.add.reduceat(w, at)
                    out += [(depth, int(x), int(m)) for x, m in zip(c[at[sums >= least]], sums[sums >= least], strict=True)]
            yield _batch(out, ("depth", "context", "w"), (pa.int32(), pa.int64(), pa.int64()))

    # at most DEPTH * 2 ** TRUNK_BITS rows
    rows = grams.mapInArrow(run, "depth int, context long, w long").groupBy("depth", "context").agg(F.sum("w").alias("w")).filter(F.col("w") >= most).collect()
    return Trunk([np.array(sorted(r["context"] for r in rows if r["depth"] == depth), np.uint64) for depth in range(1, DEPTH)])


def _placed(merged: DataFrame, trunk, groups: int) -> DataFrame:
    """(kind, g, data): the n-grams with their counts in order, each group the whole of its units."""

    def deal(batches):
        for batch in batches:
            for d in batch.column(0).to_pylist():
                rows = np.frombuffer(d, _COUNT)
                where = trunk.value.groups(rows["key"], trunk.value.depths(rows["key"]), groups)
                yield _batch(_dealt(GRAMS, rows, where))

    def join(batches):
        own: dict[int, list] = {}
        for batch in batches:
            for _, g, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(g, []).append(np.frombuffer(d, _COUNT))
        for g, parts in sorted(own.items()):
            rows = np.concatenate(parts)
            yield _batch([(GRAMS, g, rows[np.argsort(rows["key"])].tobytes())])
        trim()

    dealt = merged.filter(F.col("kind") == GRAMS).select("data").mapInArrow(deal, "kind int, g int, data binary")
    return cut(dealt.repartitionById(groups, "g").mapInArrow(join, "kind int, g int, data binary"))


def _units(keys: np.ndarray, trunk: Trunk):
    """(depth, places) of ``keys`` in order, in parts that hold whole units of one depth and about MIX_GRAMS n-grams."""
    depths = trunk.depths(keys)
    for depth in np.unique(depths).tolist():
        own = np.flatnonzero(depths == depth)
        unit = _context(keys[own], depth)
        start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        a = 0
        for b in [*start[1:].tolist(), len(own)]:
            if b - a >= MIX_GRAMS or b == len(own):
                yield depth, own[a:b]
                a = b


class _Mixer:
    """Whole units of one depth: ``codes`` in order, counts may be 0."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, trunk: Trunk):
        self.depth, self.trunk = depth, trunk
        self.keys, self.counts, self.up = {DEPTH: codes}, {DEPTH: counts.astype(np.float64)}, {}
        for d in range(DEPTH, depth, -1):
            k = self.keys[d]
            self.keys[d - 1], self.up[d] = np.unique((k >> np.uint64(16)) << np.uint64(8) | k & np.uint64(0xFF), return_inverse=True)
            self.counts[d - 1] = np.bincount(self.up[d], self.counts[d])

    def _level(self, b: int):
        """For bit ``b``: each depth's decision of every key, its parent decision, own and weighted probability, estimate
        of a one; and for the units the number of the context they hang on and the place in the byte tree."""
        at, first, own, kt = {}, {}, {}, {}
        for d in range(self.depth, DEPTH + 1):
            node = self.keys[d] >> np.uint64(8 - b)
            new = np.r_[True, node[1:] != node[:-1]]
            at[d], first[d] = np.cumsum(new) - 1, np.flatnonzero(new)
            bit = (self.keys[d] >> np.uint64(7 - b) & np.uint64(1)).astype(np.float64)
            n, n1 = np.bincount(at[d], self.counts[d]), np.bincount(at[d], self.counts[d] * bit)
            own[d], kt[d] = _log_kt(n - n1, n1), (n1 + 0.5) / (n + 1)
        parent = {d: at[d - 1][self.up[d][first[d]]] for d in range(self.depth + 1, DEPTH + 1)}
        weighted = {DEPTH: own[DEPTH]}
        for d in range(DEPTH - 1, self.depth - 1, -1):
            weighted[d] = np.logaddexp(own[d], np.bincount(parent[d + 1], weighted[d + 1], len(own[d]))) - np.log(2)
        low = self.keys[self.depth][first[self.depth]]
        place = self.trunk.parents(low, self.depth), (1 << b | (low & np.uint64(0xFF)) >> np.uint64(8 - b)).astype(np.int64)
        return at, parent, own, weighted, kt, place

    def add_to(self, below: dict[int, np.ndarray]) -> None:
        """Sums for the contexts that the units hang on: weighted probability of each decision, count of each byte."""
        k = self.keys[self.depth]
        number = self.trunk.parents(k, self.depth)
        for c in np.unique(number).tolist():
            if c not in below:
                below[c] = np.zeros((2, 256))
        own = {c: i for i, c in enumerate(np.unique(number).tolist())}
        sums = np.zeros((len(own), 2, 256))
        names = np.array(list(own))
        for b in range(8):
            *_, weighted, _, (parent, node) = self._level(b)
            np.add.at(sums, (np.searchsorted(names, parent), 0, node), weighted[self.depth])
        np.add.at(sums, (np.searchsorted(names, number), 1, (k & np.uint64(0xFF)).astype(np.int64)), self.counts[self.depth])
        for c, i in own.items():
            below[c] += sums[i]

    def logp(self, ahead: np.ndarray, above: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's byte after its context."""
        out = np.zeros(len(self.keys[DEPTH]))
        for b in range(8):
            at, parent, own, weighted, kt, place = self._level(b)
            left, p1 = ahead[place], above[place]
            for d in range(self.depth, DEPTH + 1):
                if d > self.depth:
                    left, p1 = left[parent[d]], p1[parent[d]]
                stay = _stay(own[d], weighted[d]) if d < DEPTH else 1.0
                p1 = p1 + left * stay * kt[d]
                left = left * (1 - stay)
            p1 = np.clip(p1, 1e-12, 1 - 1e-12)
            one = (self.keys[DEPTH] >> np.uint64(7 - b) & np.uint64(1)).astype(bool)
            out += np.where(one, np.log10(p1)[at[DEPTH]], np.log10(1 - p1)[at[DEPTH]])
        return out


def _above(placed: DataFrame, trunk) -> tuple[np.ndarray, np.ndarray]:
    """For every context of the trunk and decision: the weight left to longer contexts, and what it and the shorter ones
    give to the probability of a one. The driver gets one sum for each context of the trunk."""

    def sums(batches):
        for batch in batches:
            for g, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(d, _COUNT)
                below: dict[int, np.ndarray] = {}
                for depth, at in _units(rows["key"], trunk.value):
                    _Mixer(rows["key"][at], rows["n"][at], depth, trunk.value).add_to(below)
                out = []
                for c, (weighted, n) in below.items():
                    some = np.flatnonzero((weighted != 0) | (n != 0))
                    packed = np.empty(len(some), _SUM)
                    packed["place"], packed["below"], packed["n"] = some, weighted[some], n[some]
                    out.append((c, g, packed.tobytes()))
                yield _batch(out, ("c", "g", "data"))
        trim()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((2, 256))
        for d in pdf.sort_values("g")["data"]:
            part = np.frombuffer(d, _SUM)
            total[0][part["place"]] += part["below"]
            total[1][part["place"]] += part["n"]
        return pd.DataFrame({"c": [pdf["c"].iloc[0]], "data": [total.tobytes()]})

    t = trunk.value
    below, counts = np.zeros((t.start[-1], 256)), np.zeros((t.start[-1], 256))
    parts = placed.select("g", "data").mapInArrow(sums, "c int, g int, data binary")
    for r in parts.groupBy("c").applyInPandas(add, "c int, data binary").toLocalIterator():
        below[r["c"]], counts[r["c"]] = np.frombuffer(bytes(r["data"])).reshape(2, 256)
    spans = [np.arange(t.start[d], t.start[d + 1]) for d in range(len(t.at))]
    up = [t.start[d - 1] + np.searchsorted(t.at[d - 1], t.at[d] >> np.uint64(8)) if d else spans[0] for d in range(len(t.at))]
    for d in range(len(t.at) - 1, 0, -1):
        np.add.at(counts, up[d], counts[spans[d]])
    n0, n1 = np.zeros_like(below), np.zeros_like(below)  # by context and place in the byte tree
    for b in range(8):
        pairs = counts.reshape(len(counts), 1 << b, 2, -1).sum(3)
        n0[:, 1 << b : 2 << b], n1[:, 1 << b : 2 << b] = pairs[:, :, 0], pairs[:, :, 1]
    own = log_kt(n0, n1)
    kt = (n1 + 0.5) / (n0 + n1 + 1)
    weighted = np.zeros_like(below)
    for d in range(len(t.at) - 1, -1, -1):
        weighted[spans[d]] = np.logaddexp(own[spans[d]], below[spans[d]]) - np.log(2)
        if d:
            np.add.at(below, up[d], weighted[spans[d]])
    stay = _stay(own, weighted)
    ahead, above = np.ones_like(below), np.zeros_like(below)
    for d in range(len(t.at)):
        i = spans[d]
        if d:
            ahead[i], above[i] = ahead[up[d]], above[up[d]]
        above[i] += ahead[i] * stay[i] * kt[i]
        ahead[i] *= 1 - stay[i]
    return ahead, above


class Frequent:
    """Values of frequent keys behind a table of 2^22 places; a place that two share is searched."""

    BITS = 22

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        place = (mix(keys) >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.at = np.full(1 << self.BITS, -1, np.int32)
        self.at[place] = np.arange(len(keys))

    def look(self, h: np.ndarray) -> np.ndarray:
        """The value of each key; 0 for keys that are not frequent."""
        if not len(self.keys) or not len(h):
            return np.zeros(len(h), self.counts.dtype)
        i = self.at[(mix(h) >> np.uint64(64 - self.BITS)).astype(np.int64)]
        hit = (self.keys[i] == h) & (i >= 0)
        out = np.where(hit, self.counts[i], 0)
        odd = np.flatnonzero(~hit & (i >= 0))
        j = np.searchsorted(self.keys, h[odd])
        j[j == len(self.keys)] = 0
        out[odd] = np.where(self.keys[j] == h[odd], self.counts[j], 0)
        return out


def _names(ids: list, held: list, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """What rows are called between stages: the id (or, for null, a hash of the text) and a checksum. They come from the
    row's content, so that a task that runs again, on rows in another order, gives the same names; rows that are equal in
    id, text and fold share one and are counted."""
    import hashlib

    row, more = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint32)
    for i, (key, h, x) in enumerate(zip(ids, held, texts, strict=True)):
        raw = (x or "").encode("utf-8", "surrogatepass")
        row[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") if key is None else key & 0xFFFFFFFFFFFFFFFF
        more[i] = zlib.crc32(raw, (2 if key is None else 0) + bool(h))
    return row, more


_TEXT = np.dtype([("row", "<u8"), ("more", "<u4"), ("null", "?"), ("held", "?"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def _sums_by_row(ask: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of the values by row."""
    name = mix(ask["row"]) + ask["more"].astype(np.uint64)
    _, first, back = np.unique(name, return_index=True, return_inverse=True)
    return {"row": ask["row"][first].view(np.int64), "more": ask["more"][first]} | {k: np.bincount(back, v) for k, v in values.items()}


def score_texts(docs: DataFrame, fold=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    ``fold`` marks held-out rows; the others are learned from. Null and empty texts are an end token. Without training
    rows the base is 0 and every bit has probability one half. Rows are kept one for one, repeated and null ids too; an
    empty table gives an empty one; other columns are not read. Words are named by 64-bit hashes.
    """
    spark = docs.sparkSession
    fold = F.lit(False) if fold is None else fold
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), "text")
    train = picked.filter(~F.col("held_out"))
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    groups = min(MAX_GROUPS, max(MIN_GROUPS, int(chars // GROUP_CHARS)))
    merged = _gather(train, groups)
    facts = {r["kind"]: r for r in merged.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n_train, distinct = (facts[WORDS]["n"], facts[WORDS]["v"]) if WORDS in facts else (0, 0)
    least_gram = max(1, -(-(facts[GRAMS]["n"] if GRAMS in facts else 0) >> GRAM_BITS))
    trunk = spark.sparkContext.broadcast(_trunk(merged, least_gram))
    placed = _placed(merged, trunk, groups)
    sums = spark.sparkContext.broadcast(_above(placed, trunk))
    least = max(1, -(-n_train >> FREQUENT_BITS))

    def frequent(batches):
        for batch in batches:
            out = []
            for d in batch.column(0).to_pylist():
                rows = np.frombuffer(d, _COUNT)
                out.append((rows[rows["n"] >= least].tobytes(),))
            yield _batch(out, ("data",), (pa.binary(),))

    # at most 2 ** FREQUENT_BITS words
    top = [np.frombuffer(bytes(r["data"]), _COUNT) for r in merged.filter(F.col("kind") == WORDS).select("data").mapInArrow(frequent, "data binary").toLocalIterator()]
    top = np.sort(np.concatenate(top), order="key") if top else np.zeros(0, _COUNT)
    known_words = spark.sparkContext.broadcast((np.ascontiguousarray(top["key"]), top["n"].astype(np.int64)))

    def likely(batches):
        for batch in batches:
            for d in batch.column(0).to_pylist():
                rows = np.frombuffer(d, _COUNT)
                out = []
                for depth, at in _units(rows["key"], trunk.value):
                    n = rows["n"][at]
                    some = n >= least_gram
                    if some.any():
                        found = np.empty(int(some.sum()), _LOGP)
                        found["key"], found["logp"] = rows["key"][at[some]], _Mixer(rows["key"][at], n, depth, trunk.value).logp(*sums.value)[some]
                        out.append((found.tobytes(),))
                yield _batch(out, ("data",), (pa.binary(),))
        trim()

    # at most 2 ** GRAM_BITS n-grams
    near = [np.frombuffer(bytes(r["data"]), _LOGP) for r in placed.select("data").mapInArrow(likely, "data binary").toLocalIterator()]
    near = np.sort(np.concatenate(near), order="key") if near else np.zeros(0, _LOGP)
    known_grams = spark.sparkContext.broadcast((np.ascontiguousarray(near["key"]), np.ascontiguousarray(near["logp"])))
    whole = n_train + 0.5 * (distinct + 1)
    end_count = train.count()
    rare = least > 1

    def run(batches):
        table_ = Frequent(*known_words.value)
        grams_ = Frequent(*known_grams.value)
        asks: dict[int, list] = {ASKED: [], ASKED_GRAMS: []}

        def send():
            for kind, parts in asks.items():
                if parts:
                    asked = np.concatenate([p for p, _ in parts])
                    yield from _dealt(kind, asked, np.concatenate([g for _, g in parts]))
                    parts.clear()

        for batch in batches:
            for a, b, texts in pieces(batch.column(2), CHUNK):
                ids, held = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                h, first = _tokens(texts)
                c = table_.look(h)
                n = np.diff(first)
                logs = np.where(c > 0, np.log10((c + 0.5) / whole), 0.0)
                rows = np.zeros(b - a, _TEXT)
                rows["row"], rows["more"] = _names(ids, held, texts)
                rows["null"] = [x is None for x in ids]
                rows["held"] = held
                rows["n"] = n + 1
                total = np.concatenate([[0], np.cumsum(c > 0)])
                rows["known"] = total[first[1:]] - total[first[:-1]] + (end_count > 0)
                logs = np.concatenate([[0.0], np.cumsum(logs)])
                rows["base"] = logs[first[1:]] - logs[first[:-1]] + np.log10((end_count + 0.5) / whole)

                def ask(kind, keys, of, where, rows=rows):
                    asked = np.empty(len(keys), _ASK)
                    asked["key"], asked["row"], asked["more"] = keys, rows["row"][of], rows["more"][of]
                    asks[kind].append((asked, where))

                code, length = _codes(texts)
                lp = grams_.look(code)  # below 0 where it is known
                sums_ = np.concatenate([[0.0], np.cumsum(lp)])
                till = np.cumsum(length)
                rows["score"] = sums_[till] - sums_[till - length]
                open_ = np.flatnonzero(lp == 0)
                keys = code[open_]
                ask(ASKED_GRAMS, keys, np.repeat(np.arange(b - a), length)[open_], trunk.value.groups(keys, trunk.value.depths(keys), groups))
                if not rare:  # every training word is among the frequent ones
                    rows["base"] += (rows["n"] - rows["known"]) * np.log10(0.5 / whole)
                else:
                    open_ = np.flatnonzero(c == 0)
                    ask(ASKED, h[open_], np.repeat(np.arange(b - a), n)[open_], mix(h[open_]) % np.uint64(groups))
                out = [*_dealt(TEXTS, rows, mix(rows["row"]) % np.uint64(groups))]
                if sum(len(p) for parts in asks.values() for p, _ in parts) > ASK:
                    out += send()
                yield _batch(out)
        yield _batch([*send()])

    def logp_of(ask: np.ndarray, have: np.ndarray) -> np.ndarray:
        # asked n-grams are mixed with count 0 where they were not seen
        keys, back = np.unique(ask["key"], return_inverse=True)
        new = np.setdiff1d(keys, have["key"], assume_unique=True)
        all_ = np.concatenate([have, _packed(new, 0)])
        all_ = all_[np.argsort(all_["key"])]
        logp = np.zeros(len(keys))
        for depth, at in _units(all_["key"], trunk.value):
            own = all_["key"][at]
            i = np.searchsorted(keys, own)
            i[i == len(keys)] = 0
            hit = keys[i] == own
            if hit.any():
                logp[i[hit]] = _Mixer(own, all_["n"][at], depth, trunk.value).logp(*sums.value)[hit]
        return logp[back]

    def count_of(ask: np.ndarray, have: np.ndarray) -> np.ndarray:
        if not len(have):
            return np.zeros(len(ask), np.int64)
        i = np.searchsorted(have["key"], ask["key"])
        i[i == len(have)] = 0
        return np.where(have["key"][i] == ask["key"], have["n"][i].astype(np.int64), 0)

    columns = {"row": np.int64, "more": np.int64, "known": np.int64, "base": np.float64, "score": np.float64, "m": np.int64, "missing": np.bool_, "held_out": np.bool_, "n_tokens": np.int64}

    def answer(batches):
        """Sums by row. A group's counts come before its questions, which are answered a bounded number at a time."""

        def frame(**values):
            n = len(values["row"])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(values.get(c, np.zeros(n, t)), t)) for c, t in columns.items()], list(columns))

        def settle():
            if parts[ASKED_GRAMS]:
                ask = np.concatenate(parts[ASKED_GRAMS])
                yield frame(**_sums_by_row(ask, score=logp_of(ask, have[GRAMS])))
            if parts[ASKED]:
                ask = np.concatenate(parts[ASKED])
                c = count_of(ask, have[WORDS])
                yield frame(**_sums_by_row(ask, known=c > 0, base=np.log10((c + 0.5) / whole)))
            if parts[TEXTS]:
                t = np.concatenate(parts[TEXTS])
                yield frame(row=t["row"].view(np.int64), more=t["more"], known=t["known"], base=t["base"], score=t["score"], m=np.ones(len(t), np.int64), missing=t["null"], held_out=t["held"], n_tokens=t["n"])
            for x in parts.values():
                x.clear()

        now, size = None, 0
        have: dict[int, np.ndarray] = {}
        parts: dict[int, list] = {ASKED: [], TEXTS: [], ASKED_GRAMS: []}
        for batch in batches:
            for kind, g, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now or size > ASK:
                    yield from settle()
                    size = 0
                if g != now:
                    now, have = g, {WORDS: np.zeros(0, _COUNT), GRAMS: np.zeros(0, _COUNT)}
                if kind in have:
                    have[kind] = np.frombuffer(d, _COUNT)
                else:
                    parts[kind].append(np.frombuffer(d, _TEXT if kind == TEXTS else _ASK))
                    size += len(parts[kind][-1])
        yield from settle()
        trim()

    asked = picked.mapInArrow(run, "kind int, g int, data binary")
    counts = placed if not rare else placed.union(merged.filter(F.col("kind") == WORDS).select("kind", "g", "data"))
    dealt = asked.union(counts).repartitionById(groups, "g").sortWithinPartitions("g", "kind")
    parts = dealt.mapInArrow(answer, "row long, more long, known long, base double, score double, m long, missing boolean, held_out boolean, n_tokens long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = parts.groupBy("row", "more").agg(F.max("missing").alias("missing"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("m").alias("m"), total("known").alias("known"), total("base").alias("base"), total("score").alias("score"))
    # equal rows were summed; there are as many of each as came in
    several = F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / 4096))
    out = out.withColumn("_k", F.explode(several)).withColumn("_j", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(4096), F.col("m") - 4096 * F.col("_k")).cast("int"))))
    return out.select(
        F.when(~F.col("missing"), F.col("row")).alias("doc_id"), "held_out", "n_tokens", F.floor(F.col("known") / F.col("m")).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("m")).alias("base_score"), (F.col("score") / F.col("m")).alias("score"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)
