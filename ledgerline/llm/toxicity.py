"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first 4, 6 and 8 bytes. Filters of widths 1,
2 and 3 run over the embedded words; each filter's greatest response over the whole text feeds a logistic output. A
threshold is calibrated for each language that the text itself shows (by its function words), and the score is bent so
that the threshold comes to lie at ``CUT``. Training reads labelled rows only, all of them. What one shard holds is
trained on the driver, which gets hashed features; more is dealt out to shards that are each trained on an executor, and
after each epoch their parameters are averaged.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import LANGUAGE_WORDS as FUNCTION_WORDS
from .common import chunks, crc_mod, cut, drop_dir, eights, free, map_columns, mix, pieces, table, trim, words

#: About as many labelled rows and words are trained one after the other, by one process.
SHARD_ROWS = 10_000
SHARD_WORDS = 5_000_000
#: Passes over all labelled texts where there are several shards, each of which has more of them to learn from.
ROUNDS = 3
#: Up to so many labelled ids are broadcast; with more, texts are moved to them.
BROADCAST_IDS = 2_000_000
#: Embeddings that are averaged together.
BLOCK = 1024
#: Steps of the log odds by which scores are counted to find thresholds.
STEPS = 50
#: Parts that the sample falls into to calibrate each on a model of the others.
FOLDS = 3
#: Positive texts that the threshold of all languages counts for in a language's own.
PRIOR = 10
BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
CUT = 0.3
SEED = 20240501

_GAPS = np.ones(256, bool)
_GAPS[97:123] = False
_GAPS[65:91] = False
_GAPS[128:] = False
_FEATURES = 4


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the four buckets of each word, and the first word of each text."""
    parts = [_chunk_features(texts[a:b]) for a, b in chunks(texts)] or [_chunk_features([])]
    if len(parts) == 1:
        return parts[0]
    shift = np.cumsum([0] + [len(p[0]) for p in parts])
    first = np.concatenate([parts[0][2][:1], *[p[2][1:] + s for p, s in zip(parts, shift, strict=False)]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), first


def _chunk_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # accented capitals lie under one lead byte with their small letters
    h, starts, ends, first, data = words([x.lower() if x and not x.isascii() else x for x in texts], gaps=_GAPS)
    if not len(h):
        return h, np.zeros((0, _FEATURES), np.int32), first
    head, n = eights(data)[starts], ends - starts
    out = np.empty((len(h), _FEATURES), np.int32)
    with np.errstate(over="ignore"):
        out[:, 0] = h % np.uint64(BUCKETS)
        for j, k in enumerate((4, 6, 8), 1):
            mask = np.uint64((1 << (8 * k)) - 1)
            short = np.minimum(n, k)
            part = np.where(short < k, head & ((np.uint64(1) << (np.uint64(8) * np.minimum(short, 7).astype(np.uint64))) - np.uint64(1)), head & mask)
            out[:, j] = mix(part * np.uint64(2 * j + 1) + np.uint64(j)) % np.uint64(BUCKETS)
    return h, out, first


@lru_cache(maxsize=1)
def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    langs = sorted(FUNCTION_WORDS)
    own: dict[int, int] = {}
    for i, lang in enumerate(langs):
        for w in FUNCTION_WORDS[lang]:
            h = int(words([w], gaps=_GAPS)[0][0])
            own[h] = own.get(h, 0) | 1 << i
    keys = np.array(sorted(own), np.uint64)
    return keys, np.array([own[int(k)] for k in keys], np.int64)


def shown_language(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the number (from 1) of the language most of its function words belong to; 0 without any."""
    keys, bits = _function_hashes()
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    found = np.where(keys[at] == h, bits[at], 0)
    votes = np.stack([_sum(found >> i & 1, first) for i in range(len(FUNCTION_WORDS))], 1)
    return np.where(votes.max(1) > 0, votes.argmax(1) + 1, 0)


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[first[1:]] - total[first[:-1]]


#: A feature of fewer texts only teaches them by heart.
LEAST_TEXTS = 3


def texts_with(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many texts each bucket is in."""
    seen = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(first) - 1, 100):
        part = first[a : a + 101]
        doc = np.repeat(np.arange(len(part) - 1), np.diff(part)) * BUCKETS
        for j in range(_FEATURES):
            seen += np.bincount(np.unique(doc + features[part[0] : part[-1], j]) % BUCKETS, minlength=BUCKETS)
    return seen


class ConvNet:
    """Parameters as float32 arrays; ``pooled`` is shared by training and scoring."""

    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        self.emb = (g.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.filters = [(g.standard_normal((w, DIM, FILTERS)) * 0.5).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32)
        self.base = np.float32(-2.0)
        self.cuts = np.full(len(FUNCTION_WORDS) + 1, CUT)

    def pooled(self, which: np.ndarray, table: np.ndarray, first: np.ndarray, places: bool = False):
        """Greatest response of each filter in each text. ``which``: each word's row of ``table``, the embeddings.
        A text of fewer words than a filter is wide is padded with zeros; without words the pool is 0."""
        m = len(first) - 1
        n = np.diff(first)
        out = np.zeros((m, len(self.bias)), np.float32)
        spot = np.full((m, len(self.bias)), -1, np.int64) if places else None
        full = np.flatnonzero(n > 0)
        if not len(full):
            return out, spot
        last = np.repeat(first[1:], n)
        begins = first[:-1][full]
        for k, (w, weights) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            conv = (table @ weights[0])[which]
            for j in range(1, w):
                part = (table @ weights[j])[which]
                ok = np.arange(len(which) - j) + j < last[: len(which) - j] if j < len(which) else np.zeros(0, bool)
                if j < len(which):
                    conv[: len(which) - j] += part[j:] * ok[:, None]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best = np.maximum.reduceat(conv, begins, axis=0)
            out[full, cols] = best
            if places:
                doc = np.repeat(np.arange(len(full)), n[full])
                for f in range(FILTERS):
                    hit = np.flatnonzero(conv[:, f] == best[doc, f])
                    spot[full[doc[hit[::-1]]], k * FILTERS + f] = hit[::-1]
        return out, spot

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def embed(self, features: np.ndarray) -> np.ndarray:
        e = self.emb[features[:, 0]].copy()
        for j in range(1, _FEATURES):
            e += self.emb[features[:, j]]
        return e

    def score(self, texts: list[str | None]) -> np.ndarray:
        h, features, first = _features(texts)
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        pool, _ = self.pooled(which, self.embed(features[at]), first)
        raw = self.raw(pool)
        cut = self.cuts[shown_language(h, first)]
        return np.where(raw < cut, raw / cut * CUT, CUT + (raw - cut) / np.maximum(1 - cut, 1e-9) * (1 - CUT))

    def train(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, usable: np.ndarray | None = None, sums: list | None = None) -> list:
        """Adagrad over the logistic loss; only the windows that win a pool get gradients. ``features``: the buckets of all
        words, ``first``: the first word of each text (and the end). ``usable``: which buckets enough texts have, by default
        of these; ``sums``: Adagrad's of an earlier call, which are returned as they are now."""
        g = np.random.default_rng(seed)
        size = np.diff(first)
        usable = texts_with(features, first) >= LEAST_TEXTS if usable is None else usable
        self.emb[~usable] = 0
        *acc, base_acc = sums or self.no_sums()
        rate = 0.1
        for epoch in range(epochs):
            order = g.permutation(len(size))
            for a in range(0, len(order), 64):
                docs = order[a : a + 64]
                n = size[docs]
                f0 = np.concatenate([[0], np.cumsum(n)])
                idx = np.repeat(first[:-1][docs] - f0[:-1], n) + np.arange(f0[-1])
                feats = features[idx]
                emb = self.embed(feats)
                pool, spot = self.pooled(np.arange(len(idx)), emb, f0, places=True)
                act = np.maximum(pool + self.bias, 0)
                p = self.raw(pool)
                d = ((p - labels[docs]) * weights[docs] / len(docs)).astype(np.float32)
                g_out, g_base = act.T @ d, float(d.sum())
                d_pool = d[:, None] * self.out * (act > 0) * (spot >= 0)
                g_emb = np.zeros_like(emb)
                grads = []
                for k, w in enumerate(WIDTHS):
                    gw = np.zeros_like(self.filters[k])
                    for f in range(FILTERS):
                        c = k * FILTERS + f
                        rows = np.flatnonzero(d_pool[:, c])
                        for j in range(w):
                            at = spot[rows, c] + j
                            ok = at < f0[rows + 1]
                            gw[j, :, f] += emb[at[ok]].T @ d_pool[rows[ok], c]
                            np.add.at(g_emb, at[ok], d_pool[rows[ok], c][:, None] * self.filters[k][j, :, f])
                    grads.append(gw)
                touched = np.flatnonzero(np.any(g_emb != 0, axis=1))
                where = feats[touched].ravel()
                keys, back = np.unique(where, return_inverse=True)
                g_rows = np.zeros((len(keys), DIM), np.float32)
                np.add.at(g_rows, back, np.repeat(g_emb[touched], _FEATURES, axis=0))
                g_rows[~usable[keys]] = 0
                acc[0][keys] += g_rows**2
                self.emb[keys] -= rate * g_rows / np.sqrt(acc[0][keys])
                for k, gw in enumerate(grads):
                    acc[1 + k] += gw**2
                    self.filters[k] -= rate * 0.5 * gw / np.sqrt(acc[1 + k])
                acc[-2] += g_out**2
                self.out -= rate * 0.5 * g_out / np.sqrt(acc[-2])
                self.out[:] = np.maximum(self.out, 0.0)
                g_bias = d_pool.sum(0)
                acc[-1] += g_bias**2
                self.bias -= rate * 0.5 * g_bias / np.sqrt(acc[-1])
                base_acc += g_base**2
                self.base -= np.float32(rate * 0.5 * g_base / np.sqrt(base_acc))
        return [*acc, base_acc]

    def no_sums(self) -> list:
        return [*[np.full(x.shape, 1e-4, np.float32) for x in (self.emb, *self.filters, self.out, self.bias)], 1e-4]

    def probability(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Raw scores, a bounded number of words at a time."""
        out, a = [], 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(first, first[a] + 200_000)) - 1)
            part = features[first[a] : first[b]]
            out.append(self.raw(self.pooled(np.arange(len(part)), self.embed(part), first[a : b + 1] - first[a])[0]))
            a = b
        return np.concatenate(out) if out else np.zeros(0)

    def calibrate(self, raw: np.ndarray, lang: np.ndarray, labels: np.ndarray, weights: np.ndarray, texts: np.ndarray | None = None) -> None:
        """For each shown language the threshold of best weighted F1 on scores of texts that their model did not see,
        drawn towards that of all languages as if PRIOR positive texts had come from there. ``texts``: how many each score
        stands for, by default 1."""
        texts = np.ones(len(raw)) if texts is None else texts

        def best(rows: np.ndarray) -> float:
            order = rows[np.argsort(-raw[rows], kind="stable")]
            s, y, w = raw[order], labels[order], weights[order]
            hit, all_ = np.cumsum(y * w), np.cumsum(w)
            f1 = 2 * hit / (all_ + (y * w).sum())
            k = int(np.argmax(f1))
            low = s[k + 1] if k + 1 < len(s) else 0.0
            return float(np.clip((s[k] + low) / 2, 0.02, 0.98))

        odds = lambda p: np.log(p / (1 - p))
        if labels.sum():
            overall = best(np.arange(len(labels)))
            self.cuts[:] = overall
            for i in range(len(self.cuts)):
                rows = np.flatnonzero(lang == i)
                if n := (labels[rows] * texts[rows]).sum():
                    z = (n * odds(best(rows)) + PRIOR * odds(overall)) / (n + PRIOR)
                    self.cuts[i] = 1 / (1 + np.exp(-z))


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros((0, _FEATURES), np.uint16), first


def fitted(parts: list[np.ndarray], lang: np.ndarray, y: np.ndarray, weight: np.ndarray) -> ConvNet:
    """A net trained on all texts (their features), with thresholds from models that each leave out one of FOLDS parts."""
    fold = np.arange(len(parts)) % FOLDS
    raw = np.zeros(len(parts))
    for k in range(FOLDS):
        own, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and len(other) and y[own].min() < y[own].max():
            net = ConvNet()
            net.train(*_flat([parts[i] for i in own]), y[own], weight[own])
            raw[other] = net.probability(*_flat([parts[i] for i in other]))
    net = ConvNet()
    net.train(*_flat(parts), y, weight)
    net.calibrate(raw, lang, y, weight)
    return net


def _flat_state(net: ConvNet, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings with their sums, all other parameters with theirs) as two arrays of float64."""
    rest = [np.ravel(x).astype(np.float64) for x in (*net.filters, net.out, net.bias, net.base, *sums[1:])]
    return np.concatenate([net.emb, sums[0]], 1).astype(np.float64), np.concatenate(rest)


def _put_state(net: ConvNet, emb: np.ndarray, rest: np.ndarray) -> list:
    """The opposite: sets the net's parameters and returns the sums."""
    net.emb = emb[:, :DIM].astype(np.float32)
    shapes = [x.shape for x in (*net.filters, net.out, net.bias)]
    sizes = [int(np.prod(x)) for x in shapes] + [1]
    parts = np.split(rest, np.cumsum(sizes * 2)[:-1])
    n = len(shapes)
    arrays = lambda some: [p.reshape(x).astype(np.float32) for p, x in zip(some, shapes, strict=False)]
    *net.filters, net.out, net.bias = arrays(parts[:n])
    net.base = np.float32(parts[n][0])
    return [emb[:, DIM:].astype(np.float32), *arrays(parts[n + 1 :]), float(parts[-1][0])]


def _packed(group: pa.Table) -> pa.Table:
    """The rows of a shard as one row: distinct words' buckets, each word's place among them, and so on."""
    ids = group["doc_id"].to_numpy()
    at = np.unique(ids, return_index=True)[1]  # in order of ids, each once
    parts = [np.frombuffer(group["features"][int(i)].as_buffer(), "<u8") for i in at]
    vocabulary, which = np.unique(np.concatenate(parts), return_inverse=True)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    out = [vocabulary.astype("<u8"), which.astype("<i4"), first.astype("<i8"), group["y"].to_numpy()[at].astype("<i1"), group["lang"].to_numpy()[at].astype("<i1")]
    return pa.table([pa.array([group["shard"][0].as_py()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in out]], ["shard", *_SHARD])


_SHARD = ["vocabulary", "which", "first", "y", "lang"]


def _shards(batches):
    """(number, buckets of all words, first word of each text, labels, shown languages, folds) of every shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            v = {n: np.frombuffer(batch.column(k + 1)[i].as_buffer(), t) for k, (n, t) in enumerate(zip(_SHARD, ("<u8", "<i4", "<i8", "<i1", "<i1"), strict=True))}
            features = v["vocabulary"].view("<u2").reshape(-1, _FEATURES)[v["which"]]
            yield batch.column(0)[i].as_py(), features, v["first"], v["y"].astype(np.float64), v["lang"].astype(np.int64), np.arange(len(v["y"])) % FOLDS


def _rows_of(features: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts in their order, and the first word of each. One byte a word tells which go."""
    n = np.diff(first)
    taken = np.zeros(len(n), bool)
    taken[rows] = True
    trim()
    return features if taken.all() else features[np.repeat(taken, n)], np.concatenate([[0], np.cumsum(n[rows])])


def fitted_apart(packed: DataFrame) -> ConvNet:
    """As ``fitted``, with the texts in the shards of ``packed``: each epoch every shard trains the averaged net on its own
    rows, one after the other, and the nets' parameters and Adagrad sums are averaged in order of the shards, which makes
    the result independent of how they are dealt out. Models 0 to FOLDS - 1 leave out that part, the last one nothing.
    Thresholds come from counts of all scores in steps of their log odds."""
    spark = packed.sparkSession
    models, shards = FOLDS + 1, packed.count()

    def count(batches):
        for _, features, first, *_, fold in _shards(batches):
            seen = [texts_with(*_rows_of(features, first, np.flatnonzero(fold == k))) for k in range(FOLDS)]
            some = np.flatnonzero(sum(seen))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x[some]) for x in seen]], ["bucket", *[f"n{k}" for k in range(FOLDS)]])

    sums = packed.mapInArrow(count, "bucket long, " + ", ".join(f"n{k} long" for k in range(FOLDS))).groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(FOLDS)])
    seen = np.zeros((BUCKETS, FOLDS), np.int64)
    for r in sums.collect():
        seen[r["bucket"]] = [r[f"n{k}"] for k in range(FOLDS)]
    usable = [seen.sum(1) - (seen[:, k] if k < FOLDS else 0) >= LEAST_TEXTS for k in range(models)]
    nets = [ConvNet() for _ in range(models)]
    states = [_flat_state(net, net.no_sums()) for net in nets]

    def average(group: pa.Table) -> pa.Table:
        order = np.argsort(group["shard"].to_numpy(), kind="stable")
        total = sum(np.frombuffer(group["gap"][int(i)].as_buffer(), "<f4").astype(np.float64) for i in order)
        return pa.table([group["model"][:1], group["block"][:1], pa.array([(total / shards).tobytes()], pa.binary())], ["model", "block", "gap"])

    for epoch in range(ROUNDS):
        shared = spark.sparkContext.broadcast((usable, states))

        def train(batches, epoch=epoch, shared=shared):
            ok, start = shared.value
            for shard, features, first, y, _, fold in _shards(batches):
                for k in range(models):
                    net = ConvNet()
                    before = _put_state(net, *start[k])
                    rows = np.flatnonzero(fold != k)
                    after = net.train(*_rows_of(features, first, rows), y[rows], np.ones(len(rows)), 1, SEED + epoch * 1_000_003 + shard, ok[k], before)
                    emb, rest = (b - a for a, b in zip(start[k], _flat_state(net, after), strict=True))
                    gaps = [*np.split(emb, BUCKETS // BLOCK), rest]
                    n = len(gaps)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in gaps], pa.binary())], ["shard", "model", "block", "gap"])

        moved = packed.mapInArrow(train, "shard int, model int, block int, gap binary").groupBy("model", "block").applyInArrow(average, "model int, block int, gap binary")
        for r in moved.toLocalIterator():
            gap, (emb, rest) = np.frombuffer(bytes(r["gap"]), np.float64), states[r["model"]]
            if r["block"] < BUCKETS // BLOCK:
                emb[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += gap.reshape(BLOCK, -1)
            else:
                rest += gap
        del moved
        shared.destroy()
        free(spark)  # the shuffle of a round goes before the next one
    for net, state in zip(nets, states, strict=True):
        _put_state(net, *state)
    given = spark.sparkContext.broadcast(nets[:FOLDS])

    def judge(batches):
        for _, features, first, y, lang, fold in _shards(batches):
            raw = np.zeros(len(y))
            for k in range(FOLDS):
                rows = np.flatnonzero(fold == k)
                raw[rows] = given.value[k].probability(*_rows_of(features, first, rows))
            step = np.round(np.log(raw / (1 - raw)) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(y), pa.array(step)], ["lang", "y", "step"])

    scores = packed.mapInArrow(judge, "lang long, y double, step long").groupBy("lang", "y", "step").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "y", "step").collect()
    lang, y, step, n = (np.array([r[c] for r in scores]) for c in ("lang", "y", "step", "n"))
    given.destroy()
    nets[-1].calibrate(1 / (1 + np.exp(-step / STEPS)), lang, y, n.astype(np.float64), n)
    return nets[-1]


def fit(docs: DataFrame, labels: DataFrame, fold=None, label_col: str = "toxic", per_class: int | None = None, words_: int | None = None) -> ConvNet:
    """Train on all labelled ids of ``docs``; a caller may ask for a sample instead, of each class the ids of least hash, at
    most ``per_class`` of them and ``words_`` words in all. Rows with a null id, text or label teach nothing; an id labelled
    twice counts as 1 if any label is; an id that is repeated counts with the text of least hash. Without both classes, as
    with empty tables, all scores are 0. Of at most about SHARD_ROWS texts and SHARD_WORDS words the driver gets the
    features, 8 bytes a word; of more it gets averaged parameters and counts only."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    if fold is not None:
        marked = marked.filter(fold)
    marked = marked.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # about as many words as there are gaps between them
    there = rows.select("doc_id", F.xxhash64("text").alias("h"), (F.length("text") / 4 + 1).cast("long").alias("most")).groupBy("doc_id").agg(F.min(F.struct("h", "most")).alias("t"))
    known = cut(marked.filter(F.col("y").isin(0, 1)).join(there, "doc_id").select("doc_id", "y", "t.h", "t.most"))
    found = known.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("most").alias("most")).collect()
    counts = {r["y"]: r["n"] for r in found}
    picked, total, size = known, sum(counts.values()), sum(r["most"] for r in found)
    if per_class or words_:
        # at most 2 * per_class rows
        order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
        picked = picked.withColumn("at", F.row_number().over(order)).withColumn("till", F.sum("most").over(order))
        picked = picked.filter((F.col("at") <= (per_class or total)) & (F.col("till") - F.col("most") < (words_ or size)))
        total, size = 0, 0
    picked = picked.select("doc_id", "y", "h")
    net = ConvNet()
    if len(counts) < 2:
        net.out[:] = 0
        net.base = np.float32(-30)
        return net
    sample = rows.join(F.broadcast(picked) if total <= BROADCAST_IDS else picked, "doc_id").filter(F.xxhash64("text") == F.col("h")).select("doc_id", "y", "text").mapInArrow(_sampled, "doc_id long, y int, lang int, features binary")
    shards = max(-(-total // SHARD_ROWS), -(-size // SHARD_WORDS), 1)
    if shards > 1:
        packed = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_packed, "shard int, " + ", ".join(f"{n} binary" for n in _SHARD))
        packed = cut(packed)
        del sample
        free(docs.sparkSession)
        net = fitted_apart(packed)
        drop_dir(docs.sparkSession, packed)
        return net
    got = {r["doc_id"]: r for r in sample.collect()}
    got = [got[k] for k in sorted(got)]
    y = np.array([r["y"] for r in got], np.float64)
    # classes weigh as they do among all labelled rows
    weight = np.array([counts[int(v)] / max(1, (y == v).sum()) for v in y])
    parts = [np.frombuffer(bytes(r["features"]), "<u2").reshape(-1, _FEATURES) for r in got]
    net = fitted(parts, np.array([r["lang"] for r in got]), y, weight / weight.mean())
    del got, parts
    free(docs.sparkSession)
    return net


def _sampled(batches):
    """Rows (doc_id, y, text) as (doc_id, y, shown language, buckets of the words as 16-bit numbers)."""
    for batch in batches:
        for a, b, texts in pieces(batch.column(2)):
            h, features, first = _features(texts)
            packed = features.astype("<u2")
            out = [packed[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a), pa.array(shown_language(h, first).astype(np.int32)), pa.array(out, pa.binary())], ["doc_id", "y", "lang", "features"])


def score_documents(docs: DataFrame, net: ConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, predicted int) for every row, whole texts. Null and empty texts are scored as texts without
    words; repeated rows get equal scores, rows with a null id too; a score on the threshold is predicted; an empty table
    gives an empty one; other columns are not read."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(keys, texts):
        score = model.value.score(texts)
        return {id_col: keys, "score": score.tolist(), "predicted": (score >= CUT).astype(int).tolist()}

    return map_columns(docs, [id_col, text_col], run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, net: ConvNet, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with their columns, in one pass without a shuffle. Null and empty texts are
    scored as texts without words, repeated rows alike; an empty table gives an empty one; columns of any name are kept."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b, texts in pieces(batch.column(at)):
                keep = pa.array(model.value.score(texts) < CUT)
                yield batch.slice(a, b - a).filter(keep)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def held_out():
    return crc_mod("doc_id", 4) == 2


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"), fold=~held_out())
    out = score_documents(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
