"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte 2- and 3-grams of its letters, scaled to length 1. Each language is a few
centroids, found by spherical k-means over its texts; the language of the nearest centroid by cosine is the
prediction, and a text farther from it than nearly all texts it was made of is marked as rejected. Fitting reads a
bounded sample of labelled rows; whole texts are predicted.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, joined, map_columns, pieces, table

#: About so many texts of a language are read by fitting, or all if there are fewer: those whose hashed id is least.
SAMPLE_PER_LANGUAGE = 1000
CENTROIDS = 3
#: Limits of at most so many languages are broadcast; more are joined.
BROADCAST_LANGUAGES = 100_000
BITS = 12
STEPS = 10
#: Share of a centroid's own texts that lie beyond its rejection distance.
REJECT = 0.001
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile("[A-Za-z]")
_ROWS = 512


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed 2- and 3-grams over letters; anything else counts as a space. One row per text."""
    data, off = joined([x.lower() if x and not x.isascii() else x for x in texts])
    data = _LETTER[data]
    m = len(texts)
    row = np.repeat(np.arange(m, dtype=np.int64) << BITS, np.diff(off))
    wide = data.astype(np.uint32)
    pair = (wide[:-1] << 8) | wide[1:]
    out = np.zeros(m << BITS, np.int64)
    blank = data == 32
    # grams inside one text: the newline that ends each text is the last byte of its grams
    two = (pair * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    ok = ~(blank[:-1] & blank[1:])
    ok[off[1:-1] - 1] = False
    out += np.bincount((row[:-1] + two)[ok], minlength=m << BITS)
    if len(data) > 2:
        three = ((((pair[:-1] << 8) | wide[2:]) ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
        ok = ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:])
        for back in (1, 2):
            at = off[1:-1] - back
            ok[at[(at >= 0) & (at < len(ok))]] = False
        out += np.bincount((row[:-2] + three)[ok], minlength=m << BITS)
    return out.reshape(m, 1 << BITS)


class Centroids:
    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], limits: np.ndarray):
        self.idf, self.centres, self.langs, self.limits = idf, centres, langs, limits

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        v = np.log1p(term_counts(texts)).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for a in range(0, len(texts), _ROWS):
            part = texts[a : a + _ROWS]
            if not self.langs:
                langs += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                rejected += [True] * len(part)
                continue
            cos = self.vectors(part) @ self.centres.T
            best = cos.argmax(1)  # of equal centroids the first, languages in order of name
            near = np.clip(cos[np.arange(len(part)), best], 0, 1)
            for x, k, s in zip(part, best.tolist(), near.tolist(), strict=True):
                known = has_letter(x)
                langs.append(self.langs[k] if known else UNKNOWN)
                scores.append(s if known else 0.0)
                rejected.append(not known or s < self.limits[k])
        return langs, scores, rejected


def _kmeans(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from the mean's farthest vectors in turn; (centres, nearest)."""
    k = min(k, len(v))
    mean = v.mean(0)
    chosen = [int((v @ mean).argmax())]
    while len(chosen) < k:
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    centres = v[chosen]
    for _ in range(STEPS):
        near = (v @ centres.T).argmax(1)
        for i in range(k):
            if (near == i).any():
                c = v[near == i].mean(0)
                centres[i] = c / max(np.linalg.norm(c), 1e-9)
    return centres, (v @ centres.T).argmax(1)


def fit(docs: DataFrame, fold=None, per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Centroids:
    """Centroids from ``docs`` (doc_id, text, lang): about ``per_language`` texts of each language, by least hashed
    id, all if there are fewer. Rows without id, language or letters teach nothing; without any, every prediction is ``und``. Every language is
    learned: its centroids are made on the executors, and the driver gets those only."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if fold is not None:
        known = known.filter(fold)

    # ids are taken while their hash lies below a share that about per_language ids of the language have; counts are of
    # distinct ids, so that a language of few ids that are often repeated is learned too
    share = F.least(F.lit(1.0), per_language / F.approx_count_distinct("doc_id", 0.02))
    limits = cut(known.filter(F.col("doc_id").isNotNull()).groupBy("lang").agg(share.alias("share")))
    few = limits.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 31)) / (1 << 31)
    rows = known.join(F.broadcast(limits) if few else limits, "lang").filter(place < F.col("share")).select("doc_id", "text", "lang")
    # of rows that repeat an id, one
    counted = cut(rows.mapInArrow(_count_batches, "doc_id long, counts binary, lang string").groupBy("lang", "doc_id").agg(F.min("counts").alias("counts")))

    def dense(pdf: pd.DataFrame) -> np.ndarray:
        got = sorted(zip(pdf["doc_id"].tolist(), map(bytes, pdf["counts"]), strict=True))
        v = np.zeros((len(got), 1 << BITS), np.float32)
        for i, (_, x) in enumerate(got):
            pairs = np.frombuffer(x, "<u4").reshape(2, -1)
            v[i, pairs[0]] = np.log1p(pairs[1])
        return v

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "data": [(dense(pdf) > 0).mean(0).tobytes()]})

    # each language weighs the same in the document frequencies, however often it occurs
    total, n = np.zeros(1 << BITS), 0
    for r in counted.groupBy("lang").applyInPandas(shares, "lang string, data binary").orderBy("lang").toLocalIterator():
        total, n = total + np.frombuffer(bytes(r["data"])), n + 1
    if not n:
        return Centroids(np.zeros(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), [], np.zeros(0))
    idf = (np.log(1 / np.clip(total / n, 1e-3, 1)) + 0.1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        own = dense(pdf) * idf
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        c, near = _kmeans(own, k)
        cos = (own @ c.T)[np.arange(len(own)), near]
        out = [(pdf["lang"].iloc[0], i, c[i].astype(np.float32).tobytes(), float(np.quantile(cos[near == i], REJECT))) for i in range(len(c)) if (near == i).any()]
        return pd.DataFrame(out, columns=["lang", "i", "centre", "edge"])

    found = counted.groupBy("lang").applyInPandas(centroids, "lang string, i int, centre binary, edge double").collect()
    found.sort(key=lambda r: (r["lang"], r["i"]))
    centres = np.stack([np.frombuffer(bytes(r["centre"]), np.float32) for r in found])
    return Centroids(idf, centres, [r["lang"] for r in found], np.array([r["edge"] for r in found]))


def _count_batches(batches):
    import pyarrow as pa

    for batch in batches:
        for a, b, texts in pieces(batch.column(1)):
            out = []
            for i in range(0, len(texts), _ROWS):
                for row in term_counts(texts[i : i + _ROWS]):
                    at = np.flatnonzero(row)
                    out.append(np.concatenate([at, row[at]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(out, pa.binary()), batch.column(2).slice(a, b - a)], ["doc_id", "counts", "lang"])


def predict_languages(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred string, score double, rejected boolean) for every row, whole texts. The score is the cosine to
    the nearest centroid; of equally near ones the first language by name wins. A null text or one without a letter is
    ``und`` with score 0, rejected. Rows are kept one for one, repeated and null ids too; an empty table gives an empty one;
    other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys, texts):
        lang, score, rejected = shared.value.predict(texts)
        return {id_col: keys, "lang_pred": lang, "score": score, "rejected": rejected}

    return map_columns(docs, [id_col, text_col], run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    out = predict_languages(docs, fit(docs, fold=~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
