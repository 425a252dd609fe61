"""Quality rules and robust multivariate outliers.

Each text gets a vector of transformed statistics. For every language and source, for every language, and for all rows the
minimum covariance determinant is sought from three deterministic starts around medians and absolute deviations
(independent statistics, covariances of tanh-transformed ones, spatial signs) by concentration steps: take the ``SHARE`` of
rows nearest by Mahalanobis distance, estimate mean and covariance from them, and again until no determinant falls any
more; the start that ends in the smallest is kept. Every step is an aggregation over all rows with a partial sum in each
task, so a group of any size is never gathered. A group's estimate is drawn towards that of its language, and this one
towards that of all rows, as if ``PRIOR`` rows had come from there, so that small groups need no rule of their own. A row
further than the chi-square cut-off is rejected.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, cut, free, mix, pieces, table, words

MIN_WORDS = 50
#: A text fails when more than this share (in %) of its words lie in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
SHARE = 0.75
#: Steps end when no logarithm of a determinant falls by more than this, or after so many.
SETTLED = 0.01
MOST_STEPS = 20
#: Decimals of the logarithm of a distance by which rows are taken together.
DECIMALS = 2
#: Rows that the estimate of the wider group counts for.
PRIOR = 50
#: Least standard deviation of each transformed statistic: what chance alone gives in a text of about MIN_WORDS words and
#: 25 lines (1 / (2 sqrt(n)) for the root of a share of n), so that a constant one does not make every change an outlier.
FLOOR = (0.06, 0.03, 0.1, 0.08, 0.03)
#: Chance that a normal vector is rejected.
TAIL = 0.001
#: Parameters of at most so many groups are broadcast; more are joined.
BROADCAST_GROUPS = 50_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("v_word_length", "v_symbols", "v_dup_lines", "v_repeats", "v_upper")
P = len(VECTOR)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = " \t\n\x0b\x0c\r"


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The base counts and the vector of each text."""
    h, starts, ends, first, data = words(texts, lower=False)
    m = len(texts)
    n = np.diff(first)
    off = np.concatenate([[0], np.cumsum([len((x or "").encode("utf-8", "surrogatepass")) + 1 for x in texts])]).astype(np.int64)
    lead = (data & 0xC0) != 0x80
    chars = _per_text(lead & ~IS_SPACE[data], off)
    symbols = _per_text(_SYMBOL[data], off)
    upper = _per_text((data >= 65) & (data <= 90), off)
    lower = _per_text((data >= 97) & (data <= 122), off)
    dup_lines, lines = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i, x in enumerate(texts):
        if x:
            parts = [y for y in x.split("\n") if y.strip(_SPACES)]
            lines[i] = len(parts)
            dup_lines[i] = len(parts) - len(set(parts))
    repeats = np.zeros(m, np.int64)
    count = np.maximum(n - 2, 0)
    if total := int(count.sum()):
        doc = np.repeat(np.arange(m), count)
        at = np.arange(total) - (np.cumsum(count) - count)[doc] + first[:-1][doc]
        with np.errstate(over="ignore"):
            key = mix(mix(mix(h[at] + doc.astype(np.uint64)) ^ h[at + 1]) * np.uint64(3) ^ h[at + 2])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(total, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(h) + 1, bool)
        for j in range(3):
            hit[at[twice] + j] = True
        repeats = _per_text(hit[:-1], first)
    some = np.maximum(n, 1)
    return {
        "n_words": n.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats,
        "v_word_length": np.log1p(chars / some), "v_symbols": np.sqrt(symbols / np.maximum(chars, 1)), "v_dup_lines": np.sqrt(dup_lines / np.maximum(lines, 1)),
        "v_repeats": np.sqrt(repeats / some), "v_upper": np.sqrt(upper / np.maximum(upper + lower, 1)),
    }


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and a struct ``<prefix>stats`` with the base counts and the vector of each row's text."""
    inner = T.StructType([T.StructField(c, T.LongType()) for c in BASE] + [T.StructField(c, T.DoubleType()) for c in VECTOR])
    kind = pa.struct([(c, pa.int64()) for c in BASE] + [(c, pa.float64()) for c in VECTOR])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b, texts in pieces(batch.column(at)):
                found = measure(texts)
                part = batch.slice(a, b - a)
                stats = pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in kind], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*part.columns, stats], names=[*part.schema.names, f"{prefix}stats"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(f"{prefix}stats", inner)]))


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance; ``mean`` and the upper triangle ``inv`` are columns of the row."""
    d = [x[i] - F.get("mean", F.lit(i)) for i in range(P)]
    terms, k = [], 0
    for i in range(P):
        for j in range(i, P):
            terms.append(F.get("inv", F.lit(k)) * d[i] * d[j] * (1 if i == j else 2))
            k += 1
    return sum(terms[1:], terms[0])


def chi2_quantile(q: float, dof: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(q)
    a = 2 / (9 * dof)
    return dof * (1 - a + z * math.sqrt(a)) ** 3


@lru_cache(maxsize=1)
def _consistency() -> float:
    """What the covariance of the nearest SHARE of normal rows is short of: SHARE / P(chi2 with P + 2 degrees < cut)."""
    cut_at = chi2_quantile(SHARE, P)
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(max(mid, 1e-12), P + 2) < cut_at else (lo, mid)
    return SHARE / lo


KEYS = ["level", "g_lang", "g_source"]


def _levels(stats: DataFrame) -> DataFrame:
    """Each row once for its language and source, once for its language, once for all. A null key is a group."""
    groups = F.array(
        F.struct(F.lit(0).alias("level"), F.col("k_lang").alias("g_lang"), F.col("k_source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("k_lang").alias("g_lang"), F.lit("").alias("g_source")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("g_lang"), F.lit("").alias("g_source")),
    )
    return stats.withColumn("_g", F.explode(groups)).select("_g.*", *VECTOR)


def group_key(column: str | None) -> Column:
    """The key as text: null is ``0``, any value ``1`` and itself."""
    if column is None:
        return F.lit("0")
    return F.when(F.col(f"`{column}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{column}`").cast("string")))


_UPPER = np.triu_indices(P)
_PAIRS = list(zip(*(x.tolist() for x in _UPPER), strict=True))
_NUMBERS = "array<double>"


def _square(upper) -> np.ndarray:
    out = np.zeros((P, P))
    out[_UPPER] = upper
    return out + out.T - np.diag(out.diagonal())


def starts(rows: float, middle: np.ndarray, spread: np.ndarray, sums: np.ndarray, products: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
    """Covariances to start from: independent statistics, and the correlations of tanh-transformed statistics and of
    spatial signs, all scaled by the absolute deviations."""
    scale = np.sqrt(np.square(1.4826 * spread) + np.square(FLOOR))
    mean = sums / rows
    out = [np.eye(P)]
    for cov in (_square(products / rows) - np.outer(mean, mean), _square(signs / rows)):
        cov = cov + np.eye(P) * 1e-3
        d = np.sqrt(cov.diagonal())
        out.append(cov / np.outer(d, d))
    return [np.outer(scale, scale) * x for x in out]


def concentrated(distance: np.ndarray, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of the least distances that hold SHARE of the rows; equal distances go together."""
    order = np.argsort(distance)
    total = np.cumsum(n[order])
    near = order[: int(np.searchsorted(total, SHARE * total[-1])) + 1]
    h = n[near].sum()
    mean = sums[near].sum(0) / h
    return int(h), mean, (_square(products[near].sum(0) / h) - np.outer(mean, mean)) * _consistency() + np.diag(np.square(FLOOR))


def drawn(rows: float, mean: np.ndarray, cov: np.ndarray, wide_mean: np.ndarray, wide_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate of a group as if PRIOR more rows had come from the wider one."""
    w = rows / (rows + PRIOR)
    gap = mean - wide_mean
    return w * mean + (1 - w) * wide_mean, w * cov + (1 - w) * wide_cov + w * (1 - w) * np.outer(gap, gap)


_PARAMS = f"level int, g_lang string, g_source string, start int, rows long, n long, logdet double, mean {_NUMBERS}, cov {_NUMBERS}, inv {_NUMBERS}"


def _param(key, start, rows, n, mean, cov):
    return (*key, start, rows, n, float(np.linalg.slogdet(cov)[1]), mean.tolist(), cov[_UPPER].tolist(), np.linalg.inv(cov)[_UPPER].tolist())


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[f.split()[0] for f in _PARAMS.split(", ")])


def _begin(rows: DataFrame) -> DataFrame:
    """The starts of every group."""
    middle = cut(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"), *[F.percentile(F.round(v, 3), F.lit(0.5)).alias(f"m_{v}") for v in VECTOR]))
    near = rows.join(_small(middle), KEYS)
    spread = cut(near.groupBy(*KEYS).agg(F.first("rows").alias("rows"), *[F.first(f"m_{v}").alias(f"m_{v}") for v in VECTOR], *[F.percentile(F.round(F.abs(F.col(v) - F.col(f"m_{v}")), 3), F.lit(0.5)).alias(f"s_{v}") for v in VECTOR]))
    scaled = rows.join(_small(spread), KEYS).withColumns({f"z{i}": (F.col(v) - F.col(f"m_{v}")) / F.sqrt(F.pow(1.4826 * F.col(f"s_{v}"), 2) + FLOOR[i] ** 2) for i, v in enumerate(VECTOR)})
    z = [F.col(f"z{i}") for i in range(P)]
    length = sum((c * c for c in z[1:]), z[0] * z[0])
    scaled = scaled.withColumn("length", F.greatest(length, F.lit(1e-12)))
    t = [F.tanh(c) for c in z]
    sums = scaled.groupBy(*KEYS).agg(
        F.first("rows").alias("rows"), F.array(*[F.first(f"m_{v}") for v in VECTOR]).alias("middle"), F.array(*[F.first(f"s_{v}") for v in VECTOR]).alias("spread"),
        F.array(*[F.sum(c) for c in t]).alias("sums"), F.array(*[F.sum(t[i] * t[j]) for i, j in _PAIRS]).alias("products"), F.array(*[F.sum(z[i] * z[j] / F.col("length")) for i, j in _PAIRS]).alias("signs"),
    )

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                covs = starts(r.rows, *(np.array(x) for x in (r.middle, r.spread, r.sums, r.products, r.signs)))
                out += [_param((r.level, r.g_lang, r.g_source), k, r.rows, r.rows, np.array(r.middle), cov) for k, cov in enumerate(covs)]
            yield _frame(out).assign(logdet=float("inf"))

    return cut(sums.mapInPandas(run, _PARAMS))


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step from every start: moments of every step of the distance, then of the nearest ones."""
    x = [F.col(v) for v in VECTOR]
    far = rows.join(_small(params.select(*KEYS, "start", "rows", "mean", "inv")), KEYS).withColumn("d", F.round(F.log1p(F.greatest(_distance(x), F.lit(0.0))), DECIMALS))
    bins = far.groupBy(*KEYS, "start", "d").agg(F.first("rows").alias("rows"), F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("sums"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("products"))

    def near(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, mean, cov = concentrated(pdf["d"].to_numpy(), pdf["n"].to_numpy(), np.stack(pdf["sums"]), np.stack(pdf["products"]))
        return _frame([_param(key[:3], int(key[3]), int(pdf["rows"].iloc[0]), h, mean, cov)])

    # a group has as many bins as there are distances of so many decimals, however many rows it has
    return bins.groupBy(*KEYS, "start").applyInPandas(near, _PARAMS)


def fit(stats: DataFrame) -> DataFrame:
    """Estimates (k_lang, k_source, rows, mean, inv) of every language and source from rows (k_lang, k_source, vector) of
    texts that passed the base rules. Every count and moment is over all rows. An empty table gives an empty one."""
    rows = _levels(stats)
    open_, settled = _begin(rows), []
    for _ in range(MOST_STEPS):
        # only starts that still fall go on
        following = _step(rows, open_)
        before = open_.select(*KEYS, "start", F.col("logdet").alias("before"))
        judged = cut(following.join(before, [*KEYS, "start"]).withColumn("falls", F.col("before") - F.col("logdet") > SETTLED).drop("before"))
        settled.append(judged.filter(~F.col("falls")).drop("falls"))
        open_ = judged.filter("falls").drop("falls")
        if not open_.limit(1).count():
            break
    params = reduce(DataFrame.union, [*settled, open_])
    best = params.groupBy(*KEYS).agg(F.min_by(F.struct("rows", "n", "mean", "cov"), F.struct("logdet", "start")).alias("b")).select(*KEYS, "b.*")
    best = cut(best)
    top = best.filter("level = 2").first()  # one row
    if top is None:
        return best.select(F.col("g_lang").alias("k_lang"), F.col("g_source").alias("k_source"), "rows", "mean", F.col("cov").alias("inv"))
    wide = np.array(top["mean"]), _square(top["cov"])
    lang = best.filter("level = 1").select("g_lang", F.struct("n", "mean", "cov").alias("l"))
    both = best.filter("level = 0").join(_small(lang), "g_lang").select("g_lang", "g_source", "rows", "n", "mean", "cov", F.col("l.n").alias("ln"), F.col("l.mean").alias("lmean"), F.col("l.cov").alias("lcov"))

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                mean, cov = drawn(r.n, np.array(r.mean), _square(r.cov), *drawn(r.ln, np.array(r.lmean), _square(r.lcov), *wide))
                out.append((r.g_lang, r.g_source, r.rows, mean.tolist(), np.linalg.inv(cov)[_UPPER].tolist()))
            yield pd.DataFrame(out, columns=["k_lang", "k_source", "rows", "mean", "inv"])

    free(stats.sparkSession)
    return cut(both.mapInPandas(run, f"k_lang string, k_source string, rows long, mean {_NUMBERS}, inv {_NUMBERS}"))


def _small(params: DataFrame) -> DataFrame:
    return F.broadcast(params) if params.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else params


def judge(measured: DataFrame, params: DataFrame, stats: str = "stats") -> DataFrame:
    """``measured`` (with k_lang, k_source and the struct) with distance (null where no text of the group passed the base
    rules), base_failed and kept."""
    out = measured.join(_small(params.select("k_lang", "k_source", "mean", "inv")), ["k_lang", "k_source"], "left")
    out = out.withColumn("distance", _distance([F.col(f"{stats}.{v}") for v in VECTOR]))
    limit = chi2_quantile(1 - TAIL, P)
    return out.withColumn("base_failed", ~passing(stats)).withColumn("kept", passing(stats) & (F.coalesce("distance", F.lit(0.0)) <= limit)).drop("mean", "inv")


def passing(column: str = "stats") -> Column:
    s = lambda c: F.col(f"{column}.{c}")
    return (s("n_words") >= MIN_WORDS) & (100 * s("n_repeat_words") <= MAX_REPEAT_PERCENT * s("n_words"))


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source") -> DataFrame:
    """(id, the five base counts, base_failed, kept, distance) for every row of ``docs``.

    Null and empty texts have no words and fail; a null language or source is a group of its own; repeated rows and ids
    stay; equal distances get equal verdicts, one on the cut-off is kept; an empty table gives an empty one; other columns
    are not read. A very long text is measured whole.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("_id"), group_key(lang_col).alias("k_lang"), group_key(source_col).alias("k_source"), F.col(f"`{text_col}`").alias("_text"))
    measured = cut(with_statistics(picked, "_text").drop("_text"))
    params = fit(measured.filter(passing()).select("k_lang", "k_source", "stats.*").select("k_lang", "k_source", *VECTOR))
    out = judge(measured, params)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"stats.{c}").alias(c) for c in BASE], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Estimates are made from all rows first; the second pass
    measures each text again beside its row, so that no text is shuffled. Rows are judged as in ``quality_table``, so null
    and empty texts go and repeated rows stay or go together; an empty table gives an empty one; columns of any name are
    kept as they are."""
    picked = docs.select(group_key(lang_col).alias("k_lang"), group_key(source_col).alias("k_source"), F.col(f"`{text_col}`").alias("_text"))
    stats = cut(with_statistics(picked, "_text").filter(passing()).select("k_lang", "k_source", "stats.*").select("k_lang", "k_source", *VECTOR))
    params = fit(stats)
    named = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] + [group_key(lang_col).alias("k_lang"), group_key(source_col).alias("k_source")])
    kept = judge(with_statistics(named, f"c{docs.columns.index(text_col)}"), params).filter("kept")
    return kept.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"))
