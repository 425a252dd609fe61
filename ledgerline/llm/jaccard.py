"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when ``100 * |A & B| >= 75 * |A | B|`` over their sets of 5-word shingles. Equal sets are one node.
First, the entries of the incidence matrix that can decide anything say which sets may link at all: with the shingles of
each set in one global order, rarest first, linked sets share one within the first ``n - ceil(0.75 n) + 1`` of each, and
the least common place bounds the overlap still possible from both sizes. The order comes from a count sketch over all
sets; it only has to be the same everywhere, so collisions cost speed, not links. Sets that may link, directly or over
others, form a cluster, and each cluster's overlaps are counted by the product of its part of the matrix with its
transpose; pairs below the bound from their sizes are discarded.

Columns (shingles) of few sets give their pairs at once. A column that many sets share is first compared with one
of them, and then only sets of different components are multiplied, block by block, with connecting edges as the output:
no column's pairs are written out, and none is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_dir, free, mix, pieces, shingles, table, trim, words
from .components import components

WORDS = 5
PERCENT = 75
SKETCH_BITS = 20
_BLOCKS = 64
#: Columns of at most so many sets give all their pairs that the size bounds let through.
FEW = 32
#: A longer one still gives its pairs while they are at most so many times its entries.
PAIRS_PER_ENTRY = 4
#: A column of more entries is long whatever they are; it passes through without being held.
LONG = 8192
#: Entries read before whole columns are worked on, and aimed at for a partition of them.
HOLD = 200_000
PARTITION_ENTRIES = 1_000_000
#: Sets, and bytes of sets, in a block of a long column; columns of a dense block.
BLOCK = 512
BLOCK_BYTES = 8_000_000
COLUMNS = 4096
#: Sets, and bytes of sets, of a cluster that is multiplied in one place; shingles of clusters worked on together.
CLUSTER = 1024
CLUSTER_BYTES = 32_000_000
CHECK_ENTRIES = 500_000
#: Ids of at most this many sets are broadcast (16 bytes each); more are joined.
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    h, _, _, first, _ = words(texts)
    s, at = shingles(h, first, k)
    return [np.unique(s[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of the set."""
    with np.errstate(over="ignore"):
        total = mix(s).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def least_overlap(a, b, percent: int = PERCENT):
    """The size-derived bound: linked sets of these sizes share at least so many."""
    return -(-percent * (a + b) // (100 + percent))


def _sets_and_sketch(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, node) and, from each task, its part of the sketch as (block, salt, counts)."""

    def run(batches):
        from pyspark import TaskContext

        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        seen: set[int] = set()
        ids, ns, nodes = [], [], []

        def rows(ids, ns, nodes, blocks, counts):
            m = len(ids)
            salt = TaskContext.get().partitionId()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(blocks, pa.int32()), pa.array([salt] * m, pa.int32()), pa.array(counts, pa.binary())], ["doc_id", "n", "node", "block", "salt", "counts"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, _, texts in pieces(batch.column(1)):
                new = []
                for i, s in enumerate(shingle_sets(texts, k), a):
                    node = node_of(s) if len(s) else None
                    ids.append(keys[i]), ns.append(len(s)), nodes.append(node)
                    if len(s) and node not in seen:
                        seen.add(node)
                        new.append(s)
                if new:
                    sketch += np.bincount((np.concatenate(new) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
            yield rows(ids, ns, nodes, [None] * len(ids), [None] * len(ids))
            ids, ns, nodes = [], [], []
        if seen:
            parts = sketch.astype("<u4").reshape(_BLOCKS, -1)
            yield rows([None] * _BLOCKS, [None] * _BLOCKS, [None] * _BLOCKS, list(range(_BLOCKS)), [p.tobytes() for p in parts])

    return docs.mapInArrow(run, "doc_id long, n long, node long, block int, salt int, counts binary")


def _summed(parts: DataFrame, salts: int) -> np.ndarray:
    """The sketch of all tasks; summed in two steps, so that no group holds more than about the root of their number."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // _BLOCKS, "<u4")
        for c in pdf["counts"]:
            part = np.frombuffer(c, "<u4")
            total = np.where(total > np.uint32(0xFFFFFFFF) - part, np.uint32(0xFFFFFFFF), total + part)
        return pdf.iloc[:1].assign(counts=[total.astype("<u4").tobytes()])

    one = parts.select("block", (F.col("salt") % salts).cast("int").alias("salt"), "counts").groupBy("block", "salt").applyInPandas(add, "block int, salt int, counts binary")
    two = one.groupBy("block").applyInPandas(add, "block int, salt int, counts binary")
    out = np.zeros((_BLOCKS, (1 << SKETCH_BITS) // _BLOCKS), np.uint32)
    for r in two.collect():  # 4 MB, whatever the input
        out[r["block"]] = np.frombuffer(bytes(r["counts"]), "<u4")
    return out.ravel()


_POST = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4"), ("rem", "<i4"), ("hot", "?")])
#: As rows; n is negative in columns that may be very frequent.
_POST_SCHEMA = "key long, node long, n int, rem int"


def _postings(docs: DataFrame, sketch, k: int, percent: int, hot_from: int) -> DataFrame:
    """The prefix entries of every set."""

    def run(batches):
        weights = sketch.value
        seen: set[int] = set()
        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            values = [rows["key"].view(np.int64), rows["node"], np.where(rows["hot"], -rows["n"], rows["n"]), rows["rem"]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], [f.split()[0] for f in _POST_SCHEMA.split(", ")])

        for batch in batches:
            for _, _, texts in pieces(batch.column(1)):
                for s in shingle_sets(texts, k):
                    n = len(s)
                    if not n or (node := node_of(s)) in seen:
                        continue
                    seen.add(node)
                    p = n - -(-percent * n // 100) + 1
                    w = weights[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                    first = np.argsort(w, kind="stable")[:p]
                    rows = np.empty(p, _POST)
                    rows["key"], rows["hot"] = s[first], w[first] >= hot_from
                    rows["node"], rows["n"] = node, n
                    rows["rem"] = n - np.arange(p)
                    held.append(rows)
                    size += p
                    if size > 250_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _POST_SCHEMA)


def _may_link(n1, r1, n2, r2, percent: int):
    """Can sets of these sizes link, if this is the first entry they share and so many are left from it on?"""
    return (np.minimum(r1, r2) >= least_overlap(n1, n2, percent)) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))


def _long_column(column: np.ndarray, percent: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The pairs of a column that may link, if they are few beside its entries, or None; and which entries have any."""
    partner = np.zeros(len(column), bool)
    pairs, total = [], 0
    n, rem = column["n"].astype(np.int64), column["rem"].astype(np.int64)
    for a in range(0, len(column), BLOCK):
        i, j = np.nonzero(_may_link(n[a : a + BLOCK, None], rem[a : a + BLOCK, None], n[None, :], rem[None, :], percent))
        ok = i + a < j
        i, j = i[ok] + a, j[ok]
        partner[i] = partner[j] = True
        total += len(i)
        if total <= PAIRS_PER_ENTRY * len(column):
            pairs.append(np.stack([column["node"][i], column["node"][j]], 1))
    if total > PAIRS_PER_ENTRY * len(column):
        return None, partner
    return np.concatenate(pairs), partner


def _short_pairs(rows: np.ndarray, start: np.ndarray, m: np.ndarray):
    """Places (i, j), i < j, of all pairs inside the columns of at most FEW entries, about a million at a time."""
    for size in range(2, FEW + 1):
        at = start[m == size]
        if len(at):
            i, j = np.triu_indices(size, 1)
            for part in np.array_split(at, max(1, len(at) * len(i) // 1_000_000)):
                yield (part[:, None] + i).ravel(), (part[:, None] + j).ravel()


_FOUND = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("rem", pa.int32())])


def _columns(percent: int):
    """What columns give, read in order: pairs (key null, a and b nodes) of short ones, entries (b null) of long ones. A
    column is held until its end unless it is long, whatever its length."""

    def entries(rows: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(rows["key"].view(np.int64).copy()), pa.array(rows["node"].copy()), pa.nulls(len(rows), pa.int64()), pa.array(rows["n"].copy()), pa.array(rows["rem"].copy())], schema=_FOUND)

    def settle(rows: np.ndarray):
        """Whole columns."""
        same = np.r_[False, (rows["key"][1:] == rows["key"][:-1]) & (rows["node"][1:] == rows["node"][:-1])]
        rows = rows[~same]
        start = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
        m = np.diff(np.r_[start, len(rows)])
        pairs, long = [], [rows[np.repeat(m > LONG, m) | rows["hot"]]]
        keep = ~rows["hot"][start] & (m <= LONG)
        start, m = start[keep], m[keep]
        for i, j in _short_pairs(rows, start, m):
            x, y = rows[i], rows[j]
            ok = _may_link(x["n"], x["rem"], y["n"], y["rem"], percent)
            pairs.append(np.stack([x["node"][ok], y["node"][ok]], 1))
        for a, size in zip(start[m > FEW].tolist(), m[m > FEW].tolist(), strict=True):
            column = rows[a : a + size]
            mine, partner = _long_column(column, percent)
            if mine is None:
                long.append(column[partner])
            elif len(mine):
                pairs.append(mine)
        if pairs and len(found := np.unique(np.concatenate(pairs), axis=0)):
            k = len(found)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(np.zeros(k, np.int32)), pa.array(np.zeros(k, np.int32))], schema=_FOUND)
        if sum(map(len, long)):
            yield entries(np.concatenate(long))

    def run(batches):
        held, size, running = [], 0, None  # running: the key of a long column whose head is gone
        for batch in batches:
            rows = np.empty(batch.num_rows, _POST)
            for i, name in enumerate(("key", "node", "n", "rem")):
                rows[name] = batch.column(i).to_numpy().astype(_POST[name])
            rows["hot"], rows["n"] = rows["n"] < 0, np.abs(rows["n"])
            held.append(rows)
            size += len(rows)
            if size < HOLD:
                continue
            rows = np.concatenate(held)
            if running is not None:
                head = rows["key"] == running
                if head.any():
                    yield entries(rows[head])
                    rows = rows[~head]
            last = int(np.flatnonzero(rows["key"] != rows["key"][-1])[-1]) + 1 if len(rows) and rows["key"][0] != rows["key"][-1] else 0
            if last:
                yield from settle(rows[:last])
            rest = rows[last:]
            if len(rest) > LONG:
                running = rest["key"][0]
                yield entries(rest)
                rest = rest[:0]
            held, size = [rest], len(rest)
        if size:
            rows = np.concatenate(held)
            if running is not None and (head := rows["key"] == running).any():
                yield entries(rows[head])
                rows = rows[~head]
            if len(rows):
                yield from settle(rows)
        trim()

    return run


def _candidate(x: str, y: str, percent: int):
    """``_may_link`` as a column over structs (n, rem)."""
    n1, n2, r1, r2 = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.rem"), F.col(f"{y}.rem")
    return (F.least(r1, r2) * (100 + percent) >= percent * (n1 + n2)) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))


def _links(overlap, n1, n2, percent: int):
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def product(clusters: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT):
    """Links between sets of the same cluster (an array that is in order): blocks (i, j, overlap) of places, i < j.

    The sparse product of the incidence matrix with its transpose: each column adds one to the count of every pair of its
    sets. Columns of few sets are added pair by pair, the others as blocks of a dense matrix for their cluster. Pairs
    whose sizes alone rule a link out are not counted."""
    n = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    with np.errstate(over="ignore"):
        key = mix(np.concatenate(sets) ^ ((clusters[row].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    m = np.diff(np.r_[start, len(key)])
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j in _short_pairs(row, start, m):
        i, j = row[i], row[j]
        ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        new, c = np.unique(i[ok] * len(sets) + j[ok], return_counts=True)
        both = np.concatenate([codes, new])
        codes, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, c]), len(codes)).astype(np.int64)
    i, j = codes // max(len(sets), 1), codes % max(len(sets), 1)
    long = m > FEW
    dense = np.unique(clusters[row[start[long]]])  # clusters with long columns
    plain = ~np.isin(clusters[i], dense)
    ok = plain & _links(counts, n[i], n[j], percent)
    yield i[ok], j[ok], counts[ok]
    column = np.repeat(np.arange(len(m)), m)
    wide = long[column]
    for c in dense.tolist():
        lo, hi = np.searchsorted(clusters, [c, c + 1])
        size = int(hi - lo)
        own = wide & (row >= lo) & (row < hi)
        r, (_, col) = row[own] - lo, np.unique(column[own], return_inverse=True)
        overlap = np.zeros((size, size), np.float32)
        width = int(col.max()) + 1
        for a in range(0, width, COLUMNS):
            inside = (col >= a) & (col < a + COLUMNS)
            part = np.zeros((size, min(COLUMNS, width - a)), np.float32)
            part[r[inside], col[inside] - a] = 1
            overlap += part @ part.T
        mine = (i >= lo) & (i < hi)
        overlap[i[mine] - lo, j[mine] - lo] += counts[mine]
        x, y = np.nonzero(np.triu(_links(overlap, n[lo:hi, None], n[None, lo:hi], percent), 1))
        yield x + lo, y + lo, overlap[x, y].astype(np.int64)


def _joined_up(size: int, links) -> np.ndarray:
    """The least place each place is connected with."""
    label = np.arange(size)
    links = [(i, j) for i, j, _ in links if len(i)]
    while True:
        before = label.copy()
        for i, j in links:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _in_clusters(percent: int):
    """Connections (a, b) between sets of the same cluster, from rows (component, node, shingles) in order of component.
    Each set but the first of its group is named once, with that first one."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def settle(rows):
            comp = np.array([r[0] for r in rows], np.int64)
            number = np.cumsum(np.r_[0, comp[1:] != comp[:-1]])
            node = np.array([r[1] for r in rows], np.int64)
            label = _joined_up(len(rows), product(number, [np.frombuffer(r[2], "<u8") for r in rows], percent))
            other = np.flatnonzero(label != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(node[label[other]]), pa.array(node[other])], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > CHECK_ENTRIES and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) // 8
        if held:
            yield settle(held)
        trim()

    return run


def _row_products(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, as rows of the product: the set a against all its b, a block of them at a time. A set
    with many partners has as many blocks as it takes."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    cells = cut(pairs.select("a", "b").join(degree, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).select("a", "b", "block"))
    heads = cells.select("a", "block").distinct().join(sets.select(F.col("node").alias("a"), "shingles"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "shingles")
    rest = cells.join(sets.select(F.col("node").alias("b"), "shingles"), "b").select("a", "block", "b", "shingles")
    placed = heads.union(rest).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))

    def run(batches):
        own = np.zeros(0, np.uint64)
        for batch in batches:
            keep = ([], [])
            for a, _, b, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(s, "<u8")
                if b is None:
                    own = s
                    continue
                at = np.searchsorted(own, s)
                at[at == len(own)] = 0
                if _links(int((own[at] == s).sum()), len(own), len(s), percent):
                    keep[0].append(a), keep[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep[0], pa.int64()), pa.array(keep[1], pa.int64())], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def _connections(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose components are those of all links among ``pairs`` (a, b, star). Pairs fall into clusters; one of at
    most ``CLUSTER`` sets and ``CLUSTER_BYTES`` is multiplied in one place, many to a task, so that each of its sets is
    sent once. In larger ones the pairs with a long column's first set come first, then those still apart."""
    member = components(pairs.select("a", "b"))
    size = sets.select("node", F.length("shingles").alias("bytes"))
    sizes = member.join(size, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    small = (F.col("size") <= CLUSTER) & (F.col("bytes") <= CLUSTER_BYTES)
    member = cut(member.join(sizes, "component").select("node", "component", small.alias("small"), "bytes"))
    few = member.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    home = member.filter("small").select("node", "component")
    rows = sets.join(F.broadcast(home) if few else home, "node").select("component", "node", "shingles")
    out = rows.repartition("component").sortWithinPartitions("component", "node").mapInArrow(_in_clusters(percent), "a long, b long")
    large = member.filter("not small").select(F.col("node").alias("a"))
    if not large.limit(1).count():
        return cut(out)
    far = cut(pairs.join(F.broadcast(large) if few else large, "a"))
    first = cut(_row_products(far.filter("star"), sets, percent))
    seen = components(first)
    side = lambda c: seen.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = far.filter("not star").join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    return cut(out.union(first).union(_row_products(rest.select("a", "b"), sets, percent)))


def _across(percent: int):
    """Connections between the sets of two blocks of a long column: for each set of the first block one set of every
    other component it links with. A dense block of the product, a stretch of columns at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rest", "node"]).sort_values("node")
        x, y = pdf[pdf["rest"]], pdf[~pdf["rest"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        left, right = ([np.frombuffer(s, "<u8") for s in part["shingles"]] for part in (x, y))
        vocab = np.unique(np.concatenate(left))

        def places(sets):
            flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.searchsorted(vocab, flat)
            at[at == len(vocab)] = 0
            ok = vocab[at] == flat
            return row[ok], at[ok]

        (r1, c1), (r2, c2) = places(left), places(right)
        overlap = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, len(vocab), COLUMNS):
            parts = []
            for r, c, size in ((r1, c1, len(left)), (r2, c2, len(right))):
                inside = (c >= a) & (c < a + COLUMNS)
                block = np.zeros((size, min(COLUMNS, len(vocab) - a)), np.float32)
                block[r[inside], c[inside] - a] = 1
                parts.append(block)
            overlap += parts[0] @ parts[1].T
        n1, n2 = np.array([len(s) for s in left]), np.array([len(s) for s in right])
        _, comp = np.unique(np.concatenate([x["component"], y["component"]]), return_inverse=True)
        own, other = comp[: len(x)], comp[len(x) :]
        i, j = np.nonzero(_links(overlap, n1[:, None], n2[None, :], percent) & (own[:, None] != other[None, :]))
        _, first = np.unique(i * (comp.max() + 1) + other[j], return_index=True)
        trim()
        return pd.DataFrame({"a": x["node"].to_numpy()[i[first]], "b": y["node"].to_numpy()[j[first]]})

    return run


def _still_apart(many: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Connections inside long columns between sets that are not yet one component, or None without such columns. The
    sets outside a column's largest component are compared with all of it, block by block; a block holds sets of one
    size band, as linked sets are of the same or of neighbouring ones. Ids are dealt, sets fetched once for each block."""
    # a very long text has entries in very many columns
    comps = F.broadcast(comps) if comps.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else comps
    apart = many.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = apart.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("several")).filter("several > 1").select("key", "main")
    if not main.limit(1).count():
        return None
    apart = cut(apart.join(main, "key").withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int")))
    rest = apart.filter("component <> main").select("key", "node", "n", "component", "band", F.lit(True).alias("rest"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    every = apart.select("key", "node", "n", "component", near.alias("band"), F.lit(False).alias("rest"))
    blocks = lambda c: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias(c)
    grid = cut(rest.groupBy("key", "band").agg(blocks("nr")).join(every.groupBy("key", "band").agg(blocks("na")), ["key", "band"]))
    place = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["key", "band", "i", "j", "rest", "node", "component"]
    x = rest.join(grid, ["key", "band"]).withColumn("i", place("nr")).withColumn("j", each("na")).select(cols)
    y = every.join(grid, ["key", "band"]).withColumn("j", place("na")).withColumn("i", each("nr")).select(cols)
    return x.union(y).join(sets, "node").groupBy("key", "band", "i", "j").applyInPandas(_across(percent), "a long, b long")


def linked_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(meta, comps) of ``docs`` (doc_id, text): meta has (doc_id, n, node) of every row, comps (node, component) of
    the sets that link with another one. Rows with a null id take no part."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    first = cut(_sets_and_sketch(docs, k))
    meta = first.filter("block is null").select("doc_id", "n", "node")
    parts = first.filter("block is not null")
    facts = meta.agg(F.sum("n").alias("total")).first()
    total = facts["total"] or 0
    tasks = parts.agg(F.countDistinct("salt").alias("t")).first()["t"]
    sketch = _summed(parts, max(1, int(tasks**0.5)))
    weights = spark.sparkContext.broadcast(sketch)
    entries = int(total * (1 - percent / 100))
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // PARTITION_ENTRIES)
    posted = _postings(docs, weights, k, percent, int(8 * sketch.mean() + 4096))
    # a column's entries lie together, but those of columns that may be very frequent are spread by set
    home = F.when(F.col("n") < 0, F.col("node")).otherwise(F.col("key"))
    found = cut(posted.repartition(deal, home).sortWithinPartitions("key", "node").mapInArrow(_columns(percent), "key long, a long, b long, n int, rem int"))
    free(spark)
    few = found.filter("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("star"))
    many = cut(found.filter("key is not null").select("key", F.col("a").alias("node"), "n", "rem").distinct())
    # each long column against the set that comes first in it
    pivot = cut(many.groupBy("key").agg(F.min(F.struct("node", "n", "rem")).alias("p")))
    star = many.withColumn("x", F.struct("n", "rem")).join(pivot, "key").filter("node <> p.node").filter(_candidate("x", "p", percent))
    pairs = cut(few.union(star.select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("star"))).groupBy("a", "b").agg(F.max("star").alias("star")))
    drop_dir(spark, pivot)
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many.select("node")).distinct()
    ids = cut(meta.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(involved, "node", "left_semi").select("doc_id"))
    few_ids = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = docs.join(F.broadcast(ids) if few_ids else ids, "doc_id", "left_semi")

    def sets_of(batches):
        for batch in batches:
            for _, _, texts in pieces(batch.column(1)):
                found = [(node_of(s), s.astype("<u8").tobytes()) for s in shingle_sets(texts, k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["node", "shingles"])

    sets = named.mapInArrow(sets_of, "node long, shingles binary")
    if meta.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])  # an id that is repeated names several rows
    sets = cut(sets)
    edges = _connections(pairs, sets, percent)
    free(spark)
    comps = components(edges)
    more = _still_apart(many, comps, sets, percent)
    if more is not None:
        comps = components(edges.union(cut(more)))
    for used in (found, many, pairs, ids, sets, edges):
        drop_dir(spark, used)
    weights.destroy()
    free(spark)
    return meta, comps


def _labelled(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(meta, named): meta as in ``linked_sets``, named (node, component) of every set."""
    meta, comps = linked_sets(docs, k, percent)
    nodes = meta.filter("node is not null").select("node").distinct()
    return meta, nodes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles long, component_id long) for every row of ``docs`` (doc_id, text).

    Words are runs without white space, A-Z lower-cased. A text of fewer than ``k`` words is one shingle; null, empty or
    blank texts have none, link with nothing and are their own component. A row with a null id gets a null component.
    Repeated rows and equal sets share a component; rows that repeat an id with other text are judged one by one. An
    empty table gives an empty one; other columns are not read. Sets are named by 64-bit hashes.
    """
    meta, named = _labelled(docs, k, percent)
    least = meta.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    members = named.join(least, "node")
    names = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = members.select("node", "component").join(names, "component").select("node", "component_id")
    out = meta.join(label, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = docs.filter("doc_id is null")
    if lost.limit(1).count():
        def count(batches):
            for batch in batches:
                n = [len(s) for s in shingle_sets(batch.column(0).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

        out = out.union(lost.select("text").mapInArrow(count, "doc_id long, n_shingles long, component_id long"))
    return out


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``: the one of least id.

    Rows without an id, and texts without words, link with nothing and stay. Where an id is repeated its rows are judged
    one by one: of rows with the same id and the same shingles one stays, by the hash of all its columns, the rest like
    any other document. An empty table gives an empty one; other columns of any name are kept. Texts are only moved for
    repeated ids, and for an anti join with more ids than can be broadcast.
    """
    meta, named = _labelled(docs, k, percent)
    counted = cut(meta.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.max("node").alias("node")))
    rows = meta.join(named, "node")
    winner = cut(rows.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("w")).select("w.doc_id", "w.node"))
    repeated = counted.filter("m > 1").select("doc_id")
    gone = cut(counted.filter("m = 1 and node is not null").join(winner, ["doc_id", "node"], "left_anti").select("doc_id").union(repeated).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(columns)
    if not repeated.limit(1).count():
        return kept
    # rows of repeated ids, each with the name of its set
    at = docs.columns.index("text")
    plain = docs.select([c.alias(f"c{i}") for i, c in enumerate(columns)])
    key = f"c{docs.columns.index('doc_id')}"
    several = plain.join(repeated.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(key)), key, "left_semi").select(plain.columns)

    def name(batches):
        for batch in batches:
            for a, b, texts in pieces(batch.column(at)):
                part = batch.slice(a, b - a)
                nodes = pa.array([node_of(s) if len(s) else None for s in shingle_sets(texts, k)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, nodes], names=[*part.schema.names, "node"])

    several = several.mapInArrow(name, T.StructType([*plain.schema.fields, T.StructField("node", T.LongType())]))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    wordless = several.filter("node is null").select(back)
    whole = F.struct(*plain.columns)
    chosen = several.filter("node is not null").join(winner.withColumnRenamed("doc_id", key), [key, "node"], "left_semi").groupBy(key, "node").agg(F.min_by(whole, F.xxhash64(*plain.columns)).alias("r")).select("r.*")
    return kept.union(wordless).union(chosen.select(back))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
