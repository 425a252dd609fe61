"""Near duplicates, components and decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from ledgerline.llm import decontaminate, jaccard
from ledgerline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, groups=6, copies=12, edits=3, length=60):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(55)]
    rows, n = [], 0
    for k in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            w = base[:]
            for _ in range(g.randint(0, edits)):
                w[g.randrange(len(w))] = word()
            rows.append((n, " ".join(w).title() if k % 2 else " ".join(w)))
            n += 1
    for _ in range(copies):
        rows.append((n, " ".join(shared + [word() for _ in range(g.randint(5, 40))])))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One two"), (n + 5, "x " * 30000), (n + 6, "x " * 30)]


@pytest.mark.parametrize(("seed", "few", "block", "per_entry", "cluster", "long"), [(1, 32, 512, 4, 1024, 8192), (2, 2, 4, 0, 3, 8192), (3, 3, 8, 1, 1024, 4), (4, 2, 2, 0, 5, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, few, block, per_entry, cluster, long):
    """The small settings send even small groups through the star, the rows and the blocks of the product."""
    for name, v in (("FEW", few), ("BLOCK", block), ("PAIRS_PER_ENTRY", per_entry), ("CLUSTER", cluster), ("LONG", long), ("HOLD", 200)):
        monkeypatch.setattr(jaccard, name, v)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_families_inside_one_column(spark, monkeypatch):
    """Sets that all share their rarest shingles, in families of which only some link with the first set."""
    for name, v in (("FEW", 2), ("BLOCK", 4), ("PAIRS_PER_ENTRY", 0), ("CLUSTER", 4)):
        monkeypatch.setattr(jaccard, name, v)
    g = random.Random(9)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(5))
    head, rows = [word() for _ in range(30)], []
    for _ in range(6):
        tail = [word() for _ in range(40)]
        for _ in range(7):
            w = head + tail
            for _ in range(g.randint(0, 2)):
                w[g.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w[: g.choice((60, 70))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == brute(rows)


@pytest.mark.parametrize("few", [32, 3])
def test_product_counts_every_overlap(monkeypatch, few):
    """All links of each cluster with their overlaps, however many sets share a column."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    g = random.Random(4)
    clusters, sets = [], []
    for c in range(5):
        base = [g.randrange(1 << 60) for _ in range(40)]
        for _ in range(g.randint(2, 12)):
            s = set(base[: g.randint(30, 40)]) | {g.randrange(1 << 60) for _ in range(g.randint(0, 6))}
            clusters.append(c), sets.append(np.array(sorted(s), np.uint64))
    got = {(int(i), int(j)): int(n) for x, y, z in jaccard.product(np.array(clusters), sets) for i, j, n in zip(x, y, z, strict=True)}
    want = {}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if clusters[i] == clusters[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                want[i, j] = both
    assert got == want and len(want) > 20


def test_one_of_each_group_is_kept(spark):
    rows = corpus(5, groups=3, copies=4)
    df = spark.createDataFrame([(t, i) for i, t in rows] + [("a b c d e f", None)], "text string, doc_id long")
    kept = jaccard.keep_one(df)
    assert kept.columns == ["text", "doc_id"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, c in brute(rows).values()})
    assert kept.filter("doc_id is null").count() == 1


def test_rows_of_one_id_are_judged_one_by_one(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (5, b + " more", "x"), (6, a, "p"), (6, "", "p"), (7, "c d", "q"), (7, "c d", "q"), (8, None, "r"), (8, None, "r"), (None, a, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["node"]) for r in jaccard.keep_one(df).collect()))
    assert got == [(0, a, "n"), (1, a, "x"), (2, b, "x"), (6, "", "p"), (7, "c d", "q"), (8, "", "r"), (8, "", "r")]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(4, "a b c d e f")] * 3 + [(2, "A b c d e f"), (None, "a b c d e f"), (None, None)], schema)
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(same).collect() if r["doc_id"])
    assert got == [(2, 2), (4, 2), (4, 2), (4, 2)] and jaccard.near_duplicates(same).filter("doc_id is null and component_id is null").count() == 2


def test_components(spark):
    g = random.Random(3)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles():
    a, b = list(range(1, 21)), [*range(11, 21), 99, *range(1, 11)]
    assert decontaminate.tiles(a, b) == [(10, 0, 11), (10, 10, 0)]
    assert decontaminate.tiles([1, 2, 3], [9, 1, 2, 3]) == [(3, 0, 1)] and decontaminate.tiles([], [1]) == []
    assert sum(t[0] for t in decontaminate.tiles([7] * 20, [7] * 9)) == 9
    assert decontaminate.tiles([7] * 300, [7] * 32_000) == [(300, 0, 0)]


def greedy(a, b, least):
    """The plain method: the longest unmarked common stretch, again and again."""
    ua, ub, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        ua |= set(range(i, i + n))
        ub |= set(range(j, j + n))
        total += n


def test_tiling_equals_plain_method():
    g = random.Random(1)
    for _ in range(40):
        a = [g.randrange(50) for _ in range(30)]
        cut = g.randrange(8, 22)
        b = [*[g.randrange(50, 90) for _ in range(5)], *a[cut:], *[g.randrange(50, 90) for _ in range(4)], *a[:cut]]
        assert sum(t[0] for t in decontaminate.tiles(a, b, 5)) == greedy(a, b, 5)
    for _ in range(60):  # few different words, so that stretches repeat and overlap
        a, b = ([g.randrange(3) for _ in range(g.randint(1, 25))] for _ in range(2))
        found = decontaminate.tiles(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] for n, i, j in found) and [t[0] for t in found] == sorted((t[0] for t in found), reverse=True)
        ui, ud = [x for n, i, _ in found for x in range(i, i + n)], [x for n, _, j in found for x in range(j, j + n)]
        assert len(set(ui)) == len(ui) and len(set(ud)) == len(ud) and len(a) < 3 or sum(t[0] for t in found) == greedy(a, b, min(3, len(a)))


def test_contamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    other = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, f"{other} {item} {other}", 0), (2, f"{other} {' '.join(w[10:])}. {other} {' '.join(w[:10]).upper()}", 0), (3, other, 0), (4, f"{other} {' '.join(w[:6])}", 0), (5, None, 0), (6, "", 0), (7, "Short One", 0),
        (7, "Short One", 0), (None, item, 0),
    ]
    bench = spark.createDataFrame([(10, item, "x"), (11, item, "y"), (12, "short one", ""), (13, None, ""), (14, "", "")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["n_tiles"], r["coverage"]) for r in decontaminate.contaminations(df, bench).collect())
    assert got == [(0, 10, 1, 1.0), (0, 11, 1, 1.0), (1, 10, 1, 1.0), (1, 11, 1, 1.0), (2, 10, 2, 1.0), (2, 11, 2, 1.0), (7, 12, 1, 1.0), (7, 12, 1, 1.0)]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminations(df.limit(0), bench).count() == 0 and decontaminate.contaminations(df, bench.limit(0)).count() == 0
    decontaminate.BLOCK_CHARS, before = 60, decontaminate.BLOCK_CHARS
    try:
        assert decontaminate.contaminations(df, bench).count() == 8
    finally:
        decontaminate.BLOCK_CHARS = before
