"""The pipeline against the same stages done plainly, and each stage on odd rows."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import test_pairs
import test_text
import tiktoken

import corpus_pipeline
from ledgerline.llm import bpe, quality, toxicity
from ledgerline.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [w for w in "".join(chr(97 + i // 26) + chr(97 + i % 26) + " " for i in range(26 * 26)).split()]


def fixture(g):
    """Clean texts of two groups, toxic ones, copies, near copies, leaked test items and texts that rules reject."""
    prose = lambda n: [g.choice(WORDS) + g.choice(WORDS) for _ in range(n)]
    item = prose(40)
    rows, toxic = [], {}
    for i in range(160):
        w = prose(g.randint(70, 140))
        if bad := i % 5 == 0:
            for _ in range(4):
                w.insert(g.randrange(len(w)), g.choice(["scumbag", "idiot"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "a" if i % 3 else None))
        toxic[i] = int(bad)
    for k in (1, 2, 3):
        w = rows[k][1].split()
        rows.append((300 + k, rows[k][1].title() if k == 1 else " ".join([*w[:-1], "changed"]), "en", "a"))
    rows += [(400, " ".join([*prose(40), *item, *prose(30)]), "en", "a"), (401, " ".join([*item[20:], *prose(60), *item[:20]]), "de", "a"), (402, "short", "en", "a"), (403, "again and again " * 40, "en", "a"), (404, None, "en", "a"), (405, "", None, None)]
    rows += [(406, " ".join(x + "###" for x in prose(90)), "en", "a"), (407, "\n".join(x for _ in range(20) for x in (" ".join(prose(5)), "buy this")), "en", "a"), (None, " ".join(prose(80)), "en", "a")]
    return rows, toxic, " ".join(item)


def plain_quality(rows):
    passed, vectors = [], {}
    for n, (_, text, lang, source) in enumerate(rows):
        b = test_text.base(text)
        if b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"]:
            continue
        lines = sum(1 for x in text.split("\n") if test_text.WORD.search(x))
        upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
        vectors[n] = np.array([math.log1p(b["word_chars"] / b["n_words"]), math.sqrt(b["n_symbols"] / b["word_chars"]), math.sqrt(b["n_dup_lines"] / lines), math.sqrt(b["n_repeat_words"] / b["n_words"]), math.sqrt(upper / max(upper + lower, 1))])
        passed.append((n, lang, source))
    of = lambda test: test_text.plain_estimate(np.stack([vectors[n] for n, *k in passed if test(*k)]))
    top, keep = of(lambda *_: True), []
    for n, lang, source in passed:
        own, wide = of(lambda x, y, lang=lang, source=source: (x, y) == (lang, source)), of(lambda x, _, lang=lang: x == lang)
        mean, cov = quality.drawn(*own, *quality.drawn(*wide, *top[1:]))
        gap = vectors[n] - mean
        if gap @ np.linalg.inv(cov) @ gap <= quality.chi2_quantile(1 - quality.TAIL, quality.P):
            keep.append(rows[n])
    return keep


def plain_toxic(net, text):
    _, f, first = toxicity._features([text])
    e = sum(net.emb[f[:, j]] for j in range(f.shape[1]))
    pool = []
    for w, weights in zip(toxicity.WIDTHS, net.filters, strict=True):
        found = [sum(e[i + j] @ weights[j] for j in range(w) if i + j < len(e)) for i in range(len(e))]
        pool += list(np.max(found, 0)) if found else [0.0] * toxicity.FILTERS
    z = sum(max(p + b, 0) * o for p, b, o in zip(pool, net.bias, net.out, strict=True)) + net.base
    raw = 1 / (1 + math.exp(-z))
    return raw >= net.cuts[toxicity.shown_language(*(lambda h, f, first: (h, first))(*toxicity._features([text])))[0]]


def plain_leak(text, item):
    a, b = re.findall("[0-9a-z]+", item.lower()), re.findall("[0-9a-z]+", text.lower())
    seeds = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
    if not any(tuple(b[i : i + 5]) in seeds for i in range(len(b) - 4)):
        return False
    return test_pairs.greedy(a, b, 5) >= 0.5 * len(a)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    g = random.Random(3)
    rows, toxic, item = fixture(g)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1 - y, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = plain_quality(rows)
    ids = {r[0] for r in left}
    assert not ids & {402, 403, 404, 405, 406, 407} and {400, 401, None} <= ids and len(ids) > 150
    docs = spark.createDataFrame([(*r, 0) for r in left], SCHEMA)
    net = toxicity.fit(docs, table(spark, str(tmp_path), "labels"), fold=~toxicity.held_out())
    left = [r for r in left if not plain_toxic(net, r[1])]
    assert sum(toxic.get(r[0], 0) for r in left) <= 4 and len(left) > 115
    named = [r for r in left if r[0] is not None]
    groups = test_pairs.brute([r[:2] for r in named])
    left = [r for r in left if r[0] is None or groups[r[0]][1] == r[0]]
    left = [r for r in left if not plain_leak(r[1], item)]
    assert not {r[0] for r in left} & {301, 302, 303, 400, 401}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS_FILE), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text, *_ in left:
        tokens = coder.encode_ordinary(text)
        want[i] = len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    assert got == want


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, stage):
    """Null, empty and very long texts, null and repeated ids, ties, columns of any name, an empty table."""
    run = dict(corpus_pipeline.STAGES)[stage]
    g = random.Random(1)
    clean = " ".join(g.choice(WORDS) for _ in range(90))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, clean, "en", "a"), (3, clean, "en", "a"), (4, clean, "en", None), (None, clean, "en", "a"), (None, None, None, None), (5, clean * 3000, "de", "b"), (6, "x", "en", "a"), (4, "other " + clean, "en", "a")]
    extra = ["stats", "node", "c0", "k_lang", "component", "score", "n", "hash"]
    df = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(extra))) for r in rows], SCHEMA + "".join(f", {c} int" for c in extra))
    last = stage == corpus_pipeline.STAGES[-1][0]
    out = run(spark, df, sf_dir)
    got = [tuple(r) for r in out.collect()]
    if last:
        assert len(got) == len(rows)
    else:
        assert out.columns == df.columns and set(got) <= {tuple(r) for r in df.collect()}
    empty = run(spark, df.limit(0), sf_dir)
    assert empty.count() == 0 and empty.columns == out.columns
