"""Quality rules, toxicity, language and language-model scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
import context_tree
import pytest

from ledgerline.llm import ctw, langid, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


ODD = [None, "", " \n\t", "a", "a b c a b c", "x\nx\n\nx", "é #$% <b> | & *", "q " * 5000, "Ünï cödé\x0bword\x0c", "one two three four one two three"]


def base(text):
    w = WORD.findall(text or "")
    at = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def test_base_counts_equal_plain_ones():
    got = quality.measure(ODD)
    for i, t in enumerate(ODD):
        assert {k: int(got[k][i]) for k in quality.BASE} == base(t)


def prose(g, n=120):
    return " ".join("".join(g.choice("etaoinshrdlu") for _ in range(g.randint(2, 8))) for _ in range(n)) + "."


def quality_rows():
    g = random.Random(2)
    rows = [(i, prose(g, g.randint(60, 200)), "en" if i % 2 else None, "hot" if i % 3 else f"s{i}") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(g).split()), "en", "hot") for i in range(10)]
    rows += [(2000 + i, prose(g).upper(), "en", "hot") for i in range(10)]
    return rows + [(3000, None, "en", "hot"), (3001, "", None, None), (3002, "short text", "en", "hot"), (3003, "again " * 100, "en", "hot"), (5, prose(g), "en", "hot"), (None, prose(g), "xx", None)]


def test_quality(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, stats int, k_lang int").repartition(3)
    got = quality.quality_table(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i is None or i < 1000:
            assert r["kept"] and not r["base_failed"]
        else:
            assert not r["kept"] and r["base_failed"] == (i >= 3000)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.quality_table(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_one_fault_is_enough(spark):
    """Texts whose only fault is repeated lines, or repeated passages, go; clean ones of the same group stay."""
    g = random.Random(6)
    lines = lambda k: [prose(g, 5) for _ in range(k)]
    rows = [(i, "\n".join(lines(g.randint(12, 40)))) for i in range(60)]
    rows += [(1000 + i, "\n".join(x for line in lines(40) for x in ((line, "more") if g.random() < 0.7 else (line,)))) for i in range(5)]
    for i in range(5):
        passage = prose(g, 25)
        rows.append((2000 + i, f"{prose(g, 50)} {passage} {prose(g, 20)} {passage}"))
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = quality.quality_table(df).collect()
    assert not any(r["base_failed"] for r in got)
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in got), [(r["doc_id"], r["distance"]) for r in got if r["kept"] != (r["doc_id"] < 1000)]


def plain_estimate(x):
    """The minimum covariance determinant of one group, in numpy."""
    floor = np.square(quality.FLOOR)
    r3 = lambda v: np.floor(v * 1000 + 0.5) / 1000
    middle = np.median(r3(x), 0)
    spread = np.median(r3(np.abs(x - middle)), 0)
    scale = np.sqrt((1.4826 * spread) ** 2 + floor)
    z = (x - middle) / scale
    signs = z / np.sqrt(np.maximum((z**2).sum(1), 1e-12))[:, None]
    best = None
    for r in (None, np.cov(np.tanh(z).T, bias=True), signs.T @ signs / len(x)):
        corr = np.eye(quality.P)
        if r is not None:
            r = r + np.eye(quality.P) * 1e-3
            corr = r / np.sqrt(np.outer(r.diagonal(), r.diagonal()))
        mean, cov, det = middle, corr * np.outer(scale, scale), np.inf
        for _ in range(60):
            d = np.floor(np.log1p(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)) * 10**quality.DECIMALS + 0.5)
            near = x[d <= np.sort(d)[int(np.ceil(quality.SHARE * len(x))) - 1]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) * quality._consistency() + np.diag(floor)
            now = np.linalg.slogdet(cov)[1]
            if det - now <= quality.SETTLED:
                break
            det = now
        if best is None or now < best[3]:
            best = len(near), mean, cov, now
    return best[:3]


def test_estimates_equal_plain_ones(spark):
    """The estimates of large and small groups, drawn to their language's and all rows', against numpy."""
    g = np.random.default_rng(4)
    mix = np.eye(quality.P) + 0.4 * g.normal(size=(quality.P, quality.P))
    groups = {("1a", "1x"): 400, ("1a", "1y"): 60, ("1b", "1x"): 250, ("1b", "0"): 7}
    parts = {}
    for k, ((lang, source), n) in enumerate(groups.items()):
        x = np.abs(1 + 0.2 * k + (g.normal(0, 0.15, (n, quality.P)) @ mix))
        x[: n // 10] += 3
        parts[lang, source] = x
    rows = [(lang, source, *map(float, r)) for (lang, source), x in parts.items() for r in x]
    df = spark.createDataFrame(rows, "k_lang string, k_source string, " + ", ".join(f"{v} double" for v in quality.VECTOR)).repartition(3)
    got = {(r["k_lang"], r["k_source"]): r for r in quality.fit(df).collect()}
    assert set(got) == set(groups)
    top = plain_estimate(np.concatenate(list(parts.values())))
    for (lang, source), x in parts.items():
        own, wide = plain_estimate(x), plain_estimate(np.concatenate([y for k, y in parts.items() if k[0] == lang]))
        mean, cov = quality.drawn(*own, *quality.drawn(*wide, *top[1:]))
        r = got[lang, source]
        assert r["rows"] == len(x) and np.allclose(r["mean"], mean, atol=5e-3) and np.allclose(r["inv"], np.linalg.inv(cov)[np.triu_indices(quality.P)], rtol=0.05, atol=0.5)
        # the shifted tenth is left out
        assert len(x) < 100 or abs(own[1] - (x[len(x) // 10 :]).mean(0)).max() < 0.1


def toxic_rows(n=600):
    g = random.Random(7)
    bad = ["idiot", "scumbag", "achlichen", "achlicher", "achlichung"]
    rows = []
    for i in range(n):
        w = prose(g, g.randint(5, 80)).split()
        y = int(g.random() < 0.3)
        for _ in range(g.randint(2, 4) * y):
            w.insert(g.randrange(len(w)), g.choice(bad))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(None, None, "s"), (9999, "", "s"), (9998, "idiot " * 30000, "s"), (0, rows[0][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (12345, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, fold=~toxicity.held_out())
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, net).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i]["predicted"] == y for i, y in held) / len(held)
    assert right >= 0.95 and got[9998]["predicted"] == 1 and got[9999]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    kept = toxicity.drop_toxic(docs, net)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9998").count() == 0 and kept.filter("doc_id is null").count() == 1
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_documents(docs, nothing).filter("predicted = 1").count() == 0 and toxicity.score_documents(docs.limit(0), net).count() == 0


def test_sample_is_joined_first_and_bounded(spark, monkeypatch):
    """Ids that are no longer there do not use up the sample; the bounds on rows and words hold."""
    rows = toxic_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1]), (0, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, i % 2) for i in range(10_000, 12_000)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fitted", lambda parts, lang, y, weight: seen.append((parts, y, weight)))
    toxicity.fit(docs, labels, per_class=80)
    parts, y, weight = seen[0]
    assert (y == 1).sum() == 80 and (y == 0).sum() == 80
    n1 = sum(v for _, _, v in rows)
    assert weight[y == 1].sum() / weight[y == 0].sum() == pytest.approx(n1 / (300 - n1))
    toxicity.fit(docs, labels, per_class=80, words_=500)
    assert 0 < sum(map(len, seen[1][0])) < 1500 and set(seen[1][1]) == {0, 1}


def test_all_labelled_rows_teach(spark, monkeypatch):
    """More rows of a class than a sample once held, and more words."""
    docs = spark.range(7000).selectExpr("id as doc_id", "concat('word ', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 20 = 0 as int) as toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fitted", lambda parts, lang, y, weight: seen.append((y, weight)))
    toxicity.fit(docs, labels)
    assert len(seen[0][0]) == 7000 and seen[0][0].sum() == 350 and set(seen[0][1]) == {1.0}


def test_shards_learn_from_all_rows_however_dealt(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1]), (9999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, 0)], "doc_id long, toxic int")
    seen, apart = [], toxicity.fitted_apart
    monkeypatch.setattr(toxicity, "fitted_apart", lambda packed: seen.append(sum(len(r["y"]) for r in packed.collect())) or apart(packed))
    nets = [toxicity.fit(docs.repartition(n), labels.repartition(n), fold=~toxicity.held_out()) for n in (1, 7)]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    assert seen == [sum(not x for x in held) + (zlib.crc32(b"9999") % 4 != 2)] * 2
    assert all(np.array_equal(getattr(nets[0], n), getattr(nets[1], n)) for n in ("emb", "out", "bias", "base", "cuts"))
    score = nets[0].score([t for _, t, _ in rows])
    assert np.mean([(s >= toxicity.CUT) == y for s, (_, _, y), h in zip(score, rows, held, strict=True) if h]) >= 0.95


def test_gradients_equal_differences(monkeypatch):
    """A step of training against numerical slopes of the loss, for embeddings, filters, biases and output."""
    net = toxicity.ConvNet(5)
    texts, y = ["good day to you", "you idiot there", "day idiot", "good"] * 3, np.array([0.0, 1.0, 1.0, 0.0] * 3)
    _, f, first = toxicity._features(texts)

    def loss():
        p = np.clip(net.raw(net.pooled(np.arange(len(f)), net.embed(f), first)[0]), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    import copy

    slopes, places = [], []
    words_ = np.unique(f)
    for array, index in [(net.emb, (int(words_[k]), d)) for k in range(0, len(words_), 5) for d in (0, 3)] + [(net.filters[w], (j, 2, 1)) for w in range(3) for j in range(w + 1)] + [(net.out, 4), (net.bias, 9), (net.out, 20)]:
        old, eps = array[index], 2e-2
        array[index] = old + eps
        up = loss()
        array[index] = old - eps
        slopes.append((up - loss()) / (2 * eps))
        array[index] = old
        places.append((next(n for n, a in (("emb", net.emb), ("out", net.out), ("bias", net.bias), *((f"f{k}", x) for k, x in enumerate(net.filters))) if a is array), index))
    after = copy.deepcopy(net)
    after.train(f, first, y, np.ones(len(y)), epochs=1)
    moved = lambda n, net_: {"emb": net_.emb, "out": net_.out, "bias": net_.bias, "f0": net_.filters[0], "f1": net_.filters[1], "f2": net_.filters[2]}[n]
    checked = 0
    for (name, index), slope in zip(places, slopes, strict=True):
        step = moved(name, after)[index] - moved(name, net)[index]
        if abs(slope) > 2e-3:  # one batch moves every parameter against its slope
            assert step * slope < 0, (name, index, slope, step)
            checked += 1
    assert checked >= 8


def test_gradients_only_move_winning_windows():
    net = toxicity.ConvNet()
    texts, y = ["good day to you"] * 8 + ["you idiot there"] * 8, np.array([0.0] * 8 + [1.0] * 8)
    _, f, first = toxicity._features(texts)
    net.train(f, first, y, np.ones(16), epochs=30)
    pool, _ = net.pooled(np.arange(len(f)), net.embed(f), first)
    p = net.raw(pool)
    assert p[:8].max() < 0.3 < 0.7 < p[8:].min()
    assert np.allclose(net.probability(f, first), p)


def test_pool_equals_plain_convolution():
    net = toxicity.ConvNet(3)
    texts = ["a", "", "one two three four", "five six"]
    _, f, first = toxicity._features(texts)
    emb = net.embed(f)
    pool, _ = net.pooled(np.arange(len(f)), emb, first)
    for d in range(len(texts)):
        e = emb[first[d] : first[d + 1]]
        for k, w in enumerate(toxicity.WIDTHS):
            want = [sum(e[i + j] @ net.filters[k][j] for j in range(w) if i + j < len(e)) for i in range(len(e))]
            got = pool[d, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS]
            assert np.allclose(got, np.max(want, 0) if want else 0, atol=1e-5)


SYLLABLES = {"en": "the ing ed er on th and".split(), "de": "sch ung keit der ein ich".split(), "fr": "eau ion ré les que oi".split()}


def test_languages(spark):
    g = random.Random(1)
    text = lambda lang: " ".join("".join(g.choice(SYLLABLES[lang]) for _ in range(g.randint(1, 3))) for _ in range(g.randint(4, 60)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 100)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "en"), (None, "the ing and", None), (1003, "ΑΒΓ", "en"), (1004, "sch ung " * 20000, None), (0, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    from ledgerline.llm.common import crc_mod

    held = crc_mod("doc_id", 3) == 1
    got = langid.predict_languages(df, langid.fit(df, fold=~held)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[i]["lang_pred"] == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]) >= 0.97
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002)) and by[1003]["lang_pred"] != "und" and by[1004]["lang_pred"] == "de"
    assert langid.predict_languages(df, langid.fit(df.limit(0))).filter("lang_pred <> 'und'").count() == 0 and langid.predict_languages(df.limit(0), langid.fit(df)).count() == 0


def plain_terms(text):
    """Hashed 2- and 3-grams of a text, byte by byte."""
    raw = (text if text.isascii() else text.lower()).encode()
    letters = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw] + [32]
    out = collections.Counter()
    for i in range(len(letters) - 1):
        a, b = letters[i : i + 2]
        if (a, b) != (32, 32):
            out[((a << 8 | b) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
        if i + 2 < len(letters):
            c = letters[i + 2]
            if (a, b) != (32, 32) and (b, c) != (32, 32):
                out[(((a << 16 | b << 8 | c) ^ 0x5BD1E995) * 2246822519 & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
    return out


def plain_centroids(rows):
    """TF-IDF, spherical k-means and rejection distances, one text at a time."""
    size = 1 << langid.BITS
    by = collections.defaultdict(list)
    for _, text, lang in sorted(rows):
        v = np.zeros(size)
        for k, n in plain_terms(text).items():
            v[k] = math.log(1 + n)
        by[lang].append(v)
    share = sum(np.mean([v > 0 for v in vs], 0) for vs in by.values()) / len(by)
    idf = np.log(1 / np.clip(share, 1e-3, 1)) + 0.1
    out = []
    for lang in sorted(by):
        vs = [v * idf / np.linalg.norm(v * idf) for v in by[lang]]
        mean = sum(vs) / len(vs)
        chosen = [max(range(len(vs)), key=lambda i: vs[i] @ mean)]
        while len(chosen) < min(langid.CENTROIDS, len(vs)):
            chosen.append(min(range(len(vs)), key=lambda i: max(vs[i] @ vs[j] for j in chosen)))
        centres = [vs[i] for i in chosen]
        for _ in range(langid.STEPS):
            near = [max(range(len(centres)), key=lambda k: v @ centres[k]) for v in vs]
            for k in range(len(centres)):
                own = [v for v, n in zip(vs, near, strict=True) if n == k]
                if own:
                    c = sum(own) / len(own)
                    centres[k] = c / np.linalg.norm(c)
        out += [(lang, c) for c in centres]
    return idf, out


def test_centroids_equal_plain_ones(spark):
    """The fitted model and its predictions against TF-IDF, k-means and cosines computed one text at a time."""
    g = random.Random(12)
    text = lambda lang: " ".join("".join(g.choice(SYLLABLES[lang]) for _ in range(g.randint(1, 3))) for _ in range(g.randint(3, 25))) + g.choice([".", " 12 É!", ""])
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df)
    idf, centres = plain_centroids(rows)
    assert np.allclose(model.idf, idf, atol=1e-5) and model.langs == [x for x, _ in centres] and np.allclose(model.centres, np.stack([c for _, c in centres]), atol=1e-4)
    for x in [text("en"), text("de"), text("fr"), "xyz", "é"]:
        v = np.zeros(len(idf))
        for k, n in plain_terms(x).items():
            v[k] = math.log(1 + n) * idf[k]
        cos = [float(v @ c / max(np.linalg.norm(v), 1e-9)) for _, c in centres]
        lang, score, _ = model.predict([x])
        assert lang[0] == centres[int(np.argmax(cos))][0] and score[0] == pytest.approx(min(1, max(0, max(cos))), abs=1e-4)


def test_the_sample_is_bounded(spark, monkeypatch):
    """About so many texts of a frequent language; few ids that are often repeated are all learned."""
    rows = [(i, f"wort {i} sch", "de") for i in range(600)] + [(i % 7, f"the {i}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sizes = []
    monkeypatch.setattr(langid, "cut", lambda x: (sizes.append({r[0]: r[1] for r in x.groupBy("lang").count().collect()} if "counts" in x.columns else None), x)[1])
    assert langid.fit(df, per_language=60, k=1).langs == ["de", "en"]
    assert 30 < sizes[-1]["de"] < 100 and sizes[-1]["en"] == 7


def test_rare_languages_are_learned(spark):
    """250 frequent languages leave room for one of a single row."""
    word = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(3))
    rows = [(2 * i + j, f"{word(i * 53)} " * 8, f"l{i:03}") for i in range(250) for j in range(2)] + [(900, "ŵyŷ ŵyŷ ŷŵy", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert set(model.langs) == {r[2] for r in rows} and model.predict(["ŵyŷ ŷŵy"])[0] == ["rare"]


def test_terms_do_not_cross_texts():
    together = langid.term_counts(["ab", "cd é", "", None])
    assert np.array_equal(together[0], langid.term_counts(["ab"])[0]) and np.array_equal(together[1], langid.term_counts(["cd é"])[0]) and not together[2].any()


def plain_base(rows):
    tokens = {i: WORD.findall(lower(t)) for i, t in rows}
    c = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
            c[None] += 1
    n, v = sum(c.values()), len(c)
    return {i: (len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])) for i, w in tokens.items()}


@pytest.mark.parametrize("bits", [20, 6])
def test_unigram_base(spark, monkeypatch, bits):
    """With few bits most words are looked up where their counts lie."""
    monkeypatch.setattr(ctw, "FREQUENT_BITS", bits)
    g = random.Random(3)
    rows = [(i, prose(g, g.randint(0, 60)).title()) for i in range(120)] + [(500, None), (501, ""), (502, "the " * 20000)]
    from ledgerline.llm.common import crc_mod

    df = spark.createDataFrame([(t, i, 1.0) for i, t in rows], "text string, doc_id long, base_score double").repartition(3)
    got = {r["doc_id"]: r for r in ctw.score_texts(df, crc_mod("doc_id", 5) == 1).collect()}
    for i, (n, known, total, score) in plain_base(rows).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(score, rel=1e-9) and r["score"] < 0
    assert ctw.score_texts(df.limit(0)).count() == 0
    twice = spark.createDataFrame([("a b", 1), ("a b", 1), ("c", None), ("c", None), ("a", 1), (None, None), ("", -5)], "text string, doc_id long")
    out = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"]) for r in ctw.score_texts(twice).collect())
    assert [x[:3] for x in out] == [(-5, 1, 1), (0, 1, 1), (0, 2, 2), (0, 2, 2), (1, 2, 2), (1, 3, 3), (1, 3, 3)] and out[2] == out[3] and out[5] == out[6]


def tree_of(texts):
    k, n = context_tree.grams(texts)
    entries = {d: ctw._merge([k & np.uint64((1 << (8 * (d + 1))) - 1)], [n]) for d in range(1, ctw.DEPTH + 1)}
    root = np.zeros(256)
    np.add.at(root, (entries[1][0] & np.uint64(255)).astype(int), entries[1][1])
    return context_tree.ContextTree(entries, root), entries


def test_tree_probabilities_sum_to_one_and_learn():
    tree, _ = tree_of(["abracadabra " * 20, "banana " * 20])
    assert np.allclose((10.0 ** tree.logp.astype(float)).sum(1), 1, atol=1e-4)
    assert tree.score(["abracadabra banana"])[0] > tree.score(["qzxwvkjy mlpoiu"])[0] + 20
    alone, both = tree.score(["banana"])[0], tree.score(["x", "banana", "yy"])
    assert both[1] == pytest.approx(alone, abs=1e-4) and tree.score([""])[0] == tree.score([None])[0]


def test_tree_equals_plain_weighting(monkeypatch):
    """One context's mixture against a recursive evaluation of the definition."""
    texts = ["abab abba", "baab"]
    tree, _ = tree_of(texts)
    data = [b"\xff" * ctw.DEPTH + t.encode() + b"\xff" for t in texts]
    seen = collections.defaultdict(lambda: collections.Counter())
    for s in data:
        for i in range(ctw.DEPTH, len(s)):
            for d in range(ctw.DEPTH + 1):
                seen[s[i - d : i]][s[i]] += 1

    def counts(ctx, prefix):
        bits = len(prefix)
        zero = one = 0
        for b, n in seen[ctx].items():
            word = f"{b:08b}"
            if word[:bits] == prefix:
                zero, one = (zero + n, one) if word[bits] == "0" else (zero, one + n)
        return zero, one

    kt = lambda a, b: float(ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0])

    def weighted(ctx, prefix):
        own = kt(*counts(ctx, prefix))
        if len(ctx) == ctw.DEPTH:
            return own
        kids = [c for c in seen if len(c) == len(ctx) + 1 and c[1:] == ctx]
        return np.logaddexp(own, sum(weighted(c, prefix) for c in kids)) - math.log(2)

    def one(ctx, prefix, depth=0):
        at = ctx[len(ctx) - depth :]
        a, b = counts(at, prefix)
        guess = (b + 0.5) / (a + b + 1)
        if depth == ctw.DEPTH:
            return guess
        stay = math.exp(kt(a, b) - weighted(at, prefix)) / 2
        return stay * guess + (1 - stay) * one(ctx, prefix, depth + 1)

    s = data[0]
    for i in (ctw.DEPTH + 3, ctw.DEPTH + 6):
        ctx, byte = s[i - ctw.DEPTH : i], f"{s[i]:08b}"
        total = sum(math.log10(p if byte[k] == "1" else 1 - p) for k in range(8) for p in [one(ctx, byte[:k])])
        node = 0
        for back in range(1, ctw.DEPTH + 1):
            node = tree.child[node][ctx[-back]]
        assert tree.logp[node][s[i]] == pytest.approx(total, abs=1e-3)


@pytest.mark.parametrize(("bits", "unit", "hold"), [(20, 1 << 16, 1 << 20), (3, 40, 500), (6, 3, 100)])
def test_scores_keep_every_context(spark, monkeypatch, bits, unit, hold):
    """The distributed mix against one tree of all contexts: a rare context stays one, however much other text there is.
    Small units give a trunk of several depths, a small hold sends counts off in many parts."""
    for name, value in (("GRAM_BITS", bits), ("UNIT_WEIGHT", unit), ("TRUNK_BITS", 40), ("HOLD", hold), ("MIX_GRAMS", unit)):
        monkeypatch.setattr(ctw, name, value)
    g = random.Random(8)
    texts = ["qzxvk jqxzw " * 3, *[prose(g, 80)] * 900, "qzxvk jqxzw", "never seen: ÄÖ", None]
    held = len(texts) - 3
    tree, _ = tree_of(texts[:held])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in ctw.score_texts(df, df["doc_id"] >= held).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], tree.score(texts), rtol=1e-5, atol=0.01)
    nothing = ctw.score_texts(df, df["doc_id"] >= 0).filter("doc_id = 0").first()["score"]
    assert nothing == pytest.approx(8 * 37 * math.log10(0.5))
