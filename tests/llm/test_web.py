"""Pages and URLs."""

import random

from pyspark.sql import functions as F

from ledgerline.llm import pages, urls


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_subsequence(monkeypatch):
    g = random.Random(0)
    for _ in range(200):
        a, b = ([g.choice("abcd") for _ in range(g.randint(0, 12))] for _ in range(2))
        pairs = pages.common_lines(a, b)
        assert len(pairs) == plain_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        monkeypatch.setattr(pages, "TABLE_BITS", 8)
        halved = pages.common_lines(a, b)
        monkeypatch.undo()
        assert len(halved) == len(pairs) and all(a[i] == b[j] for i, j in halved) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(halved, halved[1:], strict=False))
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def text(source):
    p = pages.Page(source)
    return p.text_without(set())


def test_article_markup():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>site</header><nav><ul><li>menu</nav><div class="ad">buy</div><div id="cookie-notice"><p>we use</p></div>
      <main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>&nbsp;text<br>goes on<p>1 &lt; 2 &#8364; a<script>var x = "</p>";</script><aside>side</aside><form><input>name</form>
      <section class="comments"><p>reader</p></section><p>Last.</p></article><article class="comment">me too</article></main><footer>&copy;</footer></body></html>"""
    assert text(page) == "Title & more\nFirst bold text goes on\n1 < 2 € a\nLast."


def test_other_markup():
    assert text("<body><div class=sidebar>x<div>y</div></div><div id=content><p>a</p><p>b</p></div><div class='share-box'>s</div>") == "a\nb"
    assert text("<p>one<p>two<table><tr><td>a<td>b<tr><td>c</table>") == "one\ntwo\na b\nc"
    assert text("<nav>menu <article><p>body</article>") == "body" and text("<!-- x") == "" and text(None) == "" and text("plain  words") == "plain words"
    assert text("<article><h1>T</h1></article>" + "<div>" * 3000) == "T"


def test_every_main_element_counts():
    assert text("<article><p>one</p></article><p>between</p><article><p>two is longer</p></article>") == "one\ntwo is longer"
    assert text("<div class=content><p>a</p></div><div class=post><p>b b b</p><div class=text><p>c</p></div></div>") == "a\nb b b\nc"
    assert text("<main><p>a long text of the page</p><article>teaser</article></main>") == "a long text of the page\nteaser"
    page = pages.Page("<main><p>site line</p><article>site line</article><p>the text of this page alone</p></main>")
    assert page.text_without({0, 1}) == "site line\nthe text of this page alone"


def test_differencing(spark):
    frame = "<body><div><p>Site name</p><p>Top story list</p></div>{}<div><p>Imprint and rules</p></div></body>"
    body = lambda i: "".join(f"<p>Line {j} of page {i} says {'x' * (i + j)}</p>" for j in range(6))
    rows = [(i, f"http://h.x/a/{i}", frame.format(body(i)), "z") for i in range(6)]
    rows += [(10, "http://h.x/b/1", frame.format("<p>copy of one text</p>"), "z"), (11, "http://h.x/b/2", frame.format("<p>copy of one text</p>"), "z"), (12, "http://alone.x/", "<p>only</p>", "z"), (13, None, None, "z"), (14, "http://h.x/a/9", "", "z"), (None, "http://h.x/a/3", "<article>" + "w " * 30000 + "</article>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in pages.main_text(df.coalesce(1)).collect()}
    assert len(got) == len(rows)
    for i in range(5):
        assert got[i]["text"] == "\n".join(f"Line {j} of page {i} says {'x' * (i + j)}".strip() for j in range(6))
    assert "copy of one text" in got[10]["text"] and got[12]["text"] == "only" and got[13]["text"] == "" and got[14]["n_chars"] == 0 and got[None]["n_chars"] == 59999
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and pages.main_text(df.limit(0)).count() == 0


def framed_pages(g):
    """Hosts whose pages share a frame that no markup names; some pages are copies, some have an article."""
    rows = []
    for h in range(4):
        top, bottom = [f"Host {h} top {k}" for k in range(3)], [f"Host {h} imprint {k}" for k in range(2)]
        for n in range(40):
            own = [f"line {j} of {h} {n} {g.random()}" for j in range(g.randint(4, 9))] if n % 5 else ["the same text", "on several pages", "word " * 30]
            middle = "".join(f"<p>{x}</p>" for x in own)
            middle = f"<article>{middle}<p>{top[0]}</p></article>" if n % 7 == 3 else middle
            rows.append((None if n == 11 else (1 << 53) + 100 * h + n, f"http://h{h}.x/{n:03}/a", "".join(f"<div>{x}</div>" for x in top) + middle + "".join(f"<div>{x}</div>" for x in bottom), own, n % 7 == 3, top[0]))
    return rows


def test_shared_frames_go_whatever_the_partitions(spark, monkeypatch):
    """Differencing decides for pages without an article; a shared line inside an article stays; ids stay whole."""
    rows = framed_pages(random.Random(5))
    want = sorted((r[0] or 0, r[1], "\n".join(" ".join(x.split()) for x in [*r[3], *([r[5]] if r[4] else [])])) for r in rows)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for parts in (1, 4, 64):
        monkeypatch.setattr(pages, "LEAST_PAGES", 1)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = sorted((r["page_id"] or 0, r["url"], r["text"]) for r in pages.main_text(df.repartition(parts)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want


def test_pages_with_an_article_are_differenced_too(spark):
    """Their shared lines are found, then the check by markup brings them back; a menu is aligned with menus only."""
    page = lambda i: f"<nav><p>menu</p><p>Title {3 - i}</p></nav><article><h1>Title {i}</h1><p>a passage of both</p><p>own {'text ' * 9}{i}</p><div class=ad>buy {i}</div></article><footer>imprint</footer>"
    rows = [(1, "http://h.x/1", page(1)), (2, "http://h.x/2", page(2)), (3, "http://g.x/1", page(1)), (4, "http://g.x/2", None), (5, None, page(2).replace("article>", "div>")), (6, None, page(1).replace("article>", "div>"))]
    got = {r["page_id"]: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: f"own {'text ' * 9}{i}"
    assert [got[i]["n_shared"] for i in range(1, 7)] == [1, 1, 0, 0, 1, 1]
    assert [got[i]["text"] for i in (1, 2, 3)] == [f"Title {i}\na passage of both\n{own(i)}" for i in (1, 2, 1)] and got[4]["text"] == ""
    assert [got[i]["text"] for i in (5, 6)] == [f"Title {i}\n{own(i)}" for i in (2, 1)]


def test_lines_of_frame_elements_stay_apart():
    page = pages.Page("<nav>a<br>b<ul><li>c</li></ul></nav><p>x <span class=ad>d<div>e</div></span> y</p><footer>f")
    assert page.every == [("a b", False), ("c", False), ("d", False), ("e", False), ("x y", True), ("f", False)] and page.lines == ["x y"]


def test_very_long_pages(spark):
    lines = [f"line {i}" for i in range(30_000)]
    page = lambda own: "".join(f"<p>{x}</p>" for x in [*lines[:200], *own, *lines[200:400]])
    df = spark.createDataFrame([(1, "http://a.x/1", page(f"x {i}" for i in range(30_000))), (2, "http://a.x/2", page(f"y {i}" for i in range(30_000)))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in pages.main_text(df).collect()}
    assert got[1] == [f"x {i}" for i in range(30_000)] and got[2][0] == "y 0" and len(got[2]) == 30_000


def test_hosts_paths_and_rules(spark):
    cases = {
        "HTTP://Blog.Example.NET/en/1?x#y": ("blog.example.net", "/en/1", "example.net/en/", "allow"), "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "http://b.example.com/de/": ("b.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/1": ("x.org", "/fr/1", "org/fr/", "allow"), "foo/bar": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "http://h?x://y.net/z": ("h", "", None, "allow"), "http://a\nb.net/x": ("a\nb.net", "/x", "net/", "block"),
    }
    df = spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    got = [tuple(r)[1:] for r in urls.judge_urls(df).orderBy("page_id").collect()]
    assert got == list(cases.values()) and urls.judge_urls(df.limit(0)).count() == 0


def test_of_equal_rules_the_first_wins(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string").select("page_id", urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p"))
    for rules in ([("net/", "block"), ("net/", "allow")], [("net/", "allow"), ("net/", "block")], [("a.net/", "allow"), ("net/x", "block")]):
        rule, verdict = urls.rule_for(F.col("h"), F.col("p"), rules)
        assert tuple(df.select(rule, verdict).first()) == max(rules, key=lambda r: len(r[0]))


def test_very_long_page_and_url(spark):
    rows = [(1, "http://a.x/1", "<p>" + "w " * 500_000 + "</p><link rel=canonical href=http://b.net/q>"), (2, "http://a.x/" + "p" * 100_000, ""), (3, "http://b.net/q", None)]
    got = {r["page_id"]: (r["verdict"], len(r["path"])) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("block", 2), 2: ("allow", 100_001), 3: ("block", 2)}


def test_aliases(spark):
    link = lambda u: f'<html><head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://a.x.com/1", link("https://b.foo.net/q")), (2, "http://c.x.com/2", "<meta http-equiv=refresh content=\"0; url='//a.x.com/1'\">"), (3, "http://d.x.com/a/3", "<!-- <link rel=canonical href=//b.foo.net/q> -->"),
        (4, "http://e.x.com/4?x=1", '<link href=/4 rel=canonical><script>"<meta http-equiv=refresh content=0;url=//b.foo.net/q>"</script>'), (5, None, link("//b.foo.net/q")), (6, "http://f.x.com", link("http://b.foo.net/q2")), (7, "http://f.x.com/", link("http://z.example.net/en/1")), (8, "foo", None), (9, "http://g.x.com/9", None), (9, "http://g.x.com/9", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://g.x.com/9", "http://c.x.com/2#f"), (None, "http://a.net/"), ("x", "y")], "source string, target string")
    got = [(r["page_id"], r["verdict"]) for r in urls.judge_urls(df, moved).orderBy("page_id").collect()]
    assert got == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (9, "block"), (9, "block")]
