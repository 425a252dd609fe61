"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by path; each is paired with the neighbour whose path has the longest common beginning, their
text lines are aligned by a longest common subsequence, and lines that both share go, as parts of the site's frame. Of
copies of one page the first stands for all, so that a page is never compared with its copy.

That holds for every page and all its lines; only hashes of lines are sorted for it. A check by markup follows, as
neighbours may have other menus and adverts, and two pages may well carry the same passage or the same article: of the
lines that differencing leaves, those in elements for navigation, forms, adverts, comments and the like go, and on a page
with main elements those outside all articles and all elements of the chosen kind; shared lines inside article elements
come back.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, pieces, table
from .urls import host_of, path_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|canvas|video|audio|textarea|select|title|head(?=[\s>]))\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
# fixed values: elements and names that say what they hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset(("td", "th", "br", "option"))
FRAME_TAGS = frozenset("nav footer aside form button menu dialog label fieldset".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login sidebar sidebars comment comments disqus discussion reply replies respond share sharing social related recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead topbar popup modal overlay widget widgets toolbar pagination pager tags paywall disclaimer skip".split()
)
BODY_NAMES = frozenset("content article post entry story main body text".split())


class Page:
    """What a page holds: all its lines in order with whether no element around them names another purpose (``every``), those
    of which that is true (``lines``), and for each of these 2 in an article, 1 in another chosen main element, else 0; None
    without any."""

    __slots__ = ("every", "lines", "inside")

    def __init__(self, source: str | None):
        self.every: list[tuple[str, bool]] = []
        self.lines: list[str] = []
        owners: list[int] = []
        stack: list[tuple[str, int]] = []  # open elements, each with the main element it opened or 0
        mains: list[tuple[int, int]] = []  # (kind, number of enclosing mains) of each main element
        open_mains: list[int] = []
        spans: list[list[int]] = []
        parts: list[str] = []
        beside: list[str] = []
        skip = None  # (tag, depth) of the frame element that the text is in

        def flush(given=parts):
            if given:
                text = " ".join(html.unescape("".join(given)).split())
                given.clear()
                if text:
                    self.every.append((text, given is parts))
                    if given is parts:
                        self.lines.append(text)

        at, source = 0, source or ""
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                (parts if skip is None else beside).append(source[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                flush(beside)
            elif skip is not None and tag in CELLS:
                beside.append(" ")
            if m[2]:
                if skip is not None:
                    if tag == skip[0]:
                        skip = (tag, skip[1] - 1) if skip[1] > 1 else None
                        if skip is None:
                            flush(beside)
                            if tag in BLOCK:
                                flush()
                            continue
                    if skip is None or not any(t == tag for t, _ in stack) or tag == skip[0]:
                        continue
                    if tag not in ("article", "main", "body", "html", "section", "div"):
                        continue
                    if tag in ("div", "section"):
                        continue
                    skip = None  # the element around an unclosed frame element ends
                if tag in BLOCK:
                    flush()
                elif tag in CELLS:
                    parts.append(" ")
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        for t, k in stack[i:]:
                            if k:
                                spans[k - 1][1] = len(self.lines)
                                open_mains.remove(k)
                        del stack[i:]
                        break
                continue
            given = m[4]
            attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(given)} if given.strip() else {}
            if skip is not None:
                if tag in ("article", "main") and not self._frame(tag, attributes, bool(open_mains)):
                    skip = None  # never closed
                else:
                    if tag == skip[0] and tag not in VOID and not given.rstrip().endswith("/"):
                        skip = (tag, skip[1] + 1)
                    continue
            if tag in BLOCK:
                flush()
            elif tag in CELLS:
                parts.append(" ")
            if tag in VOID or given.rstrip().endswith("/") and tag not in BLOCK:
                continue
            if self._frame(tag, attributes, bool(open_mains)):
                skip = (tag, 1)
                continue
            kind = self._main(tag, attributes)
            number = 0
            if kind:
                mains.append((kind, len(open_mains)))
                spans.append([len(self.lines), -1])
                number = len(mains)
                open_mains.append(number)
            if tag != "p" or not (stack and stack[-1][0] == "p"):
                stack.append((tag, number))
        (parts if skip is None else beside).append(source[at:])
        flush()
        flush(beside)
        for k in open_mains:
            spans[k - 1][1] = len(self.lines)
        held = {kind: {i for (k, _), (a, b) in zip(mains, spans, strict=True) if k == kind for i in range(a, b)} for kind in (3, 2, 1)}
        sizes = {kind: sum(len(self.lines[i]) for i in places) for kind, places in held.items()}
        self.inside = None
        if most := max(sizes.values()):
            # an article that is a small part of another main element is not the page's text
            kind = next(k for k in (3, 2, 1) if 2 * sizes[k] >= most)
            self.inside = [2 if i in held[3] else int(i in held[kind]) for i in range(len(self.lines))]

    @staticmethod
    def _main(tag: str, attributes: dict) -> int:
        if tag == "article" or "articleBody" in attributes.get("itemprop", ""):
            return 3
        if tag == "main" or attributes.get("role") in ("main", "article"):
            return 2
        if tag in ("div", "section", "td") and attributes:
            names = set(_NAME_PARTS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
            return 1 if names & BODY_NAMES and not names & FRAME_NAMES else 0
        return 0

    @staticmethod
    def _frame(tag: str, attributes: dict, in_main: bool) -> bool:
        """Does the element say that it holds something else than the main text?"""
        if tag in FRAME_TAGS or tag == "header" and not in_main:
            return True
        if not attributes or tag in ("body", "html"):
            return False
        if attributes.get("role", "").lower() in FRAME_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none", attributes.get("style", "")):
            return True
        names = set(_NAME_PARTS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
        return bool(names & FRAME_NAMES) or "header" in names and not in_main

    def text_without(self, shared: set[int]) -> str:
        return kept_lines(self.lines, self.inside, shared)


def kept_lines(lines: list[str], inside: list[int] | None, shared: set[int]) -> str:
    """The lines that are not shared, after the check by markup: those of articles come back, those outside main elements go."""
    kept = [i not in shared for i in range(len(lines))]
    if inside is not None:
        kept = [zone == 2 or zone == 1 and own for zone, own in zip(inside, kept, strict=True)]
    return "\n".join(x for x, own in zip(lines, kept, strict=True) if own)


#: Bits of the table from which a longest common subsequence is read off; larger problems are halved.
TABLE_BITS = 1 << 26


def _rows(a: list, b: list, keep: bool):
    """Bit-parallel rows of the alignment of ``a`` with ``b``: bit j of row i is 0 where a common subsequence of a[:i]
    and b[:j + 1] is longer than of b[:j]. All of them, or the last."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else v


def _lengths(row: int, n: int) -> np.ndarray:
    """How long the common subsequences with each beginning of ``b`` are."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _align(a: list, b: list, i0: int, j0: int, out: list) -> None:
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.append((i0, j0 + b.index(a[0])))
        return
    if len(a) * len(b) > TABLE_BITS:  # both halves are aligned where their lengths add up to most
        mid = len(a) // 2
        head = _lengths(_rows(a[:mid], b, False), len(b))
        tail = _lengths(_rows(a[:mid - 1:-1], b[::-1], False), len(b))[::-1]
        j = int(np.argmax(head + tail))
        _align(a[:mid], b[:j], i0, j0, out)
        _align(a[mid:], b[j:], i0 + mid, j0 + j, out)
        return
    rows, found, i, j = _rows(a, b, True), [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append((i0 + i, j0 + j))
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    out += found[::-1]


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of lines as pairs of places. Memory is bounded by TABLE_BITS and the lines."""
    both = set(a) & set(b)
    i, j = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    out: list[tuple[int, int]] = []
    _align([a[k] for k in i], [b[k] for k in j], 0, 0, out)
    return [(i[x], j[y]) for x, y in out]


#: Pages that share at least this part of their characters are taken for versions of one text, not for pages in one frame.
COPY = 0.8
#: Most pages in a range of the sort, and fewest.
MOST_PAGES, LEAST_PAGES = 50_000, 1000

_LINE = np.dtype([("hash", "<u8"), ("size", "<u4")])


def fingerprint(every: list[tuple[str, bool]]) -> tuple[bytes, bytes]:
    """(hash and length of every line, name of the text that they hold). Lines in elements that name another purpose have
    other hashes than the same words in the text (a menu may hold a neighbour's title), length 0 and no part in the name."""
    out = np.empty(len(every), _LINE)
    for i, (x, plain) in enumerate(every):
        raw = x.encode("utf-8", "surrogatepass")
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=b"" if plain else b"frame").digest(), "little"), len(x) if plain else 0
    return out.tobytes(), hashlib.blake2b(out[out["size"] > 0].tobytes(), digest_size=16).digest()


def shared_lines(page: np.ndarray, other: np.ndarray) -> set[int] | None:
    """Places, among the lines of its text, of those that ``page`` shares with ``other``; None when the two are versions of
    one text."""
    pairs = common_lines(page["hash"].tolist(), other["hash"].tolist())
    both = sum(int(page["size"][i]) for i, _ in pairs)
    most = max(int(page["size"].sum()), int(other["size"].sum()))
    place = np.cumsum(page["size"] > 0) - 1
    return None if both >= COPY * most else {int(place[i]) for i, _ in pairs if page["size"][i]}


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _parsed(pages: DataFrame, fields: str, make) -> DataFrame:
    """``make(row, page) -> values or None`` over (page_id, url, html, host, path) and the parsed page."""
    schema = T._parse_datatype_string(fields)
    schema = T.StructType([T.StructField(f.name, pages.schema["page_id"].dataType if f.name == "page_id" else f.dataType) for f in schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for a, b, _ in pieces(batch.column(2)):
                rows = zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True)
                out = [v for row in rows if (v := make(row, Page(row[2]))) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    ready = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return ready.mapInArrow(run, schema)


def _frames(keys: DataFrame) -> DataFrame:
    """(host, name, shared): for every text of a host the places of the lines it shares with its neighbour, if there are any.

    Contents are dealt out by ranges of (host, path, page_id), so that a host of any size is split, and each range also
    gets the contents next to it, so that the ranges change no result."""
    spark = keys.sparkSession
    first = keys.groupBy("host", "name").agg(F.min(F.struct("path", "page_id", "lines")).alias("k"))
    first = cut(first.select("host", F.col("k.path").alias("path"), F.col("k.page_id").alias("page_id"), "name", F.col("k.lines").alias("lines")))
    count, usual = first.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(usual, count // LEAST_PAGES), count // MOST_PAGES)
    order = ["host", "path", "page_id", "name"]
    dealt = cut(first.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    cols = dealt.columns
    whole = F.struct(*[c for c in cols if c != "part"])
    ends = cut(dealt.groupBy("part").agg(F.min_by(whole, F.struct(*order)).alias("low"), F.max_by(whole, F.struct(*order)).alias("high")))
    parts = sorted(r["part"] for r in ends.select("part").collect())  # a number for each range
    pairs = spark.createDataFrame([(x, y) for x, y in zip(parts, parts[1:], strict=False)], "part int, following int")
    given = [c for c in cols if c != "part"]
    late = ends.join(pairs, "part").select("high.*", F.col("following").alias("part"))
    early = ends.join(pairs.select(F.col("following").alias("part"), F.col("part").alias("before")), "part").select("low.*", F.col("before").alias("part"))
    halo = late.union(early).select(*given, F.lit(True).alias("halo"), "part")
    every = dealt.select(*given, F.lit(False).alias("halo"), "part").union(halo)

    def run(batches):
        def rows():
            for batch in batches:
                for host, path, _, name, lines, halo, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield (part, host), path, name, not halo, np.frombuffer(lines, _LINE)

        def settle(before, now, after):
            near = [(x, k) for k, x in enumerate((before, after)) if x is not None and x[0] == now[0]]
            for other, _ in sorted(near, key=lambda x: (-_alike(now[1], x[0][1]), x[1])):
                found = shared_lines(now[4], other[4])
                if found:  # another version of the text, or a page with nothing in common, leaves it to the other side
                    return now[0][1], now[2], np.array(sorted(found), "<u4").tobytes()
            return None

        out, before, now = [], None, None
        for after in rows():
            if now is not None and now[3] and (found := settle(before, now, after)):
                out.append(found)
            before, now = now, after
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if now is not None and now[3] and (found := settle(before, now, None)):
            out.append(found)
        yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["host", "name", "shared"])

    return cut(every.repartitionById(ranges, "part").sortWithinPartitions("part", *order).mapInArrow(run, "host string, name binary, shared binary"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text string, n_chars long, n_shared long) for every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by newlines; text is
    empty for null and empty pages. ``n_shared`` counts the lines outside marked frame elements that the neighbour has too,
    whether they go or the check by markup brings them back. A null URL has an empty host and path, and its neighbours are
    pages of that host. Of equally near neighbours the earlier in order of path, then page_id, is taken. Repeated rows are
    kept; an empty table gives an empty one; other columns are not read. The result does not depend on the number of
    partitions.
    """
    def key(row, page):
        return row[0], row[3], row[4], *fingerprint(page.every)

    def whole(row, page):
        return row[0], row[1], row[3], fingerprint(page.every)[1], page.lines, None if page.inside is None else bytes(page.inside)

    shared = _frames(cut(_parsed(pages, "page_id long, host string, path string, lines binary, name binary", key)))
    texts = _parsed(pages, "page_id long, url string, host string, name binary, lines array<string>, inside binary", whole).join(shared, ["host", "name"], "left")
    ready = texts.select("page_id", "url", "lines", "inside", "shared")
    schema = T.StructType([*ready.schema.fields[:2], *T._parse_datatype_string("text string, n_chars long, n_shared long").fields])

    def run(batches):
        for batch in batches:
            for a, b, _ in pieces(pc.binary_join(batch.column(2), "")):
                given = batch.slice(a, b - a)
                made = []
                for lines, inside, places in zip(*(c.to_pylist() for c in given.columns[2:]), strict=True):
                    gone = set(np.frombuffer(places, "<u4").tolist()) if places else set()
                    made.append((kept_lines(lines, None if inside is None else list(inside), gone), len(gone)))
                counts = [pa.array([len(x) for x, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([given.column(0), given.column(1), pa.array([x for x, _ in made], pa.string()), *counts], ["page_id", "url", "text", "n_chars", "n_shared"])

    return ready.mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
