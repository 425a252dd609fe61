"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest that fits decides. A page without a rule takes its decision from the
addresses it is equivalent to: those it is connected with over redirects (meta refresh, and rows of a redirect table)
and canonical links. Components are found by distributed stars; an address explicitly allowed anywhere in a component
outweighs a block, and without either the page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

# fixed values
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
#: Parts of a page that hold no tags of its own.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. Of equally long rules the first given wins."""
    rule = verdict = F.lit(None).cast("string")
    for name, what in sorted(reversed(list(rules)), key=lambda r: len(r[0])):
        domain, _, prefix = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or bare; empty without it."""
    found = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    bare = F.regexp_replace(found, rf"(?is)^{name}\s*=\s*", "")
    return F.replace(F.trim(F.regexp_replace(bare, r"^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&"))


def address(url: Column) -> Column:
    """The address two links must share to be the same: without scheme, fragment or an empty path's slash."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    path = path_of(url)
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def _absolute(base: Column, target: Column) -> Column:
    """``target`` as a link on the page ``base``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)[^/]*$", 1)
    return (
        F.when(target == "", None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.rlike("^([#?]|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses joined by the canonical link or meta refresh of a page; pages without are left out early."""
    marked = pages.select("url", "html").filter(F.col("html").rlike(r"(?i)<link\b|\brefresh\b") & F.col("url").contains("://"))
    clean = marked.withColumn("html", F.regexp_replace("html", _HIDDEN, " "))
    link = _attribute(F.regexp_extract("html", _LINK, 0), "href")
    meta = _attribute(F.regexp_extract("html", _META, 0), "content")
    moved = F.trim(F.regexp_replace(F.regexp_extract(meta, r"(?is)url\s*=\s*(.*)$", 1), r"^['\"]|['\"]$", ""))
    both = clean.select("url", F.explode(F.array(link, moved)).alias("target")).filter("target <> ''")
    out = both.select(address(F.col("url")).alias("a"), address(_absolute(F.col("url"), F.col("target"))).alias("b"))
    return out.filter("a is not null and b is not null and a <> b")


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    ``redirects`` (source, target) adds edges between absolute URLs. A null URL, or one without ``://``, has an empty
    host and path, fits no rule, has no aliases and is allowed. Links that name no absolute address, loops and null
    or empty pages give no edges; repeated rows are kept; empty tables give an empty one; other columns are not read.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("source")), address(F.col("target"))).toDF("a", "b").filter("a <> b"))
    edges = cut(edges.distinct())
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("own", verdict)
    if edges.limit(1).count():
        comps = components(edges)
        # an address is judged by the rules whether or not a page of it was fetched
        full = F.concat(F.lit("x://"), F.col("node"))
        member = comps.select("node", "component", host_of(full).alias("host"), path_of(full).alias("path")).withColumn("v", verdict)
        word = member.groupBy("component").agg(F.max((F.col("v") == "allow").cast("int")).alias("allow"), F.max((F.col("v") == "block").cast("int")).alias("block"))
        said = word.select("component", F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").alias("said"))
        alias = cut(comps.join(said.filter("said is not null"), "component").select(F.col("node").alias("address"), "said"))
        judged = judged.withColumn("address", F.when(F.col("own").isNull(), address(F.col("url")))).join(alias, "address", "left")
    else:
        judged = judged.withColumn("said", F.lit(None).cast("string"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


#: The rules as SQL. Pages of these tables carry no canonical links or refreshes (the query finds and checks them; a
#: test covers them), so what no rule decides is allowed.
ORACLE = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
