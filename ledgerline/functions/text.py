"""Text kernel: Column functions with the string semantics the operators are defined by.

Patterns are compiled with Unicode classes and Unix line ends (``U``), so that digits, white space and word borders
of any script count and ``$`` and ``.`` only know the newline.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?Ud)"
UI = "(?Udi)"

# fixed values: scripts, and words that only say what legal form a company has
CJK = "[一-鿿㐀-䶿]"
CYRILLIC = "[Ѐ-ӿ]"
ARABIC = "[؀-ۿ]"
LEGAL_FORMS = "inc|llc|ltd|co|company|corp|corporation|gmbh|sa|srl|spa|plc"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The value as text, a missing one as the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def remembered(build):
    """Columns that ``build`` made from the same names before, for as long as the JVM they live in: long expressions take
    thousands of calls to put together."""
    kept: dict = {}

    @wraps(build)
    def call(*args):
        key = (SparkContext._gateway, args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return call


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def rewritten(value: Column, log: Column, rules: list[tuple]) -> Column:
    """The struct (v, l) of a text after ordered rules (pattern, replacement, action), each applied to its first match,
    and of the log with the action of every rule that was found in the running value. A text that no pattern matches is
    left alone at the cost of one match."""
    before = F.struct(value.alias("v"), log.alias("l"))
    out = before
    for pattern, replacement, action in rules:
        note = F.lit(action) if isinstance(action, str) else action
        out = let(out, lambda a, p=pattern, r=replacement, n=note: F.when(matches(a["v"], p), F.struct(replace_first(a["v"], p, r).alias("v"), F.array_append(a["l"], n).alias("l"))).otherwise(a))
    return F.when(matches(value, "|".join(f"(?:{p})" for p, _, _ in rules)), out).otherwise(before)


def matches(c: Column | str, pattern: str, flags: str = U) -> Column:
    return col(c).rlike(flags + pattern)


def replace_all(c: Column | str, pattern: str, replacement: str, flags: str = U) -> Column:
    return F.regexp_replace(col(c), F.lit(flags + pattern), F.lit(escape(replacement)))


def replace_first(c: Column | str, pattern: str, replacement: str) -> Column:
    """Only the first match: what precedes it is captured and put back."""
    return F.regexp_replace(col(c), F.lit(f"(?Uds)^(.*?)(?:{pattern})"), F.lit("$1" + escape(replacement)))


def escape(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def squeeze(c: Column | str, least: int = 1) -> Column:
    """Runs of at least ``least`` white-space characters become one space."""
    return F.regexp_replace(col(c), F.lit(rf"(?U)\s{{{least},}}"), F.lit(" "))


def is_blank(c: Column | str) -> Column:
    return strip(text(c)) == ""


def is_upper(c: Column | str) -> Column:
    """Has cased letters, all of them capitals."""
    c = col(c)
    return (F.upper(c) == c) & (F.lower(c) != c)


def title_case(c: Column | str) -> Column:
    """Every run of letters starts with a capital, also after an apostrophe or digit."""
    parts = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def first_nonempty(*values: Column | str) -> Column:
    """The first value that is not blank, stripped; else the empty text."""
    return F.coalesce(*[F.nullif(strip(text(v)), F.lit("")) for v in values], F.lit(""))


def normalize_text(c: Column | str) -> Column:
    """Lower case, ASCII letters and digits only, without legal forms, single spaces."""
    low = F.regexp_replace(F.lower(text(c)), F.lit(r"(?U)[^a-z0-9\s]"), F.lit(" "))
    return strip(squeeze(F.regexp_replace(low, F.lit(rf"(?U)\b(?:{LEGAL_FORMS})\b"), F.lit(" "))))


def lookup_key(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.lower(text(c)), F.lit("[^a-z0-9]+"), F.lit(" ")))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def token_set(c: Column | str) -> Column:
    return F.array_distinct(tokens(normalize_text(c)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct tokens; 0 if either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_similarity(left: Column | str, right: Column | str) -> Column:
    """Jaccard similarity of the sets of normalized tokens; 0 if either has none."""
    return set_similarity(token_set(left), token_set(right))


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """A number within bounds, three decimals; percentages are scaled, anything that is no number is the lower bound.
    NaN counts as the upper bound."""
    x = col(c).try_cast("double")
    if high == 1.0:
        x = F.when(x > 1, F.when(F.isnan(x), x).otherwise(x / 100)).otherwise(x)
    return F.when(x.isNull(), F.lit(low)).otherwise(F.round(F.greatest(F.lit(low), F.least(F.lit(high), x)), 3))


def repair_encoding(c: Column | str) -> Column:
    """Undo UTF-8 that was read as Latin-1, where marks of it show and the bytes are valid UTF-8; else unchanged.

    The check that every character is Latin-1 comes first: encoding would fail otherwise.
    """
    c = col(c)
    latin = c.rlike("^[\\x00-\\xFF]*$")
    raw = F.encode(F.when(latin, c), "ISO-8859-1")
    marked = c.contains("Ã") | c.contains("Â")
    return F.when(marked & latin & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(c)


def garble_ratio(c: Column | str) -> Column:
    """Runs of two or more characters U+00A1 to U+00FF, per character."""
    c = text(c)
    return F.regexp_count(c, F.lit("[Ã¡-ÿ]{2,}")) / F.greatest(F.length(c), F.lit(1))


def is_garbled(c: Column | str) -> Column:
    return garble_ratio(c) > 0.1


def json_object(c: Column | str) -> Column:
    """From the first ``{`` to the last ``}`` of the text, or null if there is none."""
    return F.nullif(F.regexp_extract(text(c), r"(?s)\{.*\}", 0), F.lit(""))


def chat_content(c: Column | str) -> Column:
    """The answer inside a chat response: the first choice's message, else its plain output."""
    c = col(c)
    return F.coalesce(F.get_json_object(c, "$.choices[0].message.content"), F.get_json_object(c, "$.output_text"), F.lit(""))


def literal_map(items: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def actions(*items: Column) -> Column:
    """The named actions that took place, in order; items are null where they did not."""
    return F.array_compact(F.array(*items))


def any_contains(array: Column | str, part: str) -> Column:
    return F.exists(col(array), lambda x: x.contains(part))


def in_any(c: Column, values: Iterable[str]) -> Column:
    return c.isin(list(values))
