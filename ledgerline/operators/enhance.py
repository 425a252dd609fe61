"""Second pass: multilingual street rules, structure, states, postal codes, country checks, completeness, composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x
from ..sources.providers import ask_once
from ..sources.store import cut
from .records import country_from_address, first_of, settled

LOG = "enhanced_preprocessing_actions"


def as_text(c: Column | str, missing: str = "empty") -> Column:
    """A field as the second pass reads it: missing values are empty, or the text ``nan`` where records were handed over
    as CSV (``missing='nan_text'``)."""
    c = x.col(c)
    if missing == "nan_text":
        return F.when(c.isNull() | c.isin(t.MISSING), F.lit("nan")).otherwise(c)
    return x.text(c)


@x.remembered
def by_own_rules(column: str, log: str, lang: str) -> Column:
    """The struct (v, l) of a street after the rules of its language; unchanged for English and languages without."""
    out = None
    for key, rules in t.STREET_RULES.items():
        if key != "en":
            done = x.rewritten(F.col(column), F.col(log), [(p, r, f"expanded_{p[:15]}") for p, r in rules])
            out = F.when(F.col(lang) == key, done) if out is None else out.when(F.col(lang) == key, done)
    return out.otherwise(F.struct(F.col(column).alias("v"), F.col(log).alias("l")))


@x.remembered
def by_english_rules(column: str, log: str, prefix: str) -> Column:
    return x.rewritten(F.col(column), F.col(log), [(p, r, F.concat(prefix, F.lit(p[:15]))) for p, r in t.STREET_RULES["en"]])


def expand_streets(df: DataFrame, column: str = "enhanced_street", log: str = LOG, lang: str = "detected_lang") -> DataFrame:
    """The language's own rules (English for a language without), then the English ones for the others."""
    prefix = F.when(F.col(lang).isin([k for k in t.STREET_RULES if k != "en"]), "expanded_en_").otherwise("expanded_")
    df = df.withColumns({"_f": by_own_rules(column, log, lang), "_prefix": prefix}).withColumn("_f", by_english_rules("_f.v", "_f.l", "_prefix"))
    return df.withColumns({column: F.col("_f.v"), log: F.col("_f.l")}).drop("_f", "_prefix")


def clean_structure(df: DataFrame, column: str = "enhanced_street", log: str = LOG) -> DataFrame:
    """Line breaks and doubled commas become commas; punctuation at the ends goes; number signs are spelled alike."""
    c = F.col(column)
    note = lambda hit, name: F.when(hit, F.array_append(log, F.lit(name))).otherwise(F.col(log))
    hit = c.contains("\n")
    df = df.withColumns({column: F.when(hit, x.strip(x.replace_all(c, r"\s*\n+\s*", ", "))).otherwise(c), log: note(hit, "fixed_newlines")})
    hit = c.contains(",,") | c.contains(", ,")
    df = df.withColumns({column: F.when(hit, x.replace_all(c, r",\s*,+", ",")).otherwise(c), log: note(hit, "fixed_double_commas")})
    df = df.withColumn(column, x.squeeze(x.strip(x.replace_all(c, r"^[,.\s]+|[,.\s]+$", "")), 2))
    hit = c.rlike("N[º°]")
    return df.withColumns({column: F.when(hit, x.replace_all(c, r"N[º°]\.?\s*", "No. ")).otherwise(c), log: note(hit, "normalized_number_sign")})


def expand_state(state: Column, country: Column) -> tuple[Column, Column]:
    """(state, action or null) by country; Mexican abbreviations with or without their dot."""
    code = F.upper(x.strip(state))
    mx = dict(t.STATES_MX)
    for k, v in t.STATES_MX.items():
        mx.setdefault(k.rstrip("."), v)
    full = F.when(country == "MX", F.try_element_at(x.literal_map(mx), code)).when(country == "ES", F.try_element_at(x.literal_map(t.STATES_ES), code))
    action = F.when(full.isNotNull(), F.concat(F.when(country == "MX", F.lit("expanded_state_")).otherwise("expanded_es_state_"), state))
    return F.coalesce(full, state), action


def normalize_postal(postal: Column, country: Column) -> tuple[Column, Column]:
    """(postal code, action or null) in the format of the country."""
    p = x.strip(postal)
    digits = F.regexp_replace(p, F.lit("[^0-9]"), F.lit(""))
    tight = F.upper(F.regexp_replace(p, F.lit(r"(?U)\s+"), F.lit("")))
    n = F.length(digits)
    gap = lambda c, k: F.concat(F.left(c, F.lit(k)), F.lit("-"), F.substr(c, F.lit(k + 1)))
    rules = [
        ((country == "US") & (n == 9), gap(digits, 5), F.lit("formatted_zip_plus4")),
        ((country == "US") & (n >= 5), F.left(digits, F.lit(5)), F.lit("normalized_zip5")),
        ((country == "CA") & (F.length(tight) == 6) & x.matches(tight, r"^[A-Z]\d[A-Z]\d[A-Z]\d"), F.concat(F.left(tight, F.lit(3)), F.lit(" "), F.substr(tight, F.lit(4))), F.lit("formatted_ca_postal")),
        (country.isin("GB", "GG", "JE") & (F.length(tight) >= 5), F.concat(F.left(tight, F.length(tight) - 3), F.lit(" "), F.right(tight, F.lit(3))), F.lit("formatted_uk_postal")),
        (country.isin("DE", "ES", "IT", "FR", "BE", "NL", "AT") & (n > 0), digits, F.lit("cleaned_eu_postal")),
        ((country == "BR") & (n == 8), gap(digits, 5), F.lit("formatted_br_postal")),
        (country.isin("CN", "RU", "SA", "MX", "CL", "GT") & (n > 0), digits, F.concat(F.lit("cleaned_"), F.lower(country), F.lit("_postal"))),
    ]
    empty = (p == "") | (p == "nan")
    value = F.when(empty, F.lit(""))
    action = F.when(empty, F.lit(None).cast("string"))
    for test, v, a in rules:
        value, action = value.when(test, v), action.when(test, a)
    return value.otherwise(p), action


GU_REASONS = {
    "GG": "GU code is Guam; address content indicates Guernsey",
    "JE": "GU code is Guam; address content indicates Jersey",
    "GT": "GU code is Guam; address content indicates Guatemala",
    "ES": "GU appears to be Spanish province Guadalajara, not country Guam",
}


def infer_country(street: Column, city: Column, state: Column, country: Column, postal: Column) -> tuple[Column, Column]:
    """(country, reason or null)."""
    tests = country_from_address(street, city, state, country, postal, False)
    return first_of(tests, lambda r: F.lit(r[0]), F.upper(x.strip(country))), first_of(tests, lambda r: F.lit(GU_REASONS[r[0]]), F.lit(None).cast("string"))


def check_country(df: DataFrame, street="enhanced_street", city="norm_city", state="enhanced_state", country="norm_country", name="cleaned_name", postal="enhanced_postal") -> DataFrame:
    """``country_validated``, ``country_mismatch_reason``, ``suggested_country``; a later finding replaces an earlier one."""
    s, c, st, co, na, po = (x.text(v) for v in (street, city, state, country, name, postal))
    inferred, why = infer_country(s, c, st, co, po)
    df = df.withColumns({"_c": F.when(why.isNotNull(), inferred).otherwise(co), "_why": why})
    hay = F.concat_ws(" ", s, c, na)
    now = F.col("_c")
    script = hay.rlike(x.CJK) & ~now.isin(t.CJK_COUNTRIES)
    inland = hay.rlike(x.CJK) & (now == "HK") & hay.rlike("|".join(t.MAINLAND_CITIES))
    df = df.withColumns({"_c": F.when(script | inland, "CN").otherwise(now), "_why": F.when(script, "CJK characters in address but country is not CJK").when(inland, "Address contains mainland China city but tagged as HK").otherwise(F.col("_why"))})
    expected = F.try_element_at(x.literal_map(t.CITY_COUNTRY), F.lower(x.strip(c)))
    wrong = expected.isNotNull() & (F.col("_c") != expected)
    message = F.concat(F.lit("City '"), c, F.lit("' typically in "), expected, F.lit(", tagged as "), co)
    df = df.withColumns({"suggested_country": F.when(wrong, expected).otherwise(F.col("_c")), "country_mismatch_reason": F.coalesce(F.when(wrong, message).otherwise(F.col("_why")), F.lit(""))})
    return df.withColumn("country_validated", F.col("country_mismatch_reason") == "").drop("_c", "_why")


def completeness_tests(street: Column, city: Column, state: Column, country: Column, postal: Column) -> dict[str, Column]:
    s = {k: x.strip(v) for k, v in (("street", street), ("city", city), ("state", state), ("country", country), ("postal", postal))}
    return {
        "has_street": F.length(s["street"]) > 2,
        "has_street_number": x.matches(street, r"\d"),
        "has_city": F.length(s["city"]) > 1,
        "has_state": (s["state"] != "") & (s["state"] != "nan"),
        "has_country": F.length(s["country"]) == 2,
        "has_postal": (s["postal"] != "nan") & (F.length(s["postal"]) >= 3),
    }


def score_completeness(df: DataFrame, street="enhanced_street", city="norm_city", state="enhanced_state", country="suggested_country", postal="enhanced_postal") -> DataFrame:
    """``completeness_score``, ``completeness_class`` and the struct ``completeness_details``."""
    tests = completeness_tests(*(x.text(c) for c in (street, city, state, country, postal)))
    df = df.withColumn("completeness_details", F.struct(*[v.alias(k) for k, v in tests.items()]))
    d = lambda k: F.col(f"completeness_details.{k}")
    n = sum((d(k).cast("int") for k in list(tests)[1:]), d("has_street").cast("int"))
    kind = F.when((n >= 5) & d("has_street") & d("has_street_number"), "FULL").when((n >= 3) & d("has_city"), "PARTIAL").when(n >= 2, "MINIMAL").otherwise("EMPTY")
    return df.withColumns({"completeness_score": F.round(n / len(tests), 2), "completeness_class": kind})


def compose(street: Column, city: Column, state: Column, country: Column, postal: Column) -> Column:
    """The parts that are there, joined by commas; a state equal to the country is left out."""
    s, c, st, co, p = (x.strip(v) for v in (street, city, state, country, postal))
    keep = lambda v, ok: F.when(ok & (v != ""), v)
    yes = F.lit(True)
    return F.concat_ws(", ", keep(s, yes), keep(c, yes), keep(st, (st != "nan") & (F.upper(st) != F.upper(co))), keep(p, p != "nan"), keep(co, yes))


NOT_TRANSLATED = "Azure Translator failed; Unicode source fields retained. "
NOT_CONFIGURED = ("TRANSLATION_NOT_CONFIGURED", "Azure Translator is not enabled/configured; Unicode source fields are retained.")


def api_fields(df: DataFrame, translations: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """``api_address``, ``api_strategy``, ``needs_translation`` and the translation columns.

    ``translations`` (key, street, city, state, name, status, reason) are a translator's answers; without them every
    record that needs translation is left as it is and says so. Scores keep to the untranslated text.
    """
    lang = F.col("detected_lang")
    need = lang.isin(t.UNICODE_LANGUAGES + t.TRANSLITERATED_LANGUAGES)
    names = ["street", "city", "state", "name"]
    if translations is not None:
        answers = translations.select(key, *[F.col(n).alias(f"_t_{n}") for n in names], F.col("status").alias("_t_status"), F.col("reason").alias("_t_reason"))
        df = df.join(answers, key, "left")
        got = {n: F.when(need, x.text(f"_t_{n}")).otherwise("") for n in names}
        status, reason = F.coalesce("_t_status", F.lit(NOT_CONFIGURED[0])), F.coalesce("_t_reason", F.lit(NOT_CONFIGURED[1]))
    else:
        got = {n: F.lit("") for n in names}
        status, reason = F.lit(NOT_CONFIGURED[0]), F.lit(NOT_CONFIGURED[1])
    df = df.withColumns({f"translated_{n}": got[n] for n in names})
    either = lambda n, c: F.coalesce(F.nullif(F.col(f"translated_{n}"), F.lit("")), x.text(c))
    out = df.withColumns(
        {
            "api_address": compose(either("street", "enhanced_street"), either("city", "norm_city"), either("state", "enhanced_state"), x.text("suggested_country"), x.text("enhanced_postal")),
            "api_strategy": F.when(lang.isin(t.UNICODE_LANGUAGES), "direct_cjk").when(lang.isin(t.TRANSLITERATED_LANGUAGES), "needs_transliteration").otherwise("direct"),
            "needs_translation": F.coalesce(need, F.lit(False)),
            "translation_handling_status": F.when(need, status).otherwise("NOT_NEEDED_LATIN_SCRIPT"),
            "translation_gap_reason": F.when(need, reason).otherwise(""),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_t_")])


TRANSLATED = "array<struct<translations:array<struct<text:string>>>>"
TRANSLATION_FIELDS = {"street": "enhanced_street", "city": "norm_city", "state": "enhanced_state", "name": "cleaned_name"}


def translate(df: DataFrame, resolve, key: str = "row_id") -> DataFrame:
    """(key, street, city, state, name, status, reason): a translator's answers to the records that need one. Only fields
    that are not blank are sent, and answers come in their order."""
    need = df.filter(F.col("detected_lang").isin(t.UNICODE_LANGUAGES + t.TRANSLITERATED_LANGUAGES))
    need = need.select(key, *[x.strip(x.text(c)).alias(n) for n, c in TRANSLATION_FIELDS.items()], F.col("detected_lang").alias("lang"))
    names = list(TRANSLATION_FIELDS)
    sent = [F.col(n) != "" for n in names]
    any_sent = reduce(lambda a, b: a | b, sent)
    said = ask_once(need, [*names, "lang"], resolve, "_said", order=key, wanted=any_sent)
    items = F.from_json("_said", TRANSLATED)
    good = items.isNotNull() & F.col("_said_error").isNull()
    place = lambda i: reduce(lambda a, b: a + b, [s.cast("int") for s in sent[:i]], F.lit(0))
    fields = [F.when(good & sent[i], x.text(F.get(F.get(items, place(i))["translations"], F.lit(0))["text"])).otherwise("").alias(n) for i, n in enumerate(names)]
    why = F.concat(F.lit(NOT_TRANSLATED), F.left(F.coalesce("_said_error", F.lit("no JSON")), F.lit(120)))
    status = F.when(~any_sent, "TRANSLATION_SKIPPED_EMPTY_FIELDS").when(good, "TRANSLATED_TO_ENGLISH").otherwise("TRANSLATION_ERROR")
    reason = F.when(~any_sent, "No non-empty fields were available for translation.").when(good, "").otherwise(why)
    return said.select(key, *fields, status.alias("status"), reason.alias("reason"))


def second_pass(df: DataFrame, translations: DataFrame | None = None, missing: str = "empty", translator=None, key: str = "row_id") -> DataFrame:
    """Everything of the second pass, in its order. ``translator`` is a provider that is asked where ``translations`` are
    not given."""
    fields = {c: as_text(c, missing) for c in ("norm_street", "norm_city", "norm_state", "norm_country", "norm_postal", "cleaned_name", "detected_lang")}
    df = df.withColumns(fields).withColumns({"enhanced_street": F.col("norm_street"), LOG: F.array().cast("array<string>")})
    df = clean_structure(expand_streets(df))
    state, state_action = expand_state(F.col("norm_state"), F.col("norm_country"))
    postal, postal_action = normalize_postal(F.col("norm_postal"), F.col("norm_country"))
    df = df.withColumns({"enhanced_state": state, "enhanced_postal": postal, LOG: F.concat(LOG, x.actions(state_action, postal_action))})
    df = score_completeness(check_country(df))
    if translations is None and translator is not None:
        df = cut(df)
        translations = translate(df, translator, key)
    return settled(api_fields(df, translations, key))
