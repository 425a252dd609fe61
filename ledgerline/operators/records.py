"""First pass over raw records: composite addresses, encoding, names, addresses, language, quality."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x

DELIMITER = "|#|#"
PARSED = ["parsed_street", "parsed_city", "parsed_state", "parsed_country", "parsed_postal"]
REPAIRED = ["SOURCE_NAME", "FULL_ADDRESS", "parsed_street", "parsed_city", "parsed_state", "name_reason", "address_reason"]


def split_address(df: DataFrame, column: str = "FULL_ADDRESS") -> DataFrame:
    """``FULL_ADDRESS`` split into five stripped parts; missing parts are empty, further ones dropped."""
    parts = F.split(F.col(column), re.escape(DELIMITER).replace("\\#", "#"), -1)
    return df.withColumns({name: x.strip(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))) for i, name in enumerate(PARSED)})


def repair_at_load(df: DataFrame, column: str = "FULL_ADDRESS") -> DataFrame:
    return df.withColumn(column, x.repair_encoding(column))


def repair_columns(df: DataFrame, columns=REPAIRED) -> DataFrame:
    """Repair every named column that is there; ``flag_encoding_repaired`` tells whether any changed."""
    here = [c for c in columns if c in df.columns]
    fixed = {c: x.repair_encoding(c) for c in here}
    changed = reduce(lambda a, b: a | b, [x.text(c) != x.text(fixed[c]) for c in here], F.lit(False))
    return df.withColumns({**fixed, "flag_encoding_repaired": changed})


def repair_counts(df: DataFrame, columns=REPAIRED) -> DataFrame:
    """Values that repair would change, by column: (column_name, repaired)."""
    here = [c for c in columns if c in df.columns]
    one = df.agg(*[F.count_if(x.text(c) != x.text(x.repair_encoding(c))).alias(c) for c in here])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("repaired")) for c in here])).alias("r")).select("r.*")


# fixed values: what company names are stripped of, in order (pattern, action)
NAME_RULES = [
    (r"\s*\([^)]*\)\s*$", "removed_parenthetical", ""),
    (r"\s+C/[oO]\s+.*$", "removed_care_of", "i"),
    (r"\s*-\s*Recap\s+\w+$", "removed_dept_code", "i"),
    (r"\s*-\s*Mot$", "removed_dept_code", "i"),
    (r"\s*-\s*\d+$", "removed_dept_code", ""),
    (r"\s+[A-Z]{2,4}\d{4,}$", "removed_alphanum_code", ""),
    (r"\s+Run\s+Rate$", "removed_run_rate", "i"),
]


@x.remembered
def cleaned(column: str) -> Column:
    """The struct (v, parts, l) of a name after ``NAME_RULES``: the name, what was taken off, and the log. Names that no
    rule matches are left alone at the cost of one match."""
    none = F.array().cast("array<string>")

    def rules(start: Column) -> Column:
        out = F.struct(start.alias("v"), none.alias("parts"), none.alias("l"))
        for pattern, action, flags in NAME_RULES:
            full = f"(?Ud{flags}){pattern}"

            def step(a, full=full, action=action):
                cut = F.struct(
                    x.strip(F.regexp_replace(a["v"], F.lit(full), F.lit(""))).alias("v"), F.array_append(a["parts"], x.strip(F.regexp_extract(a["v"], full, 0))).alias("parts"), F.array_append(a["l"], F.lit(action)).alias("l")
                )
                return F.when(a["v"].rlike(full), cut).otherwise(a)

            out = x.let(out, step)
        return F.when(start.rlike("|".join(f"(?Ud{flags}:{p})" for p, _, flags in NAME_RULES)), out).otherwise(F.struct(start.alias("v"), none.alias("parts"), none.alias("l")))

    return x.let(x.strip(x.text(column)), rules)


def clean_names(df: DataFrame, column: str = "SOURCE_NAME") -> DataFrame:
    """``cleaned_name``, ``name_removed_parts`` and ``name_cleaning_actions``."""
    df = df.withColumn("_f", cleaned(column))
    tail = F.regexp_replace(F.col("_f.v"), F.lit(r"(?Ud)\s*[-–—]\s*$"), F.lit(""))
    return df.withColumns({"cleaned_name": x.strip(x.squeeze(x.strip(tail), 2)), "name_removed_parts": F.col("_f.parts"), "name_cleaning_actions": F.col("_f.l")}).drop("_f")


@x.remembered
def rewritten_column(column: str, log: str, rules: tuple) -> Column:
    return x.rewritten(F.col(column), F.col(log), rules)


def fold(df: DataFrame, column: str, log: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Apply ordered rules to a column and log what was done, as ``text.rewritten``."""
    df = df.withColumn("_f", rewritten_column(column, log, tuple(rules)))
    return df.withColumns({column: F.col("_f.v"), log: F.col("_f.l")}).drop("_f")


def settled(df: DataFrame) -> DataFrame:
    """The same rows and columns, out of an ``inline`` of one struct. Filters on the columns stay above it: pushed down
    below the rules, a condition would have them applied a second time."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def street_rules() -> list[tuple[str, str, str]]:
    out = []
    for short, full in t.STREET_WORDS:
        literal = re.escape(short).replace("\\/", "/")
        out.append((literal if short.endswith(".") else rf"\b{literal}\b", full, f"expanded_{short}"))
    return out


def country_from_address(street: Column, city: Column, state: Column, country: Column, postal: Column, with_postal: bool) -> list[tuple[str, str, Column]]:
    """The ordered tests for a mistaken code GU: (right country, name, test)."""
    code = F.upper(x.strip(state))
    zip_ = F.upper(F.regexp_replace(postal, F.lit(r"(?U)\s+"), F.lit("")))
    if with_postal:
        hay = F.concat_ws(" ", F.lower(street), F.lower(city), F.lower(code), F.lower(zip_))
    else:
        hay = F.lower(F.concat_ws(" ", street, city, state))
    gu = F.upper(x.strip(country)) == "GU"
    return [
        ("GG", "guernsey", gu & (zip_.startswith("GY") | hay.contains("guernsey"))),
        ("JE", "jersey", gu & (zip_.startswith("JE") | hay.contains("jersey"))),
        ("GT", "guatemala", gu & hay.contains("guatemala")),
        ("ES", "guadalajara", gu & ((code == "GU") | hay.contains("guadalajara") | zip_.startswith("18") | zip_.startswith("19"))),
    ]


def first_of(tests: list[tuple], pick, otherwise: Column) -> Column:
    out = None
    for test in tests:
        out = F.when(test[2], pick(test)) if out is None else out.when(test[2], pick(test))
    return out.otherwise(otherwise)


def normalize_addresses(df: DataFrame) -> DataFrame:
    """``norm_street``, ``norm_city``, ``norm_state``, ``norm_country``, ``norm_postal`` and ``normalization_actions``."""
    street = F.col("parsed_street")
    broken = street.contains("\n")
    df = df.withColumns(
        {
            "norm_street": F.when(broken, x.strip(F.regexp_replace(street, F.lit("\\n+"), F.lit(", ")))).otherwise(street),
            "normalization_actions": F.when(broken, F.array(F.lit("fixed_embedded_newlines"))).otherwise(F.array().cast("array<string>")),
        }
    )
    df = fold(df, "norm_street", "normalization_actions", street_rules())
    df = df.withColumn("norm_street", x.strip(x.squeeze(F.regexp_replace("norm_street", F.lit(r"(?U)N[º°]\.?\s*"), F.lit("No. ")), 2)))
    state, city = x.strip("parsed_state"), x.strip("parsed_city")
    known = F.try_element_at(x.literal_map(t.STATES_FIRST_PASS), F.upper(state))
    shout = x.is_upper(city) & (F.length(city) > 2)
    df = df.withColumns({"_state": F.coalesce(known, state), "_state_action": F.when(known.isNotNull(), F.concat(F.lit("expanded_state_"), state)), "norm_city": F.when(shout, x.title_case(city)).otherwise(city), "_city_action": F.when(shout, F.lit("titlecased_city")), "norm_postal": x.strip("parsed_postal")})
    tests = country_from_address(F.col("norm_street"), F.col("norm_city"), F.col("_state"), F.col("parsed_country"), F.col("parsed_postal"), True)
    df = df.withColumns(
        {
            "norm_country": first_of(tests, lambda r: F.lit(r[0]), F.upper(x.strip("parsed_country"))),
            "_country_action": first_of(tests, lambda r: F.lit(f"country_gu_to_{r[0].lower()}_{r[1]}"), F.lit(None).cast("string")),
        }
    )
    province = F.try_element_at(x.literal_map(t.STATES_ES), F.upper("_state"))
    spain = (F.col("norm_country") == "ES") & province.isNotNull()
    return df.withColumns(
        {
            "norm_state": F.when(spain, province).otherwise(F.col("_state")),
            "normalization_actions": F.concat("normalization_actions", x.actions(F.col("_state_action"), F.col("_city_action"), F.col("_country_action"), F.when(spain, F.concat(F.lit("expanded_es_state_"), F.col("_state"))))),
        }
    ).drop("_state", "_state_action", "_city_action", "_country_action")


# fixed values: words and letters that tell languages apart where the script does not
LANGUAGE_WORDS = {
    "de": "der die und das ist nicht mit von den für auf ein eine im dem des sich auch als es an werden aus".split(),
    "en": "the of and to in is that for it with as was on be at by this are from or an not have which you".split(),
    "es": "el la los de y que en un una es por con para las se del al lo como más su no mi ha".split(),
    "fr": "le la les de et des un une est que dans pour qui sur pas du avec au par plus ce en sont il elle".split(),
}


def score_languages(words: Column) -> dict[str, Column]:
    """How many of the words are function words of each language."""
    one = lambda own: F.size(F.filter(words, lambda w: w.isin(own)))
    return {lang: one(own) for lang, own in LANGUAGE_WORDS.items()}


def language_by_words(c: Column | str) -> Column:
    """The language with most function words, in order of code among equals; null without any. A deterministic stand-in
    for a statistical detector."""
    words = F.regexp_extract_all(F.lower(x.text(c)), F.lit(r"(\p{L}+)"), F.lit(1))
    scores = score_languages(words)
    best = F.greatest(*scores.values())
    out = None
    for lang, s in scores.items():
        out = F.when(s == best, lang) if out is None else out.when(s == best, lang)
    return F.when(best > 0, out)


def detect_language(df: DataFrame, name: str = "cleaned_name", street: str = "parsed_street", country: str = "parsed_country", statistical: Column | None = None) -> DataFrame:
    """``detected_lang`` and ``lang_method``: by script, else by ``statistical`` (a Column that may be null; by default the
    function-word scorer) where the text is longer than ten characters, else by country."""
    both = x.strip(F.concat_ws(" ", x.text(name), x.text(street)))
    guess = language_by_words(both) if statistical is None else statistical
    guess = F.when(F.length(both) > 10, guess)
    by_country = F.coalesce(F.try_element_at(x.literal_map(t.COUNTRY_LANGUAGE), F.upper(x.text(country))), F.lit("unknown"))
    lang = F.when(both.rlike(x.CJK), "zh").when(both.rlike(x.CYRILLIC), "ru").when(both.rlike(x.ARABIC), "ar").when(guess.isNotNull(), guess).otherwise(by_country)
    method = F.when(both.rlike(x.CJK), "script_cjk").when(both.rlike(x.CYRILLIC), "script_cyrillic").when(both.rlike(x.ARABIC), "script_arabic").when(guess.isNotNull(), "function_words").otherwise("country_fallback")
    return df.withColumns({"detected_lang": lang, "lang_method": method})


FLAGS = ["flag_no_street", "flag_no_street_number", "flag_no_city", "flag_no_state", "flag_no_postal", "flag_garbled_text", "flag_encoding_repaired", "flag_complex_address", "flag_name_has_codes", "flag_non_latin"]


def flag_quality(df: DataFrame) -> DataFrame:
    """Ten flags, ``api_ready``, ``needs_translation`` and ``quality_tier``."""
    if "flag_encoding_repaired" not in df.columns:
        df = df.withColumn("flag_encoding_repaired", F.lit(False))
    both = F.concat(x.text("norm_street"), x.text("cleaned_name"))
    flags = {
        "flag_no_street": x.is_blank("parsed_street"),
        "flag_no_street_number": ~x.is_blank("parsed_street") & ~x.matches(x.text("parsed_street"), r"\d"),
        "flag_no_city": x.is_blank("parsed_city"),
        "flag_no_state": x.is_blank("parsed_state"),
        "flag_no_postal": x.is_blank("parsed_postal"),
        "flag_garbled_text": x.is_garbled("norm_street") | x.is_garbled("cleaned_name"),
        "flag_complex_address": F.length(x.text("norm_street")) > 80,
        "flag_name_has_codes": x.in_any(x.text("name_sub_category"), t.CODED_NAMES),
        "flag_non_latin": both.rlike(x.CJK) | both.rlike(x.CYRILLIC),
    }
    df = df.withColumns(flags)
    f = F.col
    df = df.withColumn("api_ready", ~(f("flag_no_street") | f("flag_garbled_text") | f("flag_no_city")))
    return df.withColumns(
        {
            "needs_translation": f("flag_non_latin") & f("api_ready"),
            "quality_tier": F.when(f("flag_no_street") | f("flag_garbled_text"), "CRITICAL").when(f("flag_no_state") | f("flag_no_postal") | f("flag_no_street_number"), "INCOMPLETE").when(f("flag_complex_address") | f("flag_non_latin"), "NEEDS_PREP").otherwise("READY"),
        }
    )


def first_pass(raw: DataFrame, statistical: Column | None = None) -> DataFrame:
    """Everything of the first pass, in its order: repair, split, repair again with the flag, names, addresses,
    language, flags."""
    df = repair_columns(split_address(repair_at_load(raw)))
    return settled(flag_quality(detect_language(normalize_addresses(clean_names(df)), statistical=statistical)))
