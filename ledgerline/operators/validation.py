"""Address validation and correction: the simulated service, a service's recorded answers, the correction strategies
and the record's final state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x
from ..sources.providers import ask_once, request_key
from ..sources.store import cut
from .records import settled

RESULT = "struct<validation_status:string,formatted_address:string,latitude:double,longitude:double,validation_granularity:string,diagnostics:array<string>,has_unconfirmed:boolean,has_inferred:boolean,has_replaced:boolean,api_error:string>"


def hash_number(address: Column) -> Column:
    """The first 32 bits of the MD5 of the text, as a long."""
    return F.conv(F.substring(F.md5(address.cast("binary")), 1, 8), 16, 10).cast("long")


def comma_parts(address: Column) -> Column:
    return F.transform(F.split(address, ",", -1), x.strip)


def simulated(address: Column, country: Column) -> Column:
    """The deterministic validator's verdict on an address, from its form and its hash; null for a null address."""
    seen = F.struct(
        address.alias("a"), country.alias("c"), x.matches(address, r"\d").alias("number"), address.rlike(rf"(?Udi)\b({t.STREET_TYPES})\b").alias("street"),
        F.size(F.filter(comma_parts(address), lambda s: s != "")).alias("parts"), hash_number(address).alias("hash"),
    )

    def judged(v: Column) -> Column:
        a, c = v["a"], v["c"]
        points = (
            F.when(v["number"], 30).otherwise(0) + F.when(v["street"], 25).otherwise(0) + F.when(v["parts"] >= 3, 20).otherwise(0)
            + F.when(v["parts"] >= 4, 10).otherwise(0) + F.when(F.length(a) > 20, 10).otherwise(0) + F.when(c.isin(t.FAVOURED_COUNTRIES), 5).otherwise(0)
        )
        return x.let(F.struct(v.alias("v"), points.alias("score"), ((v["hash"] % 1000) / 1000.0).alias("frac")), decided)

    def decided(w: Column) -> Column:
        v, f, high = w["v"], w["frac"], w["score"] >= 70
        a, c, mid = v["a"], v["c"], w["score"] >= 40
        status = (
            F.when(high & (f < 0.65), "VALIDATED").when(high & (f < 0.90), "CORRECTED").when(high, "PARTIAL_MATCH")
            .when(mid & (f < 0.30), "CORRECTED").when(mid & (f < 0.60), "PARTIAL_MATCH").otherwise("FAILED")
        )
        no_number, no_street = ~v["number"], ~v["street"]
        say = lambda test, words: F.when(test, F.lit(words))
        corrected = high & (f >= 0.65) & (f < 0.90)
        routed = F.when(high, f >= 0.90).otherwise(mid & (f >= 0.30) & (f < 0.60))
        notes = x.actions(
            say(corrected & (c == "US") & ~x.matches(a, r"\d{5}"), "postal_code: inferred"),
            say(corrected & (f > 0.80), "street_number: confirmed with correction"),
            say(~high & mid & (f < 0.30), "street: partially matched and corrected"),
            say(~high & mid & (f < 0.30) & no_number, "street_number: missing, inferred from context"),
            say(routed, "address: matched to route level only"),
            say(~high & mid & (f >= 0.60), "address: insufficient match confidence"),
            say(~high & no_number & (~mid | (f >= 0.30)), "street_number: missing"),
            say(~high & mid & (f >= 0.60) & no_street, "street_name: unrecognized format"),
            say(~mid & no_street, "street_name: unrecognized"),
            say(~mid & (v["parts"] < 3), "address: insufficient components"),
        )
        return x.let(F.struct(v.alias("v"), f.alias("frac"), status.alias("status"), notes.alias("notes"), status.isin(t.EXACT).alias("good")), told)

    def told(w: Column) -> Column:
        v, f, good, status = w["v"], w["frac"], w["good"], w["status"]
        pieces = comma_parts(x.strip(v["a"]))
        n = F.size(pieces)
        formatted = F.when(n >= 2, F.concat_ws(", ", F.slice(pieces, F.lit(1), n - 1), F.upper(F.element_at(pieces, -1)))).otherwise(F.array_join(pieces, ", "))
        lat = F.coalesce(F.try_element_at(_numbers(t.LATITUDE), v["c"]), F.lit(40.0)) + (f - 0.5) * 5
        lon = F.coalesce(F.try_element_at(_numbers(t.LONGITUDE), v["c"]), F.lit(0.0)) + ((v["hash"] % 100) / 100.0 - 0.5) * 10
        return F.struct(
            status.alias("validation_status"), F.when(good, formatted).otherwise("").alias("formatted_address"), F.when(good, F.round(lat, 6)).alias("latitude"), F.when(good, F.round(lon, 6)).alias("longitude"),
            F.when(good, "PREMISE").when(status == "PARTIAL_MATCH", "ROUTE").otherwise("OTHER").alias("validation_granularity"), w["notes"].alias("diagnostics"), (~good).alias("has_unconfirmed"),
            x.any_contains(w["notes"], "inferred").alias("has_inferred"), (status == "CORRECTED").alias("has_replaced"), F.lit(None).cast("string").alias("api_error"),
        )

    return F.when(address.isNotNull(), x.let(seen, judged))


def simulate(df: DataFrame, address: str, country: str, out: str) -> DataFrame:
    """Adds the struct ``out``: ``simulated`` of the two columns."""
    return df.withColumn(out, simulated_column(address, country))


@x.remembered
def simulated_column(address: str, country: str) -> Column:
    return simulated(F.col(address), F.col(country))


@x.remembered
def strategies(address: str, notes: str) -> tuple[Column, ...]:
    """What each strategy makes of an address; null where it changes nothing."""
    a, said = F.col(address), F.col(notes)
    return tuple(F.nullif(c, F.lit("")) for c in (component_fix(a, said), simplify(a), broaden(a)))


def _numbers(items: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for pair in items.items() for v in pair])


# answers of a live service, as recorded

ANSWER = (
    "struct<results:array<struct<score:double,type:string,entityType:string,matchType:string,position:struct<lat:double,lon:double>,"
    "address:struct<freeformAddress:string,streetNumber:string,streetName:string,municipality:string,countrySubdivision:string,postalCode:string,countryCode:string>>>>"
)
COMPONENTS = [("street_number", "streetNumber"), ("street_name", "streetName"), ("municipality", "municipality"), ("country_subdivision", "countrySubdivision"), ("postal_code", "postalCode"), ("country", "countryCode")]


def type_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(x.text(c)), F.lit("[^a-z0-9]"), F.lit(""))


def canonical_address(c: Column) -> Column:
    c = F.lower(x.text(c))
    for pattern, word in t.ADDRESS_WORDS:
        c = x.replace_all(c, pattern, word)
    c = x.replace_all(c, t.COUNTRY_WORDS, " ")
    return x.strip(F.regexp_replace(c, F.lit("[^a-z0-9]+"), F.lit(" ")))


def addresses_equivalent(left: Column, right: Column) -> Column:
    """Equal but for spelling, or one a part of the other; blank addresses are equivalent to nothing."""
    return (left != "") & (right != "") & (left.contains(right) | right.contains(left))


def concrete_street(address: Column) -> Column:
    """The first part names a numbered street and nothing in the text is a placeholder."""
    head = x.strip(F.substring_index(address, ",", 1))
    return ~address.rlike(x.UI + t.PLACEHOLDERS) & (x.matches(head, r"\d") | head.rlike(rf"(?Udi)^\s*({t.NUMBER_WORDS})\b"))


def granularity(match: Column, result: Column, entity: Column, has_number: Column) -> Column:
    best = F.coalesce(F.nullif(match, F.lit("")), F.nullif(result, F.lit("")), entity)
    return (
        F.when(best == "pointaddress", "PREMISE")
        .when(best == "addressrange", F.when(has_number, "PREMISE").otherwise("ROUTE"))
        .when(best.isin("address", "streetaddress") & has_number, "PREMISE")
        .when(best.isin("street", "streetname"), "ROUTE")
        .when(best.isin(t.LOCALITIES), "LOCALITY")
        .otherwise("OTHER")
    )


def parse_answers(df: DataFrame, answer: str, address: str, out: str, error: str | None = None) -> DataFrame:
    """Adds ``out``, the verdict that a service's JSON answer to ``address`` amounts to, and ``<out>_components``. Where the
    column ``error`` says that the call failed, the verdict carries it as ``api_error``."""
    failed = F.lit(None).cast("string") if error is None else F.col(error)
    p = f"_{out}_"
    v = lambda n: F.col(p + n)
    df = df.withColumn(p + "first", F.get(F.from_json(F.col(answer), ANSWER)["results"], F.lit(0)))
    first = v("first")
    df = df.withColumns(
        {
            p + "score": F.coalesce(first["score"], F.lit(0.0)), p + "type": type_label(first["type"]), p + "entity": type_label(first["entityType"]),
            p + "match": type_label(first["matchType"]), p + "text": x.text(first["address"]["freeformAddress"]),
            f"{out}_components": F.struct(*[F.struct(x.text(first["address"][k]).alias("value"), (x.text(first["address"][k]) != "").alias("confirmed")).alias(n) for n, k in COMPONENTS]),
        }
    )
    part = lambda n: F.col(f"{out}_components.{n}.confirmed")
    df = df.withColumns({p + "gran": granularity(v("match"), v("type"), v("entity"), part("street_number")), p + "a": canonical_address(v("text")), p + "b": canonical_address(F.col(address))})
    df = df.withColumn(p + "inferred", (v("score") >= 0.80) & ~addresses_equivalent(v("a"), v("b")))
    s, g = v("score"), v("gran")
    status = (
        F.when((s >= 0.80) & (g == "PREMISE"), F.when(v("inferred"), "CORRECTED").otherwise("VALIDATED"))
        .when((s >= 0.70) & (g == "PREMISE"), "PARTIAL_VALIDATED")
        .when((s >= 0.90) & (g == "ROUTE") & part("street_name"), "PARTIAL_VALIDATED")
        .when((s >= 0.85) & (g == "ROUTE") & part("street_name") & concrete_street(x.text(address)), "PARTIAL_VALIDATED")
        .when((s >= 0.60) & g.isin("ROUTE", "LOCALITY"), "PARTIAL_MATCH")
        .otherwise("FAILED")
    )
    notes = x.actions(
        *[F.when(~part(n), F.lit(f"{n}: unconfirmed")) for n, _ in COMPONENTS], F.concat(F.lit("azure_score: "), F.format_string("%.3f", s)),
        F.when(v("type") != "", F.concat(F.lit("azure_type: "), v("type"))), F.when(v("match") != "", F.concat(F.lit("match_type: "), v("match"))),
    )
    hit = F.struct(
        status.alias("validation_status"), v("text").alias("formatted_address"), first["position"]["lat"].alias("latitude"), first["position"]["lon"].alias("longitude"), g.alias("validation_granularity"),
        notes.alias("diagnostics"), ((s < 0.80) | g.isin("LOCALITY", "NONE", "OTHER")).alias("has_unconfirmed"), v("inferred").alias("has_inferred"),
        (v("match").isin("pointaddress", "addressrange") & v("inferred")).alias("has_replaced"), failed.alias("api_error"),
    )
    none = F.struct(
        F.lit("FAILED").alias("validation_status"), F.lit("").alias("formatted_address"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit("NONE").alias("validation_granularity"),
        F.array(F.lit("address: no Azure Maps match")).alias("diagnostics"), F.lit(True).alias("has_unconfirmed"), F.lit(False).alias("has_inferred"), F.lit(False).alias("has_replaced"), failed.alias("api_error"),
    )
    out_df = df.withColumn(out, F.when(first.isNull(), none.cast(RESULT)).otherwise(hit.cast(RESULT)))
    return out_df.drop(*[c for c in out_df.columns if c.startswith(p)])


def by_service(resolve, order: str = "row_id"):
    """A validator that asks a service, to be given as ``validate``; blank and missing addresses are not sent. ``order``
    tells the records apart and which of equal requests comes first."""

    def validate(df: DataFrame, address: str, country: str, out: str) -> DataFrame:
        # only what is asked goes through the exchange, and the records' own plan is not repeated with every question
        narrow = cut(df.select(order, F.col(address).alias("address"), F.col(country).alias("country")))
        key = request_key(x.squeeze(x.strip(F.lower(x.text("address")))), F.upper(x.strip(x.text("country"))))
        said = ask_once(narrow, ["address", "country"], resolve, "said", key, order, ~x.is_blank("address"))
        answers = parse_answers(said, "said", "address", out, "said_error").select(order, out)
        # one answer a record, mostly equal ones: files far smaller than the rows, which are no broadcast
        return df.join(cut(answers).hint("merge"), order, "left")

    validate.asks = True
    return validate


# correction

def component_fix(address: Column, notes: Column) -> Column:
    """Without a last part that looks like a postal code, and without a leading number, as far as the notes blame them;
    null if that changes nothing."""
    parts = comma_parts(address)
    tail = F.element_at(parts, -1)
    cut_tail = x.any_contains(notes, "postal") & (x.matches(tail, r"^[\d\s-]{3,10}$") | x.matches(tail, r"^[A-Z0-9\s]{3,10}$"))
    kept = F.when(cut_tail, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", ")).otherwise(address)
    scores = F.filter(F.transform(notes, lambda d: F.regexp_extract(d, "azure_score: ([0-9.]+)", 1)), lambda d: d != "")
    score = F.get(scores, F.lit(0)).try_cast("double")
    weak = x.any_contains(notes, "street_number") & (score.isNull() | (score < 0.75))
    fixed = F.when(weak, x.replace_all(kept, r"^\d+[-/]?\d*\s*", "")).otherwise(kept)
    return F.when(fixed != address, fixed)


def simplify(address: Column) -> Column:
    """Without units, parentheses and internal numbers; null if that changes nothing."""
    c = x.replace_all(address, rf",?\s*({t.UNIT_WORDS})\.?\s*\S*", "", x.UI)
    c = x.replace_all(c, r"\s*\([^)]*\)", "")
    c = x.replace_all(c, r"\s*No\.?\s*\d+", "")
    c = x.strip(F.regexp_replace(x.strip(c), F.lit(",+$"), F.lit("")))
    return F.when(c != address, c)


def broaden(address: Column) -> Column:
    """The last three parts; null if there are no more than that."""
    parts = comma_parts(address)
    c = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), ", ")
    return F.when((F.size(parts) >= 3) & (c != address), c)


def diagnose(address: Column, notes: Column) -> Column:
    r = t.FAILURE_REASONS
    said = F.concat_ws(
        "; ", F.when(~x.matches(address, r"\d"), r["digit"]), F.when(F.length(x.strip(address)) < 10, r["short"]),
        F.when(x.any_contains(notes, "unrecognized"), r["unrecognized"]), F.when(x.any_contains(notes, "insufficient"), r["insufficient"]),
    )
    return F.coalesce(F.nullif(said, F.lit("")), F.lit(r["none"]))


STRATEGIES = ["component_fix", "simplify_address", "broaden_search"]


def correct(df: DataFrame, address: str = "api_address", country: str = "suggested_country", first: str = "result", validate=simulate) -> DataFrame:
    """Adds ``correction``: the three strategies, each on the original address, validated anew; the first that succeeds
    counts, with the number of attempts up to it. ``validate(df, address, country, out)`` is the validator; one that asks a
    service is given an address only where the first answer, and no earlier strategy, succeeded."""
    asks = getattr(validate, "asks", False)
    df = df.withColumns({f"_try{i}": c for i, c in enumerate(strategies(address, f"{first}.diagnostics"))})
    done = F.col(f"{first}.validation_status").isin(t.USABLE) | F.col(f"{first}.api_error").isNotNull()
    for i in range(3):
        if asks:
            df = validate(df.withColumn("_ask", F.when(~done, F.col(f"_try{i}"))), "_ask", country, f"_got{i}").drop("_ask")
            done = done | F.col(f"_got{i}.validation_status").isin(t.USABLE)
        else:
            df = validate(df, f"_try{i}", country, f"_got{i}")
    made = lambda i: F.col(f"_try{i}").isNotNull()
    won = [made(i) & F.col(f"_got{i}.validation_status").isin(t.USABLE) for i in range(3)]
    tried = [sum((made(j).cast("int") for j in range(1, i + 1)), made(0).cast("int")) for i in range(3)]

    def pack(i):
        return F.struct(F.col(f"_got{i}.validation_status").alias("status"), F.lit(STRATEGIES[i]).alias("strategy"), tried[i].alias("attempts"), F.col(f"_got{i}").alias("result"))

    lost = F.struct(F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("strategy"), tried[2].alias("attempts"), F.col(first).alias("result"))
    out = F.when(won[0], pack(0)).when(won[1], pack(1)).when(won[2], pack(2)).otherwise(lost)
    return df.withColumn("correction", out).drop(*[f"_{n}{i}" for n in ("try", "got") for i in range(3)])


def skipped(address: str) -> Column:
    """Records without an address to validate."""
    return x.is_blank(address) | (F.col("completeness_class") == "EMPTY")


def settle(df: DataFrame, address: str = "api_address", accept_validated_correction: bool = False) -> DataFrame:
    """The record's final state from ``result`` and ``correction``: eleven columns.

    A correction that comes back VALIDATED does not count unless ``accept_validated_correction``; the record then fails
    with the reason "Unknown".
    """
    skip = skipped(address)
    r, c = (lambda n: F.col(f"result.{n}")), (lambda n: F.col(f"correction.{n}"))
    error = r("api_error").isNotNull()
    status = r("validation_status")
    direct = status.isin(t.USABLE)
    accepted = c("status").isin(t.USABLE if accept_validated_correction else ["CORRECTED", "PARTIAL_VALIDATED"])
    none = F.lit(None).cast("string")
    branch = F.when(skip, "skip").when(error, "error").when(direct, "direct").when(accepted, "fixed").otherwise("failed")
    df = df.withColumn("_b", branch)
    b = F.col("_b")
    pick = lambda name: F.when(b == "direct", r(name)).when(b == "fixed", c(f"result.{name}"))
    kinds = {"VALIDATED": (none, none, 0), "CORRECTED": (F.lit("API_CORRECTED"), F.lit("api_auto"), 1), "PARTIAL_VALIDATED": (F.lit("API_PARTIAL"), F.lit("api_partial"), 0)}

    def by_status(i):
        return F.when(status == "CORRECTED", kinds["CORRECTED"][i]).when(status == "PARTIAL_VALIDATED", kinds["PARTIAL_VALIDATED"][i]).otherwise(kinds["VALIDATED"][i])

    unknown = c("status").isin(t.USABLE)
    return df.withColumns(
        {
            "validation_status": F.when(b == "skip", "SKIPPED").when(b == "error", "API_ERROR").when(b == "direct", status).when(b == "fixed", c("status")).otherwise("FAILED"),
            "validated_address": pick("formatted_address"),
            "latitude": pick("latitude"),
            "longitude": pick("longitude"),
            "validation_granularity": F.when(b == "failed", r("validation_granularity")).otherwise(pick("validation_granularity")),
            "validation_diagnostics": F.when(b == "failed", r("diagnostics")).otherwise(pick("diagnostics")),
            "correction_status": F.when(b == "direct", by_status(0)).when(b == "fixed", F.when(c("status") == "PARTIAL_VALIDATED", "ENGINE_PARTIAL").otherwise("ENGINE_CORRECTED")).when(b == "failed", "EXHAUSTED"),
            "correction_strategy": F.when(b == "direct", by_status(1)).when(b == "fixed", c("strategy")),
            "correction_attempts": F.when(b == "direct", by_status(2)).when(b.isin("fixed", "failed"), c("attempts")).cast("int"),
            "failure_reason": F.when(b == "skip", "No usable address for API submission").when(b == "error", r("api_error")).when(b == "failed", F.when(unknown, "Unknown").otherwise(diagnose(F.col(address), r("diagnostics")))),
            "manual_review_flag": b.isin("skip", "error", "failed"),
        }
    ).drop("_b")


def validate_records(df: DataFrame, validate=simulate, accept_validated_correction: bool = False) -> DataFrame:
    """Validation, correction and final state of second-pass records; simulated, all in one row-local plan. A validator
    that asks a service is not given the addresses of records that are skipped."""
    if getattr(validate, "asks", False):
        df = validate(cut(df).withColumn("_ask", F.when(~skipped("api_address"), F.col("api_address"))), "_ask", "suggested_country", "result").drop("_ask")
    else:
        df = validate(df, "api_address", "suggested_country", "result")
    df = correct(df, validate=validate)
    return settled(settle(df, accept_validated_correction=accept_validated_correction).drop("result", "correction"))


def cache_key(df: DataFrame, address: str, country: str) -> DataFrame:
    return df.withColumns({"key_address": x.squeeze(x.strip(F.lower(x.text(address)))), "key_country": F.upper(x.strip(x.text(country)))})


def validate_once(df: DataFrame, address: str, country: str, order: str, validate=simulate) -> DataFrame:
    """Adds ``result``, computed once for each address that is equal but for case and spacing, from the spelling that
    comes first by ``order``. One aggregation and one join, whatever the number of repeats."""
    keyed = cache_key(df, address, country)
    asked = keyed.groupBy("key_address", "key_country").agg(F.min_by(F.struct(F.col(address).alias("a"), F.col(country).alias("c")), F.col(order)).alias("_ask"))
    asked = asked.select("key_address", "key_country", F.col("_ask.a").alias("asked_address"), F.col("_ask.c").alias("asked_country"))
    answered = validate(asked, "asked_address", "asked_country", "result")
    return keyed.join(answered, ["key_address", "key_country"])
