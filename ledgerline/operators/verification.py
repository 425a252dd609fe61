"""Company verification: similarity, candidate scoring, status ladders, evidence, adjudication, enrichment, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x
from ..sources.providers import ask_once, request_key, verification_key
from ..sources.store import cut
from .records import settled

VERIFICATION = (
    "struct<company_verification_status:string,verification_confidence:double,matched_company_name:string,matched_address:string,matched_latitude:double,"
    "matched_longitude:double,matched_category:string,occupant_at_address:string,verification_method:string,verification_evidence:array<string>,api_error:string>"
)
CANDIDATES = "struct<results:array<struct<type:string,score:double,poi:struct<name:string,categories:array<string>>,address:struct<freeformAddress:string>,position:struct<lat:double,lon:double>>>>"


def is_generic_place(name: Column | str) -> Column:
    n = x.normalize_text(name)
    return n.isin(t.GENERIC_PLACES) | (F.length(n) <= 2)


def distance_score(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bands of the sum of differences in degrees; 0 where a coordinate is missing."""
    gap = F.abs(lat1 - lat2) + F.abs(lon1 - lon2)
    missing = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) for c in (lat1, lon1, lat2, lon2)])
    return F.when(missing, 0.0).when(gap <= 0.001, 1.0).when(gap <= 0.01, 0.75).when(gap <= 0.05, 0.45).otherwise(0.10)


def parse_candidates(answer: Column | str) -> Column:
    """A service's JSON answer as an array of structs in its order."""
    results = F.from_json(x.col(answer), CANDIDATES)["results"]
    one = lambda i: F.struct(
        F.coalesce(F.nullif(i["poi"]["name"], F.lit("")), x.text(i["type"])).alias("name"),
        x.text(i["address"]["freeformAddress"]).alias("address"), i["position"]["lat"].alias("latitude"), i["position"]["lon"].alias("longitude"),
        F.coalesce(i["score"], F.lit(0.0)).alias("score"), F.coalesce(F.array_join(i["poi"]["categories"], ", "), F.lit("")).alias("category"),
    )
    return F.coalesce(F.transform(results, one), F.array().cast("array<struct<name:string,address:string,latitude:double,longitude:double,score:double,category:string>>"))


def with_tokens(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<column>_tokens``, what ``score_candidates`` compares, where a row is not yet paired with all others."""
    return df.withColumns({f"{c}_tokens": x.token_set(c) for c in columns})


#: Into so many shares the records of one key are dealt where they are paired with all candidates of that key.
SHARES = 8


def paired(records: DataFrame, candidates: DataFrame, key: str, candidate_key: str) -> DataFrame:
    """Each record with every candidate of its key. Few bytes make very many pairs, so that partitions of a usual size would
    leave them to a task or two: records are dealt into shares, each of which meets all candidates of the key, and
    the number of partitions is fixed."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = records.withColumn("_share", F.pmod(F.xxhash64(*records.columns), F.lit(SHARES)).cast("int")).repartition(n, key, "_share")
    theirs = candidates.withColumn("_each", F.explode(F.array(*[F.lit(i) for i in range(SHARES)]))).repartition(n, candidate_key, "_each")
    return mine.join(theirs, (F.col(key) == F.col(candidate_key)) & (F.col("_share") == F.col("_each"))).drop("_share", "_each")


def score_candidates(df: DataFrame, company="company_name", address="address", lat="latitude", lon="longitude", c="c_", keep=()) -> DataFrame:
    """Scores of rows that pair a record with a candidate (columns ``<c>name``, ``<c>address``, ``<c>latitude``,
    ``<c>longitude``, ``<c>score``): name_score, address_score, distance_score, api_score, confidence, evidence. Texts
    whose tokens are there (``with_tokens``) are not taken apart again."""
    v = lambda n: F.col(c + n)
    given = ~x.is_blank(address) if isinstance(address, str) else F.lit(False)
    parts = lambda n: F.col(f"{n}_tokens") if f"{n}_tokens" in df.columns else x.token_set(n)
    alike = lambda one, other: x.set_similarity(parts(one), parts(other))
    df = df.withColumns(
        {
            "_n": alike(company, c + "name"), "_a": F.when(given, alike(address, c + "address")).otherwise(0.0) if isinstance(address, str) else F.lit(0.0),
            "_d": distance_score(F.col(lat), F.col(lon), v("latitude"), v("longitude")) if lat else F.lit(0.0), "_s": F.least(F.coalesce(v("score"), F.lit(0.0)), F.lit(1.0)),
        }
    )
    n, a, d, s = F.col("_n"), F.col("_a"), F.col("_d"), F.col("_s")
    total = F.when(given, 0.45 * n + 0.30 * a + 0.20 * d + 0.05 * s).otherwise(0.85 * n + 0.15 * s)
    two = lambda word, q: F.concat(F.lit(word), F.format_string("%.2f", q))
    return df.withColumns(
        {
            "name_score": F.round(n, 3), "address_score": F.round(a, 3), "distance_score": F.round(d, 3), "api_score": F.round(s, 3), "confidence": F.round(total, 3),
            "evidence": F.array(two("name_similarity=", n), two("address_similarity=", a), two("distance_score=", d), two("api_score=", s)),
        }
    ).drop("_n", "_a", "_d", "_s")


def best_candidates(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The candidate of highest confidence for each key, the earliest by ``order`` of equals, by one aggregation with
    partial maxima; no group is sorted or gathered."""
    best = F.max_by(F.struct(*columns), F.struct(F.col("confidence"), -F.col(order)))
    return df.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def candidate_status(name: Column | str, n: Column, a: Column, d: Column, confidence: Column) -> Column:
    return (
        F.when(is_generic_place(name), "UNVERIFIED")
        .when((n >= 0.70) & (a >= 0.60) & (d >= 0.75), "VERIFIED")
        .when((n >= 0.45) & (a >= 0.45) & (d >= 0.45) & (confidence >= 0.50), "LIKELY_MATCH")
        .when((a >= 0.55) & (d >= 0.75), "ADDRESS_MISMATCH")
        .otherwise("UNVERIFIED")
    )


def compact_query(name: Column | str, address: Column | str) -> Column:
    return F.left(x.strip(x.squeeze(F.concat_ws(" ", x.text(name), x.text(address)))), F.lit(180))


def simulate_verification(company: Column | str, address: Column | str) -> Column:
    """A verdict from the words that name and address share."""
    score = x.token_similarity(company, address)
    likely = score > 0.20
    empty, none = F.lit(""), F.lit(None).cast("double")
    return F.struct(
        F.when(likely, "LIKELY_MATCH").otherwise("UNVERIFIED").alias("company_verification_status"), F.round(F.greatest(score, F.lit(0.25)), 3).alias("verification_confidence"),
        F.when(likely, x.text(company)).otherwise("").alias("matched_company_name"), F.when(likely, x.text(address)).otherwise("").alias("matched_address"),
        none.alias("matched_latitude"), none.alias("matched_longitude"), empty.alias("matched_category"), empty.alias("occupant_at_address"),
        F.lit("simulation").alias("verification_method"), F.array(F.lit("simulation mode")).alias("verification_evidence"), F.lit(None).cast("string").alias("api_error"),
    ).cast(VERIFICATION)


def api_error(message: Column) -> Column:
    empty, none = F.lit(""), F.lit(None).cast("double")
    return F.struct(F.lit("API_ERROR"), F.lit(0.0), empty, empty, none, none, empty, empty, F.lit("azure_maps"), F.array(message), message).cast(VERIFICATION)


def _best(df: DataFrame, answers: DataFrame, key: str, address: str | None, with_place: bool) -> DataFrame:
    """The best candidate of each record's recorded answer: key and the struct ``best``; records without one are absent."""
    rows = df.join(answers, key).select(*df.columns, F.posexplode(parse_candidates("response")).alias("ord", "c"))
    rows = rows.select(*df.columns, "ord", *[F.col(f"c.{n}").alias(f"c_{n}") for n in ("name", "address", "latitude", "longitude", "score", "category")])
    scored = score_candidates(rows, "company_name", address, "latitude" if with_place else None, "longitude" if with_place else None)
    cols = ["c_name", "c_address", "c_latitude", "c_longitude", "c_category", "name_score", "address_score", "distance_score", "confidence", "evidence"]
    out = best_candidates(scored, key, "ord", cols)
    return out.select(key, F.struct(*cols).alias("best"))


def _found(status: Column, method: str) -> Column:
    b = lambda n: F.col(f"best.{n}")
    return F.struct(status, b("confidence"), b("c_name"), b("c_address"), b("c_latitude"), b("c_longitude"), b("c_category"), b("c_name"), F.lit(method), b("evidence"), F.lit(None).cast("string")).cast(VERIFICATION)


def _answers(records: DataFrame, asked, key: str) -> DataFrame:
    """(key, response, response_error) from a table of recorded answers or from a function of the records."""
    said = asked(records) if callable(asked) else asked
    error = F.col("response_error") if "response_error" in said.columns else F.lit(None).cast("string")
    return said.select(key, "response", error.alias("response_error"))


def verify(records: DataFrame, by_name, by_address, fuzzy, key: str = "row_id") -> DataFrame:
    """(key, verification) of records (key, company_name, address, latitude, longitude): candidates near the address by
    name, then by address, then the company anywhere. Each search is a table (key, response) of recorded answers or a
    function from the records that are still open to one. A failed search near the address finds nothing; what went wrong
    with the last one is kept."""
    b = lambda n: F.col(f"best.{n}")
    status = candidate_status(F.col("best.c_name"), b("name_score"), b("address_score"), b("distance_score"), b("confidence"))
    first = _best(records, _answers(records, by_name, key), key, "address", True).withColumn("s", status).filter(F.col("s").isin(t.TRUSTED))
    first = first.select(key, _found(F.col("s"), "azure_poi_name_near_address").alias("verification"))
    first = cut(first)
    open_ = cut(records.join(first.select(key), key, "left_anti"))
    second = _best(open_, _answers(open_, by_address, key), key, "address", True).withColumn("s", status).filter(F.col("s").isin([*t.TRUSTED, "ADDRESS_MISMATCH"]))
    second = second.select(key, _found(F.col("s"), "azure_poi_address_occupant").alias("verification"))
    second = cut(second)
    rest = cut(open_.join(second.select(key), key, "left_anti"))
    said = cut(_answers(rest, fuzzy, key))
    third = rest.select(key).join(_best(rest, said, key, None, False), key, "left").join(said.select(key, "response_error"), key, "left")
    ok = F.coalesce((b("name_score") >= 0.45) & ~is_generic_place(F.col("best.c_name")), F.lit(False))
    failed = api_error(F.col("response_error"))
    empty, none = F.lit(""), F.lit(None).cast("double")
    pick = lambda n, other: F.when(ok, b(n)).otherwise(other)
    nothing = F.when(F.col("response_error").isNotNull(), failed["verification_evidence"]).otherwise(F.array(F.lit("no company lookup match")))
    located = F.struct(
        F.when(ok, "CORRECT_ADDRESS_CANDIDATE").otherwise("UNVERIFIED"), pick("confidence", F.lit(0.0)), pick("c_name", empty), pick("c_address", empty), pick("c_latitude", none), pick("c_longitude", none),
        pick("c_category", empty), empty, F.lit("azure_fuzzy_company_lookup"), pick("evidence", nothing), failed["api_error"],
    ).cast(VERIFICATION)
    return first.union(second).union(third.select(key, located.alias("verification")))


def verify_by_services(records: DataFrame, services, key: str = "row_id") -> DataFrame:
    """``verify`` over records that also have a country, asking the services of ``providers.Services``."""
    place = ["country", "latitude", "longitude"]

    def ask(resolve, columns):
        return lambda open_: ask_once(open_, [*columns, *place], resolve, "response", verification_key("company_name", "address", *place), key)

    whole = ["company_name", "address"]
    return verify(records, ask(services.poi_by_name, whole), ask(services.poi_by_address, whole), ask(services.fuzzy, whole), key)


# evidence

EVIDENCE = ["external_evidence_available", "external_evidence_source", "external_evidence_url", "external_evidence_text"]
KEY_COLUMNS = ["MDM_KEY", "SRC_KEY", "SOURCE_NAME", "cleaned_name"]


def _keys(df: DataFrame) -> Column:
    here = [x.text(c) if c in df.columns else F.lit("") for c in KEY_COLUMNS]
    return F.array(*[F.when(~x.is_blank(c), F.nullif(x.lookup_key(c), F.lit(""))) for c in here])


def shape_evidence(df: DataFrame) -> Column:
    """An evidence row as a struct, whichever of the known column names it uses."""
    have = lambda names: [F.col(c) for c in names if c in df.columns]
    words = x.first_nonempty(*have(["evidence_text", "evidence_summary", "summary", "snippet"]), F.lit(""))
    url = x.first_nonempty(*have(["evidence_url", "url", "source_url"]), F.lit(""))
    source = x.first_nonempty(*have(["evidence_source", "source"]), F.lit("external_evidence_file"))
    return F.struct(((words != "") | (url != "")).alias(EVIDENCE[0]), source.alias(EVIDENCE[1]), url.alias(EVIDENCE[2]), F.left(words, F.lit(1000)).alias(EVIDENCE[3]))


def evidence_index(evidence: DataFrame, order: str = "load_order") -> DataFrame:
    """(lookup_key, evidence): the last loaded row of each key, over all four kinds of key in one name space."""
    rows = evidence.select(F.col(order).alias("_o"), shape_evidence(evidence).alias("evidence"), F.posexplode(_keys(evidence)).alias("_p", "lookup_key")).filter("lookup_key is not null")
    return rows.groupBy("lookup_key").agg(F.max_by("evidence", F.struct("_o", "_p")).alias("evidence"))


def lookup_evidence(records: DataFrame, index: DataFrame, key: str = "row_id") -> DataFrame:
    """Records with the four evidence columns: the first of their keys that the index has, else empty."""
    probes = records.select(key, F.posexplode(_keys(records)).alias("_p", "lookup_key")).filter("lookup_key is not null")
    hits = probes.join(index, "lookup_key").groupBy(key).agg(F.min_by("evidence", "_p").alias("_e"))
    out = records.join(hits, key, "left")
    filled = {EVIDENCE[0]: F.coalesce(F.col(f"_e.{EVIDENCE[0]}"), F.lit(False))} | {c: F.coalesce(F.col(f"_e.{c}"), F.lit("")) for c in EVIDENCE[1:]}
    return out.withColumns(filled).drop("_e")


def no_evidence(df: DataFrame) -> DataFrame:
    return df.withColumns({EVIDENCE[0]: F.lit(False)} | {c: F.lit("") for c in EVIDENCE[1:]})


WEB = "struct<webPages:struct<value:array<struct<name:string,snippet:string,url:string>>>>"


def web_query(company: Column | str, address: Column | str, candidate: Column | str) -> Column:
    """Company, address and, if it is another name, the candidate."""
    c, d = x.text(company), x.text(candidate)
    other = ~x.is_blank(d) & (x.lookup_key(d) != x.lookup_key(c))
    return F.concat_ws(" ", F.nullif(c, F.lit("")), F.nullif(x.text(address), F.lit("")), F.when(other, d))


def parse_web_answer(answer: Column | str) -> Column:
    """The first three hits of a web search as evidence."""
    top = F.slice(F.coalesce(F.from_json(x.col(answer), WEB)["webPages"]["value"], F.array().cast("array<struct<name:string,snippet:string,url:string>>")), 1, 3)
    said = F.filter(F.transform(top, lambda i: F.regexp_replace(F.concat(x.strip(x.text(i["name"])), F.lit(": "), x.strip(x.text(i["snippet"]))), F.lit("^[: ]+|[: ]+$"), F.lit(""))), lambda s: s != "")
    urls = F.filter(F.transform(top, lambda i: x.strip(x.text(i["url"]))), lambda u: u != "")
    any_ = (F.size(said) > 0) | (F.size(urls) > 0)
    return F.struct(any_.alias(EVIDENCE[0]), F.when(any_, "bing_web_search").otherwise("").alias(EVIDENCE[1]), F.coalesce(F.get(urls, F.lit(0)), F.lit("")).alias(EVIDENCE[2]), F.left(F.array_join(said, " | "), F.lit(1000)).alias(EVIDENCE[3]))


def search_evidence(df: DataFrame, resolve, budget: int = 0, order: str = "row_id") -> DataFrame:
    """Records without evidence look for some on the web, equal questions once and at most ``budget`` of them (0: all), in
    order of their records."""
    company = x.first_nonempty("cleaned_name", "SOURCE_NAME")
    address = x.first_nonempty("validated_address", "api_address")
    df = df.withColumn("query", web_query(company, address, "matched_company_name"))
    wanted = ~F.col(EVIDENCE[0]) & ~x.is_blank("query")
    df = ask_once(df, ["query"], resolve, "_web", request_key(x.lookup_key("query")), order, wanted, budget)
    df = df.withColumn("_e", F.when(F.col("_web").isNotNull(), parse_web_answer("_web")))
    return df.withColumns({c: F.coalesce(F.col(f"_e.{c}"), F.col(c)) for c in EVIDENCE}).drop("_e", "_web", "_web_error", "query")


# adjudication

ADJUDICATION = ["ai_adjudication_status", "ai_adjudication_confidence", "ai_adjudication_reason", "ai_adjudication_method", "ai_promoted_match", "final_company_verification_status", "overall_confidence_score"]


def adjudication_wanted(status: Column, matched: Column, occupant: Column, has_evidence: Column) -> Column:
    gate = status.isin(t.PROMOTABLE) | ((status == "UNVERIFIED") & has_evidence)
    return gate & (~x.is_blank(matched) | ~x.is_blank(occupant) | has_evidence)


def overall_confidence(deterministic: Column, decision: Column, ai: Column, promoted: Column) -> Column:
    d = x.clamp(deterministic)
    return F.when(promoted, F.round(0.45 * d + 0.55 * ai, 3)).when(decision.isin([*t.PROMOTABLE, "UNVERIFIED"]), F.round(F.greatest(d, ai), 3)).otherwise(d)


def adjudicate(df: DataFrame, answer: str | None = None, threshold: float = t.PROMOTION_CONFIDENCE, error: str | None = None) -> DataFrame:
    """Seven adjudication columns from ``answer``, a chat response as JSON (null: not asked or failed, as ``error`` says);
    records that are not to be adjudicated, and all without ``answer``, keep their deterministic verdict."""
    status, confidence = F.coalesce("company_verification_status", F.lit("UNVERIFIED")), F.col("verification_confidence")
    default = {ADJUDICATION[0]: F.lit("NOT_RUN"), ADJUDICATION[1]: F.lit(0.0), ADJUDICATION[2]: F.lit(""), ADJUDICATION[3]: F.lit(""), ADJUDICATION[4]: F.lit(False), ADJUDICATION[5]: status, ADJUDICATION[6]: x.clamp(confidence)}
    if answer is None:
        return df.withColumns(default)
    wanted = adjudication_wanted(status, F.col("matched_company_name"), F.col("occupant_at_address"), F.col(EVIDENCE[0])) & F.col(answer).isNotNull()
    df = df.withColumn("_j", F.from_json(x.json_object(x.chat_content(answer)), "decision string, confidence string, reason string, _corrupt_record string"))
    ran = wanted & F.col("_j").isNotNull() & F.col("_j._corrupt_record").isNull()
    said = F.upper(x.strip(x.text("_j.decision")))
    df = df.withColumns({"_ran": F.coalesce(ran, F.lit(False)), "_asked": F.coalesce(wanted, F.lit(False)), "_d": F.when(said.isin(t.DECISIONS), said).otherwise(status), "_c": x.clamp("_j.confidence")})
    df = df.withColumn("_p", F.col("_d").isin(t.TRUSTED) & (F.col("_c") >= threshold))
    own = {
        ADJUDICATION[0]: F.col("_d"), ADJUDICATION[1]: F.col("_c"), ADJUDICATION[2]: F.left(x.strip(x.text("_j.reason")), F.lit(500)), ADJUDICATION[3]: F.lit("azure_openai_candidate_adjudication"),
        ADJUDICATION[4]: F.col("_p"), ADJUDICATION[5]: F.when(F.col("_p"), F.col("_d")).otherwise(status), ADJUDICATION[6]: overall_confidence(confidence, F.col("_d"), F.col("_c"), F.col("_p")),
    }
    reason = F.when(F.col("_asked"), F.lit("OpenAI adjudication returned non-JSON content"))
    if error is not None:
        reason = reason.when(F.col(error).isNotNull(), F.concat(F.lit("OpenAI adjudication failed: "), F.left(F.col(error), F.lit(120))))
    failed = {ADJUDICATION[2]: reason.otherwise("")}
    return df.withColumns({c: F.when(F.col("_ran"), own[c]).otherwise(failed.get(c, default[c])) for c in ADJUDICATION}).drop("_j", "_ran", "_asked", "_d", "_c", "_p")


# enrichment

def infer_domain(name: Column | str) -> Column:
    joined = F.array_join(F.slice(x.tokens(x.normalize_text(name)), 1, 3), "")
    return F.when(F.length(joined) >= 4, F.concat(joined, F.lit(".com"))).otherwise("")


def enrich(df: DataFrame, answer: str | None = None, status: str = "final_company_verification_status", error: str | None = None) -> DataFrame:
    """Fifteen firmographic columns: from the match of a trusted record, else held back; where ``answer`` (a chat response)
    holds a JSON object for a trusted record, its fields replace them; ``error`` says why a call failed."""
    trusted = F.coalesce(F.col(status).isin(t.TRUSTED), F.lit(False))
    either = lambda own, other: F.when(trusted & ~(x.text(own) == ""), F.col(own)).otherwise(other)
    name = either("matched_company_name", F.coalesce(F.nullif(x.text("cleaned_name"), F.lit("")), x.text("SOURCE_NAME")))
    address = either("matched_address", x.text("validated_address"))
    df = df.withColumns({"_name": name, "_address": address})
    note = F.when(trusted, "Deterministic enrichment from verified company/address match.").otherwise("Verification unresolved; firmographic enrichment held for manual review.")
    base = {c: F.lit("") for c in t.FIRMOGRAPHICS} | {"legal_name": F.col("_name"), "email_domain": F.when(trusted, infer_domain("_name")).otherwise(""), "headquarters_address": F.col("_address")}
    method = F.lit("deterministic_fallback")
    if answer is not None:
        spec = ", ".join(f"{c} string" for c in t.FIRMOGRAPHICS) + ", confidence_notes string, _corrupt_record string"
        df = df.withColumn("_j", F.when(trusted & F.col(answer).isNotNull(), F.coalesce(F.from_json(x.json_object(x.chat_content(answer)), spec), F.from_json(F.lit("x"), spec))))
        good = F.coalesce(F.col("_j").isNotNull() & F.col("_j._corrupt_record").isNull(), F.lit(False))
        bad = F.coalesce(F.col("_j").isNotNull() & ~good, F.lit(False))
        base = {c: F.when(good, F.coalesce(F.col(f"_j.{c}"), v if c == "legal_name" else F.lit(""))).otherwise(v) for c, v in base.items()}
        note = F.when(good, x.text("_j.confidence_notes")).when(bad, "OpenAI enrichment returned non-JSON content").otherwise(note)
        method = F.when(good, "openai_assisted").otherwise(method)
        if error is not None:
            note = F.when(trusted & F.col(error).isNotNull(), F.concat(F.lit("OpenAI enrichment failed: "), F.left(F.col(error), F.lit(120)))).otherwise(note)
    out = df.withColumns({**base, "enriched_full_address": F.col("_address"), "enrichment_method": method, "enrichment_notes": note})
    return out.drop("_name", "_address", "_j")


# routing

def route(df: DataFrame, status: str = "company_verification_status", confidence: str = "overall_confidence_score") -> DataFrame:
    """``review_routing``, ``review_priority``, ``review_reason`` and the review flag."""
    s, c = F.col(status), x.clamp(confidence)
    tests = [("trusted", s.isin(t.TRUSTED)), ("mismatch", (s == "ADDRESS_MISMATCH") & (c >= 0.75)), ("low", s == "ADDRESS_MISMATCH"), ("candidate", s == "CORRECT_ADDRESS_CANDIDATE"), ("error", s == "API_ERROR")]

    def pick(i):
        out = None
        for name, test in tests:
            out = F.when(test, t.ROUTES[name][i]) if out is None else out.when(test, t.ROUTES[name][i])
        return out.otherwise(t.ROUTES["none"][i])

    df = df.withColumns({"review_routing": pick(0), "review_priority": pick(1), "review_reason": pick(2)})
    return df.withColumn("week3_manual_review_flag", F.col("review_routing").startswith("REVIEW_"))


def _asked(df: DataFrame, resolve, out: str, key: list[str], given: list[str], wanted: Column, order: str) -> DataFrame:
    """A chat service's answer in ``out``, one for all records of equal ``key``."""
    here = [c for c in given if c in df.columns]
    return ask_once(df, here, resolve, out, request_key(*[x.text(c) if c in df.columns else F.lit("") for c in key]), order, wanted)


_CHAT_COLUMNS = ["MDM_KEY", "SOURCE_NAME", "cleaned_name", "validated_address", "norm_country", "company_verification_status", "verification_confidence", "matched_company_name", "matched_address", "matched_category", "verification_evidence", *EVIDENCE[1:]]


def third_pass(df: DataFrame, evidence: DataFrame | None = None, verifications: DataFrame | None = None, adjudications: str | None = None, enrichments: str | None = None, key: str = "row_id", services=None) -> DataFrame:
    """Verification, evidence, adjudication, enrichment and routing of usable records.

    ``verifications`` (key, verification) are verdicts made elsewhere; ``adjudications`` and ``enrichments`` name columns
    with recorded chat responses. ``services`` (``providers.Services``) are asked for what is not given that way; without
    either, verdicts are simulated from the record itself.
    """
    company = F.coalesce(F.nullif(x.text("cleaned_name"), F.lit("")), x.text("SOURCE_NAME"))
    address = F.coalesce(F.nullif(x.text("validated_address"), F.lit("")), x.text("api_address"))
    if services is not None:
        df = cut(df)  # each service is asked about these records, which are not computed anew every time
    if verifications is None and services is not None and services.verifies:
        asked = df.select(key, company.alias("company_name"), address.alias("address"), F.coalesce("suggested_country", "norm_country").alias("country"), "latitude", "longitude")
        verifications = cut(verify_by_services(asked, services, key))
    if verifications is None:
        df = df.withColumns({"_company": company, "_address": address}).withColumn("_v", simulate_verification("_company", "_address")).drop("_company", "_address")
        df = settled(df)
    else:
        df = df.join(verifications.withColumnRenamed("verification", "_v"), key, "left")
    names = "company_verification_status verification_confidence matched_company_name matched_address matched_latitude matched_longitude matched_category occupant_at_address verification_method verification_evidence api_error".split()
    df = df.withColumns({n: F.col(f"_v.{n}") for n in names}).drop("_v")
    df = lookup_evidence(df, evidence, key) if evidence is not None else no_evidence(df)
    if services is not None and services.web is not None:
        df = search_evidence(cut(df), services.web, services.web_budget, key)
    errors = {}
    if adjudications is None and services is not None and services.adjudicate is not None:
        wanted = adjudication_wanted(F.coalesce("company_verification_status", F.lit("UNVERIFIED")), F.col("matched_company_name"), F.col("occupant_at_address"), F.col(EVIDENCE[0]))
        adjudications, errors["a"] = "_adjudicated", "_adjudicated_error"
        df = _asked(cut(df), services.adjudicate, adjudications, ["MDM_KEY", "SOURCE_NAME", "validated_address", "matched_company_name", "matched_address"], _CHAT_COLUMNS, wanted, key)
    df = adjudicate(df, adjudications, error=errors.get("a"))
    df = df.withColumns({"deterministic_verification_status": F.col("company_verification_status"), "company_verification_status": F.col("final_company_verification_status"), "verification_confidence": F.col("overall_confidence_score")})
    df = settled(df)
    if enrichments is None and services is not None and services.enrich is not None:
        wanted = F.col("final_company_verification_status").isin(t.TRUSTED)
        enrichments, errors["e"] = "_enriched", "_enriched_error"
        df = _asked(cut(df), services.enrich, enrichments, ["MDM_KEY", "matched_company_name", "matched_address"], _CHAT_COLUMNS, wanted, key)
    out = route(enrich(df, enrichments, error=errors.get("e")))
    return settled(out.drop("_adjudicated", "_adjudicated_error", "_enriched", "_enriched_error"))
