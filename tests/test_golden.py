"""Golden rows of single operators."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import text as x
from ledgerline.operators import enhance, records, validation, verification


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


@pytest.mark.parametrize(
    ("name", "cleaned", "removed", "actions"),
    [
        ("Acme (x) (y)", "Acme (x)", ["(y)"], ["removed_parenthetical"]), ("Acme C/o Focus", "Acme", ["C/o Focus"], ["removed_care_of"]), ("Acme - 706", "Acme", ["- 706"], ["removed_dept_code"]),
        ("Acme -", "Acme", [], []), ("Acme Nbc213443", "Acme Nbc213443", [], []), ("Acme NBC213443", "Acme", ["NBC213443"], ["removed_alphanum_code"]), ("Route-66", "Route", ["-66"], ["removed_dept_code"]), (None, "", [], []),
    ],
)
def test_names(spark, name, cleaned, removed, actions):
    r = records.clean_names(spark.createDataFrame([(name,)], "SOURCE_NAME string")).first()
    assert (r["cleaned_name"], r["name_removed_parts"], r["name_cleaning_actions"]) == (cleaned, removed, actions)


@pytest.mark.parametrize(
    ("parts", "street", "country"),
    [
        (("Main St. 5", "X", "", "US", ""), "Main Street. 5", "US"), (("C/Mayor 5", "X", "", "ES", ""), "Calle Mayor 5", "ES"), (("C/ Mayor 5", "X", "", "ES", ""), "C/ Mayor 5", "ES"),
        (("1 A", "X", "", "GU", "GY1 1AA"), "1 A", "GG"), (("1 A", "X", "GU", "GU", ""), "1 A", "ES"), (("a\n\nb", "X", "", "us", ""), "a, b", "US"),
    ],
)
def test_addresses(spark, parts, street, country):
    r = records.normalize_addresses(spark.createDataFrame([parts], ", ".join(f"{c} string" for c in records.PARSED))).first()
    assert (r["norm_street"], r["norm_country"]) == (street, country)


def test_city_title_case(spark):
    assert one(spark, "c string", ("O'BRIEN 3RD",), x.title_case("c"))[0] == "O'Brien 3Rd"


def test_split_keeps_five_parts(spark):
    r = records.split_address(spark.createDataFrame([(" a |#|#b|#|#|#|#d|#|#e|#|#f",), (None,)], "FULL_ADDRESS string")).collect()
    assert [r[0][c] for c in records.PARSED] == ["a", "b", "", "d", "e"] and [r[1][c] for c in records.PARSED] == [""] * 5


def test_repair(spark):
    values = ["MÃ©xico", "México", "Ã", "北Ã©", None, ""]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(x.repair_encoding("v")).collect()]
    assert got == ["México", "México", "Ã", "北Ã©", None, ""]


@pytest.mark.parametrize(("postal", "country", "out", "action"), [
    ("1234567", "US", "12345", "normalized_zip5"), ("123", "US", "123", None), ("123456789", "US", "12345-6789", "formatted_zip_plus4"), ("k1a0b1", "CA", "K1A 0B1", "formatted_ca_postal"),
    ("1234 AB", "NL", "1234", "cleaned_eu_postal"), ("1000-001", "PT", "1000-001", None), ("nan", "US", "", None), ("sw1a1aa", "GB", "SW1A 1AA", "formatted_uk_postal"), ("01310100", "BR", "01310-100", "formatted_br_postal"),
])
def test_postal(spark, postal, country, out, action):
    assert tuple(one(spark, "p string, c string", (postal, country), *enhance.normalize_postal(F.col("p"), F.col("c")))) == (out, action)


def test_directions_expand_after_road_types(spark):
    df = spark.createDataFrame([("1 N Oak Street", "en"), ("1 N Oak Road", "en"), ("Rue X", "fr")], "enhanced_street string, detected_lang string").withColumn(enhance.LOG, F.array().cast("array<string>"))
    got = enhance.expand_streets(df).collect()
    assert [r["enhanced_street"] for r in got] == ["1 North Oak Street", "1 N Oak Road", "Rue X"] and got[2][enhance.LOG] == [r"expanded_\bRue\b"]


def test_states(spark):
    assert one(spark, "s string, c string", ("VER", "MX"), *enhance.expand_state(F.col("s"), F.col("c")))[0] == "Veracruz"


def test_compose_leaves_out_a_state_that_is_the_country(spark):
    c = [F.lit(v) for v in ("1 A St", "X", "MX", "MX", "1")]
    assert spark.range(1).select(enhance.compose(*c)).first()[0] == "1 A St, X, 1, MX"


@pytest.mark.parametrize(("address", "country", "status", "lat", "lon"), [
    ("12 Main Street, Springfield, IL, 62701, US", "US", "VALIDATED", 37.55, -102.0), ("77 Via Roma, Palermo, IT", "IT", "VALIDATED", None, None), ("Lot 9, Quito, EC", "EC", "FAILED", None, None), ("Industrial Park, Madrid, ES", "ES", "FAILED", None, None),
])
def test_simulated_validation(spark, address, country, status, lat, lon):
    r = validation.simulate(spark.createDataFrame([(address, country)], "a string, c string"), "a", "c", "r").first()["r"]
    assert r["validation_status"] == status
    if lat is not None:
        assert (round(r["latitude"], 2), round(r["longitude"], 2)) == (lat, lon)


def test_unit_words_damage_names_that_hold_them(spark):
    got = [r[0] for r in spark.createDataFrame([("12 Main Street, Miami, Florida, US",), ("1 King Rd, Suite 4, London, GB",)], "a string").select(validation.simplify(F.col("a"))).collect()]
    assert got == ["12 Main Street, Miami US", "1 King Rd London, GB"]


def test_validated_correction_ends_as_failure_unless_accepted(spark):
    base = validation.simulate(spark.createDataFrame([("x", "US", "FULL")], "api_address string, suggested_country string, completeness_class string"), "api_address", "suggested_country", "result")
    good = F.struct(F.lit("VALIDATED").alias("status"), F.lit("broaden_search").alias("strategy"), F.lit(1).alias("attempts"), F.col("result"))
    df = base.withColumn("correction", good)
    assert tuple(validation.settle(df).select("validation_status", "failure_reason").first()) == ("FAILED", "Unknown")
    assert validation.settle(df, accept_validated_correction=True).first()["validation_status"] == "VALIDATED"


@pytest.mark.parametrize(("a", "b", "s"), [("Acme Tools Inc.", "ACME Tools GmbH", 1.0), ("Acme Tools", "Acme Paints Ltd", 1 / 3), ("", "x", 0.0), (None, None, 0.0)])
def test_similarity(spark, a, b, s):
    assert one(spark, "a string, b string", (a, b), x.token_similarity("a", "b"))[0] == pytest.approx(s)


@pytest.mark.parametrize(("v", "out"), [("85", 0.85), ("abc", 0.0), ("NaN", 1.0), (None, 0.0), ("-3", 0.0)])
def test_clamp(spark, v, out):
    assert one(spark, "v string", (v,), x.clamp("v"))[0] == out


def test_json_and_domain(spark):
    assert one(spark, "v string", ('a {"x":1} b',), x.json_object("v"))[0] == '{"x":1}'
    got = [r[0] for r in spark.createDataFrame([("Acme Tools Inc.",), ("AB",)], "n string").select(verification.infer_domain("n")).collect()]
    assert got == ["acmetools.com", ""]


@pytest.mark.parametrize(("status", "c", "route"), [("ADDRESS_MISMATCH", 0.75, "AUTO_NO_ENRICH_ADDRESS_MISMATCH"), ("ADDRESS_MISMATCH", 0.74, "REVIEW_LOW_CONFIDENCE_MISMATCH"), ("VERIFIED", 0.0, "AUTO_ENRICH"), ("API_ERROR", 0.0, "REVIEW_API_ERROR"), (None, None, "DEFER_NO_EVIDENCE")])
def test_routes(spark, status, c, route):
    df = spark.createDataFrame([(status, c)], "company_verification_status string, overall_confidence_score double")
    assert verification.route(df).first()["review_routing"] == route


def test_distance_bands(spark):
    pairs = [(0.0, 0.0, 0.005, 0.0), (0.0, 0.0, 0.2, 0.0), (None, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0005)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, b double, c double, d double").select(verification.distance_score(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [0.75, 0.10, 0.0, 1.0]


def test_last_evidence_row_wins_and_first_key_is_looked_up_first(spark):
    ev = spark.createDataFrame([(1, "k1", "", "a"), (2, "K-1", "", "b"), (3, "", "k2", "c")], "load_order long, MDM_KEY string, SRC_KEY string, summary string")
    recs = spark.createDataFrame([(1, "k 1", "k2"), (2, "", "k2"), (3, "zz", None)], "row_id long, MDM_KEY string, SRC_KEY string")
    got = {r["row_id"]: r["external_evidence_text"] for r in verification.lookup_evidence(recs, verification.evidence_index(ev)).collect()}
    assert got == {1: "b", 2: "c", 3: ""}


def test_verification_cascade(spark):
    import json

    hit = lambda name, address, lat: json.dumps({"results": [{"poi": {"name": name}, "address": {"freeformAddress": address}, "position": {"lat": lat, "lon": 1.0}, "score": 1.0}]})
    recs = spark.createDataFrame([(i, "Acme Tools", "1 Main Street", 1.0, 1.0) for i in range(4)], "row_id long, company_name string, address string, latitude double, longitude double")
    t = lambda rows: spark.createDataFrame(rows, "row_id long, response string")
    out = verification.verify(recs, t([(0, hit("Acme Tools Inc", "1 main street", 1.0)), (1, hit("Other", "1 main street", 1.0))]), t([(1, hit("Other Shop", "1 Main Street", 1.0))]), t([(2, hit("ACME tools", "9 Far Road", 50.0))]))
    got = {r["row_id"]: r["verification"]["company_verification_status"] for r in out.collect()}
    assert got == {0: "VERIFIED", 1: "ADDRESS_MISMATCH", 2: "CORRECT_ADDRESS_CANDIDATE", 3: "UNVERIFIED"}


def test_enrichment_overlay(spark):
    import json

    chat = lambda s: json.dumps({"choices": [{"message": {"content": s}}]})
    rows = [("VERIFIED", "Acme", "1 A", "C", "S", "V", chat('ok {"website": "w", "confidence_notes": "n"}')), ("VERIFIED", "Acme", "1 A", "C", "S", "V", chat("no")), ("UNVERIFIED", "", "", "C", "S", "V", chat('{"website": "w"}'))]
    df = spark.createDataFrame(rows, "final_company_verification_status string, matched_company_name string, matched_address string, cleaned_name string, SOURCE_NAME string, validated_address string, answer string")
    got = [(r["legal_name"], r["website"], r["enrichment_method"], r["enrichment_notes"]) for r in verification.enrich(df, "answer").collect()]
    assert got[0] == ("Acme", "w", "openai_assisted", "n") and got[1][1:3] == ("", "deterministic_fallback") and "non-JSON" in got[1][3] and got[2][0] == "C" and "held" in got[2][3]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc .,inc", max_size=20), st.text("abc .,inc", max_size=20)), min_size=1, max_size=30))
def test_similarity_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select(x.token_similarity("a", "b").alias("s"), x.token_similarity("b", "a").alias("r"), x.normalize_text("a").alias("n"), x.normalize_text(x.normalize_text("a")).alias("nn"))
    for r in df.collect():
        assert r["s"] == r["r"] and 0 <= r["s"] <= 1
