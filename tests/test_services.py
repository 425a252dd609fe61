import json

from pyspark.sql import functions as F

from ledgerline.functions import tables as t
from ledgerline.operators import enhance, reports, validation, verification
from ledgerline.sources import providers
from ledgerline.sources import services as s


def test_requests():
    r = s.geocode("https://m/s", "k", {"address": "1 A St", "country": "us "})
    assert r.full_url == "https://m/s?api-version=1.0&subscription-key=k&query=1+A+St&limit=1&countrySet=US" and r.seconds == 10
    assert "countrySet" not in s.geocode("u", "k", {"address": "x", "country": "nan"}).params
    near = s.poi("u", "k", {"company_name": "A  B", "address": "q", "latitude": 1, "longitude": 2.0})
    assert near.params["radius"] == 3000 and near.params["query"] == "A B" and near.params["limit"] == 10
    assert s.poi("u", "k", {"company_name": "A", "address": "q", "latitude": float("nan"), "longitude": 2.0}, True).params == {"api-version": "1.0", "subscription-key": "k", "query": "q", "limit": 5}
    assert s.fuzzy("u", "k", {"company_name": "A", "latitude": 1, "longitude": 2}).params["radius"] == 50000
    assert s.web("u", "k", {"query": "q"}).params["count"] == 3
    assert "api-key" in s.chat_headers("https://x/openai/deployments/d", "k") and "Authorization" in s.chat_headers("https://x/v1", "k")
    body = s.enrichment("u", "k", {"cleaned_name": "A"}).body
    assert body["temperature"] == 0 and json.loads(body["messages"][1]["content"])["company_name"] == "A"
    asked = json.loads(s.adjudication("u", "k", {}).body["messages"][1]["content"])
    assert set(asked["allowed_decisions"]) == set(t.DECISIONS) and len(asked["decision_rules"]) == len(t.DECISIONS)
    assert json.loads(s.adjudication("u", "k", {}, {"VERIFIED": "sure"}).body["messages"][1]["content"])["decision_rules"] == ["VERIFIED: sure"]
    assert s.translation("https://t/", "k", {"street": " "}) is None and s.translation("https://t/", "k", {"street": "a", "lang": "ru"}).params["from"] == "ru"


def test_translation_answers(spark):
    row = {"row_id": 1, "street": "улица 7", "city": "", "state": "x", "name": "n"}
    got = s.translated(row, json.dumps([{"translations": [{"text": "street 7"}]}, {"translations": []}, {"translations": [{"text": "N"}]}]))
    assert got == {"street": "street 7", "city": "", "state": "", "name": "N", "status": "TRANSLATED_TO_ENGLISH", "reason": ""}
    assert s.translated(row, None)["status"] == "TRANSLATION_ERROR" and s.translated({}, "[]")["status"] == "TRANSLATION_SKIPPED_EMPTY_FIELDS"
    df = spark.createDataFrame([(1, "ru", "улица 7", "Москва", "x", "RU", "1"), (2, "en", "1 A St", "B", "", "US", "2")], "row_id long, detected_lang string, enhanced_street string, norm_city string, enhanced_state string, suggested_country string, enhanced_postal string")
    answers = spark.createDataFrame([{"row_id": 1, **got}])
    rows = {r["row_id"]: r for r in enhance.api_fields(df, answers).collect()}
    assert rows[1]["api_address"] == "street 7, Москва, x, 1, RU" and rows[1]["translation_handling_status"] == "TRANSLATED_TO_ENGLISH" and rows[2]["translation_handling_status"] == "NOT_NEEDED_LATIN_SCRIPT"


def test_counters(spark):
    df = spark.createDataFrame([("VALIDATED", None, 0, False), ("CORRECTED", "ENGINE_CORRECTED", 2, False), ("FAILED", "EXHAUSTED", 3, True), ("SKIPPED", None, None, True)], "validation_status string, correction_status string, correction_attempts int, manual_review_flag boolean")
    r = reports.run_counters(df).first()
    assert (r["total"], r["skipped"], r["attempts"], r["engine_successes"]) == (4, 1, 5, 1)
    assert "VALIDATED" in reports.summary(df.withColumn("x", F.lit(1)), ["validation_status"])


def test_request_keys_keep_borders(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a|", "bc"), ("1:a", None), ("1:a", "")], "x string, y string")
    keys = [r[0] for r in df.select(providers.request_key("x", "y")).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4]
    places = spark.createDataFrame([("Acme Inc.", "1 A St.", "us", 1.000001, 2.0), ("ACME", "1 a st", "US", 1.000004, 2.0), ("ACME", "1 a st", "US", 1.00004, 2.0), ("ACME", "1 a st", "US", None, 2.0)], "n string, a string, c string, lat double, lon double")
    keys = [r[0] for r in places.select(providers.verification_key("n", "a", "c", "lat", "lon")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_ask_once_orders_limits_and_carries_errors(spark):
    df = spark.createDataFrame([(3, "B b"), (1, "b  B"), (2, "c"), (4, "d"), (5, None), (6, "skip")], "row_id long, q string")
    seen = []

    def resolve(requests):
        seen.extend(r["q"] for r in requests.collect())
        return requests.select("request_key", F.when(F.col("q") != "c", F.upper("q")).alias("response"), F.when(F.col("q") == "c", "down").alias("error"))

    key = providers.request_key(F.lower(F.regexp_replace("q", " +", " ")))
    out = providers.ask_once(df, ["q"], resolve, "said", key, "row_id", F.col("q").isNotNull() & (F.col("q") != "skip"), budget=2)
    got = {r["row_id"]: (r["said"], r["said_error"]) for r in out.collect()}
    assert got == {1: ("B  B", None), 3: ("B  B", None), 2: (None, "down"), 4: (None, None), 5: (None, None), 6: (None, None)} and sorted(seen) == ["b  B", "c"]


def test_failed_calls_reach_the_record(spark):
    df = spark.createDataFrame([(1, "1 Main Street, Springfield, US", "US", "FULL"), (2, "x", "US", "EMPTY")], "row_id long, api_address string, suggested_country string, completeness_class string")
    asked = []

    def resolve(requests):
        asked.extend(r["address"] for r in requests.collect())
        return requests.select("request_key", F.lit(None).cast("string").alias("response"), F.lit("Request timeout").alias("error"))

    got = {r["row_id"]: r for r in validation.validate_records(df, validation.by_service(resolve)).collect()}
    assert (got[1]["validation_status"], got[1]["failure_reason"], got[1]["manual_review_flag"]) == ("API_ERROR", "Request timeout", True)
    assert got[2]["validation_status"] == "SKIPPED" and asked == ["1 Main Street, Springfield, US"]
    failed = verification.verify(
        spark.createDataFrame([(1, "Acme", "1 A", 1.0, 1.0)], "row_id long, company_name string, address string, latitude double, longitude double"),
        *[spark.createDataFrame([(1, None, "down")], "row_id long, response string, response_error string")] * 3,
    ).first()["verification"]
    assert (failed["company_verification_status"], failed["api_error"], failed["verification_evidence"]) == ("UNVERIFIED", "down", ["down"])


def chat(content):
    return F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))


def answer(response, error=None):
    return lambda r: r.select("request_key", response.alias("response"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def place(name, address):
    hit = F.struct(F.lit("POI").alias("type"), F.lit(1.0).alias("score"), F.struct(name.alias("name"), F.array(F.lit("shop")).alias("categories")).alias("poi"), F.struct(address.alias("freeformAddress")).alias("address"), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("position"))
    return F.to_json(F.struct(F.array(hit).alias("results")))


def test_a_run_with_services_and_its_replay(spark, sf_dir, tmp_path):
    from ledgerline import catalogue
    from ledgerline.plans import pipeline
    from ledgerline.sources.synthetic import mdm_raw

    raw = str(tmp_path / "raw")
    mdm_raw(spark, sf_dir).drop("row_id").orderBy("MDM_KEY").limit(60).coalesce(1).write.option("header", True).option("escape", '"').csv(raw)
    odd = F.crc32("company_name") % 2 == 0
    live = providers.Services(
        translate=answer(F.to_json(F.array(F.struct(F.array(F.struct(F.lit("7 High Street").alias("text"))).alias("translations"))))),
        geocode=catalogue._service,
        poi_by_name=answer(F.when(odd, place(F.concat("company_name", F.lit(" GmbH")), F.col("address")))), poi_by_address=answer(place(F.lit("Other Shop"), F.col("address"))), fuzzy=answer(F.lit(None).cast("string"), F.lit("down")),
        web=answer(F.lit('{"webPages": {"value": [{"name": "n", "snippet": "s", "url": "u"}]}}')), web_budget=5,
        adjudicate=answer(chat(F.lit('{"decision": "VERIFIED", "confidence": 0.9, "reason": "same"}'))), enrich=answer(F.when(F.crc32("matched_company_name") % 2 == 0, chat(F.lit('{"website": "w.com"}'))), F.when(F.crc32("matched_company_name") % 2 == 1, F.lit("HTTP 500"))),
    )
    counts = pipeline.run(spark, raw, str(tmp_path / "out"), services=live)
    done = spark.read.parquet(str(tmp_path / "out/stage2b_validated"))
    assert counts["total"] == 60 and done.filter("validation_status = 'API_ERROR'").count() > 0
    assert done.filter("translation_handling_status = 'TRANSLATED_TO_ENGLISH' and translated_street = '7 High Street'").count() > 0
    out = spark.read.parquet(str(tmp_path / "out/stage3_enriched"))
    assert out.count() == counts["success"] and out.filter("ai_promoted_match").count() > 0 and out.filter("external_evidence_available").count() > 0
    assert {r[0] for r in out.select("enrichment_method").distinct().collect()} >= {"openai_assisted"} and out.filter("enrichment_notes like 'OpenAI enrichment failed: HTTP 500%'").count() > 0
    kept = lambda n: spark.read.parquet(str(tmp_path / f"out/answers/{n}/*"))
    assert kept("geocode").count() == kept("geocode").select("request_key").distinct().count()
    names = [f for f in ("translate", "geocode", "poi_by_name", "poi_by_address", "fuzzy", "web", "adjudicate", "enrich")]
    again = providers.Services(**{n: providers.replayed(kept(n).dropDuplicates(["request_key"])) for n in names}, web_budget=5)
    assert pipeline.run(spark, raw, str(tmp_path / "again"), services=again) == counts
    back = spark.read.parquet(str(tmp_path / "again/stage3_enriched"))
    columns = [c for c in out.columns if not c.endswith("_timestamp")]
    assert out.select(columns).exceptAll(back.select(columns)).count() == 0


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / ".env"
    f.write_text("# keys\nexport A_KEY='x y'\nB=2 # two\nbroken\n")
    monkeypatch.delenv("A_KEY", raising=False)
    assert providers.setting("A_KEY", env_file=str(f)) == "x y" and providers.setting("B", env_file=str(f)) == "2" and providers.setting("A_KEY", "z") == "z"
    monkeypatch.setenv("B", "3")
    assert providers.setting("B", env_file=str(f)) == "3" and providers.setting("C", env_file=str(f)) is None
