"""Whole runs over files, and the stream."""

import json
import os

import pytest

from ledgerline.plans import pipeline
from ledgerline.sources import files, providers
from ledgerline.sources.synthetic import mdm_raw
from ledgerline.streaming import records as streaming


def test_run(spark, sf_dir, tmp_path):
    raw = mdm_raw(spark, sf_dir).drop("row_id").limit(60)
    src = str(tmp_path / "raw")
    raw.coalesce(1).write.option("header", True).option("escape", '"').csv(src)
    (tmp_path / "evidence.json").write_text(json.dumps({"records": [{"MDM_KEY": "M1", "snippet": "seen", "source_url": "u"}]}))
    counts = pipeline.run(spark, src, str(tmp_path / "out"), evidence_path=str(tmp_path / "evidence.json"))
    assert counts["total"] == 60 and counts["validated"] + counts["corrected"] + counts["partial_validated"] + counts["failed"] + counts["skipped"] == 60
    out = spark.read.parquet(str(tmp_path / "out/stage3_enriched"))
    assert out.count() == counts["success"]
    parts = [spark.read.parquet(str(tmp_path / f"out/stage3_{n}")).count() for n in ("auto_enriched", "auto_no_enrich", "targeted_review", "deferred_no_evidence")]
    assert sum(parts) == out.count()
    report = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out/eda_report")).collect()))
    assert sum(report["quality_tier_distribution"].values()) == 60
    assert out.filter("external_evidence_available").count() <= 1


def test_missing_marks_and_line_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(' MDM_KEY ,SOURCE_NAME,FULL_ADDRESS,ROWID_SYSTEM,name_sub_category\n007,NA,"a\nb|#|#c",S,x\n')
    r = files.read_records(spark, str(p)).first()
    assert (r["MDM_KEY"], r["SOURCE_NAME"], r["FULL_ADDRESS"]) == ("007", None, "a\nb|#|#c")


def test_csv_sink_flattens(spark, sf_dir, tmp_path):
    from ledgerline.operators import records

    files.write_table(records.clean_names(mdm_raw(spark, sf_dir)), str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).filter("name_cleaning_actions = '[]'").count() > 0


def test_equal_requests_are_sent_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, q string")
    seen = spark.sparkContext.accumulator(0)

    def call(row):
        seen.add(1)
        if row["q"] == "b":
            raise ValueError("down")
        return '{"ok": 1}'

    rows = {r["id"]: r["response"] for r in providers.ask_once(df, ["q"], providers.live(call, 0)).collect()}
    assert rows == {1: '{"ok": 1}', 2: '{"ok": 1}', 3: None} and seen.value == 2
    recorded = df.filter("q = 'a'").select(providers.request_key("q").alias("request_key")).dropDuplicates().selectExpr("request_key", "'r' AS response")
    assert {r["id"]: r["response"] for r in providers.ask_once(df, ["q"], providers.replayed(recorded)).collect()} == {1: "r", 2: "r", 3: None}


def test_urls():
    assert providers.service_url(" api.x/ ") == "https://api.x" and providers.service_url(" ") is None
    assert providers.chat_url("x.y", "d", "v") == "https://x.y/openai/deployments/d/chat/completions?api-version=v"
    assert providers.fuzzy_url("https://a/search/poi/json") == "https://a/search/fuzzy/json"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    raw = mdm_raw(spark, sf_dir).limit(40)
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    streaming.start(stream, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    batch = streaming.validated_stream(spark.read.parquet(str(tmp_path / "in"))).select("row_id", "validation_status").collect()
    got = spark.read.parquet(str(tmp_path / "out")).select("row_id", "validation_status").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_exact_sample(spark):
    from ledgerline.operators import reports

    df = spark.range(997).selectExpr("id AS k", "id % 3 AS v")
    import hashlib

    want = sorted(range(997), key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))[:99]
    out = reports.exact_sample(df, "k")
    assert sorted(r["k"] for r in out.collect()) == sorted(want) and out.columns == ["k", "v"]
    assert reports.exact_sample(df, "k", 1.0).count() == 997 and reports.exact_sample(df.limit(0), "k").count() == 0
    same = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(20)], "k string, v int")
    assert reports.exact_sample(same, "k", 0.25).count() == 10


def test_many_values_go_to_a_table(spark, monkeypatch):
    from ledgerline.operators import reports

    monkeypatch.setattr(reports, "MOST_VALUES", 3)
    df = spark.createDataFrame([(f"c{i % 5}",) for i in range(20)], "parsed_country string")
    assert reports._dict(reports.value_counts(df, "parsed_country"), "parsed_country") == {"table": "parsed_country"}
    assert reports.count_tables(df)["parsed_country"].count() == 5


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from ledgerline.sources import store

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(bare)
    df = store.cut(spark.range(5))
    folder = df.inputFiles()[0].rpartition("/")[0]
    store.drop_dir(spark, df)
    assert not os.path.exists(folder.removeprefix("file:").replace("//", "/"))


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from ledgerline.__main__ import main

    raw = str(tmp_path / "raw")
    mdm_raw(spark, sf_dir).drop("row_id").limit(20).coalesce(1).write.option("header", True).option("escape", '"').csv(raw)
    main(["run", raw, str(tmp_path / "out")])
    main(["validate", str(tmp_path / "out")])
    main(["verify", str(tmp_path / "out"), "--limit", "10"])
    said = capsys.readouterr().out
    assert "total: 20" in said and "10 records" not in said.split("total: 20")[0] and said.count("stage3_enriched") == 3


def test_workbooks(spark, tmp_path):
    pytest.importorskip("openpyxl")
    df = spark.createDataFrame([("a", "007"), ("b", None)], "x string, y string")
    files.write_excel(df, str(tmp_path / "t.xlsx"))
    assert sorted(r["x"] for r in files.read_excel(spark, str(tmp_path / "t.xlsx")).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        files.write_excel(df, str(tmp_path / "u.xlsx"), limit=1)
