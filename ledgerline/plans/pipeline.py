"""Whole passes over files: read, compute, write tables, subsets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as t
from ..operators import enhance, records, reports, validation, verification
from ..sources import files
from ..sources.providers import Services


def _hand_over(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Written once and read back, so that reports and subsets do not compute the pass again."""
    work = path if kind == "parquet" else f"{path}.work"
    files.write_table(df, work)
    back = df.sparkSession.read.parquet(work)
    if kind != "parquet":
        files.write_table(back, path, kind)
    return back


def _write_counts(df: DataFrame, folder: str, report: str, kind: str) -> None:
    for column, counts in reports.count_tables(df).items():
        files.write_table(counts, f"{folder}/{report}_{column}", kind)


def run_first(raw: DataFrame, folder: str, kind: str = "parquet") -> DataFrame:
    df = _hand_over(records.first_pass(raw), f"{folder}/stage1_processed", kind)
    files.write_subsets(df, folder, {"stage1_api_ready": F.col("api_ready"), "stage1_manual_review": F.col("quality_tier") == "CRITICAL"}, kind, ("stage1_manual_review",))
    files.write_text(df.sparkSession, reports.as_json(reports.first_report(df)), f"{folder}/eda_report")
    _write_counts(df.select("parsed_country", "ROWID_SYSTEM", "name_sub_category"), folder, "eda_report", kind)
    return df


def run_second(df: DataFrame, folder: str, kind: str = "parquet", missing: str = "empty", services: Services | None = None) -> DataFrame:
    return _hand_over(enhance.second_pass(df, missing=missing, translator=services and services.translate), f"{folder}/stage2a_enhanced", kind)


def run_validation(df: DataFrame, folder: str, kind: str = "parquet", accept_validated_correction: bool = False, services: Services | None = None) -> DataFrame:
    validate = validation.by_service(services.geocode) if services is not None and services.geocode is not None else validation.simulate
    df = validation.validate_records(df, validate, accept_validated_correction).withColumn("validation_timestamp", F.current_timestamp())
    df = _hand_over(df, f"{folder}/stage2b_validated", kind)
    files.write_subsets(df, folder, {"stage2b_usable": F.col("validation_status").isin(t.USABLE), "stage2b_manual_review": F.col("manual_review_flag")}, kind, ("stage2b_manual_review",))
    files.write_text(df.sparkSession, reports.as_json(reports.validation_report(df)), f"{folder}/validation_report")
    _write_counts(df.select("norm_country", "failure_reason"), folder, "validation_report", kind)
    return df


def run_verification(df: DataFrame, folder: str, kind: str = "parquet", limit: int | None = None, evidence: DataFrame | None = None, services: Services | None = None) -> DataFrame:
    """``limit`` takes the first records before the usable ones are picked."""
    if limit is not None:
        df = df.orderBy("row_id").limit(limit)
    usable = df.filter(F.col("validation_status").isin(t.USABLE))
    out = verification.third_pass(usable, verification.evidence_index(evidence) if evidence is not None else None, services=services).withColumn("stage3_timestamp", F.current_timestamp())
    out = _hand_over(out, f"{folder}/stage3_enriched", kind)
    r = F.col("review_routing")
    subsets = {
        "stage3_verified_enriched": F.col("company_verification_status").isin(t.TRUSTED), "stage3_manual_review": F.col("week3_manual_review_flag"), "stage3_auto_enriched": r == "AUTO_ENRICH",
        "stage3_auto_no_enrich": r == "AUTO_NO_ENRICH_ADDRESS_MISMATCH", "stage3_targeted_review": r.startswith("REVIEW_"), "stage3_deferred_no_evidence": r == "DEFER_NO_EVIDENCE",
    }
    files.write_subsets(out, folder, subsets, kind)
    files.write_text(out.sparkSession, reports.as_json(reports.company_report(out)), f"{folder}/week3_summary_report")
    return out


def run(spark: SparkSession, path: str, folder: str, kind: str = "parquet", evidence_path: str | None = None, services: Services | None = None) -> dict:
    """All passes over a CSV of raw records; the run's final counts. ``services`` are asked instead of simulated, and their
    answers written to ``<folder>/answers``."""
    services = services and services.recorded(f"{folder}/answers")
    df = run_second(run_first(files.read_records(spark, path), folder, kind), folder, kind, services=services)
    df = run_validation(df, folder, kind, services=services)
    evidence = files.read_evidence(spark, evidence_path) if evidence_path else None
    run_verification(df, folder, kind, evidence=evidence, services=services)
    return reports.funnel(df).first().asDict()
