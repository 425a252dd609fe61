"""Aggregates of the stage reports, each a DataFrame, and the reports put together from them."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x
from .records import FLAGS


def value_counts(df: DataFrame, column: str, nulls: str = "drop", fill: str = "N/A") -> DataFrame:
    """(value, n) in falling order, ties by value. ``nulls``: drop, keep, or fill with ``fill``."""
    c = F.col(column).cast("string")
    if nulls == "fill":
        c = F.coalesce(c, F.lit(fill))
    rows = df.select(c.alias("value"))
    if nulls == "drop":
        rows = rows.filter("value is not null")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.greatest(whole, F.lit(1)), 1)


def _rates(with_detail: bool) -> list[Column]:
    s, n = F.col("validation_status"), F.count(F.lit(1))
    exact, usable = F.count_if(s.isin(t.EXACT)), F.count_if(s.isin(t.USABLE))
    detail = [F.count_if(s == "VALIDATED").alias("validated"), F.count_if(s == "CORRECTED").alias("corrected"), F.count_if(s == "PARTIAL_VALIDATED").alias("partial_validated"), F.count_if(s == "FAILED").alias("failed")]
    counts = [exact.alias("exact_success"), usable.alias("usable_success")]
    return [n.alias("total"), *(detail if with_detail else counts), percent(exact, n).alias("exact_success_rate"), percent(usable, n).alias("usable_success_rate")]


def breakdown(df: DataFrame, column: str, with_detail: bool = False) -> DataFrame:
    """Success counts and rates by group. A null group holds records, but a total of none, as equality with null fails."""
    out = df.groupBy(column).agg(*_rates(with_detail))
    none = F.col(column).isNull()
    return out.select(column, *[F.when(none, F.lit(0).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in out.schema.fields[1:]])


def success_summary(df: DataFrame) -> DataFrame:
    s, n = F.col("validation_status"), F.count(F.lit(1))
    exact, usable = F.count_if(s.isin(t.EXACT)), F.count_if(s.isin(t.USABLE))
    return df.agg(exact.alias("exact_success"), percent(exact, n).alias("exact_success_rate"), usable.alias("usable_success"), percent(usable, n).alias("usable_success_rate"), F.count_if(s == "PARTIAL_VALIDATED").alias("partial_validated"))


def action_counts(df: DataFrame, column: str) -> DataFrame:
    """(action, n) over all entries of an array column."""
    return df.select(F.explode(column).alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "action")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` by each of the named values of ``column``, in one aggregation."""
    return df.filter(F.col(row).isNotNull()).groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def modified(df: DataFrame) -> DataFrame:
    """Records whose name or address a first pass has changed, with shares."""
    n = F.count(F.lit(1))
    name = F.count_if(x.strip(x.text("SOURCE_NAME")) != F.col("cleaned_name"))
    address = F.count_if(F.size("normalization_actions") > 0)
    return df.agg(n.alias("total"), name.alias("names_modified"), percent(name, n).alias("names_pct"), address.alias("addresses_modified"), percent(address, n).alias("addresses_pct"))


def flag_counts(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.count_if(c).alias(c) for c in FLAGS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in FLAGS])).alias("r")).select("r.*")


def field_coverage(df: DataFrame, fields: list[str] = t.COVERAGE_FIELDS) -> DataFrame:
    """(field, n): records in which the field is not blank."""
    one = df.agg(*[F.count_if(~x.is_blank(c)).alias(c) for c in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in fields])).alias("r")).select("r.*")


def truthy(df: DataFrame, column: str) -> DataFrame:
    """How many values read as true, 1 or yes."""
    return df.agg(F.count_if(F.lower(F.col(column).cast("string")).isin("true", "1", "yes")).alias("n"))


def mean_confidence(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg(F.coalesce("overall_confidence_score", F.lit(0.0))), 3).alias("average_overall_confidence"))


def funnel(df: DataFrame, with_partial: bool = True) -> DataFrame:
    """Final counts of a run; success leaves partial validations out unless ``with_partial``."""
    s = F.col("validation_status")
    names = ["VALIDATED", "CORRECTED", "PARTIAL_VALIDATED", "FAILED", "SKIPPED"]
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == v).alias(v.lower()) for v in names], F.count_if(s.isin(t.USABLE if with_partial else t.EXACT)).alias("success"), F.count_if("manual_review_flag").alias("manual_review"))


def head(df: DataFrame, test: Column, n: int = 10, order: str = "row_id") -> DataFrame:
    """The first ``n`` records that pass, in order of arrival (a top-n)."""
    return df.filter(test).orderBy(order).limit(n)


#: Leading bits of the MD5 by which a sample's cut-off is found.
SAMPLE_BITS = 16


def exact_sample(df: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Exactly ``int(share * rows)`` records, those of least MD5 of the key, ties by key: a sampling operator. A histogram
    of leading bits says which records are in; only those of the one bucket that is cut are sorted."""
    name = F.md5(F.col(key).cast("string").cast("binary"))
    rows = df.withColumn("_md5", F.coalesce(name, F.lit("")))
    bucket = F.coalesce(F.conv(F.substring("_md5", 1, SAMPLE_BITS // 4), 16, 10).cast("int"), F.lit(-1))
    rows = rows.withColumn("_bucket", bucket)
    counts = sorted((r["_bucket"], r["n"]) for r in rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2 ** SAMPLE_BITS + 1
    left = int(sum(n for _, n in counts) * share)
    for b, n in counts:
        if n > left:
            break
        left -= n
    else:
        return df
    cut = rows.filter(F.col("_bucket") == b).orderBy("_md5", key).limit(left)
    return rows.filter(F.col("_bucket") < b).union(cut).drop("_md5", "_bucket")


#: Counts of at most so many values are put into a report; of more, the report names the table they are in.
MOST_VALUES = 2000
#: Columns whose values are text of any kind, and whose counts are written as tables beside the report.
FREE_TEXT = ["parsed_country", "ROWID_SYSTEM", "name_sub_category", "norm_country", "failure_reason"]


def _few(df: DataFrame) -> list | None:
    rows = df.limit(MOST_VALUES + 1).collect()
    return rows if len(rows) <= MOST_VALUES else None


def _dict(counts: DataFrame, of: str = "") -> dict:
    """A counted column as a dictionary."""
    rows = _few(counts)
    return {"table": of} if rows is None else {r[0]: r[1] for r in rows}


def count_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The counts of free-text columns, by column."""
    return {c: value_counts(df, c) for c in FREE_TEXT if c in df.columns}


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def _by(df: DataFrame) -> dict:
    rows = _few(df)
    return {"table": df.columns[0]} if rows is None else {r[0]: {k: v for k, v in r.asDict().items() if k != df.columns[0]} for r in rows}


def first_report(df: DataFrame) -> dict:
    m = _row(modified(df))
    flags = _dict(flag_counts(df))
    tiers = ["CRITICAL", "INCOMPLETE", "NEEDS_PREP", "READY"]
    table = _by(crosstab(df, "parsed_country", "quality_tier", tiers))
    sample = head(df, F.col("quality_tier").isin("CRITICAL", "INCOMPLETE")).collect()
    return {
        "generated_at": datetime.datetime.now().isoformat(), "total_records": m["total"], "columns": df.columns,
        "country_distribution": _dict(value_counts(df, "parsed_country"), "parsed_country"), "source_system_distribution": _dict(value_counts(df, "ROWID_SYSTEM"), "ROWID_SYSTEM"), "name_subcategory_distribution": _dict(value_counts(df, "name_sub_category"), "name_sub_category"),
        "language_distribution": _dict(value_counts(df, "detected_lang")), "language_method_distribution": _dict(value_counts(df, "lang_method")), "quality_tier_distribution": _dict(value_counts(df, "quality_tier")),
        "flag_counts": flags, "missing_fields": {k: flags[f"flag_{k}"] for k in ("no_street", "no_city", "no_state", "no_postal", "no_street_number")},
        "encoding_issues": {"records_repaired": flags["flag_encoding_repaired"], "garbled_unrecoverable": flags["flag_garbled_text"]},
        "name_cleaning": {"records_modified": m["names_modified"], "pct_modified": m["names_pct"], "action_breakdown": _dict(action_counts(df, "name_cleaning_actions"))},
        "address_normalization": {"records_modified": m["addresses_modified"], "pct_modified": m["addresses_pct"], "action_breakdown": _dict(action_counts(df, "normalization_actions"))},
        "country_quality_crosstab": table if "table" in table else {tier: {c: row[tier] for c, row in table.items()} for tier in tiers},
        "sample_problematic_records": [{"MDM_KEY": r["MDM_KEY"], "SOURCE_NAME": r["SOURCE_NAME"], "cleaned_name": r["cleaned_name"], "street": r["parsed_street"], "norm_street": r["norm_street"], "city": r["parsed_city"], "country": r["parsed_country"], "quality_tier": r["quality_tier"], "flags": {c: True for c in FLAGS if r[c]}} for r in sample],
    }


def validation_report(df: DataFrame) -> dict:
    failed, manual = df.filter("validation_status = 'FAILED'"), df.filter("manual_review_flag")
    fixed = df.filter("correction_status is not null and correction_status <> 'N/A'")
    keep = ["MDM_KEY", "SOURCE_NAME", "api_address", "norm_country", "failure_reason", "quality_tier", "completeness_class"]
    return {
        "generated_at": datetime.datetime.now().isoformat(), "total_records": df.count(),
        "validation_distribution": _dict(value_counts(df, "validation_status")), "correction_distribution": _dict(value_counts(df, "correction_status", "fill")), "success_summary": _row(success_summary(df)),
        "country_breakdown": _by(breakdown(df, "norm_country", True)), "tier_breakdown": _by(breakdown(df, "quality_tier")), "completeness_breakdown": _by(breakdown(df, "completeness_class")),
        "translation_handling": {"distribution": _dict(value_counts(df, "translation_handling_status", "fill", "UNKNOWN")), "needs_translation_total": _row(truthy(df, "needs_translation"))["n"], "api_strategy_distribution": _dict(value_counts(df, "api_strategy", "fill", "UNKNOWN"))},
        "failure_analysis": {"total_failed": failed.count(), "failure_reasons": _dict(value_counts(failed, "failure_reason"), "failure_reason"), "sample_failures": [r.asDict() for r in head(failed, F.lit(True)).select(keep).withColumnRenamed("norm_country", "country").collect()]},
        "manual_review": {"total": manual.count(), "by_country": _dict(value_counts(manual, "norm_country"), "norm_country")},
        "correction_effectiveness": {"total_attempted": fixed.count(), "strategy_breakdown": _dict(value_counts(fixed, "correction_strategy"))},
    }


def company_report(df: DataFrame) -> dict:
    n = df.count()
    trusted = df.filter(F.col("company_verification_status").isin(t.TRUSTED)).count()
    routes = _dict(value_counts(df, "review_routing", "keep"))
    review = df.filter("week3_manual_review_flag")
    return {
        "generated_at": datetime.datetime.now().isoformat(), "total_records": n, "company_verification_distribution": _dict(value_counts(df, "company_verification_status", "keep")),
        "verification_success": {"verified_or_likely": trusted, "verified_or_likely_rate": round(100 * trusted / max(n, 1), 1)}, "enrichment_method_distribution": _dict(value_counts(df, "enrichment_method", "keep")),
        "enrichment_field_coverage": _dict(field_coverage(df)),
        "ai_adjudication": {"distribution": _dict(value_counts(df, "ai_adjudication_status", "keep")), "promoted_matches": df.filter("ai_promoted_match").count(), **_row(mean_confidence(df))},
        "evidence_sources": {"external_web_evidence_records_used": df.filter("external_evidence_available").count()},
        "review_routing": {"distribution": routes, "targeted_review_total": sum(v for k, v in routes.items() if k and k.startswith("REVIEW_")), "auto_enrich_total": routes.get("AUTO_ENRICH", 0), "auto_no_enrich_total": routes.get("AUTO_NO_ENRICH_ADDRESS_MISMATCH", 0), "deferred_no_evidence_total": routes.get("DEFER_NO_EVIDENCE", 0)},
        "manual_review": {"total": review.count(), "by_status": _dict(value_counts(review, "company_verification_status")), "by_priority": _dict(value_counts(review, "review_priority"))},
    }


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=str)


def run_counters(df: DataFrame) -> DataFrame:
    """What a validation run did: records by state, correction attempts and successes."""
    s = F.col("validation_status")
    named = {"validated": "VALIDATED", "corrected": "CORRECTED", "partial": "PARTIAL_VALIDATED", "failed": "FAILED", "errors": "API_ERROR", "skipped": "SKIPPED"}
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == v).alias(k) for k, v in named.items()], F.coalesce(F.sum("correction_attempts"), F.lit(0)).alias("attempts"), F.count_if(F.col("correction_status").isin("ENGINE_CORRECTED", "ENGINE_PARTIAL")).alias("engine_successes"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Each value once, a missing one too."""
    return df.select(column).distinct()


def summary(df: DataFrame, columns: list[str]) -> str:
    """Counts and shares of the named columns' values, for a console."""
    n = df.count()
    lines = [f"{n} records"]
    for c in columns:
        lines.append(c)
        lines += [f"  {r['value']}: {r['n']} ({100 * r['n'] / max(n, 1):.1f}%)" for r in value_counts(df, c, "keep").collect()]
    return "\n".join(lines)
