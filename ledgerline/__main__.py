"""Command lines: whole runs, or one pass over what an earlier one has written.

    python -m ledgerline run RECORDS.csv FOLDER [--evidence FILE]
    python -m ledgerline validate FOLDER
    python -m ledgerline verify FOLDER [--evidence FILE] [--limit N]
"""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .operators import reports
    from .plans import pipeline
    from .sources import files

    parser = argparse.ArgumentParser(prog="ledgerline")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="all passes over a CSV of raw records")
    run.add_argument("records")
    validate = commands.add_parser("validate", help="second pass and validation of a first pass")
    verify = commands.add_parser("verify", help="verification and enrichment of validated records")
    for one in (run, validate, verify):
        one.add_argument("folder")
        one.add_argument("--kind", choices=["parquet", "csv"], default="parquet")
    for one in (run, verify):
        one.add_argument("--evidence")
    verify.add_argument("--limit", type=int)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    work = lambda name: spark.read.parquet(f"{given.folder}/{name}" + (".work" if given.kind != "parquet" else ""))
    if given.command == "run":
        counts = pipeline.run(spark, given.records, given.folder, given.kind, given.evidence)
        print("\n".join(f"{k}: {v}" for k, v in counts.items()))
    elif given.command == "validate":
        df = pipeline.run_validation(pipeline.run_second(work("stage1_processed"), given.folder, given.kind), given.folder, given.kind)
        print(reports.summary(df, ["validation_status", "correction_status", "quality_tier"]))
    else:
        evidence = files.read_evidence(spark, given.evidence) if given.evidence else None
        df = pipeline.run_verification(work("stage2b_validated"), given.folder, given.kind, given.limit, evidence)
        print(reports.summary(df, ["company_verification_status", "enrichment_method", "review_routing"]))
    print("\n".join(files.listing(spark, given.folder)))


if __name__ == "__main__":
    main()
