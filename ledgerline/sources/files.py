"""Readers and writers of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tables as t

REQUIRED = ["MDM_KEY", "SOURCE_NAME", "FULL_ADDRESS", "ROWID_SYSTEM", "name_sub_category"]


def read_records(spark: SparkSession, path: str, row_id: str = "row_id") -> DataFrame:
    """A CSV of raw records: every column text, header names stripped, the usual marks of a missing value read as null,
    line breaks inside quoted fields kept. ``row_id`` numbers the rows in order of arrival (partition, then place)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    if lacking := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"columns are missing: {lacking}")
    df = df.select([F.when(~F.col(f"`{c}`").isin(t.MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.withColumn(row_id, F.monotonically_increasing_id())


def read_stage(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """What a pass has handed over, with its own schema; Parquet keeps types, CSV is read by the schema given."""
    reader = spark.read.schema(schema)
    return reader.parquet(path) if kind == "parquet" else reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_evidence(spark: SparkSession, path: str, order: str = "load_order") -> DataFrame | None:
    """Evidence from CSV or from JSON, there a list of rows or an object with ``records``; null without rows or where the
    file cannot be read."""
    try:
        if path.lower().endswith(".json"):
            df = spark.read.option("multiLine", True).json(path)
            if "records" in df.columns:
                df = df.select(F.explode("records").alias("r")).select("r.*")
        else:
            df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        if df.limit(1).count() == 0:
            return None
    except Exception as e:  # the file is optional
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e) or "_corrupt_record" in str(e):
            return None
        raise
    return df.withColumn(order, F.monotonically_increasing_id())


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's first sheet. Workbooks are small (at most 1,048,576 rows) and read on the driver; needs openpyxl."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str))


def write_excel(df: DataFrame, path: str, limit: int = 1_048_575) -> None:
    """A workbook of at most as many rows as a sheet can hold; more raise an error."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError("too many rows for a sheet")
    df.toPandas().to_excel(path, index=False)


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, as CSV needs."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select([(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "csv":
        flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_subsets(df: DataFrame, folder: str, subsets: dict, kind: str = "parquet", only_if_any: tuple = ()) -> None:
    """Named subsets by their conditions; those in ``only_if_any`` are left out when empty."""
    for name, test in subsets.items():
        part = df.filter(test)
        if name not in only_if_any or not part.isEmpty():
            write_table(part, f"{folder}/{name}", kind)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text, such as a report, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """The names in a folder that match, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getName() for f in found or [])
