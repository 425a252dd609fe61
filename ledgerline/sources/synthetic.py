"""A deterministic master-data relation derived from ``customer``, for tests and registered queries.

Each component of a record is picked from a list by the key modulo the list's length, and the lengths differ, so that
combinations vary. ``MDM_RAW_SQL`` states the same relation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ["", " (gal)", " C/o Focus", " - Recap W", " - 706", " AB12345", " Run Rate", " -", " Main Street London", " Road Madrid Inc", " - Mot", "  Oak  Avenue"]
STREETS = [
    "12 Main St", "C/ Mayor 5", "C/Mayor 5", "Bahnhof Str. 9", "V.le Roma 3", "R. Augusta 77", "Industrial Park", "", "北京路 12", "улица 7", "1 N Oak Ave", "Apt 4, 99 King Rd",
    "5 Elm Dr.\nFloor 2", "Lot 9,, Hill Ct", "Nº 8 Very Long Industrial Estate Street Name With Many More Words Than Eighty Characters 1234", "CafÃ© Rd 3", "ÃÃÃÃ ÿÿ", "one Pkwy, Suite 12",
    "77 Av. Roma", "1 St. James Blvd.", "شارع 12",
]
CITIES = ["LONDON", "Paris", "Madrid", "", "Beijing", "São Paulo", "O'BRIEN", "Guernsey", "LA"]
STATES = ["VER.", "M", "CDMX", "", "TX", "GU", "hgo"]
COUNTRIES = ["US", "MX", "ES", "GB", "DE", "GU", "CN", "BR", "CA", "HK", "FR", "nl", "IT", "PT"]
POSTALS = ["12345-6789", "sw1a1aa", "28013", "", "GY11AA", "k1a0b1", "01310100", "123", "19001", "1234 AB"]
SUB_CATEGORIES = ["Company Location and Department Codes", "Company Names with Parenthetical Descriptors", "Company Names with Contact or Attention Descriptors", "Clean Company Names"]
SYSTEMS = ["SAP", "ORACLE", "LEGACY"]


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int") + 1)


def mdm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, MDM_KEY, SRC_KEY, SOURCE_NAME, FULL_ADDRESS, ROWID_SYSTEM, name_sub_category), one row per customer."""
    k = F.col("c_custkey")
    slow = lambda n: F.floor(k / n).cast("long")
    address = F.concat_ws("|#|#", _pick(STREETS, k), _pick(CITIES, slow(2)), _pick(STATES, slow(3)), _pick(COUNTRIES, slow(5)), _pick(POSTALS, slow(7)))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    # one small file is one task; rules cost far more than dealing its rows out to all cores
    cores = spark.sparkContext.defaultParallelism
    if len(customers.inputFiles()) < cores:
        customers = customers.repartition(cores, "c_custkey")
    return customers.select(
        k.cast("long").alias("row_id"), F.concat(F.lit("M"), k).alias("MDM_KEY"), F.concat(F.lit("S"), k % 50).alias("SRC_KEY"), F.concat("c_name", _pick(SUFFIXES, slow(4))).alias("SOURCE_NAME"), address.alias("FULL_ADDRESS"),
        _pick(SYSTEMS, k).alias("ROWID_SYSTEM"), _pick(SUB_CATEGORIES, slow(6)).alias("name_sub_category"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list[str], k: str) -> str:
    return f"({_list(values)})[(({k}) % {len(values)})::INT + 1]"


MDM_RAW_SQL = f"""
SELECT c_custkey AS row_id, 'M' || c_custkey AS MDM_KEY, 'S' || (c_custkey % 50) AS SRC_KEY, c_name || {_sql_pick(SUFFIXES, "c_custkey // 4")} AS SOURCE_NAME,
  {_sql_pick(STREETS, "c_custkey")} || '|#|#' || {_sql_pick(CITIES, "c_custkey // 2")} || '|#|#' || {_sql_pick(STATES, "c_custkey // 3")} || '|#|#' ||
  {_sql_pick(COUNTRIES, "c_custkey // 5")} || '|#|#' || {_sql_pick(POSTALS, "c_custkey // 7")} AS FULL_ADDRESS,
  {_sql_pick(SYSTEMS, "c_custkey")} AS ROWID_SYSTEM, {_sql_pick(SUB_CATEGORIES, "c_custkey // 6")} AS name_sub_category
FROM customer
"""
