"""Tables on disk and the two versions of the order book that the queries compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FORMATS = ("parquet", "orc", "csv", "json")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; only the columns a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Any of Spark's file formats. Text formats need a schema; inferring one would read the data twice."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind!r} is none of {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def cents(column: str | Column) -> Column:
    """Money as whole cents, so that sums don't depend on their order."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column * 100).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input log: user k, pass number (day), place in the pass, value in cents, type and time."""
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), day.alias("version"), F.col("event_id").alias("seq"), cents("value").alias("v"), "event_type", F.col("ts"))


def book(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """The order book (k, v): version 0 as it is; version 1 without keys divisible by 10, with 100 cents more
    where 7 divides the key, and with a new key 10**9 + k for each k divisible by 11."""
    v0 = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), cents("o_totalprice").alias("v"))
    if version == 0:
        return v0
    kept = v0.where("k % 10 <> 0").select("k", (F.col("v") + F.when(F.col("k") % 7 == 0, 100).otherwise(0)).alias("v"))
    return kept.unionByName(v0.where("k % 11 = 0").select((F.col("k") + 10**9).alias("k"), "v"))
