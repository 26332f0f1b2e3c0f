"""Intermediate tables in the folder that all executors share, and prefix sums over them."""

from __future__ import annotations

import contextlib
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from deltaweave.sources.shared import shared_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there, so a lost
    executor costs a task and not the whole chain."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for file in df.inputFiles():
        at = file.rsplit("/", 1)[0]
        if root.split("://")[-1].rstrip("/") in at:
            with contextlib.suppress(Exception):
                jvm = spark._jvm
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            return


def before(df: DataFrame, bucket: str, amounts: dict[str, str | Column], within: list[str] | None = None, group: int = 4096) -> DataFrame:
    """Per bucket, the sum of each amount over all buckets before it (of the same ``within`` columns).

    Rows are summed before any shuffle of rows to one task, and then in two levels of ``group`` buckets,
    so the single-task step sees buckets / ``group`` rows. ``bucket`` is a whole number >= 0.
    Columns: ``within``, ``bucket`` and one sum per amount.
    """
    within = within or []
    names = list(amounts)
    per = df.groupBy(*within, bucket).agg(*(F.sum(F.expr(a) if isinstance(a, str) else a).alias(n) for n, a in amounts.items()))
    per = per.withColumn("_super", F.floor(F.col(bucket) / group))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    outer = per.groupBy(*within, "_super").agg(*(F.sum(n).alias(n) for n in names))
    w = earlier(Window.partitionBy(*within).orderBy("_super"))
    outer = outer.select(*within, "_super", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_o_{n}") for n in names))
    w = earlier(Window.partitionBy(*within, "_super").orderBy(bucket))
    inner = per.select(*within, "_super", bucket, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names))
    on = [inner[c].eqNullSafe(outer[c]) for c in [*within, "_super"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return inner.join(outer, cond).select(*(inner[c] for c in within), inner[bucket], *((inner[n] + outer[f"_o_{n}"]).cast("long").alias(n) for n in names))


def release(spark: SparkSession, most_seconds: float = 10.0) -> None:
    """Let Spark delete the shuffle files of finished jobs, and wait until it has: it does so when the driver's JVM
    collects garbage, and what comes next would otherwise lie on disk beside them."""
    gc.collect()
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    began, same, count = time.monotonic(), 0, -1
    while same < 2 and time.monotonic() - began < most_seconds:
        spark._jvm.System.gc()
        time.sleep(0.2)
        count, same = held().size(), same + 1 if held().size() == count else 0


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the label is the component's smallest node.

    Alternates the large-star and small-star steps, both grouped aggregations over links; every step is written
    to the shared folder. A hub's links are not gathered: its smallest neighbour comes from a partial aggregate.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = stage(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a")
        joined = large.join(least, F.col("a") == F.col("_a"))
        small = joined.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
        small = stage(small.where("a <> b").distinct(), "small-star")
        # done when the links are stars: no node hangs on two, and none is both leaf and centre
        ends = small.select(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(small.select("b", F.lit(0), F.lit(1)))
        done = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf = 1 and centre = 1").isEmpty()
        drop_staged(large)
        drop_staged(edges)
        edges = small
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
