"""Keyed tables: unique keys, upserts and deletes, and a store that takes in change sets."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


class DuplicateKey(ValueError):
    """A keyed table has a key twice, or a null key."""


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def checked(df: DataFrame, key: str) -> DataFrame:
    """``df`` if its keys are unique and not null."""
    odd = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(3).collect()
    if odd:
        raise DuplicateKey(f"{key}: {[r[0] for r in odd]}")
    return df


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` replace rows of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Without the given keys; keys that aren't there change nothing."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


class Store:
    """A keyed table in Parquet: a base with one folder per bucket of keys, and change files that came after it.

    A pass writes its change set and nothing else, in one job. Reading lays the latest change of each key over the
    base. When ``pending`` change files have piled up they are merged into the buckets they touch; the other buckets
    stay as they are. A version is a manifest, written last, so a failed pass leaves the version before, and any
    version that is not yet merged away can be opened again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int | None = None, pending: int = 16):
        self.spark, self.path, self.key, self.buckets, self.most_pending = spark, path.rstrip("/"), key, buckets, pending
        self.version, self.places, self.pending, self.schema = -1, {}, [], None

    # files

    def _folder(self, at: str):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _buckets_in(self, at: str) -> list[int]:
        fs, path = self._folder(at)
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if f.getPath().getName().startswith("_bucket="))

    def _manifest(self) -> None:
        self.version += 1
        known = {"version": self.version, "key": self.key, "buckets": self.buckets, "places": self.places, "pending": self.pending, "schema": self.schema.json()}
        fs, path = self._folder(f"{self.path}/manifest-{self.version}.json")
        out = fs.create(path, True)
        try:
            out.write(bytearray(json.dumps(known).encode()))
        finally:
            out.close()

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Store:
        """The store as of a version, the last one by default."""
        store = cls(spark, path, "")
        if version is None:
            fs, at = store._folder(store.path)
            names = [f.getPath().getName() for f in fs.listStatus(at)]
            version = max(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        fs, at = store._folder(f"{store.path}/manifest-{version}.json")
        stream = fs.open(at)
        try:
            known = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        store.version, store.key, store.buckets, store.pending = known["version"], known["key"], known["buckets"], known["pending"]
        store.places = {int(b): at for b, at in known["places"].items()}
        store.schema = StructType.fromJson(json.loads(known["schema"]))
        return store

    # keys

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.hash(column), F.lit(self.buckets))

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{self.path}/{name}-{self.version + 1}-{uuid.uuid4().hex[:8]}"
        rows = df.withColumn("_bucket", self._bucket(self.key))
        rows = rows.coalesce(1) if self.buckets == 1 else rows.repartition("_bucket")
        rows.sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(at)
        return at

    def create(self, df: DataFrame) -> Store:
        """Begin from ``df``; without a number of buckets given, one for each ``ROWS_PER_BUCKET`` rows."""
        self.schema = df.schema
        if self.buckets is None:
            self.buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
        at = self._write(df, "base")
        self.places = {b: f"{at}/_bucket={b}" for b in self._buckets_in(at)}
        self._manifest()
        return self

    def _base(self, buckets: list[int] | None = None) -> DataFrame:
        places = [at for b, at in self.places.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def _changes(self, buckets: list[int] | None = None) -> DataFrame | None:
        """(key, kind, new): the latest change of each key since the base."""
        if not self.pending:
            return None
        rest = [f for f in self.schema.fields if f.name != self.key]
        kind = StructType([self.schema[self.key], StructField("kind", StringType()), StructField("new", StructType(rest)), StructField("_bucket", IntegerType())])
        parts = [self.spark.read.schema(kind).parquet(at).withColumn("_v", F.lit(n)) for n, at in enumerate(self.pending)]
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))
        return rows.groupBy(self.key).agg(F.max_by(F.struct("kind", "new"), "_v").alias("_c")).select(self.key, "_c.kind", "_c.new")

    def _merged(self, buckets: list[int] | None = None) -> DataFrame:
        base, changes = self._base(buckets), self._changes(buckets)
        if changes is None:
            return base
        fresh = changes.where("kind <> 'removed'").select(*(F.col(f"`{c}`") if c == self.key else F.col(f"new.`{c}`").alias(c) for c in self.schema.names))
        return base.join(changes.select(self.key), self.key, "left_anti").select(*(F.col(f"`{c}`") for c in self.schema.names)).union(fresh)

    def table(self) -> DataFrame:
        return self._merged()

    def bucket_of(self, value: object) -> int:
        return self.spark.range(1).select(F.pmod(F.hash(F.lit(value).cast(self.schema[self.key].dataType)), F.lit(self.buckets))).first()[0]

    def get(self, value: object) -> DataFrame:
        """One key: one bucket is read."""
        return self._merged([self.bucket_of(value)]).where(F.col(self.key) == F.lit(value))

    def buckets_table(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; no other folder is read."""
        return self._merged(buckets)

    def apply(self, changes: DataFrame) -> None:
        """Take in a change set (key, kind, old, new)."""
        new = F.struct(*(F.col(f"new.`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key))
        at = self._write(changes.select(self.key, "kind", new.alias("new")), "changes")
        if self._buckets_in(at):
            self.pending = [*self.pending, at]
        self._manifest()
        if len(self.pending) >= self.most_pending:
            self.compact()

    def compact(self) -> list[int]:
        """Merge the change files into the buckets they touch, which are returned; the others stay."""
        touched = sorted({b for at in self.pending for b in self._buckets_in(at)})
        if touched:
            at = self._write(self._merged(touched), "base")
            filled = set(self._buckets_in(at))
            self.places = {b: p for b, p in self.places.items() if b not in touched} | {b: f"{at}/_bucket={b}" for b in touched if b in filled}
            self.pending = []
            self._manifest()
        return touched


ROWS_PER_BUCKET = 1_000_000
