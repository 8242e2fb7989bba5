"""Several keyed tables in one shared folder, changed bucket by bucket and swapped together."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from advisorium.sources.shared import Pointer, SharedFolder


class BucketedTables:
    """Tables as ``folder/<table>/v=<token>/bucket=<b>``; a numbered state names the folder of every bucket that counts.

    A transaction reads one state, writes the buckets it changes, and swaps once: readers see all of its changes or
    none, and of two transactions that began from one state the second is refused and may be tried again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, list[str]], schemas: dict[str, StructType], buckets: int) -> None:
        self.spark, self.folder, self.keys, self.schemas, self.buckets = spark, folder.rstrip("/"), keys, schemas, buckets
        self.pointer, self.files = Pointer(spark, self.folder), SharedFolder(spark, self.folder)

    def begin(self) -> "Transaction":
        return Transaction(self, *self.pointer.read())

    def read(self, name: str) -> DataFrame:
        return self.begin().read(name)


class Transaction:
    def __init__(self, tables: BucketedTables, number: int, state: dict) -> None:
        self.tables, self.number, self.state = tables, number, state
        self.changed: dict[str, dict[str, str]] = {}
        self.token = f"{number + 1:08d}-{uuid.uuid4().hex[:8]}"

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        t = self.tables
        return t.spark.read.schema(t.schemas[name]).parquet(*[f"{t.folder}/{x}" for x in folders]) if folders else t.spark.createDataFrame([], t.schemas[name])

    def read(self, name: str) -> DataFrame:
        """A table as it was when the transaction began."""
        return self._load(name, sorted(self.state.get(name, {}).values()))

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a table that have one of ``keys``; only the buckets that may hold any are read."""
        asked = keys.select(*self.tables.keys[name]).distinct()
        old = self.state.get(name, {})
        held = [old[b] for b in {str(r[0]) for r in asked.select(self.bucket(name)).distinct().collect()} if b in old]  # at most one row per bucket
        return self._load(name, sorted(held)).join(asked, self.tables.keys[name], "left_semi")

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables.keys[name]), F.lit(self.tables.buckets)).cast("int")

    def replace(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Let ``rows`` take the place of those with the same keys, and remove the keys of ``gone``; buckets with neither
        are not read."""
        t, keys = self.tables, self.tables.keys[name]
        at = f"{name}/v={self.token}"
        columns = t.schemas[name].fieldNames()
        rows.select(*columns).withColumn("bucket", self.bucket(name)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{t.folder}/{at}-new")
        added = {n.split("=")[1]: f"{at}-new/{n}" for n in t.files.names(f"{at}-new") if n.startswith("bucket=")}
        new = self._load(name, [*added.values()])
        touched = new.select(*keys) if gone is None else new.select(*keys).unionByName(gone.select(*keys))
        names = {*added} if gone is None else {*added, *(str(r[0]) for r in gone.select(self.bucket(name)).distinct().collect())}  # at most one row per bucket
        old = self.state.get(name, {})
        if held := [old[b] for b in names if b in old]:
            kept = self._load(name, held).join(touched.distinct(), keys, "left_anti").select(*columns)
            kept.unionByName(new).withColumn("bucket", self.bucket(name)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{t.folder}/{at}")
            added = {n.split("=")[1]: f"{at}/{n}" for n in t.files.names(at) if n.startswith("bucket=")}
        self.changed[name] = {b: n for b, n in old.items() if b not in names} | added

    def commit(self) -> int:
        return self.tables.pointer.swap(self.number, self.state | self.changed)
