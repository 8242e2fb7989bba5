"""What changed between full snapshots, by a stored index from key to hash.

A snapshot lands as files by key bucket: the key, a hash of the compared values, and the values beside them. Its index
is the key and hash columns. A delivery probes the index of the last snapshot with its own, fetches old and new
values for the keys that differ only, and then its index takes the place of the old one.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from advisorium.sources.shared import Pointer, SharedFolder, StaleState

BUCKETS = 64
#: So many deliveries are probed at a time; they count strictly one after the other.
PROBES_AHEAD = 2


def consecutive(snapshots: DataFrame, order: list[str]) -> DataFrame:
    """Number the snapshots by ``order``: seq from 1. One row per delivered snapshot, not per record."""
    return snapshots.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def first_rows(rows: DataFrame, by: list[str], values: list[str], order: str) -> DataFrame:
    """The compared values of each key as ``v``, of repeated rows those with the lowest ``order``. Partial aggregation
    first, so a key or snapshot that holds most rows shrinks before the shuffle."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*values), order).alias("v"))


def probe(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Keys of two indexes (on, value_hash) that differ: on, change_kind ``added``, ``removed`` or ``changed``."""
    o, n = old.select(*on, F.col("value_hash").alias("old_hash")), new.select(*on, F.col("value_hash").alias("new_hash"))
    kind = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return o.join(n, on, "full_outer").select(*on, kind.alias("change_kind")).filter("change_kind is not null")


class SnapshotIndex:
    """Snapshots by number in a shared folder, with the index that counts named by a pointer.

    ``snapshots/seq=<n>/bucket=<b>`` holds what landed, ``found`` and ``changes`` what a delivery derived, both under
    the two numbers they lie between: a delivery that is repeated after a failure overwrites its own attempt. Numbers
    only grow; a delivery not newer than the one that counts returns what it once wrote and moves nothing.

    Rows with a null key are none. Hashes have 128 bits and are taken over the values as JSON, where null and the
    empty text differ, so keys whose hashes agree have equal values.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, values: list[str], order: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.values, self.order, self.buckets = spark, folder.rstrip("/"), key, values, order, buckets
        self.pointer, self.files = Pointer(spark, self.folder), SharedFolder(spark, self.folder)
        self._schema: StructType | None = None

    def land(self, rows: DataFrame) -> list[int]:
        """Store the snapshots of ``rows`` (seq, key, values, order); returns their numbers. Nothing counts yet."""
        standing = first_rows(rows.filter(F.col(self.key).isNotNull() & F.col("seq").isNotNull()), ["seq", self.key], self.values, self.order)
        hashed = standing.select(
            "seq", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"), self.key, F.unhex(F.md5(F.to_json("v"))).alias("value_hash"), "v"
        )
        self._schema = hashed.drop("seq", "bucket").schema
        hashed.repartition("seq", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seq", "bucket").parquet(f"{self.folder}/snapshots")
        return self.landed()

    def landed(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names("snapshots") if n.startswith("seq="))

    def _snapshot(self, seq: int | None) -> DataFrame:
        """What landed under a number: bucket, key, value_hash, v; empty for a snapshot without rows and for none."""
        at = f"snapshots/seq={seq}"
        if seq is None or not self.files.names(at):
            return self.spark.createDataFrame([], StructType([StructField("bucket", IntegerType()), *self._schema.fields]))
        return self.spark.read.option("basePath", f"{self.folder}/{at}").parquet(f"{self.folder}/{at}")

    def _differences(self, last: int | None, seq: int) -> str:
        """Derive the changes from ``last`` to ``seq`` and write them; returns their path."""
        old, new = self._snapshot(last), self._snapshot(seq)
        # The numbers stand in the path alone, so that every delivery runs the same generated code.
        name = f"from_seq={'__HIVE_DEFAULT_PARTITION__' if last is None else last}/to_seq={seq}"
        found_at, changes_at = f"{self.folder}/found/{name}", f"{self.folder}/changes/{name}"
        on = ["bucket", self.key]
        probe(old, new, on).write.mode("overwrite").parquet(found_at)
        found = self.spark.read.parquet(found_at)  # its size is known from its files, which settles how it is joined
        v = new.schema["v"].dataType
        fetched = old.select(*on, F.col("v").alias("old"), F.lit(None).cast(v).alias("new")).unionByName(new.select(*on, F.lit(None).cast(v).alias("old"), F.col("v").alias("new")))
        both = fetched.join(found, on).groupBy(*on, "change_kind").agg(F.first("old", True).alias("old"), F.first("new", True).alias("new"))
        both.select(self.key, "change_kind", "old", "new").write.mode("overwrite").parquet(changes_at)
        return changes_at

    def deliver(self, *numbers: int) -> list[str]:
        """Let landed snapshots count in the given order; returns the paths of their changes.

        The changes are whole before the index is swapped, and the swap is refused if another writer came between.
        Probes run ahead, since both of their indexes have landed; swaps keep the order.
        """
        at, state = self.pointer.read()
        last = state.get("seq")
        paths = dict(state.get("changes", {}))
        out, plan, before = [], [], last
        for n in numbers:
            if before is not None and n <= before:
                if str(n) not in paths:
                    raise StaleState(f"{self.folder}: snapshot {n} is older than {before}, which counts")
                plan.append((None, n))
            else:
                plan.append((before, n))
                before = n
        with ThreadPoolExecutor(PROBES_AHEAD) as pool:
            ahead = [pool.submit(self._differences, a, n) if last is None or n > last else None for a, n in plan]
            for (_, n), job in zip(plan, ahead):
                if job is not None:
                    paths[str(n)] = job.result()
                    at = self.pointer.swap(at, {"seq": n, "changes": paths})
                out.append(paths[str(n)])
        return out

    def changes(self, paths: list[str]) -> DataFrame:
        """Delivered changes: from_seq (null: the first delivery), to_seq, key, change_kind, old, new (structs of the values)."""
        v = self._schema["v"].dataType.simpleString()
        kind = self._schema[self.key].dataType.simpleString()
        schema = f"`{self.key}` {kind}, change_kind string, old {v}, new {v}, from_seq bigint, to_seq bigint"
        read = self.spark.read.option("basePath", f"{self.folder}/changes").schema(schema)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)
