"""History of entity attributes from periodic full snapshots, kept right under late and corrected rows.

A chain is the sequence of versions of one entity. Late or corrected rows never patch a chain: the touched
entities are found, only their raw rows are read again, their chains are rebuilt as a whole and replace the old
ones in one swap.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from advisorium.session import small_enough
from advisorium.sources.shared import Pointer, SharedFolder

#: Snapshot times are a calendar: beyond so many they are joined by shuffle instead of sent to every task.
MAX_BROADCAST_SNAPSHOTS = 50_000
#: Entity buckets at least; a session with more shuffle partitions has as many.
BUCKETS = 16
#: With more snapshot times new at once every chain is built anew instead of those that span one.
MAX_LISTED_TIMES = 1_000


@dataclass(frozen=True)
class SnapshotSpec:
    """Columns of a snapshot table. ``entity`` is an expression; null entities are no rows of the history."""

    entity: Column
    snapshot_at: str
    loaded_at: str
    values: dict[str, Column]
    row_key: str


def snapshot_calendar(times: DataFrame) -> DataFrame:
    """The distinct snapshot times (at) with the one that follows: at, next_at, seq.

    Null times are none. The window without partitions runs over the distinct times only, one row per delivery.
    """
    times = times.filter("at is not null").distinct()
    w = Window.orderBy("at")
    return times.select("at", F.lead("at").over(w).alias("next_at"), F.row_number().over(w).cast("bigint").alias("seq"))


def standing_rows(raw: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Of several rows for an entity and snapshot the one loaded last: entity, at, loaded, key, v (struct of values).

    Ties go to the highest row key. Aggregated in part before the shuffle, so repeats of a hot entity shrink
    to one row per snapshot and task.
    """
    v = F.struct(*[c.alias(n) for n, c in spec.values.items()]).alias("v")
    rows = raw.select(spec.entity.alias("entity"), F.col(spec.snapshot_at).alias("at"), F.col(spec.loaded_at).alias("loaded"), F.col(spec.row_key).alias("key"), v)
    return _standing(rows.filter("entity is not null and at is not null"))


def _standing(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("loaded", "key", "v"), F.struct("loaded", "key")).alias("r")
    return rows.groupBy("entity", "at").agg(last).select("entity", "at", "r.loaded", "r.key", "r.v")


def chains_of(standing: DataFrame, calendar: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Versions of every entity of ``standing``: entity, values, valid_from, valid_to (null: still open).

    A version begins at a snapshot that holds the entity if the snapshot before does not, or if a value differs
    there; null is a value of its own. It ends at the next snapshot with a new version or without the entity.
    ``calendar`` holds the snapshots of the whole table, also those that hold none of these entities.
    """
    rows = standing.select("entity", "at", "v").join(calendar, "at")
    chain = Window.partitionBy("entity").orderBy("seq")
    before = F.lag(F.struct("seq", "v")).over(chain)
    begins = before.isNull() | (before["seq"] != F.col("seq") - 1) | ~before["v"].eqNullSafe(F.col("v"))
    flagged = rows.withColumn("begins", begins.cast("int"))
    numbered = flagged.withColumn("version", F.sum("begins").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    versions = numbered.groupBy("entity", "version").agg(
        F.min("at").alias("valid_from"), F.max(F.struct("seq", "next_at")).alias("last"), F.min_by("v", "seq").alias("v")
    )
    return versions.select("entity", *[F.col(f"v.{n}").alias(n) for n in spec.values], "valid_from", F.col("last.next_at").alias("valid_to"))


def build_chains(raw: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """All chains from all raw rows at once."""
    return chains_of(standing_rows(raw, spec), _sized(snapshot_calendar(raw.select(F.col(spec.snapshot_at).alias("at")))), spec)


def _sized(calendar: DataFrame) -> DataFrame:
    """The calendar, marked for broadcast where its checked size allows it."""
    return F.broadcast(calendar) if small_enough(calendar, MAX_BROADCAST_SNAPSHOTS) else calendar


class HistoryStore:
    """A history in a shared folder: the raw rows by entity bucket, and the chains made of them.

    ``raw/v=<token>/bucket=<b>`` is a log to which every apply adds its standing rows, ``chains/v=<token>/bucket=<b>``
    holds whole buckets of chains, ``calendar/v=<token>`` the snapshot times. A numbered state names the files that
    count, bucket by bucket: buckets that an apply does not touch stay where they are, and the swap lets all replaced
    chains count at once. Readers see the old chains or the new ones and never a mixture; a writer that is lost leaves
    files that nothing names, and of two writers that began from one state the second is refused. Applying the same
    rows again gives the same chains. The number of buckets belongs to the store: it is noted in its first state.
    """

    def __init__(self, spark: SparkSession, folder: str, spec: SnapshotSpec, buckets: int | None = None) -> None:
        self.spark, self.folder, self.spec = spark, folder.rstrip("/"), spec
        self.buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.pointer, self.files = Pointer(spark, self.folder), SharedFolder(spark, self.folder)

    def _write(self, df: DataFrame, kind: str, token: str) -> dict[str, str]:
        """Write rows by entity bucket; returns bucket to folder of the buckets that got any."""
        at = f"{kind}/v={token}"
        bucket = F.pmod(F.xxhash64("entity"), F.lit(self.buckets)).cast("int")
        df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{at}")
        return {n.split("=")[1]: f"{at}/{n}" for n in self.files.names(at) if n.startswith("bucket=")}

    def _read(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def apply(self, updates: DataFrame) -> DataFrame:
        """The history after further raw rows, regular, late or corrected; returns all chains.

        Touched are the entities that the rows name and, for a snapshot time that no row had before, those whose
        version spans it. The raw rows of touched entities alone are read again, from the buckets that hold any;
        their chains are built anew as a whole and replace the old ones.
        """
        number, state = self.pointer.read()
        self.buckets = state.get("buckets", self.buckets)
        token = f"{number + 1:08d}-{uuid.uuid4().hex[:8]}"
        fresh_rows = standing_rows(updates, self.spec)
        added = self._write(fresh_rows, "raw", token)
        rows_schema = fresh_rows.schema
        if not added:
            return self._chains(state, rows_schema)
        new = self._read([*added.values()], rows_schema)
        raw = {b: [*state.get("raw", {}).get(b, []), *([added[b]] if b in added else [])] for b in {*state.get("raw", {}), *added}}
        known = self._read([state["calendar"]] if "calendar" in state else [], "at " + rows_schema["at"].dataType.simpleString())
        times = new.select("at").distinct()
        self.spark.createDataFrame([], known.schema).union(known).union(times).distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/calendar/v={token}")
        calendar = _sized(snapshot_calendar(self._read([f"calendar/v={token}"], known.schema)))
        old = state.get("chains", {})
        if old:
            touched = self._touched(new, times.join(known, "at", "left_anti"), state, rows_schema)
            buckets = sorted({*added, *(str(r[0]) for r in touched.select(F.pmod(F.xxhash64("entity"), F.lit(self.buckets))).distinct().collect())})  # at most one row per bucket
            log = self._read([n for b in buckets for n in raw[b]], rows_schema).join(touched, "entity", "left_semi")
            again = chains_of(_standing(log), calendar, self.spec)
            kept = self._read([old[b] for b in buckets if b in old], again.schema).join(touched, "entity", "left_anti")
            chains = kept.unionByName(again)
        else:
            buckets, chains = [*added], chains_of(new, calendar, self.spec)
        written = self._write(chains, "chains", token)
        untouched = {b: n for b, n in old.items() if b not in buckets}
        self.pointer.swap(number, {"raw": raw, "chains": untouched | written, "calendar": f"calendar/v={token}", "buckets": self.buckets})
        return self.read(updates)

    def _touched(self, new: DataFrame, fresh: DataFrame, state: dict, rows_schema) -> DataFrame:
        named = new.select("entity").distinct()
        if fresh.isEmpty():
            return named
        chains = self._chains(state, rows_schema)
        if small_enough(fresh, MAX_LISTED_TIMES):
            at = F.array(*[F.lit(str(r.at)).cast(rows_schema["at"].dataType) for r in fresh.collect()])  # checked to be few
            chains = chains.filter(F.exists(at, lambda t: (t > F.col("valid_from")) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))))
        return named.unionByName(chains.select("entity")).distinct()

    def _chains(self, state: dict, rows_schema) -> DataFrame:
        at = rows_schema["at"].dataType
        v = rows_schema["v"].dataType
        schema = StructType([rows_schema["entity"], *v.fields, StructField("valid_from", at), StructField("valid_to", at)])
        return self._read(sorted(state.get("chains", {}).values()), schema)

    def read(self, like: DataFrame) -> DataFrame:
        """All chains that count; ``like`` is any raw table of the same columns."""
        return self._chains(self.pointer.read()[1], standing_rows(like, self.spec).schema)


def history_with_late_rows(raw: DataFrame, late: Column, spec: SnapshotSpec, folder: str, buckets: int | None = None) -> DataFrame:
    """Full history of ``raw``, where ``late`` marks the rows that arrived after their snapshot's regular load.

    The regular rows make the stored chains; the late ones are applied to the store, which rebuilds and replaces the
    chains of the entities they touch. Each raw row enters the store once.
    """
    store = HistoryStore(raw.sparkSession, folder, spec, buckets)
    store.apply(raw.filter(~late))
    return store.apply(raw.filter(late))
