"""Continuous ingestion: landing files as streams, one query per source, its checkpoint as the cursor.

Each micro-batch is parsed, guarded against repeats by content hash, written under its batch number and merged into the
record store, so that a batch that runs again after a failure overwrites what it wrote and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from advisorium.operators.store import RecordStore, records_of
from advisorium.sources.bucketed import BucketedTables

RAW = "source string, record_id string, content string, landed_at timestamp"
#: Cadence of each source's query, in minutes.
CADENCE = {"cvelist": 60, "vulnrichment": 360, "nvd": 120, "fkie": 360, "csaf": 360, "euvd": 180, "gcve": 180, "ghsa": 360, "osv": 180, "kev": 60, "epss": 720}


@dataclass(frozen=True)
class Landing:
    """Where a source's raw records land, and where its state lives."""

    source: str
    folder: str
    archive: str
    records: str
    checkpoint: str


def raw_stream(spark: SparkSession, landing: Landing, files_per_batch: int = 1_000) -> DataFrame:
    """Raw records as they land, as JSON lines."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(landing.folder)


HASHES = "source string, record_id string, sha256 string, batch bigint, before string"


def archive_of(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTables:
    """The newest content hash of each record, with the one before it, by bucket of (source, record_id)."""
    return BucketedTables(spark, path, {"hashes": ["source", "record_id"]}, {"hashes": StructType.fromDDL(HASHES)}, buckets)


def persist_batch(landing: Landing, parse: Callable[[DataFrame], DataFrame], store: RecordStore | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: drop unchanged records, parse the others, write records, merge them into ``store`` if
    there is one, and write hashes.

    A record counts as unchanged if its newest archived content of earlier batches is the same; only the buckets of
    the archive that hold records of the batch are read and replaced. Hashes are swapped in last, so a batch that
    failed before parses and merges its records again, which changes nothing twice, and one that runs again afterwards
    compares with what was there before it.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = archive_of(spark, landing.archive).begin()
        hashed = batch.withColumn("sha256", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
        newest = hashed.groupBy("source", "record_id").agg(F.max_by(F.struct("content", "sha256", "landed_at"), F.struct("landed_at", "sha256")).alias("r")).select("source", "record_id", "r.*")
        held = now.lookup("hashes", newest).select("source", "record_id", F.when(F.col("batch") == number, F.col("before")).otherwise(F.col("sha256")).alias("old"))
        fresh = newest.join(held, ["source", "record_id"], "left").filter(~F.col("sha256").eqNullSafe(F.col("old"))).persist()
        at = f"{landing.records}/batch={number}"
        try:
            parse(fresh.select("content")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(at)
            if store is not None:
                store.apply(records_of(spark.read.parquet(at), number))
            now.replace("hashes", fresh.select("source", "record_id", "sha256", F.lit(number).cast("bigint").alias("batch"), F.col("old").alias("before")))
            now.commit()
        finally:
            fresh.unpersist()

    return run


def start(spark: SparkSession, landing: Landing, parse: Callable[[DataFrame], DataFrame], once: bool = True, store: RecordStore | None = None) -> StreamingQuery:
    """One source's query: all that is available and stop, or on its cadence."""
    writer = raw_stream(spark, landing).writeStream.foreachBatch(persist_batch(landing, parse, store)).option("checkpointLocation", landing.checkpoint).queryName(f"ingest-{landing.source}")
    trigger = {"availableNow": True} if once else {"processingTime": f"{CADENCE.get(landing.source, 360)} minutes"}
    return writer.trigger(**trigger).start()


def read_records(spark: SparkSession, landing: Landing) -> DataFrame:
    """All records that batches have written, with their batch number as order of arrival."""
    return spark.read.parquet(f"{landing.records}/*")


GUARDED = "source string, record_id string, seq bigint, modified timestamp, stale boolean"
GUARD_STATE = "newest timestamp"


def _guard(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    newest = state.get[0] if state.exists else None
    newest = None if newest is None or pd.isna(newest) else pd.Timestamp(newest)
    rows = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)
    stale = []
    for m in rows["modified"]:
        old = not pd.isna(m) and newest is not None and pd.Timestamp(m) < newest
        stale.append(old)
        if not old:
            newest = None if pd.isna(m) else pd.Timestamp(m)
    state.update((newest.to_pydatetime() if newest is not None else None,))
    yield rows.assign(stale=stale)[["source", "record_id", "seq", "modified", "stale"]]


def guarded_stream(records: DataFrame) -> DataFrame:
    """A stream of records (source, record_id, seq, modified) with ``stale``, by state per (source, record_id).

    A record is stale if it is older than the newest accepted one of its key; one without modified is accepted and
    clears the mark. There is no horizon: state is one time per record ever seen.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return records.select("source", "record_id", "seq", "modified").groupBy("source", "record_id").applyInPandasWithState(_guard, GUARDED, GUARD_STATE, "append", GroupStateTimeout.NoTimeout)


def landing_rates(records: DataFrame, late: str = "2 days", size: str = "1 day") -> DataFrame:
    """Records and distinct sources per window of landing time, closed by a watermark: at, n, n_sources."""
    windows = records.withWatermark("landed_at", late).groupBy(F.window("landed_at", size).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("source").alias("n_sources"))
    return windows.select(F.col("w.start").alias("at"), "n", "n_sources")
