"""Merge on write: batches of records become documents, one per flaw, under all the names it goes by."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from advisorium.functions.ids import identifier
from advisorium.functions.keys import affected_fingerprint, reference_key, severity_key
from advisorium.operators.merge import SCALARS, SETS, accepted_records, alias_clusters, canonical_ids, folded_documents
from advisorium.session import Workspace
from advisorium.sources.bucketed import BucketedTables
from advisorium.sources.documents import timed
from advisorium.sources.shared import StaleState

STATEMENT = "struct<key:string,body:string>"
TIMES = "published timestamp_ntz, modified timestamp_ntz, withdrawn timestamp_ntz"
_FIELDS = ", ".join([*(f"{s} string" for s in SCALARS), *(f"{s} array<string>" for s in SETS)])
#: What a batch holds, in order of arrival by ``seq``.
RECORD = f"seq bigint, source string, record_id string, names array<string>, {TIMES}, {_FIELDS}, statements array<{STATEMENT}>"
DOCUMENT = f"doc_id string, source string, best int, {TIMES}, owner string, owner_rank int, {_FIELDS}"
NAME = "name string, doc_id string"
CONTRIBUTION = f"source string, record_id string, doc_name string, seq bigint, modified timestamp_ntz, statements array<{STATEMENT}>"
TRIES = 4


def records_of(parsed: DataFrame, batch: int) -> DataFrame:
    """Records as parsers give them (``schemas.PARSED``) as a batch of the store, in the order of their batch and rows.

    A record's names are its identifier and aliases; what it states are its affected products, severities and
    references, each under its key. Times are instants in UTC without zone, whatever the session's zone.
    """
    dated = timed(parsed)
    utc = lambda c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz")).alias(c)
    keyed = lambda c, kind, key: F.transform(F.coalesce(c, F.array().cast(parsed.schema[c].dataType)), lambda x: F.struct(F.concat(F.lit(kind), key(x)).alias("key"), F.to_json(x).alias("body")))
    said = F.concat(keyed("affected", "affected:", affected_fingerprint), keyed("severities", "severity:", severity_key), keyed("references", "reference:", reference_key))
    seq = F.lit(batch).cast("bigint") * (1 << 44) + F.monotonically_increasing_id()
    return dated.select(
        seq.alias("seq"), "source", "record_id", F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"), *[utc(c) for c in ("published", "modified", "withdrawn")],
        *SCALARS, *SETS, said.alias("statements"),
    )


@dataclass(frozen=True)
class Counts:
    """What a batch did: records seen, refused for want of an identity, stale, and documents written and folded away."""

    seen: int
    failed: int
    stale: int
    written: int
    folded: int


class RecordStore:
    """Documents, names and contributions of records, merged batch by batch.

    ``documents`` (doc_id), ``names`` (name to doc_id) and ``contributions`` (what the last accepted record of each
    source and record_id states) change together. A batch resolves its records by any of their names, folds documents
    that turn out to be one, most authoritative first, under the name of the best namespace, merges its records in
    order of arrival, and replaces the buckets it touched. What a record no longer states is gone with its last
    contribution unless another record states it too, so nothing has to be deleted row by row.

    Records without source, record_id or any name that names a flaw are counted as failed and change nothing. A batch
    that loses the race against another is drawn up anew.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        schema = lambda text: StructType.fromDDL(text)
        self.spark = spark
        self.tables = BucketedTables(
            spark, folder, {"documents": ["doc_id"], "names": ["name"], "contributions": ["source", "record_id"]},
            {"documents": schema(DOCUMENT), "names": schema(NAME), "contributions": schema(CONTRIBUTION)}, buckets,
        )

    def documents(self) -> DataFrame:
        return self.tables.read("documents")

    def names(self) -> DataFrame:
        return self.tables.read("names")

    def statements(self) -> DataFrame:
        """What documents state: doc_id, key, body; of several records that state a key the last in arrival."""
        now = self.tables.begin()
        said = now.read("contributions").join(now.read("names").withColumnRenamed("name", "doc_name"), "doc_name").select("doc_id", "seq", F.inline("statements"))
        return said.groupBy("doc_id", "key").agg(F.max_by("body", "seq").alias("body"))

    def claimed_by_others(self, source: str, record_id: str) -> DataFrame:
        """Keys that other records of the same document state as well."""
        now = self.tables.begin()
        of = now.read("contributions").join(now.read("names").withColumnRenamed("name", "doc_name"), "doc_name")
        mine = (F.col("source") == source) & (F.col("record_id") == record_id)
        doc = of.filter(mine).select("doc_id").distinct()
        return of.filter(~mine).join(doc, "doc_id", "left_semi").select(F.explode("statements.key").alias("key")).distinct()

    def apply(self, records: DataFrame) -> Counts:
        """Merge one batch (``RECORD``)."""
        for attempt in range(TRIES):
            try:
                return self._apply(records)
            except StaleState:
                if attempt + 1 == TRIES:
                    raise
                time.sleep(0.2 * 2**attempt)
        raise AssertionError

    def _apply(self, records: DataFrame) -> Counts:
        now = self.tables.begin()
        work = Workspace(self.spark, "batch")
        known = F.array_distinct(F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: identifier(n)), lambda n: n.isNotNull()))
        fit = F.coalesce((F.size("names") > 0) & (F.trim("source") != "") & (F.trim("record_id") != ""), F.lit(False))
        incoming = work.store(records.withColumn("names", known).withColumn("fit", fit).withColumn("doc_name", F.get("names", F.lit(0))), "incoming")
        usable = incoming.filter("fit")

        given = usable.select("doc_name", F.explode("names").alias("name"))
        hits = given.join(now.read("names"), "name").select("name", "doc_id").distinct()
        links = given.select(F.col("doc_name").alias("a"), F.col("name").alias("b")).unionByName(hits.select(F.col("name").alias("a"), F.col("doc_id").alias("b"))).distinct()
        clusters = alias_clusters(links)
        of = clusters.join(canonical_ids(clusters, "cluster", "name"), "cluster").select("name", F.col("canonical_id").alias("doc_id"))
        of = work.store(of, "identity")
        moved = work.store(hits.select("doc_id").distinct().join(of.select(F.col("name").alias("doc_id"), F.col("doc_id").alias("to")), "doc_id"), "moved")

        judged = work.store(self._judged(usable, now), "judged")
        fresh = judged.join(of.withColumnRenamed("name", "doc_name"), "doc_name")
        old = now.read("documents").join(moved, "doc_id")
        rows = old.select(F.lit(0).alias("age"), F.col("doc_id").alias("was"), F.lit(0).cast("bigint").alias("seq"), F.col("to").alias("doc_id"), *_document_columns(), F.lit("").alias("record_id"), F.lit(False).alias("stale"))
        new = fresh.select(F.lit(1).alias("age"), F.lit("").alias("was"), "seq", "doc_id", *[_of_record(c) for c in _document_names()], "record_id", "stale")
        order = F.struct("age", F.when(F.col("age") == 0, F.col("best")).otherwise(0).alias("rank"), "was", "seq")
        folded = folded_documents(rows.unionByName(new), "doc_id", order)
        everywhere = of.groupBy("doc_id").agg(F.collect_set("name").alias("all_names"))
        documents = folded.join(everywhere, "doc_id", "left").withColumn("aliases", F.array_sort(F.array_except(F.array_union("aliases", "all_names"), F.array("doc_id")))).drop("all_names")
        gone = moved.filter("doc_id != to").select("doc_id")
        now.replace("documents", documents, gone)

        # Names of folded documents that the batch did not mention move with them.
        followed = now.read("names").join(moved, "doc_id").select("name", F.col("to").alias("doc_id"))
        now.replace("names", followed.unionByName(of).groupBy("name").agg(F.max("doc_id").alias("doc_id")))
        last = judged.filter(~F.col("stale")).groupBy("source", "record_id").agg(F.max_by(F.struct("doc_name", "seq", "modified", "statements"), "seq").alias("r"))
        now.replace("contributions", last.select("source", "record_id", "r.*").withColumn("statements", F.coalesce("statements", F.array().cast(f"array<{STATEMENT}>"))))
        now.commit()
        seen = incoming.agg(F.count("*").alias("n"), F.count(F.when(~F.col("fit"), 1)).alias("failed")).first()
        return Counts(seen.n, seen.failed, judged.filter("stale").count(), of.select("doc_id").distinct().count(), gone.count())

    def _judged(self, usable: DataFrame, now) -> DataFrame:
        """The batch with ``stale``: older than the last accepted record of its source and record_id, stored or in the batch."""
        keys = usable.select("source", "record_id").distinct()
        marks = now.read("contributions").join(keys, ["source", "record_id"], "left_semi").select("source", "record_id", "modified", F.lit(None).cast("bigint").alias("seq"))
        both = usable.unionByName(marks, allowMissingColumns=True)
        return accepted_records(both).filter("seq is not null")


def _document_names() -> list[str]:
    return [c.split()[0] for c in DOCUMENT.split(", ") if c.split()[0] != "doc_id"]


def _document_columns() -> list:
    return [F.col(c) for c in _document_names()]


def _of_record(c: str):
    kinds = {"best": "int", "owner": "string", "owner_rank": "int"}
    return F.lit(None).cast(kinds[c]).alias(c) if c in kinds else F.col(c)
