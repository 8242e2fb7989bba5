"""Queries of the merging store: records of the tables merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.operators import store
from advisorium.plans.problems_sql import sql_id
from advisorium.plans.reference import record_stream
from advisorium.plans.reference_sql import RECORDS
from advisorium.session import Workspace, table


def _new_store(spark: SparkSession, name: str) -> store.RecordStore:
    return store.RecordStore(spark, Workspace(spark, name).folder, 8)


def _records(df: DataFrame) -> DataFrame:
    """``df`` with every column of a record; those it lacks are null."""
    kinds = [c.rsplit(" ", 1) for c in store.RECORD.replace(f"array<{store.STATEMENT}>", "STATEMENTS").split(", ")]
    typed = lambda n, t: (F.col(n) if n in df.columns else F.lit(None)).cast(t.replace("STATEMENTS", f"array<{store.STATEMENT}>")).alias(n)
    return df.select(*[typed(n, t) for n, t in kinds])


def _event_records(spark: SparkSession, d: str) -> DataFrame:
    stream = record_stream(spark, d)
    flaw = F.array(F.concat(F.lit("CVE-2024-"), F.lpad(F.col("flaw").cast("string"), 7, "0")))
    key = F.concat_ws("-", "assigner", (F.col("seq") % 4).cast("string"))
    said = F.array(F.struct(key.alias("key"), F.col("seq").cast("string").alias("body")))
    return stream.withColumns({"names": flaw, "statements": said, "aliases": F.array().cast("array<string>")})


def _merged_events(spark: SparkSession, d: str) -> tuple[store.RecordStore, DataFrame]:
    """The store after the events' records came in three batches, by time."""
    rows = _event_records(spark, d)
    into = _new_store(spark, "events")
    span = table(spark, d, "events", ["event_id"]).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    third = ((span.b or 0) - (span.a or 0)) // 3 + 1
    for i in range(3):
        into.apply(_records(rows.filter(((F.col("seq") - F.lit(span.a)) / third).cast("int") == i)))
    return into, rows


def store_after_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = _merged_events(spark, d)[0].documents()
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return docs.select("doc_id", "title", "assigner", "source", at("published"), at("modified"), F.array_join("cwes", ",").alias("cwes"))


def retired_rows(spark: SparkSession, d: str) -> DataFrame:
    """Statements that some record once made and no document makes any more: doc_id, key."""
    into, rows = _merged_events(spark, d)
    ever = rows.select(F.get("names", F.lit(0)).alias("doc_id"), F.explode("statements.key").alias("key")).distinct()
    return ever.join(into.statements().select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def store_statements(spark: SparkSession, d: str) -> DataFrame:
    return _merged_events(spark, d)[0].statements()


def folded_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every name of the alias table with the document it leads to, after the pairs came in two batches."""
    pairs = table(spark, d, "vuln_aliases", ["pair_no", "alias", "vuln_id", "source"])
    rows = pairs.select(
        F.col("pair_no").alias("seq"), F.coalesce(F.when(F.trim("source") != "", F.col("source")), F.lit("unnamed")).alias("source"), F.col("pair_no").cast("string").alias("record_id"), F.array("vuln_id", "alias").alias("names"),
    )
    into = _new_store(spark, "names")
    middle = pairs.agg(F.percentile_approx("pair_no", 0.5).alias("m")).first().m or 0
    for half in (F.col("seq") <= middle, F.col("seq") > middle):
        into.apply(_records(rows.filter(half)))
    return into.names()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "store_after_batches": store_after_batches, "retired_rows": retired_rows, "store_statements": store_statements, "folded_ids": folded_ids,
}

_STORED = f"""WITH {RECORDS},
      live AS (SELECT *, coalesce(min(rank) OVER w, 1000) AS best, count(title) OVER w AS titles FROM guarded WHERE NOT stale
        WINDOW w AS (PARTITION BY flaw ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      said AS (SELECT *, 'CVE-2024-' || lpad(CAST(flaw AS VARCHAR), 7, '0') AS doc_id, assigner || '-' || (seq % 4) AS key FROM guarded),
      last AS (SELECT source, record_id, max(seq) AS seq FROM said WHERE NOT stale GROUP BY ALL),
      final AS (SELECT doc_id, key, CAST(max(said.seq) AS VARCHAR) AS body FROM said JOIN last USING (source, record_id, seq) GROUP BY ALL)"""
_RANK = r"CASE WHEN regexp_full_match({c}, '(?i)CVE-\d{{4}}-\d{{4,}}') THEN 0 WHEN regexp_full_match({c}, '(?i)GHSA(-[a-z0-9]{{4}}){{3}}') THEN 1 WHEN regexp_full_match({c}, '(?i)EUVD-\d{{4}}-\d+') THEN 2 WHEN regexp_full_match({c}, '(?i)GCVE-\d+-\d{{4}}-\d+') THEN 3 ELSE 4 END"
#: Every name with the root of its cluster, by labels that spread along the pairs; ``rank`` puts the best namespace first.
CLUSTERS = f"""WITH RECURSIVE pairs AS (SELECT {sql_id("alias")} AS a, {sql_id("vuln_id")} AS b FROM vuln_aliases),
      names AS (SELECT a AS name FROM pairs WHERE a IS NOT NULL UNION SELECT b FROM pairs WHERE b IS NOT NULL),
      edges AS (SELECT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
      reach(name, other) AS (SELECT name, name FROM names UNION SELECT r.name, e.b FROM reach r JOIN edges e ON e.a = r.other)"""
ORACLES: dict[str, str] = {
    "store_after_batches": f"""{_STORED} SELECT 'CVE-2024-' || lpad(CAST(flaw AS VARCHAR), 7, '0') AS doc_id, arg_max(title, seq) FILTER (WHERE title IS NOT NULL AND (rank <= best OR titles = 0)) AS title,
        arg_max(assigner, seq) FILTER (WHERE rank <= best) AS assigner, arg_min(source, struct_pack(r := rank, s := seq)) AS source, strftime(min(published), '%Y-%m-%d %H:%M:%S') AS published,
        strftime(max(modified), '%Y-%m-%d %H:%M:%S') AS modified, array_to_string(list_sort(list_distinct(list(cwe))), ',') AS cwes FROM live GROUP BY flaw""",
    "retired_rows": f"{_STORED} SELECT DISTINCT doc_id, key FROM said WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.doc_id = said.doc_id AND f.key = said.key)",
    "store_statements": f"{_STORED} SELECT doc_id, key, body FROM final",
    "folded_ids": f"""{CLUSTERS} SELECT name, arg_min(other, struct_pack(r := {_RANK.format(c="other")}, n := other)) AS doc_id FROM reach GROUP BY name""",
    "alias_clusters": f"""{CLUSTERS}, told AS (SELECT a AS n FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)
      SELECT DISTINCT cluster, canonical_id FROM (SELECT min(other) AS cluster, arg_min(other, struct_pack(r := {_RANK.format(c="other")}, n := other)) AS canonical_id FROM reach WHERE name IN (SELECT n FROM told) GROUP BY name)""",
}
