"""One flaw by any of its names, with its catalogue entry, prediction and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisorium.functions.ids import identifier
from advisorium.functions.keys import affected_fingerprint, reference_key, severity_key
from advisorium.operators.enrich import first_row

HISTORY_LIMIT, HISTORY_MOST = 100, 500


def by_name(asked: DataFrame, aliases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Flaws for asked names (name): the corpus columns, name, matched_via (``id`` or ``alias``). A name that is an
    identifier itself counts before one that is an alias."""
    wanted = asked.select("name", identifier("name").alias("__n")).filter("__n is not null")
    ranked = wanted.join(corpus.select(F.col("id").alias("__n")), "__n", "left_semi").select("name", F.col("__n").alias("id"), F.lit(0).alias("via"))
    other = wanted.join(aliases.select(F.col("alias").alias("__n"), F.col("vuln_id").alias("id")), "__n").select("name", "id", F.lit(1).alias("via"))
    best = ranked.unionByName(other).groupBy("name").agg(F.min(F.struct("via", "id")).alias("b")).select("name", "b.*")
    return best.join(corpus, "id").withColumn("matched_via", F.when(F.col("via") == 0, "id").otherwise("alias")).drop("via")


def with_side_tables(found: DataFrame, aliases: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """The first catalogue entry (earliest date, entries without one last, then identifier) and best prediction."""
    named = aliases.select("alias", F.col("vuln_id").alias("id"))
    entry = first_row(kev.join(named, F.col("cve_id") == F.col("alias")).select("id", "cve_id", "date_added"), ["id"], F.col("date_added").asc_nulls_last(), "cve_id")
    score = first_row(epss.join(named, F.col("cve_id") == F.col("alias")).select("id", F.col("cve_id").alias("epss_cve_id"), "score"), ["id"], F.desc("score"), "epss_cve_id")
    return found.join(entry.withColumnRenamed("cve_id", "kev_cve_id"), "id", "left").join(score, "id", "left")


def history_of(asked: DataFrame, aliases: DataFrame, changes: DataFrame, limit: int | None = None) -> DataFrame:
    """Changes of the flaws that asked names (name) belong to, newest first."""
    n = HISTORY_LIMIT if not limit or limit < 1 else min(limit, HISTORY_MOST)
    ids = asked.select(identifier("name").alias("alias")).join(aliases, "alias").select("vuln_id").distinct()
    return changes.join(ids, "vuln_id", "left_semi").orderBy(F.desc("changed_at"), F.desc("batch"), F.desc("seq")).limit(n)


def children(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(severities, references, statements) of records as rows with their keys; scores of 0 are none."""
    severities = records.select(F.col("id").alias("vuln_id"), F.explode("severities").alias("s")).select("vuln_id", severity_key(F.col("s")).alias("key"), "s.*").withColumn("score", F.when(F.col("score") != 0, F.col("score")))
    references = records.select(F.col("id").alias("vuln_id"), F.explode("references").alias("r")).select("vuln_id", reference_key(F.col("r")).alias("key"), "r.*")
    stated = records.select(F.col("id").alias("vuln_id"), F.explode("affected").alias("a")).select("vuln_id", affected_fingerprint(F.col("a")).alias("fingerprint"), "a.*")
    return severities.dropDuplicates(["vuln_id", "key"]), references.dropDuplicates(["vuln_id", "key"]), stated.dropDuplicates(["vuln_id", "fingerprint"])
