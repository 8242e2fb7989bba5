"""Exploitation and prediction data joined to the corpus, statistics, and upserts of the side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from advisorium.sources.versioned import VersionedTable


def first_row(df: DataFrame, by: list[str], *order) -> DataFrame:
    """Of each group the row that comes first in the given order, which should end in a unique column."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(w)).filter("__at = 1").drop("__at")


def first_exploited(kev: DataFrame, aliases: DataFrame) -> DataFrame:
    """Earliest date of a flaw in the exploited catalogue under any of its names: vuln_id, kev_date_added."""
    named = kev.select(F.col("cve_id").alias("alias"), "date_added").join(aliases.select("alias", "vuln_id"), "alias")
    return named.groupBy("vuln_id").agg(F.min("date_added").alias("kev_date_added"))


def best_prediction(epss: DataFrame, aliases: DataFrame) -> DataFrame:
    """Highest score of a flaw under any of its names (ties: lowest name): vuln_id, epss_score, cve_id. One
    aggregation of a struct instead of a sort, so a hot flaw shrinks before the shuffle."""
    named = epss.select("cve_id", "score").join(aliases.select(F.col("alias").alias("cve_id"), "vuln_id"), "cve_id")
    best = F.min(F.struct((-F.col("score")).alias("s"), "cve_id")).alias("b")
    return named.groupBy("vuln_id").agg(best).select("vuln_id", (-F.col("b.s")).alias("epss_score"), F.col("b.cve_id").alias("cve_id"))


def stale_flags(corpus: DataFrame, kev: DataFrame, aliases: DataFrame) -> DataFrame:
    """Flagged flaws that no catalogue entry names any more, under any of their names."""
    live = kev.select(F.col("cve_id").alias("alias")).join(aliases, "alias").select(F.col("vuln_id").alias("id"))
    return corpus.filter("in_kev").join(live, "id", "left_anti")


def resynced(corpus: DataFrame, exploited: DataFrame, predicted: DataFrame) -> DataFrame:
    """The corpus with in_kev, kev_date_added and epss_score as the side tables say, and whether a row differs."""
    old = F.struct("in_kev", "epss_score")
    joined = corpus.join(exploited.withColumnRenamed("vuln_id", "id"), "id", "left").join(predicted.select(F.col("vuln_id").alias("id"), F.col("epss_score").alias("__epss")), "id", "left")
    new = joined.withColumn("__kev", F.col("kev_date_added").isNotNull())
    changed = ~old.eqNullSafe(F.struct(F.col("__kev").alias("in_kev"), F.col("__epss").alias("epss_score")))
    return new.withColumn("changed", changed).withColumn("in_kev", F.col("__kev")).withColumn("epss_score", F.col("__epss")).drop("__kev", "__epss")


def statistics(corpus: DataFrame, aliases: DataFrame, kev: DataFrame) -> DataFrame:
    """Counters of the corpus in one row; each table is read once, for what its counter needs."""
    own = corpus.agg(
        F.count("*").alias("vulnerabilities"), F.count(F.when(F.col("primary_score").isNull(), 1)).alias("unscored"), F.count(F.when(F.col("in_kev"), 1)).alias("exploited"),
        F.max("modified").alias("newest_modified"), F.min("published").alias("oldest_published"),
    )
    rows = own.unionByName(aliases.agg(F.count("*").alias("aliases")), allowMissingColumns=True).unionByName(kev.agg(F.count("*").alias("kev_entries")), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])  # three rows, each with its own columns


def counts_by_rating(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy(F.coalesce(F.upper("primary_rating"), F.lit("UNSCORED")).alias("rating")).agg(F.count("*").alias("n"))


def counts_by_source(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def vendor_rank(statements: DataFrame) -> DataFrame:
    """How many flaws each vendor has under a product name, from platform names: product, vendor, n."""
    exploded = statements.select("vuln_id", F.explode("cpes").alias("cpe")).filter(F.col("cpe").startswith("cpe:2.3:"))
    part = lambda i: F.lower(F.split_part("cpe", F.lit(":"), F.lit(i)))
    named = exploded.select("vuln_id", part(5).alias("product"), part(4).alias("vendor")).filter("product not in ('', '*', '-') and vendor not in ('', '*', '-')")
    return named.groupBy("product", "vendor").agg(F.count_distinct("vuln_id").alias("n"))


class VendorRankTable:
    """The rank as a stored table by product, rebuilt after an ingest and swapped in; lookups read it and count nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = VersionedTable(spark, folder)

    def refresh(self, statements: DataFrame) -> DataFrame:
        """Rebuild the rank; readers see the old one until the new one is whole, and of two rebuilds one is refused."""
        return self.table.replace(vendor_rank(statements).sortWithinPartitions("product"))

    def read(self) -> DataFrame:
        return self.table.read()


def top_vendors(rank: DataFrame, k: int = 5) -> DataFrame:
    """The vendors with most flaws per product, ties by name."""
    w = Window.partitionBy("product").orderBy(F.desc("n"), "vendor")
    return rank.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)


def reconciled_vendors(services: DataFrame, ranked: DataFrame) -> DataFrame:
    """Services with their vendor where the corpus knows it for the product, else the product's first vendor."""
    known = ranked.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("at", "vendor"))).alias("v")).select("product", F.transform("v", lambda x: x["vendor"]).alias("vendors"))
    joined = services.join(known, "product", "left")
    kept = F.when(F.col("vendors").isNull() | F.array_contains("vendors", F.col("vendor")), F.col("vendor")).otherwise(F.get("vendors", F.lit(0)))
    return joined.withColumn("vendor", kept).drop("vendors")


def upsert_kev(stored: DataFrame, incoming: DataFrame, texts: list[str]) -> DataFrame:
    """Catalogue entries merged by cve_id: stored texts stay where they say something, the earliest date_added
    counts, known_ransomware once true stays true, sources are united."""
    both = stored.select("*", F.lit(0).alias("__age")).unionByName(incoming.select("*", F.lit(1).alias("__age")))
    keep = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__age"))).alias(c) for c in texts]
    merged = both.groupBy("cve_id").agg(*keep, F.min("date_added").alias("date_added"), F.coalesce(F.bool_or("known_ransomware"), F.lit(False)).alias("known_ransomware"), F.collect_set("kev_sources").alias("s"))
    return merged.select("cve_id", *texts, "date_added", "known_ransomware", F.array_sort(F.array_distinct(F.flatten("s"))).alias("kev_sources"))


def replace_catalogue(stored: DataFrame, incoming: DataFrame, labels: list[str], texts: list[str]) -> DataFrame:
    """A full catalogue replaces what it owns: entries absent from it go if no other label holds them. An empty
    catalogue is refused."""
    if incoming.isEmpty():
        raise ValueError("an empty catalogue replaces nothing")
    mine = F.size(F.array_except("kev_sources", F.array(*[F.lit(x) for x in labels]))) == 0
    gone = stored.filter(mine).join(incoming.select("cve_id"), "cve_id", "left_anti").select("cve_id")
    return upsert_kev(stored.join(gone, "cve_id", "left_anti"), incoming, texts)


def upsert_epss(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest score per cve_id by score_date; of one date the incoming row counts."""
    both = stored.select("*", F.lit(0).alias("__age")).unionByName(incoming.select("*", F.lit(1).alias("__age")))
    row = F.struct(*[c for c in stored.columns])
    return both.groupBy("cve_id").agg(F.max_by(row, F.struct("score_date", "__age")).alias("r")).select("r.*")


def changed_raw(incoming: DataFrame, archive: DataFrame) -> DataFrame:
    """Records whose content differs from the archived: source, record_id, content, sha256. Repeated records count once."""
    hashed = incoming.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicates(["source", "record_id", "sha256"])
    return hashed.join(archive.select("source", "record_id", "sha256"), ["source", "record_id", "sha256"], "left_anti")


def history_entries(before: DataFrame, after: DataFrame, key: str, ignored: list[str]) -> DataFrame:
    """Records that a run changed: key, change_kind, compared by the hash of all columns but the ignored ones."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        kept = sorted(c for c in df.columns if c != key and c not in ignored)
        return df.select(key, F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256).alias(name))

    joined = hashed(before, "old").join(hashed(after, "new"), key, "full_outer")
    kind = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated")
    return joined.select(key, kind.alias("change_kind")).filter("change_kind is not null")
