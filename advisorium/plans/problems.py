"""The queries of the general data-processing problems over the tables of the vulnerability corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions.ids import identifier
from advisorium.functions.text import folded
from advisorium.functions.times import add_instant, calendar_day, read_times, us_of_ntz
from advisorium.operators import history, ledger, packed, snapdiff, zones
from advisorium.session import Workspace, bounded_rows, table

Query = Callable[[SparkSession, str], DataFrame]

def feeds() -> tuple[zones.Feed, ...]:
    """The four time columns. Rows of one entity state one time in several spellings, which tells the feed's zone."""
    return (
        zones.Feed("nvd_cve", "row_no", "published", "nvd", "landed_at", entity=identifier("cve_id")),
        zones.Feed("euvd_items", "item_no", "date_published", "euvd", "fetched_at", entity=identifier("id")),
        zones.Feed("osv_records", "rec_no", "modified", "osv", "fetched_at", "published", identifier("id")),
        zones.Feed("kev_entries", "entry_no", "date_added", "kev", entity=identifier("cve_id")),
    )


NVD_MODIFIED = zones.Feed("nvd_cve", "row_no", "last_modified", "nvd", "landed_at", "published")
PACKED = {"aliases": packed.ALIAS, "reference_list": packed.REFERENCE}
REGULAR_LOAD = "INTERVAL 1 DAY"
#: Versions of the catalogue are a calendar; an index of some thousand entries needs few buckets.
MAX_CATALOGUES = 100_000
CATALOGUE_BUCKETS = 4


def zone_feeds() -> tuple[zones.Feed, ...]:
    """What tells the zone of each source: times that stay the same in all rows of an entity."""
    return tuple(zones.Feed("osv_records", "rec_no", "published", "osv", "fetched_at", entity=identifier("id")) if f.source == "osv" else f for f in feeds())


def _inputs(spark: SparkSession, d: str, of: tuple[zones.Feed, ...]) -> list[tuple[DataFrame, zones.Feed]]:
    return [(table(spark, d, f.table), f) for f in of]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every readable time text of the four feeds as one instant."""
    normalizer = zones.TimeNormalizer(spark, table(spark, d, "sources"))
    return normalizer.normalize(_inputs(spark, d, feeds()), _inputs(spark, d, zone_feeds()))


def p1_unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Local time texts of sources whose zone nothing tells."""
    normalizer = zones.TimeNormalizer(spark, table(spark, d, "sources"))
    return normalizer.unplaced(_inputs(spark, d, feeds()), _inputs(spark, d, zone_feeds()))


def p1_zone_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How often each candidate zone violates what is known, whatever zone is declared."""
    normalizer = zones.TimeNormalizer(spark, table(spark, d, "sources"))
    return normalizer.scores(_inputs(spark, d, zone_feeds()))


def p1_withheld(spark: SparkSession, d: str) -> DataFrame:
    """How the estimate fares when no declaration is given: per table, how many texts are read, and how many of them to
    the same instant as with the declared zones."""
    normalizer = zones.TimeNormalizer(spark, table(spark, d, "sources"))
    given, told = _inputs(spark, d, feeds()), _inputs(spark, d, zone_feeds())
    right = normalizer.normalize(given, told).withColumnRenamed("epoch_us", "true_us")
    guessed = normalizer.normalize(given, told, withheld=True)
    both = right.join(guessed, ["table_name", "row_no"], "left")
    return both.groupBy("table_name").agg(F.count("*").alias("n_read"), F.count(F.when(F.col("true_us") == F.col("epoch_us"), 1)).alias("n_same"))


def _packer() -> Column:
    """Who packed an item's lists: EUVD takes them over from the item's assigner."""
    return folded("assigner")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every alias and reference of the EUVD items as its own row with its position."""
    return packed.unpack(table(spark, d, "euvd_items", ["item_no", "assigner", *PACKED]), "item_no", PACKED, _packer())


def p2_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """Score of every candidate delimiter by field and assigner."""
    scores = packed.delimiter_scores(table(spark, d, "euvd_items", ["assigner", *PACKED]), PACKED, _packer())
    return scores.select("field", "source", "delimiter", "n", F.round("score", 6).alias("score"))


def snapshot_spec() -> history.SnapshotSpec:
    """Values compared as integers: epss_score at five decimals, primary_score at one."""
    return history.SnapshotSpec(
        identifier("vuln_id"), "snapshot_at", "loaded_at",
        {
            "epss_e5": F.round(F.round("epss_score", 5) * 100_000).cast("long"),
            "in_kev": F.col("in_kev"),
            "score_e1": F.round(F.round("primary_score", 1) * 10).cast("int"),
        },
        "row_no",
    )


SNAPSHOT_COLUMNS = ["row_no", "snapshot_at", "loaded_at", "vuln_id", "epss_score", "in_kev", "primary_score"]


def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """The whole history: a store of the regular loads, to which late and corrected rows are applied."""
    raw = table(spark, d, "vuln_snapshots", SNAPSHOT_COLUMNS)
    late = F.coalesce(F.col("loaded_at") > F.col("snapshot_at") + F.expr(REGULAR_LOAD), F.lit(False))
    return history.history_with_late_rows(raw, late, snapshot_spec(), Workspace(spark, "history").folder)


def _as_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every vulnerability with the period in which it was valid."""
    ends = F.coalesce(_as_text("valid_to"), F.lit("9999-12-31 00:00:00"))
    return snapshot_history(spark, d).select(F.col("entity").alias("vuln_id"), _as_text("valid_from").alias("valid_from"), ends.alias("valid_to"))


def p4_open_versions(spark: SparkSession, d: str) -> DataFrame:
    """What holds after the last snapshot: the open version of each vulnerability with its values."""
    now = snapshot_history(spark, d).filter("valid_to is null")
    return now.select(F.col("entity").alias("vuln_id"), (F.col("epss_e5") / 100_000).alias("epss_score"), "in_kev", (F.col("score_e1") / 10).alias("primary_score"), _as_text("valid_from").alias("valid_from"))


def catalog_snapshots(catalogs: DataFrame) -> DataFrame:
    """The versions of the catalogue in order, each by its complete delivery that was fetched last: seq, delivery_no.

    Versions are compared as year, month and day numbers; one that is no such numbers is left out.
    """
    spelled = r"^\D*(\d{4})(?:\D+(\d{1,2})\D+(\d{1,2})|(\d{2})(\d{2}))\D*$"
    part = lambda *groups: F.coalesce(*[F.regexp_extract("catalog_version", spelled, g).try_cast("int") for g in groups])
    number = F.when(F.col("catalog_version").rlike(spelled), F.array(part(1), part(2, 4), part(3, 5)))
    complete = catalogs.filter(folded("fetch_status") == "complete").select(number.alias("version"), "delivery_no", "fetched_at")
    best = complete.filter(F.size("version") == 3).groupBy("version").agg(F.max_by("delivery_no", F.struct("fetched_at", "delivery_no")).alias("delivery_no"))
    return snapdiff.consecutive(best, ["version"]).select("seq", "delivery_no")


def catalogue_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes between every two consecutive catalogue versions, old and new values beside: every version is landed and
    delivered in order to a stored index."""
    snapshots = bounded_rows(catalog_snapshots(table(spark, d, "kev_catalogs")).select("seq", "delivery_no"), MAX_CATALOGUES, "versions of the catalogue")
    seq_of = spark.createDataFrame([tuple(r) for r in snapshots], "seq long, delivery_no long")
    entries = table(spark, d, "kev_entries", ["entry_no", "delivery_no", "cve_id", "date_added", "known_ransomware_use"])
    rows = read_times(entries.join(F.broadcast(seq_of), "delivery_no"), "date_added", zones.zone_names(spark)).select(
        "seq", "entry_no", identifier("cve_id").alias("cve_id"), calendar_day("time_us").alias("day"), folded("known_ransomware_use").alias("ransomware")
    )
    index = snapdiff.SnapshotIndex(spark, Workspace(spark, "catalogue").folder, "cve_id", ["day", "ransomware"], "entry_no", CATALOGUE_BUCKETS)
    index.land(rows)
    paths = index.deliver(*sorted(r.seq for r in snapshots))
    of = {r.seq: r.delivery_no for r in snapshots}
    pairs = spark.createDataFrame([(n, of[n - 1], of[n]) for n in of if n - 1 in of], "to_seq long, from_delivery long, to_delivery long")
    return index.changes(paths).join(F.broadcast(pairs), "to_seq").select("from_delivery", "to_delivery", "cve_id", "change_kind", "old", "new")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Added, removed and changed entries between every two consecutive catalogue versions."""
    return catalogue_changes(spark, d).select("from_delivery", "to_delivery", "cve_id", "change_kind")


def p5_moves(spark: SparkSession, d: str) -> DataFrame:
    """The entries that came and went, whatever their values."""
    return p5_found(spark, d).filter("change_kind != 'changed'")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """The same with the values before and after."""
    side = lambda s: [F.date_format(f"{s}.day", "yyyy-MM-dd").alias(f"{s}_day"), F.col(f"{s}.ransomware").alias(f"{s}_ransomware")]
    return catalogue_changes(spark, d).select("to_delivery", "cve_id", "change_kind", *side("old"), *side("new"))


def nvd_items(spark: SparkSession, d: str) -> DataFrame:
    """NVD records as work items: source_name, entity, row_no, landed_at, time_us."""
    normalizer = zones.TimeNormalizer(spark, table(spark, d, "sources"))
    nvd = table(spark, d, "nvd_cve")
    nvd_zone = normalizer.declared.get("nvd") or normalizer.zone_of("nvd", normalizer.estimate([(nvd, NVD_MODIFIED)]))
    nvd = nvd.select("row_no", "cve_id", "last_modified", "landed_at")
    nvd = add_instant(read_times(nvd, "last_modified", normalizer.zones), "time_us", nvd_zone)
    return nvd.select(F.lit("nvd").alias("source_name"), identifier("cve_id").alias("entity"), "row_no", "landed_at", "time_us")


def republished_items(spark: SparkSession, d: str) -> DataFrame:
    """Records of the corpus as work items, their times where they are believed."""
    vulns = table(spark, d, "vulnerabilities", ["record_no", "id", "modified", "updated_at"])
    believed = F.when(~F.coalesce(F.col("modified") > F.col("updated_at"), F.lit(False)), us_of_ntz(F.col("modified")))
    return vulns.select(F.lit("republish").alias("source_name"), identifier("id").alias("entity"), F.col("record_no").alias("row_no"), F.col("updated_at").alias("landed_at"), believed.alias("time_us"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each new or changed record with the one successful run that takes it up."""
    items = nvd_items(spark, d).unionByName(republished_items(spark, d))
    return ledger.new_or_changed(ledger.replay(items, table(spark, d, "source_runs"), Workspace(spark, "runs").folder))


def p7_republish(spark: SparkSession, d: str) -> DataFrame:
    """The same for the corpus' own records alone."""
    return ledger.new_or_changed(ledger.replay(republished_items(spark, d), table(spark, d, "source_runs"), Workspace(spark, "runs").folder))


def p7_ledger(spark: SparkSession, d: str) -> DataFrame:
    """State, token and takeover window of every run."""
    runs = ledger.replay_ledger(table(spark, d, "source_runs"))
    spans = ledger.takeover_windows(runs).select("source_name", "run_no", F.col("after").alias("takes_after"))
    return runs.join(spans, ["source_name", "run_no"], "left").select("source_name", "run_no", "state", "token", _as_text("started_at").alias("started_at"), _as_text("takes_after").alias("takes_after"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_unplaced": p1_unplaced, "p1_withheld": p1_withheld, "p1_zone_evidence": p1_zone_evidence, "p2_found": p2_found, "p2_delimiters": p2_delimiters,
    "p4_found": p4_found, "p4_open_versions": p4_open_versions, "p5_found": p5_found, "p5_values": p5_values, "p5_moves": p5_moves, "p7_republish": p7_republish, "p7_found": p7_found, "p7_ledger": p7_ledger,
}
