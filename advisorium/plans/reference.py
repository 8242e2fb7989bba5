"""Queries of the corpus operators over the given tables; each has SQL in ``reference_sql`` where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from advisorium.functions import ids, packages, severity, text
from advisorium.operators import detail, enrich, listing, matching, merge, scan
from advisorium.plans.problems import catalog_snapshots
from advisorium.session import Workspace, table
from advisorium.sinks import exports
from advisorium.sources import bundle, documents, inventory
from advisorium.versions import frames

Query = Callable[[SparkSession, str], DataFrame]
LIST_COLUMNS = ["record_no", "id", "title", "description", "state", "published", "modified", "cwes", "aliases", "primary_score", "primary_rating", "epss_score", "in_kev", "sources"]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vulnerabilities", LIST_COLUMNS)


def _product() -> Column:
    return F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements derived from the order lines: one per line, with a version window."""
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    parts = table(spark, d, "part", ["p_partkey", "p_name", "p_size"])
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    product = _product()
    vendor = F.concat(F.lit("vendor-"), F.col("l_suppkey").cast("string"))
    window = F.struct(
        F.col("l_linenumber").cast("string").alias("introduced"), F.col("l_quantity").cast("int").cast("string").alias("fixed"), F.lit(None).cast("string").alias("last_affected"),
        F.lit("SEMVER").alias("type"), F.lit(None).cast("string").alias("cpe"), F.lit(False).alias("introduced_exclusive"),
    )
    none = F.lit(None).cast("string")
    return joined.select(
        F.concat(F.lit("CVE-2024-"), F.lpad(F.col("l_orderkey").cast("string"), 7, "0")).alias("vuln_id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("fingerprint"),
        vendor.alias("vendor"), product.alias("product"), none.alias("ecosystem"), none.alias("purl"),
        F.array(F.concat(F.lit("cpe:2.3:a:"), vendor, F.lit(":"), product, F.lit(":*:*:*:*:*:*:*:*"))).alias("cpes"), F.array().cast("array<string>").alias("versions"),
        F.array(window).alias("ranges"), none.alias("default_state"), none.alias("status"), none.alias("source"), F.col("l_linenumber").alias("low"), F.col("l_quantity").cast("int").alias("high"), "p_size",
    )


def components(spark: SparkSession, d: str) -> DataFrame:
    """An inventory derived from the parts: one component each, whose version is its size."""
    parts = table(spark, d, "part", ["p_partkey", "p_name", "p_size"])
    none = F.lit(None).cast("string")
    return parts.select(
        F.col("p_partkey").alias("comp_id"), _product().alias("name"), F.col("p_size").cast("string").alias("version"),
        F.concat(F.lit("vendor-"), (F.col("p_partkey") % 10 + 1).cast("string")).alias("vendor"), none.alias("ecosystem"), none.alias("purl"), none.alias("cpe"), none.alias("origin"),
    )


def names(spark: SparkSession, d: str) -> DataFrame:
    """Which name belongs to which flaw, normalised."""
    stated = table(spark, d, "vuln_aliases", ["alias", "vuln_id"])
    return stated.select(ids.identifier("alias").alias("alias"), ids.identifier("vuln_id").alias("vuln_id")).filter("alias is not null and vuln_id is not null").distinct()


def exploited(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "vuln_snapshots", ["vuln_id", "snapshot_at", "in_kev"]).filter("in_kev")
    return seen.select(ids.identifier("vuln_id").alias("cve_id"), F.col("snapshot_at").alias("date_added")).groupBy("cve_id").agg(F.min("date_added").alias("date_added")).filter("cve_id is not null")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vuln_snapshots", ["vuln_id", "snapshot_at", "epss_score", "row_no"]).filter("epss_score is not null")
    return rows.select(ids.identifier("vuln_id").alias("cve_id"), F.col("epss_score").alias("score"), F.col("snapshot_at").alias("score_date"), "row_no").filter("cve_id is not null")


def _page(f: listing.ListFilter, *columns: str) -> Query:
    return lambda spark, d: listing.page(corpus(spark, d), f, tiebreak=("record_no",)).select("record_no", "id", *columns)


def list_children(spark: SparkSession, d: str) -> DataFrame:
    """Orders as flaws, asked for by two conditions that different statements may meet."""
    flaws = table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).select(F.concat(F.lit("CVE-2024-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("id"), "o_orderkey")
    said = statements(spark, d)
    one = listing.filtered(flaws, listing.ListFilter(vendor="VENDOR-1"), said)
    return listing.filtered(one, listing.ListFilter(vendor="Vendor-2"), said).select("id")


def kev_first(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.first_exploited(exploited(spark, d), names(spark, d))
    return out.select("vuln_id", F.date_format("kev_date_added", "yyyy-MM-dd").alias("kev_date_added"))


def epss_best(spark: SparkSession, d: str) -> DataFrame:
    return enrich.best_prediction(predicted(spark, d), names(spark, d)).select("vuln_id", F.round("epss_score", 6).alias("epss_score"))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vulnerabilities", ["record_no", "id", "in_kev", "epss_score"])
    return rows.select("record_no", ids.identifier("id").alias("id"), "in_kev", "epss_score")


def kev_stale(spark: SparkSession, d: str) -> DataFrame:
    return enrich.stale_flags(flagged(spark, d), exploited(spark, d), names(spark, d)).select("record_no", "id")


def kev_resync(spark: SparkSession, d: str) -> DataFrame:
    known = names(spark, d)
    out = enrich.resynced(flagged(spark, d), enrich.first_exploited(exploited(spark, d), known), enrich.best_prediction(predicted(spark, d), known))
    return out.groupBy("in_kev", "changed").agg(F.count("*").alias("n"))


def stats(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.statistics(corpus(spark, d), table(spark, d, "vuln_aliases"), table(spark, d, "kev_entries"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("vulnerabilities", "unscored", "exploited", "aliases", "kev_entries", day("newest_modified"), day("oldest_published"))


def record_stream(spark: SparkSession, d: str) -> DataFrame:
    """Records in order of arrival, derived from the events: 500 flaws, a record per user and source."""
    e = table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    kind = lambda word, source: F.when(F.col("event_type") == word, source)
    source = F.coalesce(kind("purchase", "cvelist"), kind("signup", "nvd"), kind("click", "csaf"), kind("view", "osv"), F.lit("other"))
    said = F.when(F.col("event_id") % 3 != 0, F.concat_ws("-", "event_type", F.col("event_id").cast("string")))
    return e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 500).alias("flaw"), source.alias("source"), F.col("user_id").cast("string").alias("record_id"),
        F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("modified"), F.col("ts").alias("published"), F.when(F.col("event_id") % 29 == 0, F.col("ts")).alias("withdrawn"),
        said.alias("title"), F.lit("").alias("description"), F.col("event_type").alias("assigner"), F.lit(None).cast("string").alias("state"),
        F.array(F.concat(F.lit("A-"), (F.col("event_id") % 7).cast("string"))).alias("aliases"), F.array().cast("array<string>").alias("related"), F.array(F.col("event_type")).alias("cwes"), F.array().cast("array<string>").alias("tags"),
    )


def version_guard(spark: SparkSession, d: str) -> DataFrame:
    return merge.accepted_records(record_stream(spark, d)).groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("stale"), 1)).alias("n_stale"))


def fold_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = merge.folded_documents(merge.accepted_records(record_stream(spark, d)), "flaw")
    return docs.select("flaw", "title", "assigner", "source", F.array_join("aliases", ",").alias("aliases"), F.array_join("cwes", ",").alias("cwes"), F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))


def newest_contributions(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_contributions(merge.accepted_records(record_stream(spark, d))).select("source", "record_id", "seq")


def alias_clusters(spark: SparkSession, d: str) -> DataFrame:
    pairs = names(spark, d).select(F.col("alias").alias("a"), F.col("vuln_id").alias("b"))
    return merge.canonical_ids(merge.alias_clusters(pairs), "cluster", "name").select("cluster", "canonical_id")


def top_statements(spark: SparkSession, d: str) -> DataFrame:
    pairs, _ = scan.candidates(components(spark, d), statements(spark, d), per_key=3)
    return pairs


def truncated_lookups(spark: SparkSession, d: str) -> DataFrame:
    return scan.candidates(components(spark, d), statements(spark, d), per_key=3)[1]


def capped_lookups(spark: SparkSession, d: str) -> DataFrame:
    """The lookups that a cap of 2,000 statements per key would cut, and how many statements there are."""
    return scan.candidates(components(spark, d), statements(spark, d), per_key=2_000)[1]


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    comps, said = components(spark, d), statements(spark, d)
    verdicts = scan.judge(scan.all_candidates(comps, said), comps, said)
    return scan.reduce_verdicts(verdicts).select("comp_id", "vuln_id", "outcome", "confidence", "matched_on")


def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    return scan.confidence_counts(scan_findings(spark, d))


def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 findings in report order; what a flaw's summary says is derived from its order."""
    flaws = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"]).select(
        F.concat(F.lit("CVE-2024-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("vuln_id"), (F.col("o_orderstatus") == "F").alias("in_kev"), (F.col("o_totalprice") / 1e6).alias("epss_score"), (F.col("o_orderkey") % 100 / 10).alias("primary_score"),
    )
    named = components(spark, d).select("comp_id", "name")
    return scan.ordered_findings(scan_findings(spark, d), flaws, named).limit(200).select("comp_id", "vuln_id", "name", "in_kev")


def channel_lookups(spark: SparkSession, d: str) -> DataFrame:
    """The first three statements of each key, where statements name their product by package URL, ecosystem, vendor or
    name alone, by their place in the order, and components by all four."""
    said, place = statements(spark, d), F.col("low") % 4
    purl = F.concat(F.lit("pkg:npm/"), "product")
    offered = said.select("vuln_id", "fingerprint", "product", F.when(place == 0, purl).alias("purl"), F.when(place == 1, "npm").alias("ecosystem"), F.when(place == 2, F.col("vendor")).alias("vendor"))
    comps = components(spark, d).withColumns({"purl": F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version", F.lit("?a=b#c")), "ecosystem": F.lit("NPM")})
    return scan.candidates(comps, offered, per_key=3)[0]


def flaw_details(spark: SparkSession, d: str) -> DataFrame:
    """Every name of the alias table looked up: the flaw it leads to, by which way, and its first entry in the exploited
    catalogue and highest prediction under any of its names."""
    known = names(spark, d)
    own = table(spark, d, "vulnerabilities", ["id"]).select(ids.identifier("id").alias("id")).filter("id is not null").groupBy("id").agg(F.count("*").alias("n_records"))
    best = predicted(spark, d).groupBy("cve_id").agg(F.max("score").alias("score"))
    found = detail.by_name(table(spark, d, "vuln_aliases", ["alias"]).select(ids.identifier("alias").alias("name")).distinct(), known, own)
    side = detail.with_side_tables(found, known, exploited(spark, d), best)
    return side.select("name", "id", "matched_via", "n_records", "kev_cve_id", F.date_format("date_added", "yyyy-MM-dd").alias("date_added"), "epss_cve_id", F.round("score", 6).alias("score"))


def merged_children(spark: SparkSession, d: str) -> DataFrame:
    """Of the lines of a part and supplier the one that came last."""
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).withColumn("seq", F.struct("l_orderkey", "l_linenumber"))
    return merge.merged_children(lines, ["l_partkey", "l_suppkey"]).drop("seq")


def version_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as versions inside the window of each statement, by sort keys alone."""
    rows = statements(spark, d).select("vuln_id", "fingerprint", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), F.col("p_size").cast("string").alias("v"), F.lit("semver").alias("s"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vuln_id")
    for c in ("low", "high", "v"):
        rows = frames.with_sort_key(rows, "s", c, f"k_{c}")
    inside = (F.col("k_v") >= F.col("k_low")) & (F.col("k_v") < F.col("k_high"))
    return rows.groupBy(inside.alias("inside")).agg(F.count("*").alias("n"))


_RANKS: dict[tuple[str, str], enrich.VendorRankTable] = {}


def stored_rank(spark: SparkSession, d: str) -> DataFrame:
    """The vendor rank of a folder's statements, built by the first query of an application that asks for it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RANKS or _RANKS[key].table.current() is None:
        rank = enrich.VendorRankTable(spark, Workspace(spark, "vendor-rank").folder)
        rank.refresh(statements(spark, d))
        _RANKS[key] = rank
    return _RANKS[key].read()


def vendor_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The rank built anew."""
    return enrich.vendor_rank(statements(spark, d))


def vendor_top(spark: SparkSession, d: str) -> DataFrame:
    return enrich.top_vendors(stored_rank(spark, d)).select("product", "vendor", "n")


def id_forms(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vulnerabilities", ["record_no", "id"])
    return v.select("record_no", ids.identifier("id").alias("identifier"), ids.namespace_rank("id").alias("rank"))


def id_lists(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vulnerabilities", ["record_no", "id", "aliases"])
    return v.select("record_no", F.array_join(ids.all_identifiers("id", "aliases"), "|").alias("identifiers"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "euvd_items", ["item_no", "base_score", "base_score_vector"])
    return e.select("item_no", severity.rating("base_score").alias("rating"), severity.rating("base_score", v2=True).alias("rating_v2"), severity.vector_type(F.trim("base_score_vector")).alias("vector_type"))


def base_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "euvd_items", ["item_no", "base_score_vector"])
    return e.select("item_no", severity.base_score("base_score_vector").alias("score"))


def purl_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "osv_records", ["rec_no", "ecosystem", "package_name"])
    return o.select("rec_no", packages.purl_key(F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "package_name", F.lit("@1.0?arch=x#y"))).alias("purl_key"))


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "euvd_items", ["item_no", "product_name"]).select("item_no", packages.folded_name("product_name").alias("folded"))


def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text", "source"])
    rows = docs.filter("text is not null").select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("content"))
    archive = rows.filter(F.col("record_id").cast("long") % 2 == 0).select("source", "record_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return enrich.changed_raw(rows, archive).select("record_id", "sha256")


def snapshot_changes_last(spark: SparkSession, d: str) -> DataFrame:
    """What the last two NVD rows of a record differ in, by content hash; a record with one row is created.

    Rows without an identifier are no record's.
    """
    rows = table(spark, d, "nvd_cve", ["row_no", "cve_id", "vuln_status", "base_score", "description"]).withColumn("id", ids.identifier("cve_id")).filter("id is not null")
    last = rows.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("row_no")))).filter("at <= 2")
    one = lambda at: last.filter(F.col("at") == at).select("id", "vuln_status", "base_score", "description")
    return enrich.history_entries(one(2), one(1), "id", ["description"])


def epss_upserts(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d)
    latest = enrich.first_row(rows, ["cve_id", "score_date"], F.col("row_no").desc()).select("cve_id", "score", "score_date")
    even = F.dayofmonth("score_date") % 2 == 0
    stored = enrich.first_row(latest.filter(even), ["cve_id"], F.col("score_date").desc())
    incoming = enrich.first_row(latest.filter(~even), ["cve_id"], F.col("score_date").desc())
    return enrich.upsert_epss(stored, incoming).select("cve_id", F.round("score", 6).alias("score"), F.date_format("score_date", "yyyy-MM-dd").alias("score_date"))


def kev_replace_all(spark: SparkSession, d: str) -> DataFrame:
    """The exploited catalogue after every version replaced the one before, in version order, from an empty store.

    A version counts by its complete delivery that was fetched last; one without entries replaces nothing. The result
    is that of ``enrich.replace_catalogue`` applied version by version, in one aggregation: what the newest version
    lists stands, and of each entry its unbroken run of versions up to the newest counts, for what was removed before
    is gone. entry_no stands for the date added.
    """
    versions = catalog_snapshots(table(spark, d, "kev_catalogs"))
    rows = table(spark, d, "kev_entries", ["entry_no", "delivery_no", "cve_id", "product", "known_ransomware_use"]).withColumn("id", ids.identifier("cve_id")).filter("id is not null")
    said = F.struct(text.blank_to_null("product").alias("product"), (text.folded("known_ransomware_use") == "known").alias("known"))
    stated = rows.join(versions, "delivery_no").groupBy("seq", "id").agg(F.min("entry_no").alias("entry_no"), F.min_by(said, "entry_no").alias("said"))
    # One row per version: its place counted back from the newest version that has entries.
    places = stated.select("seq").distinct().select("seq", F.row_number().over(Window.orderBy(F.desc("seq"))).alias("back"))
    run = stated.join(F.broadcast(places), "seq").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("back"))).filter("at = back")
    return run.groupBy(F.col("id").alias("cve_id")).agg(
        F.min_by("said.product", F.when(F.col("said.product").isNotNull(), F.col("seq"))).alias("product"), F.min("entry_no").alias("date_added"),
        F.coalesce(F.bool_or("said.known"), F.lit(False)).alias("known_ransomware"), F.lit("cisa").alias("kev_sources"),
    )


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.size(text.tokens("text")).alias("n_distinct"))


def distinct_arrays(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vulnerabilities", ["record_no", "cwes"])
    return v.select("record_no", F.array_join(ids.distinct_texts("cwes"), ",").alias("cwes"))


def verdict_batch(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of every line's statement against its own part."""
    said = statements(spark, d)
    own = F.struct(*[(F.col("product") if c == "name" else F.col("p_size").cast("string") if c == "version" else F.lit(None).cast("string")).alias(c) for c in ("name", "version", "vendor", "ecosystem", "purl", "cpe", "origin")])
    pairs = said.select("vuln_id", "fingerprint", own.alias("component"), F.struct("vendor", "product", "ecosystem", "purl", F.array().cast("array<string>").alias("cpes"), "versions", "ranges", "default_state", "status", "source").alias("statement"))
    spread = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vuln_id")
    return matching.with_verdicts(spread).groupBy("result", "confidence").agg(F.count("*").alias("n"))


def osv_parsed(spark: SparkSession, d: str) -> DataFrame:
    """OSV records written as documents and parsed again."""
    o = table(spark, d, "osv_records", ["rec_no", "id", "aliases", "summary", "details", "ecosystem", "package_name"])
    package = F.struct(F.col("ecosystem"), F.col("package_name").alias("name"), F.concat(F.lit("pkg:x/"), "package_name").alias("purl"))
    doc = F.to_json(F.struct("id", "aliases", "summary", "details", F.array(F.struct(package.alias("package"))).alias("affected")))
    parsed = documents.parse_osv(o.select(doc.alias("content")))
    return parsed.groupBy("id").agg(F.count("*").alias("n"), F.max("title").alias("title"), F.max(F.col("affected")[0]["product"]).alias("product"), F.max(F.size("aliases") + F.size("related")).alias("n_names"))


def nvd_parsed(spark: SparkSession, d: str) -> DataFrame:
    """NVD records written as documents and parsed again."""
    n = table(spark, d, "nvd_cve", ["row_no", "cve_id", "source_identifier", "vuln_status", "description", "base_score"])
    metric = F.struct(F.struct(F.col("base_score").alias("baseScore")).alias("cvssData"))
    doc = F.to_json(F.struct(F.trim(F.translate("cve_id", "\n\t", "")).alias("id"), F.col("source_identifier").alias("sourceIdentifier"), F.col("vuln_status").alias("vulnStatus"), F.array(F.struct(F.lit("en").alias("lang"), F.col("description").alias("value"))).alias("descriptions"), F.struct(F.array(metric).alias("cvssMetricV31")).alias("metrics")))
    parsed = documents.parse_nvd(n.select(doc.alias("content")))
    return parsed.groupBy("id", "state").agg(F.count("*").alias("n"), F.max(F.col("severities")[0]["score"]).alias("score"), F.max(F.col("severities")[0]["rating"]).alias("rating"))


def banner_services(spark: SparkSession, d: str) -> DataFrame:
    """Services that name themselves in the lines of any document."""
    docs = table(spark, d, "documents", ["doc_id", "text"])
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\R")).alias("line_no", "banner"))
    return inventory.named_services(lines).select("doc_id", "line_no", "product", "version")


def known_banners(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of the documents each rule of well-known services tells, products without any included."""
    lines = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.explode(F.split("text", r"\R")).alias("banner"))
    found = inventory.identify_banners(lines).groupBy("vendor", "product").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame(inventory.KNOWN_SERVICES, "vendor string, product string")
    return rules.join(found, ["vendor", "product"], "left").select("vendor", "product", F.coalesce("n", F.lit(0)).alias("n"))


def csv_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.csv_rows(corpus(spark, d))


def service_vendors(spark: SparkSession, d: str) -> DataFrame:
    """Components with the vendor that the corpus knows for their name."""
    ranked = enrich.top_vendors(stored_rank(spark, d))
    services = components(spark, d).select("comp_id", F.col("name").alias("product"), "vendor")
    return enrich.reconciled_vendors(services, ranked).select("comp_id", "product", "vendor")


def bundle_windows(spark: SparkSession, d: str) -> DataFrame:
    """Addresses by day, each served by the recorded window that lies nearest."""
    e = table(spark, d, "events", ["event_id", "ts", "event_type"])
    url = lambda day: F.concat(F.lit("https://host.invalid/"), "event_type", F.lit("?from="), F.date_format(day, "yyyy-MM-dd"), F.lit("&page=1"))
    asked = e.select(url(F.col("ts")).alias("url")).distinct()
    third = e.filter(F.dayofmonth("ts") % 3 == 0).select("event_type", F.col("ts").cast("date").alias("day")).distinct()
    kept = third.select(url(F.col("day")).alias("url"))
    recorded = kept.select("url", F.sha2("url", 256).alias("sha256"), F.lit(200).alias("status"), F.lit(0.0).alias("captured_at"), bundle.shape(F.col("url")).alias("shape"), bundle.dates(F.col("url")).alias("dates"))
    return bundle.lookup(asked, recorded).select("url", "recorded_url", "exact")


SINCE = datetime(2025, 6, 1)
QUERIES: dict[str, Query] = {
    "list_modified": _page(listing.ListFilter(modified_since=SINCE, limit=200)),
    "list_published": _page(listing.ListFilter(published_since=SINCE, order_by="published", limit=50, offset=25)),
    "list_score": _page(listing.ListFilter(min_score=5, max_score=9, order_by="score", limit=100, offset=50), "primary_score"),
    "list_epss_kev": _page(listing.ListFilter(kev=True, min_epss=0.01, order_by="epss")),
    "list_ratings": _page(listing.ListFilter(ratings=("high", "CRITICAL"), states=("published",), order_by="id", limit=1000)),
    "list_sources": _page(listing.ListFilter(sources=("nvd", "osv"), cwes=("CWE-79", "CWE-89"), order_by="id", limit=500)),
    "list_text": _page(listing.ListFilter(text="cache Authorization", order_by="id", limit=1000)),
    "list_total": lambda spark, d: listing.total(corpus(spark, d), listing.ListFilter(min_score=5, sources=("nvd",))),
    "list_children": list_children,
    "kev_first": kev_first, "epss_best": epss_best, "kev_stale": kev_stale, "kev_resync": kev_resync, "stats": stats,
    "counts_by_rating": lambda spark, d: enrich.counts_by_rating(corpus(spark, d)), "counts_by_source": lambda spark, d: enrich.counts_by_source(corpus(spark, d)),
    "vendor_ranks": vendor_ranks, "vendor_top": vendor_top, "version_guard": version_guard, "fold_documents": fold_documents,
    "newest_contributions": newest_contributions, "alias_clusters": alias_clusters, "top_statements": top_statements, "truncated_lookups": truncated_lookups,
    "scan_findings": scan_findings, "scan_counts": scan_counts, "capped_lookups": capped_lookups, "scan_report": scan_report, "channel_lookups": channel_lookups, "flaw_details": flaw_details, "merged_children": merged_children, "version_windows": version_windows, "verdict_batch": verdict_batch, "id_forms": id_forms, "id_lists": id_lists,
    "ratings": ratings, "base_scores": base_scores, "purl_keys": purl_keys, "folded_names": folded_names, "document_hashes": document_hashes,
    "snapshot_changes_last": snapshot_changes_last, "epss_upserts": epss_upserts, "kev_replace_all": kev_replace_all, "text_tokens": text_tokens, "distinct_arrays": distinct_arrays, "osv_parsed": osv_parsed, "nvd_parsed": nvd_parsed, "banner_services": banner_services, "known_banners": known_banners, "csv_export": csv_export, "service_vendors": service_vendors, "bundle_windows": bundle_windows,
}
