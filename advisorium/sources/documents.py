"""Advisory documents as canonical records.

Flat formats are read by ``from_json`` with an explicit schema and stay in Catalyst; documents with recursive or
order-dependent parts (CVE 5 intervals, CSAF product trees) are read in Arrow batches. A document that cannot be
read gives no record and never ends the job; ``unreadable`` counts them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from advisorium.functions import ids, severity
from advisorium.functions.times import add_instant, read_times, zone_names
from advisorium.schemas import AFFECTED, PARSED, RANGE, REFERENCE, SEVERITY
from advisorium.session import ship_package

FUTURE_SLACK = "INTERVAL 24 HOURS"
OSV = (
    "id string, aliases array<string>, related array<string>, upstream array<string>, modified string, published string, withdrawn string, summary string, details string, "
    "severity array<struct<type:string,score:string>>, references array<struct<type:string,url:string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string,purl:string>,ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>,versions:array<string>>>, "
    "database_specific struct<cwe_ids:array<string>,severity:string>"
)
_METRIC = "array<struct<source:string,baseSeverity:string,cvssData:struct<vectorString:string,baseScore:double,baseSeverity:string>>>"
NVD = (
    "id string, sourceIdentifier string, published string, lastModified string, vulnStatus string, cveTags string, descriptions array<struct<lang:string,value:string>>, "
    f"metrics struct<cvssMetricV40:{_METRIC},cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>, "
    "weaknesses array<struct<description:array<struct<lang:string,value:string>>>>, references array<struct<url:string,source:string,tags:array<string>>>, "
    "configurations array<struct<operator:string,negate:boolean,nodes:array<struct<operator:string,negate:boolean,cpeMatch:array<struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>>>>>, "
    "affected array<struct<affectedData:array<struct<vendor:string,product:string,packageName:string,versions:array<struct<version:string,status:string,lessThan:string,lessThanOrEqual:string>>>>>>"
)
_VERSIONS = "array<struct<version:string,status:string,lessThan:string,lessThanOrEqual:string>>"
_DATA = f"array<struct<vendor:string,product:string,packageName:string,versions:{_VERSIONS}>>"
_AFFECTED_DATA = f"array<struct<affectedData:{_DATA}>>"
EUVD = "id string, description string, datePublished string, dateUpdated string, baseScore double, baseScoreVersion string, baseScoreVector string, references string, aliases string, assigner string, epss double, exploitedSince string, enisaIdProduct array<struct<product:struct<name:string>,product_version:string>>, enisaIdVendor array<struct<vendor:struct<name:string>>>"
KEV = "title string, catalogVersion string, dateReleased string, count int, vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,notes:string,cwes:array<string>>>"

_null = lambda t: F.lit(None).cast(t)


def _texts() -> Column:
    return F.array().cast("array<string>")


def _some(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, _texts())


def timed(records: DataFrame, now: str | None = None) -> DataFrame:
    """Records with published, modified and withdrawn as instants in UTC, in place of their texts.

    Unreadable times are null, and so are times more than a day after ``now`` (a column, such as fetched_at).
    """
    zones = zone_names(records.sparkSession)
    out = records
    for name in ("published", "modified", "withdrawn"):
        out = add_instant(read_times(out, f"{name}_text", zones, "rt_"), name, "UTC", "rt_").drop(f"{name}_text")
        at = F.timestamp_micros(name)
        out = out.withColumn(name, F.when(at <= F.col(now) + F.expr(FUTURE_SLACK), at) if now else at)
    return out


def osv_windows(kind: Column, events: Column) -> Column:
    """Version windows of an OSV range: an introduction opens one, a fix, last affected version or limit closes it.

    Only a reversed pair of two events is put in order. Other words give no window.
    """
    empty = F.struct(F.array().cast(f"array<{RANGE}>").alias("done"), _null(RANGE).alias("open"))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    pair = (F.size(events) == 2) & ~given(F.get(events, F.lit(0))["introduced"]) & given(F.get(events, F.lit(1))["introduced"])
    ordered = F.when(pair, F.reverse(events)).otherwise(events)

    def window(low: Column, fixed: Column, last: Column) -> Column:
        return F.struct(low.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"), F.upper(kind).alias("type"), _null("string").alias("cpe"), F.lit(False).alias("introduced_exclusive"))

    def flushed(a: Column) -> Column:
        return F.when(a["open"].isNotNull(), F.array_append(a["done"], a["open"])).otherwise(a["done"])

    def step(a: Column, e: Column) -> Column:
        opens, closes = given(e["introduced"]), given(e["fixed"]) | given(e["last_affected"]) | given(e["limit"])
        fixed = F.when(given(e["fixed"]), e["fixed"])
        last = F.when(fixed.isNull(), F.when(given(e["last_affected"]), e["last_affected"]).when(given(e["limit"]), e["limit"]))
        closed = window(a["open"]["introduced"], fixed, last)
        return F.struct(
            F.when(opens, flushed(a)).when(closes, F.array_append(a["done"], closed)).otherwise(a["done"]).alias("done"),
            F.when(opens, window(e["introduced"], _null("string"), _null("string"))).when(closes, _null(RANGE)).otherwise(a["open"]).alias("open"),
        )

    return F.when(events.isNotNull(), F.aggregate(ordered, empty, step, flushed))


def parse_osv(raw: DataFrame, content: str = "content", source: str = "osv") -> DataFrame:
    """OSV and GHSA documents. Several distinct CVE identifiers among the aliases make all aliases related only."""
    d = raw.select(F.from_json(content, OSV).alias("d")).select("d.*").filter("trim(coalesce(id, '')) != ''")
    names = ids.distinct_texts(F.transform(_some("aliases"), lambda x: ids.normalized_id(x)))
    several = F.size(F.filter(names, lambda x: x.rlike(ids.CVE_SHAPE))) > 1
    related = F.flatten(F.array(_some("related"), _some("upstream"), F.when(several, names).otherwise(_texts())))
    src = F.lit(source)

    # One step per transform, so that no step is repeated inside the next.
    def read(s: Column) -> Column:
        t = F.trim(s["score"])
        return F.struct(t.alias("t"), severity.vector_type(t).alias("typed"), F.upper(s["type"]).alias("named"), F.trim(s["type"]).alias("said"))

    def kinds(s: Column) -> Column:
        named = F.when(s["named"] == "CVSS_V4", "CVSS_V4_0").when(s["named"] == "CVSS_V3", "CVSS_V3_1").when(s["named"] == "CVSS_V2", "CVSS_V2").otherwise("OTHER")
        kind = F.when(s["typed"] != "OTHER", s["typed"]).otherwise(named)
        return F.struct(s["t"].alias("t"), kind.alias("kind"), s["said"].alias("said"), F.when(s["typed"] == "OTHER", s["t"].try_cast("double")).otherwise(severity.base_score(s["t"])).alias("score"))

    def judged(s: Column) -> Column:
        other = s["kind"] == "OTHER"
        score = F.when(other | ~s["t"].rlike(r"^[0-9.]+$"), s["score"])
        rated = F.when(s["kind"] == "CVSS_V2", severity.rating(score, v2=True)).otherwise(severity.rating(score))
        return F.struct(s["kind"].alias("type"), score.alias("score"), F.when(~other, s["t"]).alias("vector"), F.when(other & s["score"].isNull(), F.upper(s["t"])).otherwise(rated).alias("rating"), F.when(other, s["said"]).alias("provider"), src.alias("source"))

    def package(a: Column) -> Column:
        p = a["package"]
        windows = F.flatten(F.transform(F.coalesce(a["ranges"], F.array().cast("array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>")), lambda r: F.coalesce(osv_windows(r["type"], r["events"]), F.array().cast(f"array<{RANGE}>"))))
        return F.struct(_null("string").alias("vendor"), p["name"].alias("product"), p["ecosystem"].alias("ecosystem"), p["purl"].alias("purl"), _texts().alias("cpes"), _some(a["versions"]).alias("versions"), windows.alias("ranges"), _null("string").alias("default_state"), _null("string").alias("status"), src.alias("source"))

    band = severity.qualitative_band("database_specific.severity")
    listed = F.filter(F.coalesce("severity", F.array().cast("array<struct<type:string,score:string>>")), lambda s: F.trim(F.coalesce(s["score"], F.lit(""))) != "")
    scored = F.transform(F.transform(F.transform(listed, read), kinds), judged)
    worded = F.array(F.struct(F.lit("OTHER").alias("type"), _null("double").alias("score"), _null("string").alias("vector"), band.alias("rating"), _null("string").alias("provider"), src.alias("source")))
    return d.select(
        ids.normalized_id("id").alias("id"), F.col("summary").alias("title"), F.coalesce(F.when(F.trim("details") != "", F.col("details")), F.col("summary")).alias("description"),
        F.when(F.trim("withdrawn") != "", "WITHDRAWN").otherwise("PUBLISHED").alias("state"), F.col("published").alias("published_text"), F.col("modified").alias("modified_text"), F.col("withdrawn").alias("withdrawn_text"), _null("string").alias("assigner"),
        F.when(several, _texts()).otherwise(names).alias("aliases"), ids.distinct_texts(F.transform(related, lambda x: ids.normalized_id(x))).alias("related"), ids.distinct_texts(_some("database_specific.cwe_ids")).alias("cwes"), _texts().alias("tags"),
        F.when((F.size(listed) == 0) & (F.coalesce(band, F.lit("")) != ""), worded).otherwise(scored).cast(f"array<{SEVERITY}>").alias("severities"),
        F.transform(F.filter(F.coalesce("references", F.array().cast("array<struct<type:string,url:string>>")), lambda r: F.coalesce(r["url"], F.lit("")) != ""), lambda r: F.struct(r["url"].alias("url"), _null("string").alias("name"), F.array(F.lower(F.coalesce(r["type"], F.lit("")))).alias("tags"), src.alias("source"))).cast(f"array<{REFERENCE}>").alias("references"),
        F.transform(F.coalesce("affected", F.array().cast(OSV.split("affected ")[1].split(", database_specific")[0])), package).cast(f"array<{AFFECTED}>").alias("affected"),
        _null("struct<exploitation:string,automatable:string,technical_impact:string,source:string>").alias("ssvc"), src.alias("source"), F.col("id").alias("record_id"),
    )


def nvd_platforms(configurations: Column) -> Column:
    """Vulnerable platforms of NVD configurations, flat: vendor, product, conditional, criteria, window.

    Negated configurations and nodes are left out; an AND over several children makes a platform conditional.
    """
    is_and = lambda x, n: (F.upper(F.trim(F.coalesce(x["operator"], F.lit("")))) == "AND") & (F.size(n) > 1)
    asserted = lambda x: ~F.coalesce(x["negate"], F.lit(False))

    def match(m: Column, conditional: Column) -> Column:
        part = lambda i: F.replace(F.get(F.split(m["criteria"], r"(?<!\\):"), F.lit(i)), F.lit("\\"), F.lit(""))
        start, after = m["versionStartIncluding"], m["versionStartExcluding"]
        window = F.struct(F.coalesce(start, after).alias("introduced"), m["versionEndExcluding"].alias("fixed"), F.when(m["versionEndExcluding"].isNull(), m["versionEndIncluding"]).alias("last_affected"), F.lit("CPE").alias("type"), m["criteria"].alias("cpe"), (start.isNull() & after.isNotNull()).alias("introduced_exclusive"))
        stated = F.coalesce(start, after, m["versionEndExcluding"], m["versionEndIncluding"]).isNotNull()
        return F.struct(part(3).alias("vendor"), part(4).alias("product"), conditional.alias("conditional"), m["criteria"].alias("criteria"), F.when(stated, window).alias("window"))

    def node(n: Column, whole: Column) -> Column:
        wanted = F.filter(n["cpeMatch"], lambda m: F.coalesce(m["vulnerable"], F.lit(False)) & (F.coalesce(m["criteria"], F.lit("")) != ""))
        return F.transform(wanted, lambda m: match(m, whole | is_and(n, n["cpeMatch"])))

    return F.flatten(F.flatten(F.transform(F.filter(configurations, asserted), lambda c: F.transform(F.filter(c["nodes"], asserted), lambda n: F.coalesce(node(n, is_and(c, c["nodes"])), F.array().cast("array<struct<vendor:string,product:string,conditional:boolean,criteria:string,window:" + RANGE + ">>"))))))


def parse_nvd(raw: DataFrame, content: str = "content", source: str = "nvd") -> DataFrame:
    """NVD 2.0 records (the content of ``cve``), platforms grouped by vendor, product and condition."""
    src = F.lit(source)
    d = raw.select(F.from_json(content, NVD).alias("d")).select("d.*").filter("trim(coalesce(id, '')) != ''")
    first_en = lambda c: F.get(F.filter(c, lambda x: F.lower(x["lang"]).startswith("en")), F.lit(0))["value"]

    def scored(field: str, kind: str) -> Column:
        rate = lambda m: F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"], severity.rating(m["cvssData"]["baseScore"], v2=kind == "CVSS_V2"))
        made = F.transform(F.col(f"metrics.{field}"), lambda m: F.struct(F.lit(kind).alias("type"), m["cvssData"]["baseScore"].alias("score"), m["cvssData"]["vectorString"].alias("vector"), rate(m).alias("rating"), m["source"].alias("provider"), src.alias("source")))
        return F.coalesce(made, F.array().cast(f"array<{SEVERITY}>"))

    # Grouping inside the row: distinct keys, and for each the platforms that carry it.
    flat = F.coalesce(nvd_platforms(F.col("configurations")), F.array().cast("array<struct<vendor:string,product:string,conditional:boolean,criteria:string,window:" + RANGE + ">>"))
    keys = F.array_sort(F.array_distinct(F.transform("flat", lambda p: F.struct(p["vendor"].alias("vendor"), p["product"].alias("product"), p["conditional"].alias("conditional")))))

    def grouped(k: Column) -> Column:
        own = F.filter("flat", lambda p: F.struct(p["vendor"].alias("vendor"), p["product"].alias("product"), p["conditional"].alias("conditional")).eqNullSafe(k))
        windows = F.array_distinct(F.transform(F.filter(own, lambda p: p["window"].isNotNull()), lambda p: p["window"]))
        return F.struct(k["vendor"].alias("vendor"), k["product"].alias("product"), _null("string").alias("ecosystem"), _null("string").alias("purl"), F.array_sort(F.array_distinct(F.transform(own, lambda p: p["criteria"]))).alias("cpes"), _texts().alias("versions"), windows.alias("ranges"), _null("string").alias("default_state"), F.when(k["conditional"], "conditional").alias("status"), src.alias("source"))

    cwes = F.flatten(F.transform(F.coalesce("weaknesses", F.array().cast("array<struct<description:array<struct<lang:string,value:string>>>>")), lambda w: F.transform(w["description"], lambda x: x["value"])))
    tags = F.coalesce(F.from_json("cveTags", "array<string>"), _texts())
    tagged = F.flatten(F.transform(F.coalesce(F.from_json("cveTags", "array<struct<sourceIdentifier:string,tags:array<string>>>"), F.array().cast("array<struct<sourceIdentifier:string,tags:array<string>>>")), lambda t: F.coalesce(t["tags"], _texts())))
    plain = F.filter(tags, lambda t: ~t.startswith("{"))
    return d.withColumn("flat", flat).select(
        ids.normalized_id("id").alias("id"), _null("string").alias("title"), first_en("descriptions").alias("description"), F.when(F.upper("vulnStatus") == "REJECTED", "REJECTED").otherwise("PUBLISHED").alias("state"),
        F.col("published").alias("published_text"), F.col("lastModified").alias("modified_text"), _null("string").alias("withdrawn_text"), F.col("sourceIdentifier").alias("assigner"), _texts().alias("aliases"), _texts().alias("related"),
        ids.distinct_texts(F.filter(cwes, lambda x: x.startswith("CWE-"))).alias("cwes"), F.array_sort(F.array_distinct(F.concat(plain, tagged))).alias("tags"),
        F.concat(scored("cvssMetricV40", "CVSS_V4_0"), scored("cvssMetricV31", "CVSS_V3_1"), scored("cvssMetricV30", "CVSS_V3_0"), scored("cvssMetricV2", "CVSS_V2")).alias("severities"),
        F.transform(F.coalesce("references", F.array().cast("array<struct<url:string,source:string,tags:array<string>>>")), lambda r: F.struct(r["url"].alias("url"), _null("string").alias("name"), _some(r["tags"]).alias("tags"), src.alias("source"))).alias("references"),
        F.concat(F.transform(keys, grouped).cast(f"array<{AFFECTED}>"), assigner_statements(F.col("affected"), src).cast(f"array<{AFFECTED}>")).alias("affected"), _null("struct<exploitation:string,automatable:string,technical_impact:string,source:string>").alias("ssvc"), src.alias("source"), F.col("id").alias("record_id"),
    )


def assigner_statements(affected: Column, source: Column) -> Column:
    """Statements of the assigner that NVD passes on: per vendor and product one that is affected and, where versions
    are listed as unaffected, one that is not. ``n/a`` stands for nothing, and other statuses are no statement."""
    said = F.flatten(F.transform(F.coalesce(affected, F.array().cast(_AFFECTED_DATA)), lambda a: F.coalesce(a["affectedData"], F.array().cast(_DATA))))
    known = lambda c: F.when(F.lower(F.trim(c)).isin("", "n/a") | c.isNull(), "").otherwise(c)
    product = lambda d: known(F.coalesce(F.when(d["product"] != "", d["product"]), d["packageName"]))
    stated = lambda c: F.coalesce(c, F.lit("")) != ""

    def one(d: Column, states: tuple[str, ...], status: Column) -> Column:
        own = F.filter(F.coalesce(d["versions"], F.array().cast(_VERSIONS)), lambda v: F.lower(F.coalesce(v["status"], F.lit(""))).isin(*states))
        bounded = F.filter(own, lambda v: stated(v["lessThan"]) | stated(v["lessThanOrEqual"]))
        last = lambda v: F.when(~stated(v["lessThan"]), v["lessThanOrEqual"])
        ranges = F.transform(bounded, lambda v: F.struct(v["version"].alias("introduced"), F.when(stated(v["lessThan"]), v["lessThan"]).alias("fixed"), last(v).alias("last_affected"), _null("string").alias("type"), _null("string").alias("cpe"), F.lit(False).alias("introduced_exclusive")))
        single = F.filter(own, lambda v: ~stated(v["lessThan"]) & ~stated(v["lessThanOrEqual"]) & (known(v["version"]) != ""))
        return F.struct(
            known(d["vendor"]).alias("vendor"), product(d).alias("product"), _null("string").alias("ecosystem"), _null("string").alias("purl"), _texts().alias("cpes"), F.transform(single, lambda v: v["version"]).alias("versions"),
            ranges.alias("ranges"), _null("string").alias("default_state"), status.alias("status"), source.alias("source"),
        )

    named = F.filter(said, lambda d: (known(d["vendor"]) != "") | (product(d) != ""))
    both = F.flatten(F.transform(named, lambda d: F.array(one(d, ("", "affected"), _null("string")), one(d, ("unaffected",), F.lit("not_affected")))))
    return F.filter(both, lambda a: a["status"].isNull() | (F.size(a["versions"]) + F.size(a["ranges"]) > 0))


def parse_euvd(raw: DataFrame, content: str = "content", source: str = "euvd") -> DataFrame:
    """EUVD items; packed aliases and references are split by line here, and by ``operators.packed`` where delimiters vary."""
    src = F.lit(source)
    d = raw.select(F.from_json(content, EUVD).alias("d")).select("d.*").filter("trim(coalesce(id, '')) != ''")
    lines = lambda c: ids.distinct_texts(F.split(F.coalesce(F.col(c), F.lit("")), r"\R"))
    vendor = F.get(F.col("enisaIdVendor"), F.lit(0))["vendor"]["name"]
    score = F.when(F.col("baseScore") > 0, F.col("baseScore"))
    judged = F.array(F.struct(severity.vector_type("baseScoreVector").alias("type"), score.alias("score"), F.col("baseScoreVector").alias("vector"), severity.rating(score).alias("rating"), _null("string").alias("provider"), src.alias("source")))
    product = lambda p: F.struct(vendor.alias("vendor"), p["product"]["name"].alias("product"), _null("string").alias("ecosystem"), _null("string").alias("purl"), _texts().alias("cpes"), F.when(F.trim(p["product_version"]) != "", F.array(p["product_version"])).otherwise(_texts()).alias("versions"), F.array().cast(f"array<{RANGE}>").alias("ranges"), _null("string").alias("default_state"), _null("string").alias("status"), src.alias("source"))
    return d.select(
        ids.normalized_id("id").alias("id"), _null("string").alias("title"), "description", F.lit("PUBLISHED").alias("state"), F.col("datePublished").alias("published_text"), F.col("dateUpdated").alias("modified_text"), _null("string").alias("withdrawn_text"), "assigner",
        F.transform(lines("aliases"), lambda x: ids.normalized_id(x)).alias("aliases"), _texts().alias("related"), _texts().alias("cwes"), _texts().alias("tags"), F.when(score.isNotNull() | (F.trim("baseScoreVector") != ""), judged).otherwise(F.array().cast(f"array<{SEVERITY}>")).alias("severities"),
        F.transform(lines("references"), lambda u: F.struct(u.alias("url"), _null("string").alias("name"), _texts().alias("tags"), src.alias("source"))).alias("references"),
        F.transform(F.coalesce("enisaIdProduct", F.array().cast("array<struct<product:struct<name:string>,product_version:string>>")), product).cast(f"array<{AFFECTED}>").alias("affected"),
        _null("struct<exploitation:string,automatable:string,technical_impact:string,source:string>").alias("ssvc"), src.alias("source"), F.col("id").alias("record_id"),
    )


def euvd_exploited(raw: DataFrame, content: str = "content") -> DataFrame:
    """Catalogue entries that EUVD items imply by exploitedSince, under their first CVE alias, else their own name."""
    d = raw.select(F.from_json(content, EUVD).alias("d")).select("d.*").filter("trim(coalesce(exploitedSince, '')) != ''")
    names = F.transform(F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\R"), lambda x: x.rlike(ids.CVE_SHAPE)), lambda x: ids.normalized_id(x))
    at = add_instant(read_times(d, "exploitedSince", zone_names(raw.sparkSession), "rt_"), "us", "UTC", "rt_")
    return at.select(F.coalesce(F.get(names, F.lit(0)), ids.normalized_id("id")).alias("cve_id"), F.timestamp_micros("us").cast("date").alias("date_added"), F.array(F.lit("eu_exploited")).alias("kev_sources"))


def parse_kev(raw: DataFrame, content: str = "content", label: str = "cisa") -> DataFrame:
    """Entries of exploited-vulnerability catalogues, one row each, with the version of their catalogue."""
    d = raw.select(F.from_json(content, KEV).alias("d")).select("d.catalogVersion", "d.dateReleased", F.inline("d.vulnerabilities"))
    zones = zone_names(raw.sparkSession)
    for c, name in (("dateAdded", "date_added"), ("dueDate", "due_date")):
        d = add_instant(read_times(d, c, zones, "rt_"), name, "UTC", "rt_").withColumn(name, F.timestamp_micros(name).cast("date"))
    return d.select(
        F.col("catalogVersion").alias("catalog_version"), ids.identifier("cveID").alias("cve_id"), F.col("vendorProject").alias("vendor_project"), "product", F.col("vulnerabilityName").alias("name"), "date_added", "due_date",
        F.col("shortDescription").alias("description"), F.col("requiredAction").alias("required_action"), (F.lower(F.trim("knownRansomwareCampaignUse")) == "known").alias("known_ransomware"), "notes", _some("cwes").alias("cwes"), F.array(F.lit(label)).alias("kev_sources"),
    ).filter("cve_id is not null")


def batch_parsed(raw: DataFrame, parse: Callable[[str], list[dict]], content: str, schema: str = PARSED) -> DataFrame:
    """Records that a Python parser makes of each document; a document it cannot read gives none."""
    ship_package(raw.sparkSession)
    target = to_arrow_schema(StructType.fromJson(json.loads(_parse_datatype_string(schema).json())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                try:
                    out += parse(text) if text else []
                except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
                    continue
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return raw.select(content).mapInArrow(run, schema)


def parse_cve5(raw: DataFrame, content: str = "content", source: str = "cvelist") -> DataFrame:
    """CVE JSON 5 records."""
    from advisorium.sources.trees import cve5_records

    return batch_parsed(raw, lambda t: cve5_records(t, source), content)


def parse_csaf(raw: DataFrame, content: str = "content", source: str = "csaf") -> DataFrame:
    """CSAF 2.0 documents, one record per vulnerability."""
    from advisorium.sources.trees import csaf_records

    return batch_parsed(raw, lambda t: csaf_records(t, source), content)


def shape(content: Column | str) -> Column:
    """Format of a document by what it holds: cve5, csaf, osv, nvd or generic; null for no JSON object."""
    c = F.col(content) if isinstance(content, str) else content
    has = lambda path: F.get_json_object(c, path).isNotNull()
    return (
        F.when(has("$.cveMetadata"), "cve5").when(has("$.document"), "csaf").when(has("$.id") & has("$.affected"), "osv").when(has("$.id") & has("$.vulnStatus"), "nvd")
        .when(has("$.id") | has("$.cve"), "generic")
    )


def parse_any(raw: DataFrame, content: str = "content", source: str = "gcve") -> DataFrame:
    """Documents of mixed formats, each by its own parser; what only has an identifier gives a bare record.

    An identifier GCVE-0-X also names CVE-X.
    """
    marked = raw.select(content, shape(content).alias("__shape"))
    of = lambda s: marked.filter(F.col("__shape") == s)
    parsers = {"cve5": parse_cve5, "csaf": parse_csaf, "osv": parse_osv, "nvd": parse_nvd}
    parts = [p(of(s), content, source) for s, p in parsers.items()]
    got = lambda *paths: F.coalesce(*[F.get_json_object(content, f"$.{p}") for p in paths])
    known = {"id": ids.normalized_id(got("id", "cve")), "title": got("title", "summary"), "description": got("description", "details", "summary"), "published_text": got("published", "datePublished"), "modified_text": got("modified", "last-modified", "dateUpdated"), "record_id": got("id", "cve"), "source": F.lit(source), "state": F.lit("PUBLISHED")}
    fields = _parse_datatype_string(PARSED).fields
    empty = lambda f: F.array().cast(f.dataType) if f.dataType.typeName() == "array" else _null(f.dataType)
    parts.append(of("generic").select(*[known[f.name].alias(f.name) if f.name in known else empty(f).alias(f.name) for f in fields]))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    twin = F.regexp_extract("id", r"^GCVE-0-(\d{4}-\d{4,})$", 1)
    return both.withColumn("aliases", F.when(twin != "", F.array_sort(F.array_union("aliases", F.array(F.concat(F.lit("CVE-"), twin))))).otherwise(F.col("aliases")))


def unreadable(raw: DataFrame, content: str = "content") -> DataFrame:
    """How many documents no parser can tell the format of: n_documents, n_unreadable."""
    return raw.agg(F.count("*").alias("n_documents"), F.count(F.when(shape(content).isNull(), 1)).alias("n_unreadable"))
