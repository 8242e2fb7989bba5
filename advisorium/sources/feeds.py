"""Feeds as they land in files: archives, tables with a header line, catalogues of links, and the cursor between runs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions.times import add_instant, read_times, zone_names
from advisorium.session import ship_package

MAX_LEVELS = 3
MEMBER_BYTES, NESTED_BYTES = 64 * 1024 * 1024, 2 * 1024 * 1024 * 1024
# How far each source's window reaches back before its cursor, in hours.
OVERLAP_HOURS = {"osv": 6.0, "nvd": 1.0, "euvd": 48.0}


def zip_members(raw: bytes, accept: str, label: str = "", level: int = 0) -> Iterator[tuple[str, str | None, str | None]]:
    """(name, text, error) of the members whose name matches, archives inside archives included."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        yield label, None, str(e)
        return
    for m in archive.infolist():
        name, nested = f"{label}{m.filename}", m.filename.lower().endswith(".zip")
        if m.is_dir() or not (nested or re.search(accept, m.filename)):
            continue
        if m.file_size > (NESTED_BYTES if nested else MEMBER_BYTES) or (nested and level + 1 >= MAX_LEVELS):
            yield name, None, "too large" if not nested or level + 1 < MAX_LEVELS else "nested too deeply"
            continue
        try:
            data = archive.read(m)
        except (zipfile.BadZipFile, OSError, RuntimeError) as e:
            yield name, None, str(e)
            continue
        if nested:
            yield from zip_members(data, accept, f"{name}!", level + 1)
        else:
            yield name, data.decode("utf-8", errors="replace"), None


def read_archives(files: DataFrame, accept: str = r"\.json$") -> DataFrame:
    """Members of many archives: path, member, content, error. Members are streamed, a task holds one archive at a time."""
    ship_package(files.sparkSession)
    schema = pa.schema([(n, pa.string()) for n in ("path", "member", "content", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size = [], 0
                for member, text, error in zip_members(raw or b"", accept):
                    rows.append({"path": path, "member": member, "content": text, "error": error})
                    size += len(text or "")
                    if size > 16 * 1024 * 1024:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, member string, content string, error string")


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file (CSV, also gzip): cve_id, score, percentile, model_version, score_date from its first line."""
    head = spark.read.text(path).filter(F.col("value").startswith("#")).select(
        F.regexp_extract("value", r"model_version:([^,]+)", 1).alias("model_version"), F.regexp_extract("value", r"score_date:([^,]+)", 1).alias("stamp"), F.input_file_name().alias("file")
    )
    dated = add_instant(read_times(head, "stamp", zone_names(spark), "rt_"), "us", "UTC", "rt_").select("file", "model_version", F.timestamp_micros("us").cast("date").alias("score_date"))
    rows = spark.read.schema("cve string, epss double, percentile double").option("header", True).option("comment", "#").csv(path).withColumn("file", F.input_file_name())
    return rows.join(dated, "file", "left").select(F.upper(F.trim("cve")).alias("cve_id"), F.col("epss").alias("score"), "percentile", "model_version", "score_date").filter("cve_id is not null")


def enough_rows(rows: DataFrame, last: int) -> DataFrame:
    """Refuse a file with fewer than half the rows of the last one."""
    n = rows.count()
    if n * 2 < last:
        raise ValueError(f"{n} rows, after {last} in the last run")
    return rows


def changed_ids(spark: SparkSession, path: str, since: Column, limit: int = 20_000) -> tuple[DataFrame, bool]:
    """(identifiers changed after ``since`` in a list of time and identifier, whether they are so many that the full
    export is the better way)."""
    rows = spark.read.schema("stamp string, name string").csv(path)
    at = add_instant(read_times(rows, "stamp", zone_names(spark), "rt_"), "us", "UTC", "rt_").withColumn("at", F.timestamp_micros("us"))
    fresh = at.filter((F.col("at") > since) & (F.col("at") <= F.current_timestamp())).select("at", F.element_at(F.split("name", "/"), -1).alias("id"))
    return fresh, fresh.limit(limit).count() >= limit


def rolie_entries(raw: DataFrame, content: str = "content") -> DataFrame:
    """Links of ROLIE feeds: base, href, updated; links to signatures and hashes are left out."""
    feed = F.from_json(content, "feed struct<entry:array<struct<updated:string,link:array<struct<rel:string,href:string>>,content:struct<src:string>>>>")
    entries = raw.select(feed.alias("d")).select(F.explode("d.feed.entry").alias("e"))
    links = entries.select(F.col("e.updated").alias("updated"), F.explode(F.filter(F.concat(F.coalesce("e.link.href", F.array().cast("array<string>")), F.array("e.content.src")), lambda h: h.isNotNull())).alias("href"))
    return links.filter(F.col("href").rlike(r"\.json$")).groupBy("href").agg(F.max("updated").alias("updated"))


def verified(files: DataFrame) -> DataFrame:
    """Files (content, sidecar) whose SHA-256 is what the sidecar says; an absent or short sidecar lets a file pass."""
    stated = F.lower(F.regexp_extract(F.coalesce("sidecar", F.lit("")), r"^\s*([0-9a-fA-F]{64})\b", 1))
    return files.filter((stated == "") | (stated == F.sha2(F.col("content").cast("binary"), 256)))


def replayed_cursor(cursor: dict[str, str], at: str) -> dict[str, str]:
    """A cursor set back to an instant: times become ``at``, marks that would skip unchanged or resume go."""
    gone = ("etag", "catalog_version", "resume", "page", "started")
    return {k: at if re.match(r"\d{4}-\d\d-\d\d", v) else v for k, v in cursor.items() if not any(g in k for g in gone)}
