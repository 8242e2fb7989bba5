"""Recorded downloads for use without a network: a manifest of addresses and content-addressed files beside it.

A lookup takes the exact address, else the recorded window of the same shape that lies nearest.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tarfile
import time
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?"
#: The same inside an address, where colons and blanks may be escaped.
WRITTEN = r"\d{4}-\d{2}-\d{2}(?:(?:T|%20)\d{2}(?::|%3A)\d{2}(?::|%3A)\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}(?::|%3A)?\d{2})?)?"
MAX_MEMBER, MAX_TOTAL, MAX_ENTRIES = 8 << 30, 64 << 30, 5_000_000


class Recorder:
    """Writes downloads into a bundle; the manifest is complete after every record."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)
        (self.folder / "blobs").mkdir(parents=True, exist_ok=True)
        self.manifest = self.folder / "manifest.jsonl"

    def record(self, url: str, body: bytes, status: int = 200, etag: str = "", captured_at: float | None = None) -> str:
        digest = hashlib.sha256(body).hexdigest()
        blob = self.folder / "blobs" / digest
        if not blob.exists():
            beside = blob.with_suffix(f".{os.getpid()}.partial")
            beside.write_bytes(body)
            beside.replace(blob)
        entry = {"url": url, "sha256": digest, "size": len(body), "status": status, "etag": etag, "captured_at": captured_at if captured_at is not None else time.time()}
        with self.manifest.open("a") as f:
            f.write(json.dumps(entry) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return digest


def pack(folder: str, archive: str) -> int:
    """Pack a bundle; partial files, links and the archive itself stay out. Number of files."""
    root, target, n = Path(folder), Path(archive).resolve(), 0
    with tarfile.open(archive, "w:gz") as t:
        for p in sorted(root.rglob("*")):
            if p.is_file() and not p.is_symlink() and not p.name.endswith(".partial") and p.resolve() != target:
                t.add(p, p.relative_to(root).as_posix(), recursive=False)
                n += 1
    return n


def unpack(archive: str, folder: str) -> int:
    """Unpack a bundle; a member that leaves the folder, is no plain file or is too large ends it."""
    root, total, n = Path(folder).resolve(), 0, 0
    with tarfile.open(archive, "r:gz") as t:
        for m in t:
            if m.isdir():
                continue
            out = (root / m.name).resolve()
            total, n = total + m.size, n + 1
            if not m.isfile() or root not in out.parents or m.size > MAX_MEMBER or total > MAX_TOTAL or n > MAX_ENTRIES:
                raise ValueError(f"refused: {m.name}")
            out.parent.mkdir(parents=True, exist_ok=True)
            out.write_bytes(t.extractfile(m).read())
    return n


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest as a table, with shape and window of every address."""
    rows = spark.read.schema("url string, sha256 string, size bigint, status int, etag string, captured_at double").json(f"{folder}/manifest.jsonl")
    return rows.withColumn("shape", shape(F.col("url"))).withColumn("dates", dates(F.col("url")))


def shape(url: Column) -> Column:
    """An address with its times blanked; addresses of one shape differ in their window only."""
    return F.regexp_replace(url, WRITTEN, "*")


def dates(url: Column) -> Column:
    """Days of an address's window, in order."""
    return F.transform(F.regexp_extract_all(url, F.lit(r"\d{4}-\d{2}-\d{2}"), 0), lambda d: F.unix_date(d.try_cast("date")))


def lookup(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (url) with what serves them: recorded_url, sha256, exact.

    The exact address first; else of the same shape the one with the least sum of day distances, ties by the newest
    capture, then the smallest address. Requests that nothing serves give null.
    """
    asked = requests.select("url").distinct().withColumns({"shape": shape(F.col("url")), "want": dates(F.col("url"))})
    have = recorded.filter("status = 200").select(F.col("url").alias("recorded_url"), "sha256", "captured_at", "shape", F.col("dates").alias("has"))
    far = F.aggregate(F.zip_with("want", "has", lambda a, b: F.abs(a - b)), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(1_000_000)))
    pairs = asked.join(have, "shape")
    best = F.min(F.struct((F.col("url") != F.col("recorded_url")).alias("other"), far.alias("far"), (-F.col("captured_at")).alias("age"), "recorded_url", "sha256")).alias("b")
    found = pairs.groupBy("url").agg(best).select("url", "b.recorded_url", "b.sha256", (~F.col("b.other")).alias("exact"))
    return requests.join(found, "url", "left")


def read_blob(folder: str, digest: str) -> bytes:
    """A recorded body, refused if it is not what its name says."""
    if not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("no digest")
    body = (Path(folder) / "blobs" / digest).read_bytes()
    if hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"{digest} was changed")
    return body


def query_window(url: str) -> dict[str, str]:
    """Parameters of an address that hold times."""
    return {k: v for k, v in parse_qsl(urlsplit(url).query) if re.match(DATE, v)}


def fetcher(folder: str):
    """A function from an address to what was recorded for it: the newest download of the address itself, else of the
    address of the same shape whose first date lies nearest. What was not recorded raises KeyError."""
    newest: dict[str, dict] = {}
    for line in (Path(folder) / "manifest.jsonl").read_text().splitlines():
        e = json.loads(line)
        if e["status"] == 200 and e["captured_at"] >= newest.get(e["url"], e)["captured_at"]:
            newest[e["url"]] = e
    alike: dict[str, list[str]] = {}
    for url in sorted(newest):
        alike.setdefault(re.sub(WRITTEN, "*", url), []).append(url)

    def first_day(url: str) -> int:
        m = re.search(r"(\d{4})-(\d{2})-(\d{2})", url)
        return int(m[1]) * 372 + int(m[2]) * 31 + int(m[3]) if m else 0

    def fetch(url: str) -> bytes:
        if url not in newest:
            near = alike.get(re.sub(WRITTEN, "*", url), [])
            if not near or not re.search(WRITTEN, url):
                raise KeyError(url)
            url = min(near, key=lambda u: abs(first_day(u) - first_day(url)))
        return read_blob(folder, newest[url]["sha256"])

    return fetch
