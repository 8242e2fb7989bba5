"""A thin HTTP reader over the tables: requests become DataFrame queries, answers are streamed.

``respond`` maps a request to an answer without any network; ``serve`` puts it behind Python's own server. Routes:
``/healthz``, ``/readyz``, ``/v1/vulns`` and below it one flaw and its history, ``/v1/export``, ``/v1/stats``,
``/v1/sources``, ``/v1/attribution``, ``/v1/feed.atom``, and ``POST /v1/scan``. Scanning of live targets is not offered.
"""

from __future__ import annotations

import hmac
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import NamedTuple
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.config import Settings
from advisorium.operators import detail, enrich, listing, scan
from advisorium.sinks import exports
from advisorium.sources import inventory
from advisorium.sources.collectors import ATTRIBUTIONS
from advisorium.streaming.ingest import CADENCE
from advisorium.streaming.runs import SourceBook

JSON, LINES, CSV, ATOM = "application/json", "application/x-ndjson", "text/csv", "application/atom+xml"
LARGEST_BODY = 64 * 1024 * 1024
TIMES, NUMBERS, LISTS = ("modified_since", "published_since"), ("min_score", "max_score", "min_epss"), ("ratings", "states", "sources", "cwes")


class Answer(NamedTuple):
    status: int
    kind: str
    pieces: Iterator[str]


@dataclass
class Tables:
    """The tables of a folder: ``vulnerabilities`` and, where present, aliases, kev, epss, changes and statements."""

    spark: SparkSession
    folder: str

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        from advisorium.sources.shared import SharedFolder

        if schema is not None and f"{name}.parquet" not in SharedFolder(self.spark, self.folder).names(""):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def corpus(self) -> DataFrame:
        return self.read("vulnerabilities")

    @property
    def aliases(self) -> DataFrame:
        return self.read("aliases", "alias string, vuln_id string")

    @property
    def statements(self) -> DataFrame:
        from advisorium.schemas import AFFECTED

        held = self.spark.createDataFrame([], f"a {AFFECTED}").select("a.*").schema
        return self.read("statements", "vuln_id string, fingerprint string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held))


def asked_filter(query: dict[str, list[str]], most: int) -> listing.ListFilter:
    """The filter of a query string; unknown parameters and unreadable values are errors."""
    known = {f for f in listing.ListFilter.__dataclass_fields__ if f != "extra"}
    given: dict = {"extra": {k: v for k, v in query.items() if k not in known}}
    for k, v in query.items():
        if k in TIMES:
            given[k] = datetime.fromisoformat(v[-1].replace("Z", "+00:00")).replace(tzinfo=None)
        elif k in NUMBERS:
            given[k] = float(v[-1])
        elif k in LISTS:
            given[k] = tuple(x for text in v for x in text.split(",") if x)
        elif k in ("limit", "offset"):
            given[k] = int(v[-1])
        elif k in known:
            given[k] = v[-1].lower() in ("1", "true", "yes") if k == "kev" else v[-1]
    return listing.ListFilter(**({"limit": most} | given))


def _whole(kind: str, value) -> Answer:
    return Answer(200, kind, iter([value if isinstance(value, str) else json.dumps(value, default=str)]))


def _error(status: int, text: str) -> Answer:
    return Answer(status, JSON, iter([json.dumps({"error": text})]))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def respond(tables: Tables, settings: Settings, method: str, target: str, headers: dict[str, str], body: bytes = b"") -> Answer:
    """The answer to one request; a token that is set is asked of every path below ``/v1/``, also of those that are none."""
    parts = urlsplit(target)
    path, query = parts.path, parse_qs(parts.query, keep_blank_values=True)
    if path.startswith("/v1/") and settings.token:
        said = {k.lower(): v for k, v in headers.items()}.get("authorization", "")
        if not hmac.compare_digest(said.encode(), f"Bearer {settings.token}".encode()):
            return _error(401, "a token is needed")
    try:
        route = _POSTS.get(path) if method == "POST" else _GETS.get(path) if method == "GET" else None
        if route:
            return route(tables, settings, query, body)
        if method == "GET" and path.startswith("/v1/vulns/"):
            name, _, rest = path.removeprefix("/v1/vulns/").partition("/")
            if rest in ("", "history"):
                return (_history if rest else _one)(tables, unquote(name), query)
        if path in {*_GETS, *_POSTS}:
            return _error(405, "another method is needed")
        return _error(403, "scanning of targets is not offered") if path == "/v1/scan/target" else _error(404, "no such path")
    except (ValueError, TypeError) as e:
        return _error(400, str(e))


def _list(t: Tables, s: Settings, query, body) -> Answer:
    f = asked_filter(query, s.page_limit)
    rows = _rows(listing.page(t.corpus, f, t.statements))
    return _whole(JSON, {"total": listing.total(t.corpus, f, t.statements).first().total, "items": rows})


def _one(t: Tables, name: str, query) -> Answer:
    asked = t.spark.createDataFrame([(name,)], "name string")
    found = detail.by_name(asked, t.aliases, t.corpus)
    side = detail.with_side_tables(found, t.aliases, t.read("kev", "cve_id string, date_added date"), t.read("epss", "cve_id string, score double"))
    rows = _rows(side)
    return _whole(JSON, rows[0]) if rows else _error(404, f"{name} is not known")


def _history(t: Tables, name: str, query) -> Answer:
    asked = t.spark.createDataFrame([(name,)], "name string")
    own = t.corpus.select(F.col("id").alias("alias"), F.col("id").alias("vuln_id"))
    changes = t.read("changes", "vuln_id string, change_kind string, changed_at timestamp, batch long, seq long")
    limit = int(query["limit"][-1]) if "limit" in query else None
    return _whole(JSON, {"items": _rows(detail.history_of(asked, t.aliases.select("alias", "vuln_id").unionByName(own).distinct(), changes, limit))})


def _export(t: Tables, s: Settings, query, body) -> Answer:
    kind = query.pop("format", ["ndjson"])[-1]
    f = asked_filter(query, s.page_limit)
    rows = listing.filtered(t.corpus, f, t.statements)
    if kind == "csv":
        return Answer(200, CSV, exports.stream_csv(rows, f.order_by))
    if kind != "ndjson":
        raise ValueError("format is ndjson or csv")
    return Answer(200, LINES, (line + "\n" for line in exports.stream_ndjson(rows, f.order_by)))


def _stats(t: Tables, s: Settings, query, body) -> Answer:
    totals = _rows(enrich.statistics(t.corpus, t.aliases, t.read("kev", "cve_id string, date_added date")))[0]
    return _whole(JSON, totals | {"by_rating": _rows(enrich.counts_by_rating(t.corpus)), "by_source": _rows(enrich.counts_by_source(t.corpus))})


def _sources(t: Tables, s: Settings, query, body) -> Answer:
    return _whole(JSON, {"items": _rows(SourceBook(t.spark, f"{t.folder}/runs").sources(sorted(CADENCE)))})


def attributions(spark: SparkSession) -> DataFrame:
    """Whom each source's data is owed to: source, owner, terms."""
    return spark.createDataFrame(ATTRIBUTIONS, "source string, owner string, terms string")


def _scan(t: Tables, s: Settings, query, body) -> Answer:
    if len(body) > LARGEST_BODY:
        return _error(413, "the inventory is too large")
    found = inventory.parse_document(body)
    schema = "comp_id long, " + ", ".join(f"{f} string" for f in inventory.FIELDS)
    comps = scan.dedupe_components(t.spark.createDataFrame([(i, *(c[f] for f in inventory.FIELDS)) for i, c in enumerate(found)], schema))
    verdicts = scan.judge(scan.all_candidates(comps, t.statements), comps, t.statements)
    named = scan.reduce_verdicts(verdicts, s.scan_minimum).filter("outcome = 'finding'").join(comps.select("comp_id", "name"), "comp_id").orderBy("vuln_id", "name")
    return Answer(200, JSON, exports.report_json(named))


_GETS = {
    "/": lambda t, s, q, b: _whole(JSON, {"routes": sorted([*_GETS, *_POSTS])}),
    "/healthz": lambda t, s, q, b: _whole(JSON, {"status": "ok"}),
    "/readyz": lambda t, s, q, b: _whole(JSON, {"status": "ready", "columns": t.corpus.columns}),
    "/v1/vulns": _list, "/v1/export": _export, "/v1/stats": _stats, "/v1/sources": _sources,
    "/v1/attribution": lambda t, s, q, b: _whole(JSON, {"items": _rows(attributions(t.spark))}),
    "/v1/feed.atom": lambda t, s, q, b: _whole(ATOM, exports.atom_feed(t.corpus, "advisories", listing.effective_limit(int(q["limit"][-1]) if "limit" in q else None))),
}
_POSTS = {"/v1/scan": _scan}


def serve(tables: Tables, settings: Settings) -> None:
    """Answer requests until interrupted; those under way are finished first."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            body = self.rfile.read(min(int(self.headers.get("Content-Length") or 0), LARGEST_BODY + 1))
            answer = respond(tables, settings, self.command, self.path, dict(self.headers), body)
            self.send_response(answer.status)
            self.send_header("Content-Type", answer.kind)
            self.end_headers()
            for piece in answer.pieces:
                self.wfile.write(piece.encode())

        do_GET = do_POST = do_PUT = do_DELETE = _run

    host, _, port = settings.address.rpartition(":")
    server = ThreadingHTTPServer((host or "127.0.0.1", int(port)), Handler)
    server.daemon_threads = False
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()


def bootstrap(spark: SparkSession, folder: str) -> list[str]:
    """Create the tables that a folder lacks, empty; returns their names. Tables that exist are left as they are."""
    from advisorium.plans.reference import LIST_COLUMNS
    from advisorium.sources.shared import SharedFolder

    kinds = {"record_no": "bigint", "published": "timestamp_ntz", "modified": "timestamp_ntz", "cwes": "array<string>", "aliases": "array<string>", "sources": "array<string>", "primary_score": "double", "epss_score": "double", "in_kev": "boolean"}
    wanted = {
        "vulnerabilities": ", ".join(f"{c} {kinds.get(c, 'string')}" for c in LIST_COLUMNS), "aliases": "alias string, vuln_id string", "kev": "cve_id string, date_added date",
        "epss": "cve_id string, score double", "changes": "vuln_id string, change_kind string, changed_at timestamp, batch long, seq long",
    }
    there = SharedFolder(spark, folder).names("")
    made = [n for n in wanted if f"{n}.parquet" not in there]
    for n in made:
        spark.createDataFrame([], wanted[n]).write.parquet(f"{folder}/{n}.parquet")
    return made


def local_inventory(spark: SparkSession, root: str = "/") -> DataFrame:
    """Components of the machine that runs this, by the package databases below ``root``: dpkg's status file, apk's
    database, and a list of installed rpm packages where one was written to ``var/lib/rpm/packages.tsv``."""
    read = lambda name: Path(root, name).read_text(encoding="utf-8", errors="replace") if Path(root, name).is_file() else None
    release = inventory.os_release(read("etc/os-release") or "")
    named = {"debian": "Debian", "ubuntu": "Ubuntu", "alpine": "Alpine"}.get(release.get("ID", ""), release.get("NAME") or "Linux")
    version = release.get("VERSION_ID", "")
    ecosystem = f"{named}:{version}" if version else named
    one = lambda text: spark.createDataFrame([(root, text)], "path string, content string")
    readers = {"var/lib/dpkg/status": inventory.read_dpkg_status, "lib/apk/db/installed": inventory.read_apk_installed, "var/lib/rpm/packages.tsv": inventory.read_rpm_query}
    out = spark.createDataFrame([], "path string, " + ", ".join(f"{f} string" for f in inventory.FIELDS))
    for name, reader in readers.items():
        if (text := read(name)) is not None:
            out = out.unionByName(reader(one(text), ecosystem))
    return out.distinct()
