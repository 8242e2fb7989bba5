"""Exports of the corpus: lines of JSON, CSV, an Atom feed, and the text of a scan report."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.operators.listing import order_columns

CSV_COLUMNS = ("id", "title", "state", "published", "modified", "rating", "score", "epss", "in_kev", "sources", "cwes")


def csv_safe(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def truncated(text: str | None, most: int) -> str:
    """At most ``most`` bytes of UTF-8, cut between characters, with an ellipsis where something is missing."""
    raw = (text or "").encode()
    if len(raw) <= most:
        return text or ""
    return raw[:most].decode(errors="ignore") + "…"


def csv_rows(corpus: DataFrame) -> DataFrame:
    """The eleven columns of the CSV export; scores with one decimal, predictions with five, null as empty text."""
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    joined = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    text = lambda c: csv_safe(F.coalesce(c, F.lit("")))
    shown = {
        "id": text(F.col("id")), "title": text(F.col("title")), "state": text(F.col("state")), "published": stamp("published"), "modified": stamp("modified"), "rating": text(F.col("primary_rating")),
        "score": F.coalesce(F.format_string("%.1f", "primary_score"), F.lit("")), "epss": F.coalesce(F.format_string("%.5f", "epss_score"), F.lit("")),
        "in_kev": F.coalesce(F.col("in_kev"), F.lit(False)).cast("string"), "sources": csv_safe(joined("sources")), "cwes": csv_safe(joined("cwes")),
    }
    nulls = {"score": "primary_score", "epss": "epss_score"}
    return corpus.select(*[F.when(F.col(nulls[c]).isNull(), "").otherwise(e).alias(c) if c in nulls else e.alias(c) for c, e in shown.items()])


def write_csv(corpus: DataFrame, path: str, order_by: str = "modified") -> None:
    """The CSV export, ordered over its files."""
    csv_rows(corpus.orderBy(*order_columns(order_by))).write.mode("overwrite").option("header", True).csv(path)


def write_ndjson(corpus: DataFrame, path: str, order_by: str = "modified") -> None:
    """One JSON object a line, ordered over its files."""
    corpus.orderBy(*order_columns(order_by)).write.mode("overwrite").json(path)


def stream_ndjson(corpus: DataFrame, order_by: str = "modified") -> Iterator[str]:
    """Lines of JSON in order, partition by partition; a failure on the way ends with a line that names it."""
    try:
        for r in corpus.orderBy(*order_columns(order_by)).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator(prefetchPartitions=True):
            yield r.j
    except Exception as e:  # the reader must not take a cut export for a whole one
        yield '{"error":' + _quoted(str(e).splitlines()[0][:200]) + "}"


def _quoted(text: str) -> str:
    return json.dumps(text)


def stream_csv(corpus: DataFrame, order_by: str = "modified") -> Iterator[str]:
    """The CSV export in order, line by line with its header."""
    yield ",".join(CSV_COLUMNS) + "\n"
    quoted = F.concat(F.lit('"'), F.array_join(F.array(*[F.replace(c, F.lit('"'), F.lit('""')) for c in CSV_COLUMNS]), '","'), F.lit('"'))
    for r in csv_rows(corpus.orderBy(*order_columns(order_by))).select(quoted.alias("line")).toLocalIterator(prefetchPartitions=True):
        yield r.line + "\n"


def canonical_url(identifier: str) -> str:
    """Where an identifier is described."""
    i = identifier.upper()
    if i.startswith("CVE-"):
        return f"https://www.cve.org/CVERecord?id={i}"
    if i.startswith("GHSA-"):
        return f"https://github.com/advisories/{identifier}"
    if i.startswith("EUVD-"):
        return f"https://euvd.enisa.europa.eu/vulnerability/{i}"
    return f"https://osv.dev/vulnerability/{identifier}"


def atom_feed(corpus: DataFrame, title: str, limit: int = 50) -> str:
    """The newest records as an Atom feed; at most 200, summaries of at most 800 bytes."""
    newest = corpus.filter("modified is not null").orderBy(*order_columns("modified")).limit(min(max(limit, 1), 200))
    rows = newest.select("id", "title", "description", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")).collect()
    entries = [
        f"<entry><id>{escape(canonical_url(r.id))}</id><title>{escape(r.id + (f': {r.title}' if r.title else ''))}</title><updated>{r['at']}</updated>"
        f'<link href="{escape(canonical_url(r.id), {chr(34): "&quot;"})}"/><summary>{escape(truncated(r.description, 800))}</summary></entry>'
        for r in rows
    ]
    updated = rows[0]["at"] if rows else "1970-01-01T00:00:00Z"
    return f'<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{escape(title)}</title><id>urn:advisorium</id><updated>{updated}</updated>{"".join(entries)}</feed>'


def scan_status(findings: DataFrame) -> int:
    """Exit status of a scan: 2 with findings, else 0."""
    return 0 if findings.filter("outcome = 'finding'").isEmpty() else 2


def report_lines(ordered: DataFrame) -> Iterator[str]:
    """The report as text: one line per finding in order, and how many there are. Rows come one partition at a time."""
    n = 0
    for r in ordered.select("vuln_id", "name", "confidence", "matched_on").toLocalIterator():
        n += 1
        yield f"{r.vuln_id}\t{r.name}\t{r.confidence}\t{r.matched_on}"
    yield f"{n} findings"


def report_json(ordered: DataFrame) -> Iterator[str]:
    """The report as a JSON document in pieces: the findings in order, how many there are, and how many of each confidence."""
    counts: dict[str, int] = {}
    yield '{"findings": ['
    for i, r in enumerate(ordered.toLocalIterator()):
        counts[r.confidence] = counts.get(r.confidence, 0) + 1
        yield ("," if i else "") + json.dumps(r.asDict(recursive=True), default=str, sort_keys=True)
    yield f'], "total": {sum(counts.values())}, "by_confidence": {json.dumps(counts, sort_keys=True)}}}'
