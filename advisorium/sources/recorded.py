"""A Spark data source over recorded downloads: ``spark.read.format("recorded").option("folder", bundle)``.

Every address of the bundle that the ``pattern`` option matches is one partition, so downloads are read and verified
in parallel; the folder lies where all executors see it. Also the windows and cursors of paged feeds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Longest span that a paged feed answers at once, and how many addresses one partition reads.
WINDOW_DAYS = 110
PER_PARTITION = 64


class RecordedSource(DataSource):
    """Rows of recorded downloads: url, status, captured_at, content."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "url string, status int, captured_at double, content string"

    def reader(self, schema) -> DataSourceReader:
        return RecordedReader(self.options["folder"], self.options.get("pattern", ""))


class _Part(InputPartition):
    def __init__(self, entries: list[dict]) -> None:
        self.entries = entries


class RecordedReader(DataSourceReader):
    def __init__(self, folder: str, pattern: str) -> None:
        self.folder, self.pattern = folder, pattern

    def partitions(self) -> list[InputPartition]:
        newest: dict[str, dict] = {}
        for line in (Path(self.folder) / "manifest.jsonl").read_text().splitlines():
            e = json.loads(line)
            if re.search(self.pattern, e["url"]) and e["status"] == 200 and e["captured_at"] >= newest.get(e["url"], e)["captured_at"]:
                newest[e["url"]] = e
        entries = [newest[u] for u in sorted(newest)]
        return [_Part(entries[i : i + PER_PARTITION]) for i in range(0, len(entries), PER_PARTITION)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        from advisorium.sources.bundle import read_blob
        from advisorium.sources.inventory import opened

        for e in partition.entries:
            yield e["url"], e["status"], e["captured_at"], opened(read_blob(self.folder, e["sha256"])).decode("utf-8", errors="replace")


def page_windows(since: datetime, until: datetime, days: int = WINDOW_DAYS) -> list[tuple[datetime, datetime]]:
    """Consecutive windows from ``since`` to ``until``, none longer than ``days``."""
    out = []
    while since < until:
        end = min(since + timedelta(days=days), until)
        out.append((since, end))
        since = end
    return out


def page_watermark(window_end: datetime, newest_seen: datetime | None) -> datetime:
    """How far a cursor may move after a window: its end, or less if nothing as new was seen."""
    return min(window_end, newest_seen) if newest_seen else window_end


def baseline_cut(tag: datetime | None, midnight: datetime | None) -> datetime | None:
    """Instant a baseline stands for: the earlier of its release tag and its day."""
    return min((t for t in (tag, midnight) if t), default=None)


def resumed_walk(cursor: dict[str, str]) -> tuple[str, int, str] | None:
    """(since, page, started) of a page walk that was cut off, or None to begin anew."""
    try:
        since, page, started = cursor["vl_since"], int(cursor["vl_page"]), cursor["vl_started"]
    except (KeyError, ValueError):
        return None
    return (since, page, started) if page > 0 and started else None


def delta_runs(log: list[dict], since: str) -> tuple[list[list[str]], str]:
    """(identifiers to fetch per run, oldest first; cursor after them) of a delta log, each identifier once a run."""
    runs: dict[str, list[str]] = {}
    for entry in log:
        at = entry.get("fetchTime") or ""
        if at > since:
            ids = [x["cveId"] for k in ("new", "updated") for x in entry.get(k) or [] if x.get("cveId")]
            runs[at] = list(dict.fromkeys([*runs.get(at, []), *ids]))
    return [runs[k] for k in sorted(runs)], max(runs, default=since)
