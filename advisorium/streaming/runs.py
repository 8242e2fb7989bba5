"""Runs of collectors: their cursors, what they did, and when each is due."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.sources.collectors import PARTIAL, Raw, Run, instant, stamp
from advisorium.sources.shared import Pointer
from advisorium.streaming.ingest import CADENCE

STAGGER_SECONDS = 20
BATCH = 10_000


@dataclass
class Work:
    """Counters of a run: records seen, written, the same as before, and failed."""

    seen: int = 0
    written: int = 0
    unchanged: int = 0
    failed: int = 0


class SourceBook:
    """State of each source by name: cursor, last run, last success, last error, records seen in all."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, source: str) -> Pointer:
        return Pointer(self.spark, f"{self.folder}/{source}")

    def load(self, source: str) -> dict[str, str]:
        return dict(self._pointer(source).read()[1].get("cursor", {}))

    def save(self, source: str, cursor: dict[str, str], seen: int, at: datetime, error: str | None = None) -> None:
        """Note a run. Only a run without error moves the time of success; the records seen add up."""
        pointer = self._pointer(source)
        number, old = pointer.read()
        state = {"source": source, "cursor": cursor, "last_run_at": stamp(at), "last_success_at": old.get("last_success_at") if error else stamp(at), "last_error": error, "records_seen": old.get("records_seen", 0) + seen}
        pointer.swap(number, state)

    def sources(self, names: list[str]) -> DataFrame:
        """One row per source that ever ran: source, cursor_json, last_run_at, last_success_at, last_error, records_seen."""
        states = [s for n in names if (s := self._pointer(n).read()[1])]
        rows = [(s["source"], json.dumps(s["cursor"], sort_keys=True), s["last_run_at"], s["last_success_at"], s["last_error"], s["records_seen"]) for s in states]
        return self.spark.createDataFrame(rows, "source string, cursor_json string, last_run_at string, last_success_at string, last_error string, records_seen long")


def batches(records: Iterator[Raw], size: int = BATCH) -> Iterator[list[Raw]]:
    """Records in runs of bounded length; those before a failure come out before it is raised."""
    held: list[Raw] = []
    try:
        for r in records:
            held.append(r)
            if len(held) == size:
                yield held
                held = []
    except Exception:
        if held:
            yield held
        raise
    if held:
        yield held


def run_one(
    book: SourceBook, source: str, collect: Callable[[Run], Iterator[Raw]], fetch: Callable[[str], bytes], sink: Callable[[DataFrame], tuple[int, int]],
    now: datetime | None = None, backfill: bool = False, after: Callable[[], None] | None = None,
) -> Work:
    """One run of a source: its cursor is read, its records go to ``sink`` batch by batch, ``after`` refreshes what is
    derived, and the cursor is saved.

    ``sink`` takes raw records (source, record_id, content) and returns (written, unchanged). If it fails, or the
    collector does and is none that stops its cursor where its records end, the cursor is saved as it was at the start;
    what was written is met again by the next run and found unchanged. The error is noted and raised.
    """
    now = now or datetime.now(timezone.utc)
    before = book.load(source)
    run, work = Run(fetch, now, dict(before), backfill), Work()
    try:
        for held in batches(collect(run)):
            work.seen += len(held)
            try:
                written, unchanged = sink(book.spark.createDataFrame(held, "source string, record_id string, content string"))
            except Exception:
                work.failed += len(held)
                run.cursor = dict(before)
                raise
            work.written += written
            work.unchanged += unchanged
        if after:
            after()
    except Exception as e:
        kept = run.cursor if source in PARTIAL and not work.failed else before
        book.save(source, kept, work.seen, now, f"{type(e).__name__}: {e}"[:500])
        raise
    book.save(source, run.cursor, work.seen, now)
    return work


def landing_sink(landing: str) -> Callable[[DataFrame], tuple[int, int]]:
    """A sink that adds records to a landing folder, from which a source's stream takes them up."""

    def write(raw: DataFrame) -> tuple[int, int]:
        raw.withColumn("landed_at", F.current_timestamp()).coalesce(1).write.mode("append").json(landing)
        return raw.count(), 0

    return write


def next_due(sources: list[str], states: dict[str, str | None], started: datetime) -> list[tuple[datetime, str]]:
    """When each source is due: at first staggered by its place, then a cadence after its last run; soonest first."""
    due = []
    for i, s in enumerate(sources):
        last = instant(states.get(s))
        first = started + timedelta(seconds=STAGGER_SECONDS * i)
        due.append((max(first, last + timedelta(minutes=CADENCE.get(s, 360))) if last else first, s))
    return sorted(due)


def schedule(book: SourceBook, sources: list[str], run: Callable[[str], None], stopped: Callable[[], bool], clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), sleep: Callable[[float], None] = time.sleep) -> None:
    """Run sources as they fall due until ``stopped``; a run that fails waits for its next turn."""
    started = clock()
    while not stopped():
        states = {r.source: r.last_run_at for r in book.sources(sources).collect()}
        at, source = next_due(sources, states, started)[0]
        if (wait := (at - clock()).total_seconds()) > 0:
            sleep(min(wait, 1.0))
            continue
        try:
            run(source)
        except Exception as e:  # run_one has noted it in the book; other sources go on
            warnings.warn(f"{source}: {e}", stacklevel=2)
