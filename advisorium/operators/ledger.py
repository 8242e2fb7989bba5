"""Processing only new or changed records, each change in exactly one successful run.

``WorkLedger`` keeps work items in a shared folder, and ``replay`` runs past runs through it as their log tells them.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from advisorium.session import bounded_rows, literal_map, small_enough
from advisorium.sources.shared import SharedFolder

#: Sources are a dimension; the days of run windows are sent to every task only up to so many rows.
MAX_SOURCES = 10_000
MAX_BROADCAST_SPANS = 100_000
#: One row per run of the log is collected; more is an error.
MAX_RUNS = 1_000_000
#: Sources replayed side by side, and files that one large landing item is spread over.
SOURCES_AT_ONCE = 4
LANDING_FILES = 4
PENDING, LEASED, DONE = "pending", "leased", "done"


@dataclass(frozen=True)
class Lease:
    """The right to process one work item; a later lease of the item has a higher token and fences this one off."""

    item: str
    token: int
    expires_at: float


class StaleLease(Exception):
    """The writer's lease was taken over or the item is done."""


class WorkLedger:
    """Work items with states pending, leased and done, as files in a folder that all writers share.

    ``items/<item>`` is an item, ``leases/<item>/<token>`` a lease (created whole or not at all, so two writers never
    hold one token and a writer lost in between holds none), ``given/<item>/<token>`` a lease that was given back,
    ``done/<item>`` the token whose output counts. An expired lease leaves its item pending. Output goes to
    ``output/item=<item>/lease=<token>``, the same path for every retry of the same lease; readers read the path that
    ``done`` names, so repeated and abandoned attempts are never seen.
    """

    def __init__(self, spark: SparkSession, folder: str, lease_seconds: float = 600, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.lease_seconds, self.clock = spark, folder.rstrip("/"), lease_seconds, clock
        self.files = SharedFolder(spark, self.folder)

    def add(self, item: str, payload: dict | None = None) -> bool:
        """Register an item; False if it is known already, so a repeated plan adds nothing twice."""
        return self.files.create_once(f"items/{item}", {"payload": payload or {}})

    def payload(self, item: str) -> dict:
        return (self.files.load(f"items/{item}") or {}).get("payload", {})

    def _last_lease(self, item: str) -> Lease | None:
        tokens = [int(n) for n in self.files.names(f"leases/{item}") if n.isdigit()]
        if not tokens:
            return None
        token = max(tokens)
        held = self.files.load(f"leases/{item}/{token:08d}") or {}
        given = self.files.load(f"given/{item}/{token:08d}") is not None
        return Lease(item, token, 0.0 if given else held.get("expires_at", 0.0))

    def _done_token(self, item: str) -> int | None:
        return (self.files.load(f"done/{item}") or {}).get("token")

    def state(self, item: str) -> str:
        if self._done_token(item) is not None:
            return DONE
        lease = self._last_lease(item)
        return LEASED if lease and lease.expires_at > self.clock() else PENDING

    def items(self) -> dict[str, str]:
        """State of every item."""
        return {i: self.state(i) for i in self.files.names("items")}

    def lease(self, item: str) -> Lease | None:
        """Take a pending item; None if it is leased, done, or another writer was faster."""
        if self.state(item) != PENDING:
            return None
        last = self._last_lease(item)
        mine = Lease(item, (last.token if last else 0) + 1, self.clock() + self.lease_seconds)
        return mine if self.files.create_once(f"leases/{item}/{mine.token:08d}", {"expires_at": mine.expires_at}) else None

    def output_path(self, lease: Lease) -> str:
        return f"{self.folder}/output/item={lease.item}/lease={lease.token:08d}"

    def process(self, lease: Lease, rows: DataFrame) -> None:
        """Write an item's rows and mark it done."""
        self.write(lease, rows)
        self.finish(lease)

    def write(self, lease: Lease, rows: DataFrame) -> None:
        """Write an item's rows where nobody reads them before ``finish``; a fenced writer is refused."""
        self._check(lease)
        rows.write.mode("overwrite").parquet(self.output_path(lease))

    def write_all(self, leases: list[Lease], rows: DataFrame) -> None:
        """Write the rows of many items (item, ...) in one job, each to the path of its lease."""
        for lease in leases:
            self._check(lease)
        token = F.try_element_at(literal_map({i.item: f"{i.token:08d}" for i in leases}), F.col("item"))
        keyed = rows.withColumn("lease", token).filter("lease is not null")
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("item", "lease").parquet(f"{self.folder}/output")

    def _check(self, lease: Lease) -> None:
        last = self._last_lease(lease.item)
        if last is None or last.token != lease.token:
            raise StaleLease(f"{lease.item}: token {lease.token} was fenced off")

    def finish(self, lease: Lease, written: bool = True) -> None:
        """Let the lease's output count, if any was ``written``; a stale writer is refused, the winner may repeat itself."""
        self._check(lease)
        if not self.files.create_once(f"done/{lease.item}", {"token": lease.token, "written": written}) and self._done_token(lease.item) != lease.token:
            raise StaleLease(f"{lease.item} is done by another writer")

    def fail(self, lease: Lease) -> None:
        """Give the item back before the lease ends."""
        self._check(lease)
        self.files.create_once(f"given/{lease.item}/{lease.token:08d}", {})

    def done_paths(self) -> list[str]:
        """Output that counts, one path per done item that has any."""
        done = ((i, self.files.load(f"done/{i}")) for i in self.files.names("done"))
        return [self.output_path(Lease(i, d["token"], 0.0)) for i, d in done if d and d["written"]]


def replay_ledger(log: DataFrame) -> DataFrame:
    """How each run of the log ended: source_name, run_no, started_at, state, token.

    A line with an end and no error makes the run done. A run without such a line failed or its lease expired, and
    what it held is pending again. ``token`` numbers the runs of a source by start, so a later run fences off an
    earlier one. Lines without source, run or start are none.
    """
    ok = F.col("finished_at").isNotNull() & F.col("error_text").isNull()
    runs = (
        log.filter("source_name is not null and run_no is not null and started_at is not null")
        .groupBy("source_name", "run_no")
        .agg(F.min("started_at").alias("started_at"), F.max(ok.cast("int")).alias("ok"), F.count("error_text").alias("errors"))
    )
    token = F.row_number().over(Window.partitionBy("source_name").orderBy("started_at", "run_no"))
    return runs.select("source_name", "run_no", "started_at", F.when(F.col("ok") == 1, DONE).otherwise(PENDING).alias("state"), token.alias("token"), (F.col("errors") > 0).alias("told"))


def takeover_windows(ledger: DataFrame) -> DataFrame:
    """The span of landing times that each done run takes up: source_name, run_no, token, after, until.

    What pending runs held passes to the next done run. ``after`` is null for a source's first done run.
    """
    done = ledger.filter(F.col("state") == DONE)
    w = Window.partitionBy("source_name").orderBy("token")
    return done.select("source_name", "run_no", "token", F.lag("started_at").over(w).alias("after"), F.col("started_at").alias("until"))


def item_name(source: str, number: int) -> str:
    """Name of the work item that holds what landed between two starts of a source's runs."""
    return f"{hashlib.sha256(source.encode()).hexdigest()[:16]}-{number:07d}"


def landing_slices(items: DataFrame, runs: DataFrame) -> DataFrame:
    """``items`` (source_name, entity, row_no, landed_at, time_us) with ``slice``: the token of the first run that
    starts at or after their landing, successful or not. What no run could see, or has no landing time, gives no row.

    An equi join on source and day: every span between two starts is listed under the days it touches. What landed
    before a source's first start needs no join and is spread over keys that match nothing.
    """
    w = Window.partitionBy("source_name").orderBy("token")
    spans = runs.select("source_name", F.col("token").alias("slice"), F.lag("started_at").over(w).alias("after"), F.col("started_at").alias("until"))
    rows = bounded_rows(spans.filter("after is null").select("source_name", F.col("until").cast("string").alias("first")), MAX_SOURCES, "sources with runs")
    first = F.try_element_at(literal_map({r.source_name: r["first"] for r in rows}), F.col("source_name")).cast(runs.schema["started_at"].dataType)
    days = spans.filter("after is not null").withColumn("day", F.explode(F.sequence(F.to_date("after"), F.to_date("until"))))
    if small_enough(days, MAX_BROADCAST_SPANS):
        days = F.broadcast(days)
    known = items.withColumn("__first", first).filter("__first is not null and landed_at is not null")
    early = F.col("landed_at") <= F.col("__first")
    nowhere = F.date_add(F.lit("0001-01-01").cast("date"), F.pmod(F.xxhash64("row_no"), F.lit(1_000)).cast("int"))
    keyed = known.withColumn("day", F.when(early, nowhere).otherwise(F.to_date("landed_at"))).alias("i")
    inside = (F.col("i.source_name") == F.col("d.source_name")) & (F.col("i.day") == F.col("d.day")) & (F.col("landed_at") <= F.col("until")) & (F.col("landed_at") > F.col("after"))
    return keyed.join(days.alias("d"), inside, "left").select("i.source_name", F.when(early, 1).otherwise(F.col("slice")).alias("slice"), "entity", "row_no", "time_us").filter("slice is not null")


def replay(items: DataFrame, log: DataFrame, folder: str) -> DataFrame:
    """Past runs of the log replayed on a work ledger: source_name, run_no, token, entity, row_no, time_us.

    What landed between two starts of a source is one work item, written once to the landing folder. Run by run, in
    order of start, the items that are pending are leased at the run's start. A done run's leases are written and
    then finished; one that reported an error gives them back; one that never ended loses them
    when the leases expire, which is before the source's next start. The rows are those of ``done_paths``.

    Of an entity's rows in one item only the latest is kept (ties: lowest row key), by an aggregation with partial
    results. Rows without entity or time are no changes. Sources are replayed side by side; one row per run is
    collected.
    """
    spark = items.sparkSession
    runs = replay_ledger(log)
    told = bounded_rows(runs, MAX_RUNS, "runs of the log")
    latest = F.max(F.struct("time_us", (-F.col("row_no")).alias("back"))).alias("top")
    kept = landing_slices(items.filter("time_us is not null and entity is not null"), runs).groupBy("source_name", "slice", "entity").agg(latest)
    rows = kept.select("source_name", "entity", (-F.col("top.back")).cast("bigint").alias("row_no"), F.col("top.time_us").alias("time_us"), F.concat_ws("-", F.substring(F.sha2("source_name", 256), 1, 16), F.lpad(F.col("slice").cast("string"), 7, "0")).alias("item"))
    landing = f"{folder}/landing"
    rows.repartition("item", F.pmod(F.xxhash64("entity"), F.lit(LANDING_FILES))).write.mode("overwrite").partitionBy("item").parquet(landing)
    landed = {n.split("=", 1)[1] for n in SharedFolder(spark, landing).names("") if n.startswith("item=")}
    schema = rows.drop("item").schema

    def source_runs(mine: list) -> WorkLedger:
        starts = [r.started_at.timestamp() for r in mine]
        gaps = [b - a for a, b in zip(starts, starts[1:])]
        now = [0.0]
        book = WorkLedger(spark, f"{folder}/ledger-{item_name(mine[0].source_name, 0)}", min(gaps, default=600.0), lambda: now[0])
        waiting: list[str] = []
        working: list[tuple[Lease, dict]] = []
        for r, now[0] in zip(mine, starts):
            waiting.append(item_name(r.source_name, r.token))
            book.add(waiting[-1], {"run": r.run_no})
            held = [lease for i in waiting if (lease := book.lease(i))]
            if r.state == DONE:
                working += [(lease, {"run_no": r.run_no, "token": r.token}) for lease in held]
                waiting = [i for i in waiting if i not in {lease.item for lease in held}]
            elif r.told:
                for lease in held:
                    book.fail(lease)
        full = [(lease, of) for lease, of in working if lease.item in landed]
        if full:
            runs_of = {n: F.try_element_at(F.create_map(*[F.lit(x) for lease, of in full for x in (lease.item, of[n])]), F.col("item")) for n in ("run_no", "token")}
            taken = spark.read.option("basePath", landing).schema(rows.schema).parquet(*[f"{landing}/item={lease.item}" for lease, _ in full])
            book.write_all([lease for lease, _ in full], taken.withColumns(runs_of))
        for lease, _ in working:
            book.finish(lease, lease.item in landed)
        return book

    by_source: dict[str, list] = {}
    for r in sorted(told, key=lambda r: (r.source_name, r.token)):
        by_source.setdefault(r.source_name, []).append(r)
    with ThreadPoolExecutor(SOURCES_AT_ONCE) as pool:
        books = list(pool.map(source_runs, by_source.values()))
    paths = [p for b in books for p in b.done_paths()]
    out = StructType([*schema.fields, runs.schema["run_no"], runs.schema["token"]])
    done = spark.read.schema(out).parquet(*paths) if paths else spark.createDataFrame([], out)
    return done.select("source_name", "run_no", "token", "entity", "row_no", "time_us")


def new_or_changed(assigned: DataFrame) -> DataFrame:
    """The rows that are a change: source_name, run_no, row_no.

    Of an entity's rows in one run the latest counts (ties: lowest row key), and it must be later than all rows of
    the entity in earlier runs. Rows without a time are none. The first aggregation leaves one row per entity and
    run before anything is ordered, so an entity with most of the rows makes no large group.
    """
    latest = F.max(F.struct("time_us", (-F.col("row_no")).alias("back"))).alias("top")
    per_run = assigned.filter("time_us is not null and entity is not null").groupBy("source_name", "entity", "token", "run_no").agg(latest)
    w = Window.partitionBy("source_name", "entity").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("top.time_us").over(w)
    return (
        per_run.withColumn("seen", seen)
        .filter(F.col("seen").isNull() | (F.col("top.time_us") > F.col("seen")))
        .select("source_name", "run_no", (-F.col("top.back")).alias("row_no"))
    )
