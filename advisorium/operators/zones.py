"""Time texts of several feeds as unambiguous instants, with zones estimated where none is declared.

A candidate is an offset history: all zones of the zone database, grouped by what their clocks showed. For each source
the wall clocks without zone are held against what is known about order: an instant may not lie after the row was
ingested, nor before an instant of the same row that is known to be earlier, and lies where other rows of its entity
state it with a zone. The sequence of histories with the fewest violations is chosen, month by month, so that a source
may change its zone.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions.text import as_column
from advisorium.functions.times import add_instant, read_times, us_of_ntz, zone_names
from advisorium.session import bounded_rows

#: Sources are a dimension; more than this is an error.
MAX_SOURCES = 10_000
#: Days since 1970 on which clocks are compared (1990 to 2037; others count as the nearest), and offsets in quarter hours.
FIRST_DAY, LAST_DAY = 7_305, 24_836
LEAST, MOST = -52, 60
#: A row that a candidate puts elsewhere than the declared zone; it can violate order at most twice.
DECLARED_WEIGHT = 3
#: What a change of zone within a source must save.
SWITCH_ROWS, SWITCH_SHARE = 20, 0.02
#: Spellings of one time may leave out its seconds.
SPELLING_SLACK_US = 60_000_000


@dataclass(frozen=True)
class Segment:
    """A span of a source's wall clock with its zone, and how many rows tell it and violate it."""

    zone: str
    from_us: int | None
    to_us: int | None
    n: int
    violations: int


@dataclass(frozen=True)
class Feed:
    """One time column of a table: where it is, the row key, and which declared source it belongs to.

    What says something about its zone: ``ingested``, when the row landed; ``earlier``, a text column known to denote
    no later an instant; ``entity``, whose rows repeat the same time in several spellings, some with their zone.
    """

    table: str
    key: str
    text: str
    source: str
    ingested: str | None = None
    earlier: str | None = None
    entity: Column | None = None


def offset_histories(names: tuple[str, ...]) -> list[tuple[tuple[str, ...], np.ndarray, np.ndarray]]:
    """Candidate histories: (zones that share it, days since 1970 on which it changes, offset in quarter hours from then).

    Offsets are those at noon UTC of each day from ``FIRST_DAY`` to ``LAST_DAY``; zones that agree on all days are one
    candidate. Zones that the driver's zone database lacks are left out.
    """
    return _offset_histories(tuple(names))


@lru_cache(maxsize=4)
def _offset_histories(names: tuple[str, ...]) -> list[tuple[tuple[str, ...], np.ndarray, np.ndarray]]:
    noon = pd.DatetimeIndex(pd.to_datetime(np.arange(FIRST_DAY, LAST_DAY + 1), unit="D")) + pd.Timedelta(hours=12)
    utc = noon.tz_localize("UTC")
    alike: dict[bytes, tuple[list[str], np.ndarray, np.ndarray]] = {}
    for name in names:
        try:
            local = utc.tz_convert(name).tz_localize(None)
        except (KeyError, ValueError, OSError):
            continue
        quarters = np.round((local - noon).total_seconds().to_numpy() / 900).astype(np.int16)
        at = np.flatnonzero(np.diff(quarters, prepend=quarters[0] - 1))
        alike.setdefault(quarters.tobytes(), ([], at + FIRST_DAY, quarters[at]))[0].append(name)
    return [(tuple(n), days, offsets) for n, days, offsets in alike.values()]


def zone_evidence(rows: DataFrame) -> DataFrame:
    """What rows say of their offset, by day: source, day, least, most (offsets in quarter hours), n.

    ``rows``: source string, wall_us bigint (a clock without zone), lower_us and upper_us bigint (null: no bound). An
    offset below ``least`` puts the instant after its upper bound, one above ``most`` before its lower. Rows without
    any bound are no evidence. Aggregated with partial results to at most one row per source, day and pair of
    offsets, so a source that holds most rows makes no large group.
    """
    known = rows.filter(F.col("wall_us").isNotNull() & (F.col("lower_us").isNotNull() | F.col("upper_us").isNotNull()))
    quarter = 900 * 1_000_000
    within = lambda c, low, high: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)).cast("int"))
    return known.groupBy(
        "source", within(F.floor(F.col("wall_us") / (86_400 * 1_000_000)), FIRST_DAY, LAST_DAY).alias("day"),
        F.coalesce(within(F.ceil((F.col("wall_us") - F.col("upper_us")) / quarter), LEAST, MOST + 1), F.lit(LEAST)).alias("least"),
        F.coalesce(within(F.floor((F.col("wall_us") - F.col("lower_us")) / quarter), LEAST - 1, MOST), F.lit(MOST)).alias("most"),
    ).agg(F.count("*").alias("n"))


class _Scores:
    """One source's evidence against every candidate history: order violations by candidate and day."""

    def __init__(self, evidence: pd.DataFrame, histories: list, declared: str | None) -> None:
        self.days, at = np.unique(evidence["day"].to_numpy(), return_inverse=True)
        n = evidence["n"].to_numpy()
        width = MOST - LEAST + 1
        late, early = np.zeros((len(self.days), width + 1)), np.zeros((len(self.days), width + 1))
        np.add.at(late, (at, evidence["least"].to_numpy() - LEAST), n)  # offsets below violate
        np.add.at(early, (at, evidence["most"].to_numpy() - LEAST + 1), n)  # offsets from there on violate
        by_offset = late[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] + early.cumsum(axis=1)[:, :width]
        self.n = np.bincount(at, weights=n, minlength=len(self.days))
        offsets = np.stack([o[np.maximum(np.searchsorted(d, self.days, side="right") - 1, 0)] for _, d, o in histories])
        self.violations = np.take_along_axis(by_offset, (offsets.T - LEAST).clip(0, width - 1), axis=1).T
        own = next((i for i, h in enumerate(histories) if declared in h[0]), None)
        contradicts = np.zeros_like(self.violations) if own is None else (offsets != offsets[own]) * self.n
        self.cost = self.violations + DECLARED_WEIGHT * contradicts
        self.closeness = (offsets * self.n).sum(axis=1)
        self.own = own

    def ranked(self, histories: list, known: set[str]) -> np.ndarray:
        """Rank of each candidate among equals: declared here, declared by others, closest to the upper bounds, name."""
        order = sorted(range(len(histories)), key=lambda i: (i != self.own, known.isdisjoint(histories[i][0]), self.closeness[i], min(histories[i][0])))
        rank = np.empty(len(order))
        rank[order] = np.arange(len(order))
        return rank


def _segments(source: str, evidence: pd.DataFrame, histories: list, declared: dict[str, str]) -> pd.DataFrame:
    """The cheapest sequence of candidates over the months with evidence, a change costing what is stated above."""
    s = _Scores(evidence, histories, declared.get(source))
    known = {*declared.values()}
    month = s.days.astype("datetime64[D]").astype("datetime64[M]")
    months, first = np.unique(month, return_index=True)
    cost = np.add.reduceat(s.cost, first, axis=1).T
    among_equals = s.ranked(histories, known) / (len(histories) * len(months) * 4)
    cost = cost + among_equals
    change = max(SWITCH_ROWS, SWITCH_SHARE * s.n.sum())
    best, came = cost[0], np.zeros(cost.shape, dtype=np.int64)
    for m in range(1, len(months)):
        cheapest = int(best.argmin())
        moved = best[cheapest] + change < best
        came[m] = np.where(moved, cheapest, np.arange(len(best)))
        best = np.where(moved, best[cheapest] + change, best) + cost[m]
    chosen = [int(best.argmin())]
    for m in range(len(months) - 1, 0, -1):
        chosen.append(int(came[m][chosen[-1]]))
    chosen = np.array(chosen[::-1])
    starts = np.flatnonzero(np.diff(chosen, prepend=-1))
    out = []
    for i, at in enumerate(starts):
        until = starts[i + 1] if i + 1 < len(starts) else len(months)
        inside = (month >= months[at]) & (month <= months[until - 1])
        names = histories[chosen[at]][0]
        own = declared.get(source)
        zone = own if own in names else min(names, key=lambda z: (z not in known, z))
        edge = lambda k: int(months[k].astype("datetime64[us]").astype(np.int64))
        out.append((source, zone, None if i == 0 else edge(at), edge(until) if until < len(months) else None, int(s.n[inside].sum()), int(s.violations[chosen[at]][inside].sum())))
    return pd.DataFrame(out, columns=["source", "zone", "from_us", "to_us", "n", "violations"]).astype({"from_us": "Int64", "to_us": "Int64"})


def estimate_zones(evidence: DataFrame, histories: list, declared: dict[str, str]) -> DataFrame:
    """Per source the zones that violate order least, by span of its wall clock: source, zone, from_us, to_us (null: open),
    n, violations.

    A candidate costs its violations in each month. Where a source declares a zone, a candidate that puts a row
    elsewhere than the declared one contradicts a statement, which weighs more than any order can. A change of zone
    within a source must save ``SWITCH_ROWS`` violations and ``SWITCH_SHARE`` of the rows. A group is the evidence of
    one source, whose size the calendar bounds.
    """
    schema = "source string, zone string, from_us bigint, to_us bigint, n bigint, violations bigint"
    return evidence.groupBy("source").applyInPandas(lambda rows: _segments(rows["source"].iat[0], rows, histories, declared), schema)


def zone_scores(evidence: DataFrame, histories: list) -> DataFrame:
    """Order violations of every candidate over all of a source's evidence, whatever is declared: source, zone (the
    first by name of those that share the history), n, violations."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = _Scores(rows, histories, None)
        return pd.DataFrame({"source": rows["source"].iat[0], "zone": [min(h[0]) for h in histories], "n": int(s.n.sum()), "violations": s.violations.sum(axis=1).astype(np.int64)})

    return evidence.groupBy("source").applyInPandas(run, "source string, zone string, n bigint, violations bigint")


def declared_zones(sources: DataFrame, known: list[str]) -> dict[str, str]:
    """Declared zone by source; a source whose zone is missing or unknown is left out."""
    good = {*known, "UTC", "GMT"}
    rows = bounded_rows(sources.select("source_name", "local_zone"), MAX_SOURCES, "declared zones")
    return {r.source_name: r.local_zone for r in rows if r.local_zone in good}


def _evidence_columns(df: DataFrame, feed: Feed) -> DataFrame:
    none = F.lit(None)
    upper = us_of_ntz(F.col(feed.ingested)) if feed.ingested else none.cast("bigint")
    return df.select(
        F.lit(feed.source).alias("source"), F.col(feed.text).alias("text"), (F.col(feed.earlier) if feed.earlier else none).cast("string").alias("earlier"),
        (feed.entity if feed.entity is not None else none).cast("string").alias("entity"), upper.alias("upper_us"),
    )


def evidence_rows(inputs: list[tuple[DataFrame, Feed]], zones: list[str]) -> DataFrame:
    """The rows of feeds that say something about their zones: local clocks with their bounds.

    An instant lies no later than its ingestion, no earlier than ``feed.earlier`` where that states its own zone, and
    among the instants that other rows of the entity state with a zone, give or take what spellings cut off. Known
    instants are reduced to a least and greatest one per entity before they are joined. All feeds are read in one plan.
    """
    read = read_times(_union([_evidence_columns(df, feed) for df, feed in inputs]), "text", zones)
    local = read.filter("time_kind = 'local'").select("source", F.col("time_us").alias("wall_us"), "earlier", "entity", "upper_us")
    bounded = add_instant(read_times(local, "earlier", zones), "lower_us", None) if any(f.earlier for _, f in inputs) else local.withColumn("lower_us", F.lit(None).cast("bigint"))
    if any(f.entity is not None for _, f in inputs):
        stated = add_instant(read.filter("time_kind in ('epoch', 'offset', 'zone') and entity is not null"), "at", None)
        span = stated.groupBy("source", "entity").agg((F.min("at") - SPELLING_SLACK_US).alias("from_us"), (F.max("at") + SPELLING_SLACK_US).alias("to_us"))
        bounded = bounded.join(span, ["source", "entity"], "left").withColumns({"lower_us": F.greatest("lower_us", "from_us"), "upper_us": F.least("upper_us", "to_us")})
    return bounded.select("source", "wall_us", "lower_us", "upper_us")


def normalized_times(inputs: list[tuple[DataFrame, Feed]], zone_by_source: dict[str, Column | None], zones: list[str]) -> DataFrame:
    """One row per readable text of the feeds: table_name, row_no, epoch_us.

    Null, blank, incomplete, impossible and ambiguous texts give no row; repeated rows each give theirs. A local
    text gives no row where its source has no zone. All feeds are read in one plan.
    """
    held = _union([df.select(F.lit(f.table).alias("table_name"), F.lit(f.source).alias("source"), F.col(f.key).cast("bigint").alias("row_no"), F.col(f.text).alias("text")) for df, f in inputs])
    zone = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("source") == s, z) for s, z in zone_by_source.items() if z is not None])
    at = add_instant(read_times(held, "text", zones), "epoch_us", zone)
    return at.select("table_name", "row_no", "epoch_us").filter(F.col("epoch_us").isNotNull())


class TimeNormalizer:
    """Brings the time columns of several feeds to instants, by the zones that order and declarations tell."""

    def __init__(self, spark: SparkSession, sources: DataFrame) -> None:
        self.spark = spark
        self.zones = zone_names(spark)
        self.declared = declared_zones(sources, self.zones)
        self.histories = offset_histories(("UTC", *self.zones))

    def evidence(self, inputs: list[tuple[DataFrame, Feed]]) -> DataFrame:
        return zone_evidence(evidence_rows(inputs, self.zones))

    def scores(self, inputs: list[tuple[DataFrame, Feed]]) -> DataFrame:
        """``zone_scores`` of the given feeds."""
        return zone_scores(self.evidence(inputs), self.histories)

    def estimate(self, inputs: list[tuple[DataFrame, Feed]], withheld: bool = False) -> dict[str, list[Segment]]:
        """The zones of each source by span, from its evidence and its declaration; ``withheld``: from evidence alone.

        A source that declares a zone and has no evidence keeps it; one that has neither is missing.
        """
        declared = {} if withheld else self.declared
        rows = bounded_rows(estimate_zones(self.evidence(inputs), self.histories, declared), MAX_SOURCES * 10, "spans of zones")
        out: dict[str, list[Segment]] = {}
        for r in sorted(rows, key=lambda r: (r.source, r.from_us is not None, r.from_us or 0)):
            out.setdefault(r.source, []).append(Segment(r.zone, r.from_us, r.to_us, r.n, r.violations))
        return {s: [Segment(z, None, None, 0, 0)] for s, z in declared.items()} | out

    def zone_of(self, source: str, segments: dict[str, list[Segment]], wall: Column | str = "time_us") -> Column | None:
        """Zone of a wall clock of ``source``; None, with a warning, where nothing tells it."""
        spans = segments.get(source)
        if not spans:
            warnings.warn(f"{source}: no zone is declared or can be estimated; its local times are unplaced", stacklevel=2)
            return None
        for s in spans:
            if source not in self.declared and s.violations:
                warnings.warn(f"{source}: the estimated zone {s.zone} violates order {s.violations} times in {s.n} rows", stacklevel=2)
        zone = F.lit(spans[-1].zone)
        for s in reversed(spans[:-1]):
            zone = F.when(as_column(wall) < s.to_us, s.zone).otherwise(zone)
        return zone

    def normalize(self, inputs: list[tuple[DataFrame, Feed]], evidence: list[tuple[DataFrame, Feed]] | None = None, withheld: bool = False) -> DataFrame:
        """One row per readable text: table_name, row_no, epoch_us. The zones are estimated from ``evidence``, or else
        from the feeds themselves. Local texts that nothing places are those of ``unplaced``."""
        segments = self.estimate(evidence or inputs, withheld)
        return normalized_times(inputs, {s: self.zone_of(s, segments) for s in dict.fromkeys(f.source for _, f in inputs)}, self.zones)

    def unplaced(self, inputs: list[tuple[DataFrame, Feed]], evidence: list[tuple[DataFrame, Feed]] | None = None) -> DataFrame:
        """Local texts of sources whose zone nothing tells, as they stand: table_name, row_no, text."""
        segments = self.estimate(evidence or inputs)
        out = []
        for df, feed in inputs:
            held = df.select(F.lit(feed.table).alias("table_name"), F.col(feed.key).cast("bigint").alias("row_no"), F.col(feed.text).alias("text"))
            local = read_times(held, "text", self.zones).filter("time_kind = 'local'")
            out.append(local.select("table_name", "row_no", "text").filter(F.lit(not segments.get(feed.source))))
        return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union
