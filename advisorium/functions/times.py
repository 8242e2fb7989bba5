"""Time texts of many forms as one instant, in microseconds since 1970-01-01 UTC.

The work is split in two so that zones can be estimated in between: ``read_times`` reads a text into local wall
time and what it says of its zone, ``add_instant`` turns both into an instant. Both depend on no session time zone
and stay in generated code. Their steps are bound by ``let``, which keeps the optimizer from repeating a step in
every expression and filter that uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions.text import as_column, spaces_to_blank

# English month names, and zone abbreviations with their offset from UTC in minutes.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240,
    "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTH_KEYS = "".join(m[:3] for m in MONTHS).upper()

_MONTH = "(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS if m != "May") + r"|May|Sept)\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?: ?([AP]M))?"
_ZONE = r" ?([+-]\d{2}(?::?\d{2})?|[A-Z]{1,5}|[A-Z][A-Z_]*(?:/[A-Z0-9_+-]+){1,3})?(?:\[[^\]]*\])?"

#: Each form with the replacement that brings it to year|month|day|hour|minute|second|fraction|half|zone.
FORMS = (
    (rf"(?i)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"(?i)^{_MONTH} (\d{{1,2}}),? (\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:T?(\d{{2}})(\d{{2}})(\d{{2}})(?:\.(\d+))?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"(?i)^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[T ]{_CLOCK}{_HALF}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^(1[3-9]|2\d|3[01])/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^(\d{{1,2}})/(1[3-9]|2\d|3[01])/(\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)
#: Counts since 1970 by their number of digits: seconds, milli-, micro- and nanoseconds. Four, six and eight digits are
#: a year, a month and a date, seven may be a year with a day of the year, and up to three say nothing.
EPOCHS = (
    (r"^(?:-\d{5,11}|\d{5}|\d{9,11}|(?!(?:19|20)\d\d[0-3])\d{7})$", 1_000_000, 1), (r"^-?\d{12,14}$", 1_000, 1), (r"^-?\d{15,17}$", 1, 1), (r"^-?\d{18,19}$", 1, 1_000),
)


def zone_names(spark: SparkSession) -> list[str]:
    """Zones that the session's JVM knows and that stand for an area; a text with any other zone is unreadable."""
    return sorted(z for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)


def _number(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def let(df: DataFrame, **steps: Column) -> DataFrame:
    """``df`` with further columns that are computed once, here: a generator that always gives one row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in steps.items()]))))


def read_times(df: DataFrame, text: Column | str, zones: list[str], prefix: str = "time_") -> DataFrame:
    """``df`` with what a time text says, in four columns named with ``prefix``:

    ``kind``: ``epoch`` (a count since 1970), ``date`` (a date alone), ``local`` (no zone), ``offset``, ``zone``
    (a named zone), or null for what is no possible date or time; ``us``: microseconds of the wall clock, or the
    count itself; ``offset_us``: stated offset; ``zone``: stated area.

    Null, blank, incomplete, impossible and ambiguous texts (day and month both up to 12 between slashes) are
    null throughout. Digits past the microsecond are cut off, however many there are; every form is told from what
    it is not within its first characters, so long texts cost little. A count of 14 digits that is a possible date
    and time in digits is that. Columns of ``df`` that begin with ``__t_`` are lost.
    """
    kept = [c for c in df.columns if not c.startswith("__t_")]
    cleaned = F.btrim(spaces_to_blank(as_column(text)))
    df = let(df, __t_text=cleaned)
    given = F.col("__t_text")
    canon = F.lit(None).cast("string")
    for pattern, replacement in reversed(FORMS):
        canon = F.when(given.rlike(pattern), F.regexp_replace(given, pattern, replacement)).otherwise(canon)
    count = F.lit(None).cast("bigint")
    for pattern, times, over in reversed(EPOCHS):
        number = given.try_cast("bigint")
        count = F.when(given.rlike(pattern), F.floor(number / over).cast("bigint") if over > 1 else number * times).otherwise(count)
    df = let(df, __t_part=F.split(canon, r"\|"), __t_count=count)

    def part(i: int) -> Column:
        return F.get("__t_part", i)

    month_text, hour, half = part(1), _number(part(3)), F.upper(part(7))
    named = ((F.position(F.upper(F.substring(month_text, 1, 3)), F.lit(MONTH_KEYS)) + 2) / 3).cast("int")
    clock = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    df = let(
        df,
        __t_y=_number(part(0)), __t_m=F.when(month_text.rlike(r"^\d+$"), _number(month_text)).otherwise(named), __t_d=_number(part(2)),
        __t_dated=part(3) == "", __t_h=clock, __t_mi=F.coalesce(_number(part(4)), F.lit(0)), __t_s=F.coalesce(_number(part(5)), F.lit(0)),
        __t_frac=F.coalesce(_number(F.rpad(F.substring(part(6), 1, 6), 6, "0")), F.lit(0)), __t_z=F.upper(part(8)),
    )
    y, m, d, h, mi, s, dated, z = (F.col(f"__t_{n}") for n in ("y", "m", "d", "h", "mi", "s", "dated", "z"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days) & (dated | (h.between(0, 23) & (mi <= 59) & (s <= 59)))
    # Days since 1970 of a proleptic Gregorian date, with years that begin in March.
    march = (y - F.when(m <= 2, 1).otherwise(0)).cast("bigint")
    of_year = F.floor((153 * ((m + 9) % 12) + 2) / 5) + d - 1
    day = march * 365 + F.floor(march / 4) - F.floor(march / 100) + F.floor(march / 400) + of_year - 719468
    of_day = F.when(dated, F.lit(0).cast("bigint")).otherwise((h * 3600 + mi * 60 + s).cast("bigint") * 1_000_000 + F.col("__t_frac"))
    signed = z.rlike(r"^[+-]")
    digits = F.rpad(F.translate(F.substring(z, 2, 5), ":", ""), 4, "0")
    off_h, off_m = F.substring(digits, 1, 2), F.substring(digits, 3, 2)
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    listed = lambda names: "split('" + ",".join(names) + "', ',')"  # noqa: E731  one constant instead of a node per zone
    areas = F.expr(f"map_from_arrays({listed([n.upper() for n in zones])}, {listed(zones)})")
    minutes = F.when(signed & (_number(off_h) <= 18) & (_number(off_m) <= 59), (_number(off_h) * 60 + _number(off_m)) * F.when(z.startswith("-"), -1).otherwise(1)).when(
        ~signed, F.try_element_at(known, z)
    )
    df = let(df, __t_ok=ok, __t_wall=day.cast("bigint") * 86_400_000_000 + of_day, __t_min=minutes, __t_area=F.when(z.contains("/"), F.try_element_at(areas, z)))
    kind = (
        F.when(F.col("__t_count").isNotNull() & ~(F.col("__t_part").isNotNull() & F.coalesce(F.col("__t_ok"), F.lit(False))), "epoch")
        .when(~F.coalesce(F.col("__t_ok"), F.lit(False)), None)
        .when(dated, "date")
        .when(z == "", "local")
        .when(F.col("__t_min").isNotNull(), "offset")
        .when(F.col("__t_area").isNotNull(), "zone")
    )
    df = let(df, __t_kind=kind)
    kind = F.col("__t_kind")
    return df.select(
        *kept,
        kind.alias(f"{prefix}kind"), F.when(kind == "epoch", F.col("__t_count")).when(kind.isNotNull(), F.col("__t_wall")).alias(f"{prefix}us"),
        F.when(kind == "offset", F.col("__t_min").cast("bigint") * 60_000_000).alias(f"{prefix}offset_us"), F.when(kind == "zone", F.col("__t_area")).alias(f"{prefix}zone"),
    )


def wall_to_utc(us: Column, zone: Column) -> Column:
    """Zoneless UTC timestamp, to the second, of a wall clock in a zone: of two such instants the first; a skipped
    time by the offset in force just before."""
    seconds = F.floor(us / 1_000_000).cast("bigint")
    day, of_day = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds, F.lit(86_400)).cast("int")
    date = F.date_from_unix_date(day)
    local = F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), (of_day / 3600).cast("int"), (of_day % 3600 / 60).cast("int"), (of_day % 60).cast("decimal(16,6)"))
    return F.convert_timezone(zone, F.lit("UTC"), local)


def seconds_of(ntz: Column) -> Column:
    """Seconds since 1970 of a zoneless timestamp, independent of the session zone."""
    return F.unix_date(ntz.cast("date")).cast("bigint") * 86_400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)


def add_instant(df: DataFrame, out: str, local_zone: Column | str | None, prefix: str = "time_") -> DataFrame:
    """``df``, which ``read_times`` made, with the instant of its text in microseconds since 1970 UTC as ``out``.

    ``local_zone`` holds for texts without a zone. Null where the text is unreadable, or is local and the zone null.
    The columns of ``read_times`` go.
    """
    kind, us, offset, named = (F.col(f"{prefix}{n}") for n in ("kind", "us", "offset_us", "zone"))
    zone = F.lit(local_zone).cast("string") if local_zone is None or isinstance(local_zone, str) else local_zone
    kept = [c for c in df.columns if c not in {f"{prefix}{n}" for n in ("kind", "us", "offset_us", "zone")}]
    df = let(df, __t_utc=F.when(kind.isin("local", "zone"), wall_to_utc(us, F.when(kind == "zone", named).otherwise(zone))))
    rest = F.pmod(us, F.lit(1_000_000))
    at = F.when(kind.isin("epoch", "date"), us).when(kind == "offset", us - offset).when(kind.isin("local", "zone"), seconds_of(F.col("__t_utc")) * 1_000_000 + rest)
    return let(df, __t_out=at).select(*kept, F.col("__t_out").alias(out))


def calendar_day(us: Column | str) -> Column:
    """The calendar day as written, whatever the zone; a count since 1970 names its day in UTC."""
    return F.date_from_unix_date(F.floor(as_column(us) / 86_400_000_000).cast("int"))


def us_of_ntz(c: Column) -> Column:
    """Microseconds of a zoneless timestamp column read as UTC, independent of the session zone."""
    c = c.cast("timestamp_ntz")
    return seconds_of(c) * 1_000_000 + F.date_format(c, "SSSSSS").cast("bigint")
