"""One surviving record per duplicate group, field by field.

One aggregation does it all: for each attribute the best composite struct (does the row qualify, trust of its
source, time, key) of the group. Structs combine on the map side, so a group that holds a third of all rows is
one struct per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions.text import folded, trimmed
from advisorium.functions.times import us_of_ntz
from advisorium.session import bounded_rows

UNKNOWN_RANK = 100
NAMES_PER_MASK = 62
#: Sources are a dimension table; more than this is an error.
MAX_SOURCES = 10_000
EARLIEST_PUBLISHED = "1999-01-01"

# Words of which texts are made that say nothing about a flaw.
EMPTY_WORDS = (
    "a", "advisory", "advisories", "announced", "announcement", "as", "available", "be", "been", "cve", "description", "determined", "details",
    "entry", "follow", "follows", "for", "has", "have", "information", "is", "later", "n", "na", "nil", "no", "none", "not", "null", "of", "once",
    "pending", "placeholder", "provided", "published", "reference", "references", "reserved", "see", "soon", "supplied", "summary", "tba", "tbd", "text",
    "the", "this", "to", "todo", "unknown", "vendor", "was", "will", "yet",
)


def says_something(text: Column | str) -> Column:
    """False for null, blank and stand-ins: texts of nothing but words that say nothing about a flaw, and signs. A text
    that was cut short says something."""
    sign = r"[\p{L}\p{N}]"
    other_word = rf"(?<!{sign})(?!(?:{'|'.join(EMPTY_WORDS)})(?!{sign})){sign}"
    return F.coalesce(folded(text).rlike(other_word), F.lit(False))


def source_ranks(sources: DataFrame) -> dict[str, int]:
    """Rank of each source by its folded name, 0 being most trusted; of repeated names the best."""
    ranks: dict[str, int] = {}
    for r in bounded_rows(sources.select(folded("source_name").alias("name"), F.col("authority_rank").alias("rank")), MAX_SOURCES, "sources"):
        if r.name is not None and r["rank"] is not None:
            ranks[r.name] = min(r["rank"], ranks.get(r.name, r["rank"]))
    return ranks


def names_of(sources: Column | str) -> Column:
    """Folded source names of a row, without null and blank."""
    c = F.col(sources) if isinstance(sources, str) else sources
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: folded(s)), lambda s: s.isNotNull())


def trust(names: Column, ranks: dict[str, int]) -> Column:
    """Best rank among folded names; unknown names and no name rank last."""
    known = F.create_map(*[F.lit(x) for p in ranks.items() for x in p]) if ranks else F.create_map().cast("map<string,int>")
    return F.least(F.lit(UNKNOWN_RANK), F.array_min(F.transform(names, lambda n: F.coalesce(F.try_element_at(known, n), F.lit(UNKNOWN_RANK)))))


def survivors(records: DataFrame, group: Column, ranks: dict[str, int]) -> DataFrame:
    """One row per group of at least two records.

    ``records``: record_no, description, sources, published, modified, updated_at; further columns do not matter.
    Result: vuln_id, description_from, published_from, modified_from (each the record_no of the row that serves the
    field best, 0 where none qualifies), all_sources (sorted distinct names joined by ``,``). A time counts only up
    to the row's own updated_at, and a publication only from 1999; where updated_at is null nothing speaks against
    it. Null groups give no row. Names of known sources are gathered as bits, others, which are dirt, as a set. Description: best trust, then latest believed modification, rows without one
    last, then lowest record_no; ties of times by lowest record_no.
    """
    in_time = lambda c: F.when(~F.coalesce(F.col(c) > F.col("updated_at"), F.lit(False)), F.col(c))
    modified, published = in_time("modified"), in_time("published")
    published = F.when(published >= F.lit(EARLIEST_PUBLISHED).cast("timestamp_ntz"), published)
    newest_first = -us_of_ntz(modified)
    names = names_of("sources")
    best = F.struct(trust(names, ranks).alias("rank"), modified.isNull().alias("undated"), newest_first.alias("age"), F.col("record_no").alias("no"))
    rows = records.select(
        group.alias("vuln_id"), F.col("record_no").alias("no"), names.alias("names"),
        F.when(says_something("description"), best).alias("d"),
        F.when(published.isNotNull(), F.struct(published.alias("at"), F.col("record_no").alias("no"))).alias("p"),
        F.when(modified.isNotNull(), F.struct(newest_first.alias("age"), F.col("record_no").alias("no"))).alias("m"),
    ).filter("vuln_id is not null")
    known = sorted(ranks)
    parts = [known[i : i + NAMES_PER_MASK] for i in range(0, len(known), NAMES_PER_MASK)]
    masks = [F.bit_or(sum((F.when(F.array_contains("names", x), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(part)), F.lit(0).cast("bigint"))).alias(f"mask{k}") for k, part in enumerate(parts)]
    others = F.array_except("names", F.array(*[F.lit(x) for x in known]).cast("array<string>"))
    odd = F.collect_set(F.when(F.size(others) > 0, others)).alias("odd")
    chosen = rows.groupBy("vuln_id").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.min("p").alias("p"), F.min("m").alias("m"), odd, *masks)
    marked = lambda part, mask: F.filter(F.array(*[F.lit(x) for x in part]), lambda x, i: F.getbit(mask, i) == 1)
    found = [marked(part, f"mask{k}") for k, part in enumerate(parts)]
    named = F.array_distinct(F.flatten(F.concat(F.col("odd"), F.array(*found)))) if found else F.array_distinct(F.flatten("odd"))
    no = lambda c: F.coalesce(F.col(f"{c}.no"), F.lit(0)).cast("bigint")
    return chosen.filter("n >= 2").select(
        "vuln_id", no("d").alias("description_from"), no("p").alias("published_from"), no("m").alias("modified_from"),
        F.array_join(F.array_sort(named), ",").alias("all_sources"),
    )


def merged_records(records: DataFrame, group: Column, ranks: dict[str, int]) -> DataFrame:
    """The surviving records with their values: the fields of ``survivors`` looked up in the rows that serve them."""
    keyed = records.withColumn("__g", group)
    chosen = survivors(records, group, ranks)
    out = chosen.select("vuln_id", "all_sources", "description_from", "published_from", "modified_from")
    wanted = chosen.select("vuln_id", F.explode(F.array_distinct(F.array("description_from", "published_from", "modified_from"))).alias("record_no"))
    values = keyed.join(wanted, "record_no", "left_semi").select("record_no", "description", "published", "modified")
    wide = wanted.join(values, "record_no").groupBy("vuln_id").agg(F.collect_list(F.struct("record_no", "description", "published", "modified")).alias("v"))
    pick = lambda key, field: F.get(F.filter("v", lambda x: x["record_no"] == F.col(key)), F.lit(0))[field]
    return out.join(wide, "vuln_id", "left").select(
        "vuln_id", pick("description_from", "description").alias("description"), pick("published_from", "published").alias("published"),
        pick("modified_from", "modified").alias("modified"), "all_sources",
    )
