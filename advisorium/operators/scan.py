"""Scan of an inventory: candidates by four identity channels, verdicts, reduction per component and flaw, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from advisorium.functions.packages import folded_vendor, purl_key
from advisorium.operators.matching import with_verdicts

#: Parts that the statements of one key are ranked in before they are ranked together.
SALTS = 32
RANKS = {"confirmed": 3, "probable": 2, "possible": 1}


def channel_keys(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the lookup keys of the four channels; ``name`` is the column that holds the product name."""
    present = lambda c: F.when(F.trim(c) != "", F.lower(c))
    return df.withColumns({
        "k_purl": F.when(F.trim("purl") != "", purl_key("purl")),
        "k_eco": F.when(present("ecosystem").isNotNull() & present(name).isNotNull(), F.concat_ws("\x1f", F.lower("ecosystem"), F.lower(name))),
        "k_vendor": F.when(present("vendor").isNotNull() & present(name).isNotNull(), F.concat_ws("\x1f", F.lower("vendor"), F.lower(name))),
        "k_name": present(name),
    })


CHANNELS = ("k_purl", "k_eco", "k_vendor", "k_name")


def _exploded(df: DataFrame, kept: list[str], channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row per channel and key."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("key")) for c in channels]), lambda p: p["key"].isNotNull())
    return df.select(*kept, F.inline(pairs))


def candidates(components: DataFrame, statements: DataFrame, per_key: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs comp_id, vuln_id, fingerprint; truncated comp_id, channel, n_statements).

    Only keys that some component asks for are looked up, so a hot name that nobody has costs nothing. With
    ``per_key`` a key gives its first so many statements, and the second table tells which lookups were cut; without
    it nothing is. The first statements of a key are found in two steps, per salt and then per key, so that no task
    sorts all statements of a hot name. A pair found by several channels counts once. Null and blank fields give no key.
    """
    asked = _exploded(channel_keys(components, "name"), ["comp_id"])
    wanted = asked.select("channel", "key").distinct()
    offered = _exploded(channel_keys(statements, "product"), ["vuln_id", "fingerprint"]).join(wanted, ["channel", "key"], "left_semi")
    sizes = offered.groupBy("channel", "key").agg(F.count("*").alias("n_statements"))
    first = offered
    if per_key is not None:
        first = offered.withColumn("salt", F.pmod(F.xxhash64("vuln_id", "fingerprint"), F.lit(SALTS)))
        for by in (["channel", "key", "salt"], ["channel", "key"]):
            w = Window.partitionBy(*by).orderBy("vuln_id", "fingerprint")
            first = first.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= per_key).drop("at")
        first = first.drop("salt")
    cut = sizes.filter(F.col("n_statements") > per_key) if per_key is not None else sizes.limit(0)
    pairs = asked.join(first, ["channel", "key"]).select("comp_id", "vuln_id", "fingerprint").distinct()
    return pairs, asked.join(cut, ["channel", "key"]).select("comp_id", "channel", "n_statements").distinct()


def all_candidates(components: DataFrame, statements: DataFrame) -> DataFrame:
    """Pairs comp_id, vuln_id, fingerprint of every statement that the four channels offer and that can be about the component.

    There is no cap, so the bare name finds whatever ecosystem or vendor with name would. A component with a vendor
    and without package URL, ecosystem and platform name is told by vendor and name alone (``matching.identify``): it
    asks for the statements of its folded vendor (``k_own``) and for those whose vendor is absent or not plain ASCII
    (``k_open``); all others under its name are no match. Adaptive execution splits the join of a hot key.
    """
    plain = F.coalesce(F.col("vendor").rlike(r"\A[\x20-\x7e]+\z"), F.lit(False))  # folded alike here and in Python
    bound = plain & (F.concat(*[F.coalesce(c, F.lit("")) for c in ("purl", "origin", "ecosystem", "cpe")]) == "")
    own = F.when(F.col("k_name").isNotNull(), F.concat_ws("\x1f", "k_name", folded_vendor("vendor")))
    kinds = ("k_purl", "k_own", "k_open", "k_name")
    asks = channel_keys(components, "name").withColumns({"k_own": F.when(bound, own), "k_open": F.when(bound, F.col("k_name")), "k_name": F.when(~bound, F.col("k_name"))})
    says = channel_keys(statements, "product").withColumns({"k_own": F.when(plain, own), "k_open": F.when(~plain, F.col("k_name"))})
    asked = _exploded(asks, ["comp_id"], kinds)
    wanted = asked.select("channel", "key").distinct()
    offered = _exploded(says, ["vuln_id", "fingerprint"], kinds).join(wanted, ["channel", "key"], "left_semi")
    return asked.join(offered, ["channel", "key"]).select("comp_id", "vuln_id", "fingerprint").distinct()


def judge(pairs: DataFrame, components: DataFrame, statements: DataFrame) -> DataFrame:
    """Verdicts of candidate pairs: comp_id, vuln_id, fingerprint and the verdict's columns."""
    own = F.struct(*[F.col(c).cast("string").alias(c) for c in ("name", "version", "vendor", "ecosystem", "purl", "cpe", "origin")]).alias("component")
    said = F.struct("vendor", "product", "ecosystem", "purl", "cpes", "versions", "ranges", "default_state", "status", "source").alias("statement")
    asked = pairs.join(components.select("comp_id", own), "comp_id").repartition("vuln_id", "fingerprint")
    both = asked.join(statements.select("vuln_id", "fingerprint", said), ["vuln_id", "fingerprint"])
    return with_verdicts(both.select("comp_id", "vuln_id", "fingerprint", "component", "statement"))


def reduce_verdicts(verdicts: DataFrame, minimum: str = "possible") -> DataFrame:
    """One row per component and flaw: outcome ``finding``, ``suppressed`` or ``undecidable``, confidence, matched_on, retired_by.

    Matches below ``minimum`` do not count. The strongest suppression retires a finding that is not stronger.
    Undecidable pairs count only where nothing suppresses and nothing matches; a flaw with suppressions alone gives
    no row. One aggregation with partial results: no group of verdicts is ever held as a whole.
    """
    rank = F.coalesce(*[F.when(F.col("confidence") == c, r) for c, r in RANKS.items()], F.lit(0))
    strongest = lambda result, least: F.min(F.when((F.col("result") == result) & (rank >= least), F.struct((-rank).alias("r"), F.col("fingerprint").alias("by"), "matched_on", "confidence")))
    best = verdicts.groupBy("comp_id", "vuln_id").agg(
        strongest("match", RANKS[minimum]).alias("m"), strongest("suppressed", 0).alias("s"),
        F.min(F.when(F.col("result") == "undecidable", F.struct("fingerprint", "matched_on", "review"))).alias("u"),
    )
    retired = F.col("s").isNotNull() & (F.col("s.r") <= F.col("m.r"))
    outcome = (
        F.when(F.col("m").isNotNull() & retired, "suppressed").when(F.col("m").isNotNull(), "finding")
        .when(F.col("u").isNotNull() & F.col("s").isNull(), "undecidable")
    )
    return best.select(
        "comp_id", "vuln_id", outcome.alias("outcome"), F.col("m.confidence").alias("confidence"), F.coalesce("m.matched_on", "u.matched_on").alias("matched_on"),
        F.when(F.col("m").isNotNull(), F.col("s.by")).alias("retired_by"), F.when(F.col("m").isNull(), F.col("u.review")).alias("review"),
    ).filter("outcome is not null")


def ordered_findings(findings: DataFrame, summaries: DataFrame, names: DataFrame) -> DataFrame:
    """Findings with their flaw's summary in report order: exploited first, then confidence, epss, score, flaw, name, component."""
    rank = F.coalesce(*[F.when(F.col("confidence") == c, r) for c, r in RANKS.items()], F.lit(0))
    full = findings.filter("outcome = 'finding'").join(summaries, "vuln_id", "left").join(names, "comp_id", "left")
    return full.orderBy(F.coalesce("in_kev", F.lit(False)).desc(), rank.desc(), F.coalesce("epss_score", F.lit(0.0)).desc(), F.coalesce("primary_score", F.lit(0.0)).desc(), "vuln_id", "name", "comp_id")


def confidence_counts(findings: DataFrame) -> DataFrame:
    """How many findings there are of each confidence."""
    return findings.filter("outcome = 'finding'").groupBy("confidence").agg(F.count("*").alias("n"))


def dedupe_components(components: DataFrame) -> DataFrame:
    """Components that say the same count once; the lowest comp_id stands."""
    keys = [F.coalesce(F.lower(F.col(c)), F.lit("")).alias(f"d_{c}") for c in ("name", "version", "ecosystem", "cpe", "vendor")]
    bare = F.coalesce(F.split_part("purl", F.lit("?"), F.lit(1)), F.lit("")).alias("d_purl")
    first = components.select("comp_id", bare, *keys).groupBy("d_purl", *[f"d_{c}" for c in ("name", "version", "ecosystem", "cpe", "vendor")]).agg(F.min("comp_id").alias("comp_id"))
    return components.join(first.select("comp_id"), "comp_id", "left_semi")
