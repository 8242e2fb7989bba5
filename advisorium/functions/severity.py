"""Scores, ratings and vectors of severities, and the vocabulary of statuses, as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisorium.functions.text import as_column

# Weights of the published CVSS formulas, and words of the status and rating vocabularies.
V3 = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}}
V3_PR = {"N": 0.85, "L": 0.62, "H": 0.27}
V3_PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}
V3_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
V2 = {"AV": {"L": 0.395, "A": 0.646, "N": 1.0}, "AC": {"H": 0.35, "M": 0.61, "L": 0.71}, "AU": {"M": 0.45, "S": 0.56, "N": 0.704}}
V2_CIA = {"N": 0.0, "P": 0.275, "C": 0.660}
STATUS_WORDS = {
    "affected": ("affected", "known_affected", "vulnerable"),
    "not_affected": ("not_affected", "unaffected", "known_not_affected", "not_vulnerable"),
    "fixed": ("fixed", "first_fixed", "patched", "resolved"),
    "under_investigation": ("under_investigation", "investigating", "unknown"),
    "conditional": ("conditional",),
}
TYPE_RANKS = ("CVSS_V4_0", "CVSS_V3_1", "CVSS_V3_0", "CVSS_V2", "OTHER")
SOURCE_RANKS = ("cvelist", "vulnrichment", "nvd", "fkie", "csaf", "euvd", "gcve", "ghsa", "osv")


def _pick(value: Column, words: dict) -> Column:
    out = None
    for k, v in words.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out


def status_word(c: Column | str) -> Column:
    """One of the five statuses; the empty text for an unknown word and null."""
    t = F.lower(F.trim(F.replace(as_column(c), F.lit(" "), F.lit("_"))))
    return F.coalesce(_pick(t, {w: s for s, words in STATUS_WORDS.items() for w in words}), F.lit(""))


def rating(score: Column | str, v2: bool = False) -> Column:
    """Rating of a score: NONE for 0 and below; version 2 has no CRITICAL. Null stays null."""
    s = as_column(score)
    out = F.when(s <= 0, "NONE").when(s < 4, "LOW").when(s < 7, "MEDIUM")
    return (out if v2 else out.when(s < 9, "HIGH")).when(s.isNotNull(), "HIGH" if v2 else "CRITICAL")


def vector_type(vector: Column | str) -> Column:
    """Type of a vector; OTHER for anything else."""
    v = F.coalesce(as_column(vector), F.lit(""))
    return (
        F.when(v.startswith("CVSS:4.0"), "CVSS_V4_0").when(v.startswith("CVSS:3.1"), "CVSS_V3_1").when(v.startswith("CVSS:3.0"), "CVSS_V3_0")
        .when(v.startswith("AV:"), "CVSS_V2").otherwise("OTHER")
    )


def vector_metric(vector: Column, name: str) -> Column:
    """Value of a metric in a vector; of a repeated metric the last counts. The empty text where it is missing."""
    return F.regexp_extract(F.concat(F.lit("/"), F.upper(vector)), rf".*/\s*{name}\s*:\s*([^/]*?)\s*(?:/|$)", 1)


def base_score(vector: Column | str) -> Column:
    """Base score of a version 2, 3.0 or 3.1 vector; null where a metric is missing, and for version 4.

    3.1 rounds up on integers of five decimals, 3.0 up and 2 half up to one decimal.
    """
    v = F.trim(as_column(vector))
    m = lambda n: vector_metric(v, n)
    weights = {n: _pick(m(n.upper()), w) for n, w in (("av", V3["AV"]), ("ac", V3["AC"]), ("ui", V3["UI"]), ("pr", V3_PR))}
    weights |= {f"{n}2": _pick(m(n.upper()), w) for n, w in (("av", V2["AV"]), ("ac", V2["AC"]), ("au", V2["AU"]))}
    weights["pr_changed"] = _pick(m("PR"), V3_PR_CHANGED)
    weights |= {f"{n}{k}": _pick(m(n.upper()), w) for n in "cia" for k, w in ((3, V3_CIA), (2, V2_CIA))}
    given = F.array(F.struct(vector_type(v).alias("kind"), (m("S") == "C").alias("changed"), *[w.alias(n) for n, w in weights.items()]))

    # One step per transform, so that no step is repeated inside the next.
    def losses(w: Column) -> Column:
        left = lambda k: 1 - (1 - w[f"c{k}"]) * (1 - w[f"i{k}"]) * (1 - w[f"a{k}"])
        easy = F.lit(8.22) * w["av"] * w["ac"] * F.when(w["changed"], w["pr_changed"]).otherwise(w["pr"]) * w["ui"]
        return F.struct(w["kind"].alias("kind"), w["changed"].alias("changed"), left(3).alias("iss"), easy.alias("easy"), (10.41 * left(2)).alias("impact2"), (F.lit(20.0) * w["av2"] * w["ac2"] * w["au2"]).alias("easy2"))

    def impacts(w: Column) -> Column:
        impact = F.when(w["changed"], 7.52 * (w["iss"] - 0.029) - 3.25 * F.pow(w["iss"] - 0.02, F.lit(15))).otherwise(6.42 * w["iss"])
        total2 = (0.6 * w["impact2"] + 0.4 * w["easy2"] - 1.5) * F.when(w["impact2"] == 0, 0.0).otherwise(1.176)
        return F.struct(w["kind"].alias("kind"), w["changed"].alias("changed"), impact.alias("impact"), w["easy"].alias("easy"), total2.alias("total2"))

    def totals(w: Column) -> Column:
        total = (w["impact"] + w["easy"]) * F.when(w["changed"], 1.08).otherwise(1.0)
        return F.struct(w["kind"].alias("kind"), ((w["impact"] <= 0) & w["easy"].isNotNull()).alias("harmless"), total.alias("total"), w["total2"].alias("total2"))

    def rounding(w: Column) -> Column:
        raw = F.when(w["total"] > 10, 10.0).otherwise(w["total"])  # keeps null, which least() would pass over
        return F.struct(w["kind"].alias("kind"), w["harmless"].alias("harmless"), raw.alias("raw"), F.round(raw * 100_000).cast("bigint").alias("whole"), F.when(w["total2"] < 0, 0.0).otherwise(w["total2"]).alias("raw2"))

    def scores(w: Column) -> Column:
        up31 = F.when(w["whole"] % 10_000 == 0, w["whole"] / 100_000).otherwise((F.floor(w["whole"] / 10_000) + 1) / 10)
        v3 = F.when(w["harmless"], 0.0).when(w["kind"] == "CVSS_V3_1", up31).otherwise(F.ceil(w["raw"] * 10) / 10)
        # Version 2 rounds half up, as its published tables do.
        return F.when(w["kind"].isin("CVSS_V3_0", "CVSS_V3_1"), v3).when(w["kind"] == "CVSS_V2", F.floor(w["raw2"] * 10 + 0.5) / 10)

    out = given
    for step in (losses, impacts, totals, rounding, scores):
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def qualitative_band(c: Column | str) -> Column:
    """NONE, LOW, MEDIUM (also MODERATE), HIGH or CRITICAL; the empty text for other words."""
    t = F.upper(F.trim(as_column(c)))
    return F.when(t == "MODERATE", "MEDIUM").when(t.isin("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"), t).otherwise("")


def type_rank(c: Column) -> Column:
    """Preference among severity types; unknown types last."""
    return F.coalesce(_pick(c, {t: i for i, t in enumerate(TYPE_RANKS)}), F.lit(len(TYPE_RANKS)))


def source_rank(c: Column) -> Column:
    """Authority of a source, 0 being most trusted; other names 100."""
    return F.coalesce(_pick(c, {s: i for i, s in enumerate(SOURCE_RANKS)}), F.lit(100))


def primary_severity(severities: Column | str) -> Column:
    """The severity to show: scored ones first, then by type, source and position. Null for none."""
    ranked = F.transform(
        as_column(severities),
        lambda s, at: F.struct((F.coalesce(s["score"], F.lit(0.0)) <= 0).alias("unscored"), type_rank(s["type"]).alias("t"), source_rank(s["source"]).alias("r"), at.alias("at"), s.alias("s")),
    )
    # The first four fields are unique by position, so the severity itself never decides.
    return F.array_min(ranked)["s"]
