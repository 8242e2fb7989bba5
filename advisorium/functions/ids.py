"""Identifiers of flaws: one spelling, namespaces and stand-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisorium.functions.text import as_column, trimmed

# Shapes of the identifiers whose letter case carries no meaning.
UPPER_SHAPE = r"(?i)^(CVE-\d{4}-\d{4,}|EUVD-\d{4}-\d+|GCVE-\d+-\d{4}-\d+)$"
GHSA_SHAPE = r"(?i)^GHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}$"
CVE_SHAPE = r"(?i)^CVE-\d{4}-\d{4,}$"
EUVD_SHAPE = r"(?i)^EUVD-\d{4}-\d+$"
GCVE_SHAPE = r"(?i)^GCVE-\d+-\d{4}-\d+$"

# Texts that feeds put where they have no identifier, in lower case.
STAND_INS = (
    "-", "--", "?", "...", "n/a", "na", "n.a.", "nil", "none", "null", "unknown", "tbd", "tba", "todo",
    "pending", "unassigned", "not assigned", "not available", "undefined", "no cve", "cve-xxxx-xxxx",
    "cve-yyyy-nnnn", "ghsa-xxxx-xxxx-xxxx",
)
ZERO_SHAPE = r"(?i)^(CVE|EUVD|GCVE|GHSA)(-0+)+$"


def normalized_id(c: Column | str) -> Column:
    """One spelling per identifier.

    Trimmed; CVE, EUVD and GCVE identifiers in upper case, GHSA as ``GHSA-`` and a lower-case rest, all others
    only trimmed. Null stays null, and a blank text becomes the empty text.
    """
    t = trimmed(c)
    return (
        F.when(t.rlike(UPPER_SHAPE), F.upper(t))
        .when(t.rlike(GHSA_SHAPE), F.concat(F.lit("GHSA-"), F.lower(F.substring(t, 6, 100))))
        .otherwise(t)
    )


def names_a_flaw(c: Column | str) -> Column:
    """False for null, blank and stand-ins, which are no identifiers and link nothing."""
    t = F.lower(trimmed(c))
    return F.coalesce((t != "") & ~t.isin(*STAND_INS) & ~t.rlike(ZERO_SHAPE), F.lit(False))


def identifier(c: Column | str) -> Column:
    """The normalised identifier, or null where the text names no flaw."""
    return F.when(names_a_flaw(c), normalized_id(c))


def namespace_rank(c: Column | str) -> Column:
    """Which namespace gives a cluster its name: CVE 0, GHSA 1, EUVD 2, GCVE 3, any other 4."""
    t = trimmed(c)
    return (
        F.when(t.rlike(CVE_SHAPE), 0)
        .when(t.rlike(GHSA_SHAPE), 1)
        .when(t.rlike(EUVD_SHAPE), 2)
        .when(t.rlike(GCVE_SHAPE), 3)
        .otherwise(4)
    )


def distinct_texts(c: Column | str) -> Column:
    """Sorted distinct trimmed texts of an array, without null and blank; an empty array for null."""
    parts = F.filter(F.transform(F.coalesce(as_column(c), F.array().cast("array<string>")), lambda x: trimmed(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(parts))


def all_identifiers(own: Column | str, aliases: Column | str) -> Column:
    """Own identifier and aliases, normalised, distinct and sorted."""
    listed = F.concat(F.array(as_column(own)), F.coalesce(as_column(aliases), F.array().cast("array<string>")))
    return distinct_texts(F.transform(F.filter(listed, lambda x: x.isNotNull()), lambda x: normalized_id(x)))
