"""Text helpers that stay inside Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of Unicode (property White_Space) and the byte order mark.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without the white space at both ends, whatever its kind; null stays null."""
    return F.btrim(as_column(c), F.lit(SPACES))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed, and null where nothing remains."""
    t = trimmed(c)
    return F.when(t != "", t)


def folded(c: Column | str) -> Column:
    """Trimmed and in lower case; null where nothing remains."""
    return F.lower(blank_to_null(c))


def spaces_to_blank(c: Column | str) -> Column:
    """Every white space character as an ordinary blank."""
    return F.translate(as_column(c), SPACES, " " * len(SPACES))


def strip_nul(c: Column | str) -> Column:
    """Text without NUL characters, which a text column may not hold."""
    return F.translate(as_column(c), "\x00", "")


def tokens(c: Column | str) -> Column:
    """Distinct lower-case runs of letters and digits; an empty array for null.

    The tokeniser is part of the contract of full-text filters: everything but letters and digits separates.
    """
    parts = F.split(F.lower(F.coalesce(as_column(c), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
