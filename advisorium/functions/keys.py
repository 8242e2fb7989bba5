"""Keys that tell whether two statements, severities or references are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def affected_fingerprint(a: Column) -> Column:
    """128 bits of a hash over all that a statement says, letter case aside; null and empty count alike."""
    text = lambda c: F.coalesce(a[c], F.lit(""))
    listed = lambda c: F.array_join(F.coalesce(a[c], F.array().cast("array<string>")), ",")
    said = [*map(text, ("source", "vendor", "product", "ecosystem", "purl", "status", "default_state")), listed("cpes"), listed("versions"), F.coalesce(F.to_json(a["ranges"]), F.lit("[]"))]
    return F.substring(F.sha2(F.lower(F.concat_ws("|", *said)), 256), 1, 32)


def severity_key(s: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(s[c], F.lit("")) for c in ("type", "provider", "source")])


def reference_key(r: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(r[c], F.lit("")) for c in ("url", "source")])
