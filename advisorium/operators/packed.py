"""Several values packed in one text field, one row per value.

First the delimiters of a source are inferred: every candidate is scored over all rows that hold it outside
quotes, by how regular the pieces are that it yields and how consistently it yields several. Then each text is
split by the accepted delimiters, with quoting respected, and exploded with the position kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions.text import as_column, trimmed
from advisorium.functions.times import let
from advisorium.session import bounded_rows, small_enough

#: Up to so many sources are looked up by a broadcast; sets of delimiters that sources accept are few.
MAX_SOURCES = 100_000
MAX_SETS = 200
#: With so many rows the evidence weighs as much as what is expected of a delimiter.
PRIOR_ROWS = 20
# Candidate delimiters by name; the last five are not expected to separate.
CANDIDATES = {
    "line": r"[\r\n]",
    "tab": r"\t",
    "blank": r"[ \u00a0]",
    "comma": r",",
    "semicolon": r";",
    "pipe": r"\|",
    "written line": r"\\[nrt]",
    "tag": r"<[bB][rR] {0,4}/?>",
    "slash": r"/",
    "colon": r":",
    "hyphen": r"-",
    "ampersand": r"&",
    "dot": r"\.",
}
UNEXPECTED = ("slash", "colon", "hyphen", "ampersand", "dot")
# Texts that stand for no value, in lower case.
NO_VALUE = ("-", "--", "?", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "tbd", "[]", "{}", "not assigned", "not available", "...")

QUOTED = r"""(?:"[^"\\]*+(?:(?:\\[\s\S]|"")[^"\\]*+)*+"|'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+')"""
SCHEME = r"(?:https?|ftp)://"


@dataclass(frozen=True)
class PieceType:
    """What a regular piece of a field looks like; ``starts`` is how each begins, if that alone tells pieces apart."""

    regular: str
    starts: str | None = None


ALIAS = PieceType(r"[A-Za-z][A-Za-z0-9_]*(?:-[A-Za-z0-9_.:]+)+")
REFERENCE = PieceType(rf"(?i){SCHEME}\S+", SCHEME)


def _is_regular(kind: PieceType):
    return lambda piece: (piece == '""') | piece.rlike(rf"^(?:{kind.regular})$")


def delimiter_scores(df: DataFrame, columns: dict[str, PieceType], source: Column | None = None) -> DataFrame:
    """Score of each candidate by field and source: field, source, delimiter, n, score in 0 to 1.

    ``n`` counts the rows in which the candidate separates at least two pieces outside quotes; the score is the
    mean share of regular pieces there times the share of rows in which all pieces are regular. One pass with
    partial aggregation: a text is cut by the candidates alone that it holds, and each yields one measurement, so
    that what is aggregated are sums. Quoted stretches count as one regular piece each.
    """
    own = source if source is not None else F.lit("all")
    rows = None
    for field, kind in columns.items():
        masked = let(df.select(own.cast("string").alias("source"), as_column(field).alias("__f")).filter("__f is not null"), __m=F.regexp_replace("__f", QUOTED, "\"\""))
        measured = []
        for name, delimiter in CANDIDATES.items():
            cut = rf"{delimiter}(?=[\"']?{kind.starts})" if kind.starts else delimiter
            parts = F.filter(F.transform(F.split("__m", cut), lambda p: F.regexp_replace(p, r"^[\s,;|\[\]]++|[\s,;|\[\]]++$", "")), lambda p: p != "")
            good = F.transform(parts, lambda p: F.when(_is_regular(kind)(p), 1).otherwise(0))  # noqa: B023
            measured.append(F.when(F.col("__m").rlike(cut), F.struct(F.lit(name).alias("delimiter"), good.alias("good"))))
        each = masked.select("source", F.explode(F.filter(F.array(*measured), lambda m: m.isNotNull())).alias("m")).select("source", "m.delimiter", F.col("m.good").alias("good")).filter(F.size("good") >= 2)
        summed = each.select("source", F.lit(field).alias("field"), "delimiter", (F.aggregate("good", F.lit(0), lambda a, x: a + x) / F.size("good")).alias("share"))
        rows = summed if rows is None else rows.unionByName(summed)
    return rows.groupBy("field", "source", "delimiter").agg(F.count("*").alias("n"), (F.avg("share") * F.avg((F.col("share") == 1).cast("double"))).alias("score"))


def accepted_delimiters(scores: DataFrame, fields: list[str], least: float = 0.5) -> DataFrame:
    """By source the delimiters of each field whose score there reaches ``least``: source, and an array of names per field.

    Scores are drawn towards what is expected of a delimiter, by the weight of ``PRIOR_ROWS`` rows, so that a small
    source is split by the usual delimiters and a large one by what its own rows say. Null is a source of its own.
    """
    expected = F.when(F.col("delimiter").isin(*UNEXPECTED), 0.0).otherwise(1.0)
    drawn = (F.col("score") * F.col("n") + expected * PRIOR_ROWS) / (F.col("n") + PRIOR_ROWS)
    told = scores.select("source", "field", "delimiter", (drawn >= least).alias("good"))
    of = lambda f, good: F.collect_set(F.when((F.col("field") == f) & (F.col("good") == good), F.col("delimiter"))).alias(f"{f}_{good}")  # noqa: E731  at most one per candidate
    per_source = told.groupBy("source").agg(*[of(f, good) for f in fields for good in (True, False)])
    usual = F.array(*[F.lit(d) for d in CANDIDATES if d not in UNEXPECTED])
    every = F.array(*[F.lit(d) for d in CANDIDATES])
    kept = lambda f: F.array_intersect(every, F.array_union(F.array_except(usual, f"{f}_False"), f"{f}_True"))
    return per_source.select("source", *[kept(f).alias(f) for f in fields])


def _unquoted(piece: Column) -> Column:
    """Without enclosing quotes and the escapes inside them."""
    first = F.substring(piece, 1, 1)
    inside = piece.substr(F.lit(2), F.greatest(F.length(piece) - 2, F.lit(0)))
    undone = F.regexp_replace(F.when(first == '"', F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(F.replace(inside, F.lit("''"), F.lit("'"))), r"""\\(["'\\/])""", "$1")
    return F.when(piece.rlike(rf"^{QUOTED}$"), undone).otherwise(piece)


def split_packed(text: Column | str, kind: PieceType, delimiters: list[str]) -> Column:
    """The values of a packed text in the order written, as an array; empty for null, blank and no value.

    A value comes without surrounding blanks, separators and enclosing quotes, escapes inside quotes undone;
    what stands in quotes is one value. Repeated values each count; empty ones do not. Where pieces have a
    ``starts``, a delimiter that neither another piece nor the end follows belongs to the piece.
    """
    text = as_column(text)
    any_of = "(?:" + "|".join([CANDIDATES[d] for d in delimiters] or [CANDIDATES["line"]]) + ")"
    edge = rf"^(?:{any_of}|\s)++|(?:{any_of}|\s)++$"
    if kind.starts:
        listed = trimmed(text).startswith("[")
        quoted = rf"""(?:"\s*{kind.starts}[^"\\]*+(?:(?:\\[\s\S]|"")[^"\\]*+)*+"|'\s*{kind.starts}[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+')"""
        token = rf"""(?i){quoted}|{kind.starts}[\s\S]*?(?={any_of}\s*["']?{kind.starts}|\z)"""
        found = F.regexp_extract_all(F.when(listed, F.regexp_replace(text, r"\]\s*$", "")).otherwise(text), F.lit(token), 0)
    else:
        token = rf"""{any_of}|{QUOTED}|(?:(?!{any_of})[^\s"'\[\]])++"""
        found = F.regexp_extract_all(text, F.lit(token), 0)
    json = F.when(trimmed(text).rlike(r'^\[\s*"[\s\S]*"\s*\]$'), F.from_json(trimmed(text), "array<string>"))
    pieces = F.when(json.isNotNull(), json).otherwise(F.transform(F.transform(found, lambda p: F.regexp_replace(p, edge, "")), _unquoted))
    clean = F.transform(F.filter(pieces, lambda p: p.isNotNull()), lambda p: F.regexp_replace(trimmed(p), edge, ""))
    keep = F.filter(clean, lambda p: (p != "") & ~F.lower(p).isin(*NO_VALUE))
    return F.coalesce(keep, F.array().cast("array<string>"))


def unpack(df: DataFrame, key: str, columns: dict[str, PieceType], source: Column | None = None) -> DataFrame:
    """Infer the delimiters of each field and source over the whole table, then split and explode with position: key,
    field_name, pos from 1, piece. Rows without a value give none.

    Sources that accept the same delimiters are split by the same expression; which one a row takes is looked up by
    its source, in a table that is broadcast where its checked size allows it and joined otherwise. A source of which
    nothing is known has the usual delimiters.
    """
    fields = list(columns)
    own = (source if source is not None else F.lit("all")).cast("string")
    told = accepted_delimiters(delimiter_scores(df, columns, own), fields)
    sets = bounded_rows(told.select(*fields).distinct(), MAX_SETS, "sets of accepted delimiters")
    usual = {f: [d for d in CANDIDATES if d not in UNEXPECTED] for f in fields}
    alike = [usual, *[{f: list(r[f]) for f in fields} for r in sets if any(list(r[f]) != usual[f] for f in fields)]]
    held = df.select(F.col(key).cast("bigint").alias(key), *columns, own.alias("__source"))
    if len(alike) == 1:
        chosen = held.withColumn("__set", F.lit(0))
    else:
        number = F.coalesce(*[F.when(F.concat(*[F.concat_ws(",", f) for f in fields]) == F.lit("".join(",".join(a[f]) for f in fields)), i) for i, a in enumerate(alike)], F.lit(0))
        odd = told.select(F.col("source").alias("__source"), number.alias("__set")).filter("__set != 0")
        chosen = held.join(F.broadcast(odd) if small_enough(odd, MAX_SOURCES) else odd, held["__source"].eqNullSafe(odd["__source"]), "left").select(*[held[c] for c in held.columns], F.coalesce("__set", F.lit(0)).alias("__set"))

    def pieces(f: str, kind: PieceType) -> Column:
        out = split_packed(f, kind, alike[0][f])
        for i, a in enumerate(alike[1:], 1):
            if a[f] != alike[0][f]:
                out = F.when(F.col("__set") == i, split_packed(f, kind, a[f])).otherwise(out)
        return out

    split = [F.struct(F.lit(f).alias("field_name"), pieces(f, kind).alias("pieces")) for f, kind in columns.items()]
    return (
        chosen.select(key, F.inline(F.array(*split)))
        .select(key, "field_name", F.posexplode("pieces").alias("at", "piece"))
        .select(key, "field_name", (F.col("at") + 1).cast("bigint").alias("pos"), "piece")
    )
