"""Texts that look the same brought to one form, so that comparing them works.

DuckDB runs inside the Arrow batches of a task: one SQL expression removes invisible characters, maps compatibility
forms, spaces and look-alike letters, and composes accents. What a reader can tell apart stays apart: letter case,
accents, raised digits, fractions, dashes and quotation marks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from advisorium.session import ship_package

# Letters of other scripts with the Latin letter of the same shape.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
    # Greek
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "Օ": "O", "Ս": "U",
}
# Ligatures and the letters they show.
LIGATURES = {"ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬁ": "fi", "ﬂ": "fl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "Ǉ": "LJ", "Ǌ": "NJ"}
#: Hyphens that look like the ordinary one, and spaces, as code points.
HYPHENS = (0x2010, 0x2011)
SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
#: Characters that show nothing and move nothing, as a class for regular expressions.
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FE00}-\x{FE0D}\x{FEFF}]"
PICTURE = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}\x{FE0F}\x{1F3FB}-\x{1F3FF}]"
#: Stands for a joiner between two pictures, which makes one picture of them, while others are removed.
JOINED = 0xFDD0


@lru_cache(maxsize=1)
def single_map() -> dict[str, str]:
    """Every character that maps to one other: by rule from widths, spaces, hyphens and look-alikes.

    A composed letter of another script maps to the composition of the look-alike of its base, so that composed and
    decomposed spellings meet.
    """
    out = {chr(c): " " for c in SPACES} | {chr(c): "-" for c in HYPHENS}
    for c in (*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7)):  # full width
        out[chr(c)] = unicodedata.normalize("NFKC", chr(c)).lstrip(" ")[:1] or chr(c)
    out["￣"] = "¯"
    for c in (*range(0xFF61, 0xFFBF), *range(0xFFC2, 0xFFDD)):  # half width
        if len(w := unicodedata.normalize("NFKC", chr(c))) == 1 and unicodedata.name(chr(c), "").startswith("HALFWIDTH"):
            out[chr(c)] = w
    out |= LOOK_ALIKES
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0] in LOOK_ALIKES and len(m := unicodedata.normalize("NFC", LOOK_ALIKES[d[0]] + d[1:])) == 1:
            out[chr(c)] = m
    return out


@lru_cache(maxsize=1)
def several_map() -> dict[str, str]:
    """Composed letters whose look-alike has no composed form: to the letter and its accents apart."""
    out = {}
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0] in LOOK_ALIKES and chr(c) not in single_map():
            out[chr(c)] = LOOK_ALIKES[d[0]] + d[1:]
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(expr: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        expr = f"replace({expr}, {_quoted(a)}, {_quoted(b)})"
    return expr


@lru_cache(maxsize=1)
def one_form_sql() -> str:
    """The query that brings the texts of ``batch`` (row, text) to their one form, in the order of row.

    Texts of ASCII alone only need their line ends; null stays null.
    """
    singles, several = single_map(), several_map()
    kept = "nfc_normalize(text)"
    for _ in range(2):  # a picture between two joiners ends one match and begins the next
        kept = rf"regexp_replace({kept}, '({PICTURE})\x{{200D}}({PICTURE})', '\1{chr(JOINED)}\2', 'g')"
    shown = f"replace(regexp_replace({kept}, '{INVISIBLE}', '', 'g'), {_quoted(chr(JOINED))}, chr(8205))"
    mapped = f"translate({shown}, {_quoted(''.join(singles))}, {_quoted(''.join(singles.values()))})"
    letters = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in (*LIGATURES, *several)) + "]"
    return f"""
        SELECT replace(CASE WHEN plain THEN m WHEN regexp_matches(m, '{letters}') THEN nfc_normalize({_replaced("m", LIGATURES | several)}) ELSE nfc_normalize(m) END, chr(13) || chr(10), chr(10)) AS one_form
        FROM (SELECT "row", strlen(text) = length(text) AS plain, CASE WHEN strlen(text) = length(text) THEN text ELSE {mapped} END AS m FROM batch)
        ORDER BY "row" """


def in_one_form(df: DataFrame, text: str, memory: str = "512MB") -> DataFrame:
    """``df`` with the column ``text`` replaced by its one form, ``one_form``; all other columns pass through.

    Null stays null and an empty text empty; no row is dropped and nothing is shuffled. Each task runs DuckDB with
    one thread and bounded memory over its batches; a batch holds as many rows as the session's Arrow settings say.
    """
    others = [c for c in df.columns if c != text]
    schema = StructType([*[df.schema[c] for c in others], StructField("one_form", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        sql = one_form_sql()
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                con.register("batch", pa.table({"row": pa.array(range(b.num_rows), pa.int64()), "text": b.column(b.num_columns - 1).cast(pa.string())}))
                formed = con.sql(sql).to_arrow_table().column(0)
                con.unregister("batch")
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.concat_arrays([c.cast(pa.string()) for c in formed.chunks])], names=[*others, "one_form"])
        finally:
            con.close()

    ship_package(df.sparkSession)
    return df.select(*others, text).mapInArrow(run, schema)


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """What to compare by: key, look (fingerprint of the one form), chars (of the text's own characters).

    Null texts and texts that show nothing give no row; repeated keys each give theirs. Fingerprints are 128 bits.
    """
    own = df.select(key, F.unhex(F.md5(F.col(text))).alias("chars"), F.col(text).alias("__text"))
    shown = in_one_form(own, "__text").filter(F.length(F.regexp_replace("one_form", r"[\s\p{Z}\p{C}]+", "")) > 0)
    return shown.select(key, F.unhex(F.md5("one_form")).alias("look"), "chars")


def look_classes(prints: DataFrame, key: str) -> DataFrame:
    """One row per document: key, class_id (the look in hex), n_spellings (how many different texts share it)."""
    spellings = prints.select("look", "chars").distinct().groupBy("look").agg(F.count("*").alias("n_spellings"))
    return prints.join(spellings, "look").select(key, F.lower(F.hex("look")).alias("class_id"), "n_spellings")


#: A spelling with more documents than this share of all is hot; there are at most 1 / share such spellings.
HOT_SHARE = 1 / 2000
#: Documents of a hot spelling per salt.
PER_SALT = 10_000


def look_pairs(prints: DataFrame, key: str) -> DataFrame:
    """Pairs of documents that look the same but differ in their characters: a, b with a < b.

    Spellings are paired first, one row each however many documents share one, and documents join the pairs of
    their spelling; copies of one spelling never meet each other. Only looks with more than one spelling are
    shuffled beyond a first aggregation. The documents of a hot spelling are spread over salts, and the pairs that
    ask for them are repeated once for each; hot spellings are looked up by a broadcast whose size their share bounds.
    """
    ends = prints.groupBy("look").agg(F.min("chars").alias("low"), F.max("chars").alias("high"))
    several = prints.join(ends.filter("low != high").select("look"), "look", "left_semi")
    spellings = several.groupBy("look", "chars").agg(F.count("*").alias("n"))
    threshold = max(PER_SALT, int(prints.count() * HOT_SHARE))
    salts = lambda n: F.when(n > threshold, F.ceil(n / PER_SALT)).otherwise(1).cast("int")
    hot = F.broadcast(spellings.filter(F.col("n") > threshold).select("look", "chars", salts(F.col("n")).alias("salts")))
    salted = several.join(hot, ["look", "chars"], "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.col("salts"))).cast("int"))
    each = F.sequence(F.lit(0), salts(F.col("n")) - 1)
    side = lambda of: spellings.select("look", F.col("chars").alias(f"chars_{of}"), each.alias(f"salts_{of}"))
    pairs = side("a").join(side("b"), "look").filter("chars_a < chars_b")
    a = salted.select("look", F.col("chars").alias("chars_a"), F.col("salt").alias("salt_a"), F.col(key).alias("x"))
    b = salted.select("look", F.col("chars").alias("chars_b"), F.col("salt").alias("salt_b"), F.col(key).alias("y"))
    first = pairs.withColumn("salt_a", F.explode("salts_a")).drop("salts_a").join(a, ["look", "chars_a", "salt_a"])
    both = first.withColumn("salt_b", F.explode("salts_b")).drop("salts_b").join(b, ["look", "chars_b", "salt_b"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
