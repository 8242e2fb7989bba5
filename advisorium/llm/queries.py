"""Queries of the training-data problems, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions.ids import identifier
from advisorium.llm import components, encode, lookalike, packing, survivor
from advisorium.llm.oracles import ORACLES as ORACLES
from advisorium.session import Workspace, table

RECORD_COLUMNS = ["record_no", "id", "description", "sources", "published", "modified", "updated_at"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Which row serves each field of each identifier with several rows."""
    ranks = survivor.source_ranks(table(spark, d, "sources"))
    return survivor.survivors(table(spark, d, "vulnerabilities", RECORD_COLUMNS), identifier("id"), ranks)


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records with their values."""
    ranks = survivor.source_ranks(table(spark, d, "sources"))
    out = survivor.merged_records(table(spark, d, "vulnerabilities", RECORD_COLUMNS), identifier("id"), ranks)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("vuln_id", "description", text("published"), text("modified"), "all_sources")


def identifier_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All statements that two identifiers name one flaw: a, b; b is null for an identifier without a partner."""
    vulns = table(spark, d, "vulnerabilities", ["id", "aliases"])
    stated = table(spark, d, "vuln_aliases", ["alias", "vuln_id"]).select(identifier("alias").alias("a"), identifier("vuln_id").alias("b"))
    own = vulns.select(identifier("id").alias("a"), F.explode_outer("aliases").alias("b")).select("a", identifier("b").alias("b"))
    return stated.unionByName(own)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every identifier with the smallest identifier of its group."""
    pairs = identifier_pairs(spark, d)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("identifier"))
    return components.groups(nodes, components.links(pairs, "a", "b"), "aliases")


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups of identifiers there are of each size."""
    return components.group_sizes(p6_found(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether decoding its ids gives its text, and whether the offsets cover it whole."""
    docs = table(spark, d, "documents", ["doc_id", "text"])
    both = encode.encode_with_offsets(docs, "doc_id", "text")
    back = encode.decode(both, "doc_id")
    spans = both.select("doc_id", F.size("ids").alias("n_tokens"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("covered"))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("given"))
    joined = back.withColumnRenamed("text", "back").join(spans, "doc_id").join(text, "doc_id")
    return joined.select("doc_id", "n_tokens", (F.col("back") == F.col("given")).alias("same"), (F.col("covered") == F.length("given")).alias("whole"))


#: Kinds of text that a model is shown but not taught to write.
CONTEXT_KINDS = ("banner", "raw_json", "patch")


def token_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents measured in tokens; those written by machines bear no loss, all others on every token."""
    sizes = encode.count_tokens(table(spark, d, "documents", ["doc_id", "text", "kind"]), "doc_id", "text", carried=("kind",))
    shown = F.coalesce(F.lower(F.trim("kind")).isin(*CONTEXT_KINDS), F.lit(False))
    return sizes.select("doc_id", "n_tokens", F.when(shown, F.lit(0)).otherwise(F.col("n_tokens")).cast("bigint").alias("loss_tokens"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces with their containers of 2,048 tokens."""
    return packing.pack(token_sizes(spark, d), "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are used."""
    return packing.fill_report(p9_containers(spark, d))


def _prints(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.fingerprints(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    prints = Workspace(spark, "looks").store(_prints(spark, d), "prints")
    return lookalike.look_pairs(prints, "doc_id").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document that shows something with the class of its look."""
    prints = Workspace(spark, "looks").store(_prints(spark, d), "prints")
    return lookalike.look_classes(prints, "doc_id")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its one form."""
    return lookalike.in_one_form(table(spark, d, "documents", ["doc_id", "text"]), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found, "p3_records": p3_records, "p6_found": p6_found, "p6_sizes": p6_sizes, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip,
    "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_classes": p10_classes, "p10_texts": p10_texts,
}
