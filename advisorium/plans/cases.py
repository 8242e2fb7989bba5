"""Queries that put versions of every scheme and statements of every identity channel before the matcher."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.operators import matching
from advisorium.session import table
from advisorium.versions import frames

#: Versions of each scheme in ascending order.
CHAINS = {
    "semver": ("1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "12.0.0"),
    "go": ("v0.9.0", "v1.0.0-pre", "v1.0.0", "v1.0.1", "v1.10.0", "v2.0.0"),
    "debian": ("1.0~beta1-1", "1.0~rc1-1", "1.0-1", "1.0-1+deb11u1", "1.0-2", "1.0a-1", "1.0.1-1", "1.10-1", "1:0.5-1"),
    "rpm": ("1.0~rc1-1", "1.0-1", "1.0-1.el8", "1.0-2", "1.0^git1-1", "1.0a-1", "1.0.1-1", "1.10-1", "1:0.5-1"),
    "alpine": ("1.0_alpha1", "1.0_beta1", "1.0_rc1", "1.0", "1.0-r1", "1.0_p1", "1.0a", "1.0.1", "1.1", "1.10"),
    "maven": ("1.0-alpha-1", "1.0-beta-1", "1.0-milestone-1", "1.0-rc-1", "1.0-SNAPSHOT", "1.0", "1.0-sp-1", "1.0-zulu", "1.0-1", "1.0.1", "1.1", "1.10"),
    "python": ("1.0.dev1", "1.0a1.dev1", "1.0a1", "1.0b1", "1.0rc1", "1.0", "1.0+local.1", "1.0.post1.dev1", "1.0.post1", "1.0.1", "1.10", "1!0.1"),
    "generic": ("1.2", "1.2.1", "1.3", "1.10", "2.0", "2.0.5", "11.0"),
}
#: Pairs that have no order: unknown words, an epoch, no number, and commits.
REFUSED = (
    ("generic", "1.0-red", "1.0-blue"), ("generic", "1.0", "1:2.0"), ("generic", "latest", "1.0"), ("generic", "1.0", "1.0-hotfix"),
    ("opaque", "1.0", "2.0"), ("semver", "0123abc", "1.0.0"), ("debian", "", "1.0"), ("rpm", "unknown", "1.0"),
)


def version_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Order of every two versions of a scheme, by the comparator and, where the scheme has them, by sort keys."""
    pairs = [(s, a, b) for s, chain in CHAINS.items() for a, b in product(chain, chain)] + list(REFUSED)
    both = frames.compared(spark.createDataFrame(pairs, "scheme string, a string, b string"), "scheme", "a", "b")
    for c in ("a", "b"):
        both = frames.with_sort_key(both, "scheme", c, f"key_{c}")
    sign = F.when(F.col("key_a") < F.col("key_b"), -1).when(F.col("key_a") > F.col("key_b"), 1).when(F.col("key_a") == F.col("key_b"), 0)
    return both.select("scheme", "a", "b", F.col("order.cmp").alias("cmp"), F.coalesce(sign, F.col("order.cmp")).alias("by_key"))


# Ecosystem, scheme, range type, how a number becomes a version, type and namespace of the package URL.
SCHEMES = (
    ("npm", "semver", "SEMVER", "", ".0.0", "npm/"), ("PyPI", "python", "PYPI", "", ".0", "pypi/"), ("Maven", "maven", "MAVEN", "", ".0", "maven/org.example/"), ("Go", "go", "GO", "v", ".0.0", "golang/example.org/"),
    ("Debian", "debian", "DEB", "", ".0-1", "deb/debian/"), ("Red Hat", "rpm", "RPM", "", ".0-1.el9", "rpm/redhat/"), ("Alpine", "alpine", "APK", "", ".0-r0", "apk/alpine/"), ("CRAN", "generic", "", "", ".0", "cran/"),
)


def verdict_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every order line as a statement about its part, under a scheme by its order, an identity channel by its place in
    the order and a status by its flag; how many lines get which verdict."""
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])
    joined = lines.join(table(spark, d, "part", ["p_partkey", "p_name", "p_size"]), F.col("l_partkey") == F.col("p_partkey"))
    of = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("eco", "scheme", "type", "head", "tail", "purl"), s)]) for s in SCHEMES])
    n_schemes = len(SCHEMES)
    rows = joined.select(
        "l_linenumber", "l_returnflag", "p_size", F.col("l_quantity").cast("int").alias("high"), F.col("l_linenumber").alias("low"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"),
        F.get(of, (F.col("l_orderkey") % n_schemes).cast("int")).alias("s"), F.get(of, ((F.col("l_orderkey") + 1) % n_schemes).cast("int"))["eco"].alias("other"), F.concat(F.lit("vendor-"), F.col("l_suppkey").cast("string")).alias("maker"),
    )
    version = lambda c: F.concat("s.head", F.col(c).cast("string"), "s.tail")
    at = lambda *places: F.col("l_linenumber").isin(*places)
    none = F.lit(None).cast("string")
    purl, cpe = F.concat(F.lit("pkg:"), "s.purl", F.lower("name")), F.concat(F.lit("cpe:2.3:a:"), "maker", F.lit(":"), F.lower("name"), F.lit(":"))
    component = F.struct(
        F.col("name").alias("name"), version("p_size").alias("version"), F.when(at(4), F.col("maker")).alias("vendor"), F.when(at(2, 7), F.col("s.eco")).alias("ecosystem"),
        F.when(at(1), F.concat(purl, F.lit("@1"))).when(at(6), F.concat(purl, F.lit("-other"))).alias("purl"),
        F.when(at(3), F.concat(cpe, F.lit("1:*:*:*:*:*:*:*"))).alias("cpe"), none.alias("origin"),
    )
    window = F.struct(version("low").alias("introduced"), version("high").alias("fixed"), none.alias("last_affected"), F.col("s.type").alias("type"), none.alias("cpe"), F.lit(False).alias("introduced_exclusive"))
    status = F.when(F.col("l_returnflag") == "N", "known_not_affected").when(F.col("l_returnflag") == "R", "under investigation").otherwise("affected")
    statement = F.struct(
        F.when(at(4), F.upper("maker")).alias("vendor"), F.col("name").alias("product"), F.when(at(2), F.col("s.eco")).when(at(7), F.col("other")).alias("ecosystem"), F.when(at(1, 6), purl).alias("purl"),
        F.when(at(3), F.array(F.concat(cpe, F.lit("*:*:*:*:*:*:*:*")))).otherwise(F.array().cast("array<string>")).alias("cpes"), F.array().cast("array<string>").alias("versions"),
        F.array(window).alias("ranges"), none.alias("default_state"), status.alias("status"), none.alias("source"),
    )
    pairs = rows.select(F.col("s.eco").alias("ecosystem"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("flag"), component.alias("component"), statement.alias("statement"))
    verdicts = matching.with_verdicts(pairs.repartition(spark.sparkContext.defaultParallelism))
    return verdicts.groupBy("ecosystem", "place", "flag", "result", "matched_on", "confidence", "scheme").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"version_pairs": version_pairs, "verdict_matrix": verdict_matrix}

_VALUES = ", ".join(f"('{s}', {i}, '{v}')" for s, chain in CHAINS.items() for i, v in enumerate(chain))
_REFUSED = ", ".join(f"('{s}', '{a}', '{b}')" for s, a, b in REFUSED)
_SCHEMES = ", ".join(f"({i}, '{s[0]}', '{s[1]}')" for i, s in enumerate(SCHEMES))
ORACLES: dict[str, str] = {
    "version_pairs": f"""WITH c AS (SELECT * FROM (VALUES {_VALUES}) t(scheme, at_, v))
      SELECT x.scheme, x.v AS a, y.v AS b, CAST(sign(x.at_ - y.at_) AS INTEGER) AS cmp, CAST(sign(x.at_ - y.at_) AS INTEGER) AS by_key FROM c x JOIN c y ON x.scheme = y.scheme
      UNION ALL SELECT scheme, a, b, NULL, NULL FROM (VALUES {_REFUSED}) r(scheme, a, b)""",
    "verdict_matrix": f"""WITH s AS (SELECT * FROM (VALUES {_SCHEMES}) t(i, eco, scheme)),
      l AS (SELECT s.eco, s.scheme, l_linenumber AS place, l_returnflag AS flag, p_size >= l_linenumber AND p_size < trunc(l_quantity) AS inside
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON s.i = l_orderkey % 8),
      v AS (SELECT eco AS ecosystem, place, flag, CASE WHEN place IN (6, 7) OR NOT inside THEN 'no_match' WHEN flag = 'R' THEN 'undecidable' WHEN flag = 'N' THEN 'suppressed' ELSE 'match' END AS result,
        CASE place WHEN 1 THEN 'purl' WHEN 2 THEN 'ecosystem_name' WHEN 3 THEN 'cpe' WHEN 4 THEN 'vendor_product' WHEN 5 THEN 'name' ELSE '' END AS matched_on,
        CASE WHEN place > 3 THEN 'possible' WHEN scheme = 'generic' THEN 'probable' ELSE 'confirmed' END AS level, CASE WHEN place IN (6, 7) THEN '' ELSE scheme END AS scheme FROM l)
      SELECT ecosystem, place, flag, result, matched_on, CASE WHEN result IN ('match', 'suppressed') THEN level END AS confidence, scheme, count(*) AS n FROM v GROUP BY ALL""",
}
