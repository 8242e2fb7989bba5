"""Queries over small tables on which a capped or sampled job gives other rows than the whole one."""

from itertools import product

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F

from advisorium.operators import enrich, matching, packed, scan, zones


def same_rows(name, spark, folder, tables):
    """The query's rows over the folder, after comparing them with the query's SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = entry.queries()[name](spark, str(folder))
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    return got


@pytest.fixture(scope="module")
def hot_lines(tmp_path_factory):
    """2,100 order lines of one part and supplier."""
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS l_orderkey, 1::INTEGER AS l_linenumber, 1::BIGINT AS l_partkey, 2::BIGINT AS l_suppkey, 40.0::DOUBLE AS l_quantity FROM range(2100)) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT 1::BIGINT AS p_partkey, 'Hot Part' AS p_name, 20::INTEGER AS p_size) TO '{folder}/part.parquet' (FORMAT parquet)")
    return folder


def test_every_statement_of_a_hot_key_is_judged(spark, hot_lines):
    assert len(same_rows("scan_findings", spark, hot_lines, ["lineitem", "part"])) == 2100
    assert same_rows("scan_counts", spark, hot_lines, ["lineitem", "part"]) == [("possible", 2100)]


def test_lookup_by_vendor_loses_no_verdict(spark):
    vendors = [None, "", " ", "Acme", "The ACME_Inc", "acme\n", "Äcme", "äcme", "the", "other"]
    ids = [(None, None, None, None), ("npm", None, None, None), (None, "pkg:npm/hot@1", None, None), (None, None, "cpe:2.3:a:acme:hot:1:*:*:*:*:*:*:*", None), (None, None, None, "pkg:npm/hot@1")]
    comps = spark.createDataFrame([(i, "Hot", "1", v, *x) for i, (v, x) in enumerate(product(vendors, ids))], "comp_id long, name string, version string, vendor string, ecosystem string, purl string, cpe string, origin string")
    rows = [(f"CVE-{i}", "f", v, "hOT", e, p, c) for i, (v, (e, p, c)) in enumerate(product(vendors, [(None, None, []), ("npm", None, []), (None, "pkg:npm/hot", []), (None, None, ["cpe:2.3:a:acme:hot:*:*:*:*:*:*:*:*"])]))]
    says = spark.createDataFrame(rows, "vuln_id string, fingerprint string, vendor string, product string, ecosystem string, purl string, cpes array<string>").withColumns(
        {"versions": F.array(F.lit("1")), "ranges": F.lit(None).cast(f"array<{matching.RANGE}>"), "default_state": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}
    )
    verdicts = lambda pairs: sorted((tuple(r) for r in scan.reduce_verdicts(scan.judge(pairs, comps, says)).collect()), key=repr)
    pairs = scan.all_candidates(comps, says)
    whole = comps.select("comp_id").crossJoin(says.select("vuln_id", "fingerprint"))
    assert pairs.count() < whole.count()
    assert verdicts(pairs) == verdicts(whole) != []


def test_parts_of_one_name_are_one_product(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS l_orderkey, 1::INTEGER AS l_linenumber, 1 + range % 3 AS l_partkey, 2::BIGINT AS l_suppkey, 40.0::DOUBLE AS l_quantity FROM range(9)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT 1 + range AS p_partkey, 'Hot Part' AS p_name, 20::INTEGER AS p_size FROM range(3)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    rows = lambda name: same_rows(name, spark, tmp_path, ["lineitem", "part"])
    assert rows("vendor_ranks") == rows("vendor_top") == [("hot-part", "vendor-2", 9)]
    assert rows("scan_counts") == [("possible", 9)]  # part 1 alone has the vendor, and meets the lines of all three
    assert len(rows("scan_findings")) == 9 and len(rows("top_statements")) == 9
    assert len(rows("truncated_lookups")) == 4 and {r[2] for r in rows("service_vendors")} == {"vendor-2"}


def test_last_two_rows_of_one_parity_are_compared(spark, tmp_path):
    rows = [(1, "CVE-2024-0001", "A", 1.0), (3, "cve-2024-0001 ", "B", 1.0), (2, "CVE-2024-0002", "A", 1.0), (5, "CVE-2024-0002", "B", None), (7, "CVE-2024-0002", "B", None), (4, "CVE-2024-0003", "A", None), (6, "", "A", 1.0), (8, "CVE-2024-0004", None, 1.0), (10, "CVE-2024-0004", None, None)]
    values = ", ".join(f"({n}, '{c}', {repr(s) if s else 'NULL'}, {v if v else 'NULL'}, 'd{n}')" for n, c, s, v in rows)
    duckdb.connect().execute(f"COPY (SELECT row_no::BIGINT AS row_no, cve_id, vuln_status, base_score::DOUBLE AS base_score, description FROM (VALUES {values}) t(row_no, cve_id, vuln_status, base_score, description)) TO '{tmp_path}/nvd_cve.parquet' (FORMAT parquet)")
    assert same_rows("snapshot_changes_last", spark, tmp_path, ["nvd_cve"]) == [("CVE-2024-0001", "updated"), ("CVE-2024-0003", "created"), ("CVE-2024-0004", "updated")]


def test_catalogue_is_replaced_by_every_version(spark, tmp_path):
    status = {1: ("2024.01.01", "complete"), 2: ("2024.01.05", "complete"), 3: ("2024.1.3", "complete"), 4: ("2024.01.09", "partial"), 5: ("2024.01.07", "complete"), 6: ("2024.01.08", "complete")}
    entries = [
        (1, 1, "CVE-2024-0001", "", "Known"), (2, 1, "CVE-2024-0002", "old", "Known"), (3, 1, "CVE-2024-0003", "gone", "Known"), (4, 3, "CVE-2024-0001", "late", None), (5, 3, "CVE-2024-0003", None, None),
        (6, 2, "cve-2024-0001", "later", ""), (7, 2, "CVE-2024-0002", "new", "Unknown"), (8, 2, "", "none", "Known"), (9, 4, "CVE-2024-0009", "partial", "Known"), (10, 6, "CVE-2024-0001", "last", None), (11, 6, "CVE-2024-0002", "newest", None), (12, 6, "CVE-2024-0004", None, None), (13, 6, "CVE-2024-0004", "twice", "Known"),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE kev_catalogs (delivery_no BIGINT, catalog_version VARCHAR, fetched_at TIMESTAMP, fetch_status VARCHAR)")
    con.executemany("INSERT INTO kev_catalogs VALUES (?, ?, TIMESTAMP '2024-02-01', ?)", [(n, *x) for n, x in status.items()])
    con.execute("CREATE TABLE kev_entries (entry_no BIGINT, delivery_no BIGINT, cve_id VARCHAR, product VARCHAR, known_ransomware_use VARCHAR)")
    con.executemany("INSERT INTO kev_entries VALUES (?, ?, ?, ?, ?)", entries)
    for t in ("kev_catalogs", "kev_entries"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = same_rows("kev_replace_all", spark, tmp_path, ["kev_catalogs", "kev_entries"])
    kinds = "cve_id string, product string, date_added long, known_ransomware boolean, kev_sources array<string>"
    stored = spark.createDataFrame([], kinds)
    for n in (1, 3, 2, 6):  # in version order; delivery 5 is empty, 4 partial
        first = {}
        for no, _, c, product_, use in (e for e in entries if e[1] == n and e[2]):
            first.setdefault(c.upper(), (c.upper(), product_ or None, no, (use or "").lower() == "known", ["cisa"]))
        stored = spark.createDataFrame(enrich.replace_catalogue(stored, spark.createDataFrame(list(first.values()), kinds), ["cisa"], ["product"]).collect(), kinds)
    assert got == sorted(((*tuple(r)[:4], "cisa") for r in stored.collect()), key=repr)
    assert got == [("CVE-2024-0001", "late", 1, True, "cisa"), ("CVE-2024-0002", "new", 7, False, "cisa"), ("CVE-2024-0004", None, 12, False, "cisa")]


def test_delimiters_are_those_of_the_row_s_source(spark):
    rows = [(i, "a", f"CVE-{i}/CVE-{i + 1}") for i in range(100)] + [(100 + i, s, "GHSA-1/x") for i, s in enumerate(["b", "b", None])]
    df = spark.createDataFrame(rows, "k long, s string, f string")
    got = packed.unpack(df, "k", {"f": packed.ALIAS}, F.col("s")).filter("k >= 99").orderBy("k", "pos").collect()
    assert [tuple(r) for r in got] == [(99, "f", 1, "CVE-99"), (99, "f", 2, "CVE-100")] + [(k, "f", 1, "GHSA-1/x") for k in (100, 101, 102)]


def test_doubtful_zones_are_told(spark):
    sources = spark.createDataFrame([("a", None), ("b", "UTC")], "source_name string, local_zone string")
    rows = [(1, "2024-01-01 12:00:00"), (2, "2024-01-01T03:00:00Z"), (3, "2024-01-01T07:00:00Z")]
    doubt = spark.createDataFrame([(*r, "e") for r in rows], "k long, t string, e string").unionByName(spark.createDataFrame([(4, "2024-01-01 20:00:00", "e")], "k long, t string, e string"))
    normalizer = zones.TimeNormalizer(spark, sources)
    feed = zones.Feed("f", "k", "t", "a", entity=F.col("e"))
    with pytest.warns(UserWarning, match="a: the estimated zone .* violates order 1 times in 2 rows"):
        assert normalizer.normalize([(doubt, feed)]).count() == 4
    lone = [(doubt.filter("k = 1"), feed)]
    with pytest.warns(UserWarning, match="a: no zone"):
        assert normalizer.normalize(lone).count() == 0
    assert [tuple(r) for r in normalizer.unplaced(lone).collect()] == [("f", 1, "2024-01-01 12:00:00")]  # told, not lost
