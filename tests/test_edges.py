"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns for the general problems."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from advisorium.functions import ids, text, times
from advisorium.operators import history, packed, snapdiff, zones


def read(spark, values, zone="America/New_York"):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "no long, t string, epoch_us string")
    known = times.zone_names(spark)
    out = times.add_instant(times.read_times(df, "t", known), "at", zone)
    return [r["at"] for r in out.orderBy("no").collect()]


def us(*a):
    return int((datetime(*a) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_time_texts(spark):
    cases = [
        (None, None), ("", None), (" \t\n", None), ("x" * 1_000_000, None), ("2024", None), ("2024-05", None), ("01/02/2024", None), ("05/05/2024", None),
        ("13/02/2024", us(2024, 2, 13)), ("02/13/2024", us(2024, 2, 13)), ("2024-02-30", None), ("2023-02-29", None), ("2024-02-29", us(2024, 2, 29)), ("2024-01-01T24:00:00Z", None),
        ("2024-01-01T10:61:00Z", None), ("Jan 1, 2024, 13:00:00 PM", None), ("Jan 1, 2024, 12:00:00 AM UTC", us(2024, 1, 1)), ("Jan 1, 2024, 12:30 PM UTC", us(2024, 1, 1, 12, 30)),
        ("2024-03-10 02:30:00", us(2024, 3, 10, 7, 30)), ("2024-11-03 01:30:00", us(2024, 11, 3, 5, 30)), ("2024-07-01T00:00:00+99:00", None), ("2024-07-01T00:00:00.1234567Z", us(2024, 7, 1) + 123456),
        ("2024-07-01 00:00:00 Mars/Base", None), ("2024-07-01 00:00:00 QQQ", None), ("-86400", -86_400_000_000), ("86400", 86_400_000_000), ("202405", None), ("2024123", None), ("12345678901", 12_345_678_901_000_000), ("20240102030405", us(2024, 1, 2, 8, 4, 5)), ("17000000001234", 17_000_000_001_234_000),
        ("2024-01-01T00:00:00." + "7" * 100 + "Z", us(2024, 1, 1) + 777_777), ("2024-01-01T00:00:00Z[" + "x" * 500 + "]", us(2024, 1, 1)), ("2024-01-01T00:00:00 " + "A/" * 100_000, None), ("2024-01-01T00:00:00." + "1" * 200_000 + "!", None), ("1700000000", 1_700_000_000_000_000), ("1700000000123", 1_700_000_000_123_000), ("20240101T000000Z", us(2024, 1, 1)),
        ("1 JAN 2024", us(2024, 1, 1)), ("September 9, 2021 06:43", us(2021, 9, 9, 10, 43)), ("0001-01-01T00:00:00Z", us(1970, 1, 1) - 62_135_596_800_000_000),
    ]
    assert read(spark, [c[0] for c in cases]) == [c[1] for c in cases]
    assert read(spark, ["2024-01-01 10:00:00", "2024-01-01"], None) == [None, us(2024, 1, 1)]
    assert read(spark, []) == []


def test_zone_estimate(spark):
    rows = spark.createDataFrame([("a", us(2024, m, 1, 12), us(2024, m, 1, 16, 59), us(2024, m, 1, 17, 1)) for m in (1, 2, 12)] + [("a", us(2024, 7, 1, 12), us(2024, 7, 1, 15, 59), us(2024, 7, 1, 16, 1)), ("b", us(2024, 7, 1, 12), None, None)], "source string, wall_us long, lower_us long, upper_us long")
    histories = zones.offset_histories(("UTC", "America/New_York", "America/Detroit", "America/Bogota", "Europe/Brussels"))
    best = zones.estimate_zones(zones.zone_evidence(rows), histories, {}).collect()
    assert [tuple(r) for r in best] == [("a", "America/Detroit", None, None, 4, 0)]
    assert {r.zone: r.violations for r in zones.zone_scores(zones.zone_evidence(rows), histories).collect()} == {"America/Detroit": 0, "America/Bogota": 1, "UTC": 4, "Europe/Brussels": 4}
    assert zones.estimate_zones(zones.zone_evidence(rows.limit(0)), histories, {}).collect() == []
    told = zones.estimate_zones(zones.zone_evidence(rows), histories, {"a": "UTC"}).collect()  # a declaration outweighs order
    assert [(r.zone, r.violations) for r in told] == [("UTC", 4)]
    sources = spark.createDataFrame([("a", "Nowhere/City"), ("b", "UTC"), ("c", "America/New_York"), ("d", None)], "source_name string, local_zone string")
    feed = spark.createDataFrame([(1, "2024-01-01 12:00:00", datetime(2024, 1, 1, 17, 1), "2024-01-01T16:59:00Z")], "k long, t string, seen timestamp_ntz, low string")
    got = zones.TimeNormalizer(spark, sources).normalize([(feed, zones.Feed("f", "k", "t", "a", "seen", "low"))]).collect()
    assert [tuple(r) for r in got] == [("f", 1, us(2024, 1, 1, 17))]


def test_a_source_changes_its_zone(spark):
    """Half a year by New York's clock, then half a year by Tokyo's, which no source declares."""
    rows = []
    for i in range(360):
        wall = us(2024, 1 + i // 30, 1 + i % 28, 12)
        at = wall + (5 if (1 + i // 30, 1 + i % 28) < (3, 10) else 4) * 3_600_000_000 if i < 180 else wall - 9 * 3_600_000_000
        rows.append((i, str(datetime(1970, 1, 1) + timedelta(microseconds=wall)), str(datetime(1970, 1, 1) + timedelta(microseconds=at)) + "Z", i))
    df = spark.createDataFrame(rows, "k long, t string, z string, e int")
    both = df.select("k", "t", F.col("e").cast("string").alias("e")).unionByName(df.select((F.col("k") + 1000).alias("k"), F.col("z").alias("t"), F.col("e").cast("string").alias("e")))
    normalizer = zones.TimeNormalizer(spark, spark.createDataFrame([("s", None)], "source_name string, local_zone string"))
    given = [(both, zones.Feed("f", "k", "t", "s", entity=F.col("e")))]
    spans = normalizer.estimate(given)["s"]
    assert len(spans) == 2 and spans[1].zone in ("Asia/Tokyo", "Asia/Chita") and spans[1].from_us == us(2024, 7, 1)
    at = {r.row_no: r.epoch_us for r in normalizer.normalize(given).collect()}
    assert all(at[k] == at[k + 1000] for k in range(360)) and len(at) == 720
    assert normalizer.unplaced(given).count() == 0


def unpack(spark, values, kind):
    df = spark.createDataFrame([(i, v, 7) for i, v in enumerate(values)], "k long, f string, pos int")
    rows = packed.unpack(df, "k", {"f": kind}).orderBy("k", "pos").collect()
    return [[r.piece for r in rows if r.k == i] for i in range(len(values))]


def test_packed_values(spark):
    got = unpack(spark, [
        "CVE-2024-1, CVE-2024-2", "CVE-2024-1\\nCVE-2024-2\\n", "CVE-2024-1<br/>CVE-2024-2", None, "", " \n", "n/a", "[]", '["A-1", "say \\"x\\", y", null, ""]', "'CVE-2024-1';\"a; \"\"b\"\"\"",
        "CVE-2024-1,,CVE-2024-1", '"unclosed CVE-2024-9', "-", "CVE-2024-1 | CVE-2024-2\tX-3-y", "A-1," * 50_000, '"' + "x" * 200_000 + '"', "<br>" * 20_000 + "A-1",
    ], packed.ALIAS)
    assert got[:14] == [["CVE-2024-1", "CVE-2024-2"]] * 3 + [[]] * 5 + [["A-1", 'say "x", y'], ["CVE-2024-1", 'a; "b"'], ["CVE-2024-1", "CVE-2024-1"], ["unclosed", "CVE-2024-9"], [], ["CVE-2024-1", "CVE-2024-2", "X-3-y"]]
    assert len(got[14]) == 50_000 and len(got[15][0]) == 200_000 and got[16] == ["A-1"]


def test_packed_references(spark):
    got = unpack(spark, [
        "https://a/x,y;z https://b", "http://a?to=https://b,ftp://c", '"https://a, https://b"; https://c', "see https://a", "https://a;\\n", "[https://a, https://b]", "none", "https://a/x\thttps://a/x", "https://a" + "/x" * 100_000, '["https:\\/\\/a"]', None,
    ], packed.REFERENCE)
    assert got[:8] == [["https://a/x,y;z", "https://b"], ["http://a?to=https://b", "ftp://c"], ["https://a, https://b", "https://c"], ["https://a"], ["https://a"], ["https://a", "https://b"], [], ["https://a/x", "https://a/x"]]
    assert len(got[8][0]) > 200_000 and got[9:] == [["https://a"], []]
    assert unpack(spark, [], packed.REFERENCE) == []


def test_history_cases(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [
        (1, "A", at(1), at(1), 1), (2, "A", at(2), at(2), 1), (3, "A", at(3), at(3), None), (4, "A", at(3), at(9), 5), (5, "A", at(3), at(9), 6),
        (6, None, at(1), at(1), 1), (7, "B", at(1), at(1), None), (8, "B", at(2), at(2), None), (9, "B", at(4), at(4), None), (10, "C", at(4), at(4), 1), (11, "C", None, at(4), 1), (12, "C", at(4), None, 2),
    ]
    raw = spark.createDataFrame(rows, "no long, e string, s timestamp_ntz, l timestamp_ntz, v int").withColumn("entity", F.lit("clash"))
    spec = history.SnapshotSpec(F.col("e"), "s", "l", {"v": F.col("v")}, "no")
    got = sorted((r.entity, r.v, r.valid_from.day, r.valid_to.day if r.valid_to else None) for r in history.history_with_late_rows(raw, F.col("l") > F.col("s") + F.expr("INTERVAL 1 DAY"), spec, f"file://{tmp_path}/h").collect())
    assert got == [("A", 1, 1, 3), ("A", 6, 3, 4), ("B", None, 1, 3), ("B", None, 4, None), ("C", 1, 4, None)]


def test_snapshot_change_cases(spark, tmp_path):
    rows = [(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", None), (1, 4, None, "z"), (2, 5, "a", "x"), (2, 6, "b", ""), (4, 7, "c", "n")]
    df = spark.createDataFrame(rows, "seq long, no long, k string, v string").withColumn("value_hash", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    index = snapdiff.SnapshotIndex(spark, f"file://{tmp_path}/i", "k", ["v"], "no", 2)
    index.land(df)
    got = sorted((r.to_seq, r.k, r.change_kind) for r in index.changes(index.deliver(1, 2, 3, 4, 5)).filter("from_seq is not null").collect())
    assert got == [(2, "b", "changed"), (3, "a", "removed"), (3, "b", "removed"), (4, "c", "added"), (5, "c", "removed")]
    none = snapdiff.SnapshotIndex(spark, f"file://{tmp_path}/n", "k", ["v"], "no")
    assert none.land(df.limit(0)) == [] and none.changes(none.deliver()).count() == 0


@pytest.mark.parametrize(("given", "want"), [(" cve-2024-0001\n", "CVE-2024-0001"), ("GHSA-ABCD-efgh-1234", "GHSA-abcd-efgh-1234"), ("Cve-0000-0000", None), ("  ", None), (None, None), ("N/A", None), ("rustsec-1", "rustsec-1"), (" CVE-2024-00001　", "CVE-2024-00001")])
def test_identifiers(spark, given, want):
    assert spark.createDataFrame([(given,)], "i string").select(ids.identifier("i")).first()[0] == want


def test_tokens(spark):
    df = spark.createDataFrame([("Ab-c ab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokens("t")).collect()] == [["ab", "c"], [], []]


def test_catalogue_versions(spark):
    from advisorium.plans.problems import catalog_snapshots

    rows = [(1, "2025.8.11", 1, "complete"), (2, " 2025-08-11 ", 2, "Complete "), (3, "v2025.08.09", 1, "complete"), (4, "20250812", 1, "complete"), (5, "2025.08.13", 1, "partial"), (6, "soon", 1, "complete"), (7, None, 1, "complete")]
    df = spark.createDataFrame(rows, "delivery_no long, catalog_version string, fetched_at int, fetch_status string")
    assert [tuple(r) for r in catalog_snapshots(df).orderBy("seq").collect()] == [(1, 3), (2, 2), (3, 4)]
