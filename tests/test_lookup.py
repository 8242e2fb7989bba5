"""Detail lookup, child rows, the data source over recorded downloads and the cursors of feeds."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from advisorium.operators import detail
from advisorium.operators.listing import ListFilter, effective_limit
from advisorium.sources import bundle, documents, inventory, recorded


def test_detail(spark):
    corpus = spark.createDataFrame([("CVE-2024-0001", "one"), ("CVE-2024-0002", "two")], "id string, title string")
    aliases = spark.createDataFrame([("CVE-2024-0001", "CVE-2024-0001"), ("X-1", "CVE-2024-0001"), ("CVE-2024-0002", "CVE-2024-0001"), ("X-2", "CVE-2024-0001")], "alias string, vuln_id string")
    asked = spark.createDataFrame([("x-0",), (" cve-2024-0002",), ("X-1",), (None,)], "name string")
    found = detail.by_name(asked, aliases, corpus)
    assert sorted((r.name, r.title, r.matched_via) for r in found.collect()) == [(" cve-2024-0002", "two", "id"), ("X-1", "one", "alias")]
    kev = spark.createDataFrame([("X-1", None), ("X-2", datetime(2024, 1, 2))], "cve_id string, date_added timestamp")
    epss = spark.createDataFrame([("X-1", 0.5), ("X-2", 0.5), ("CVE-2024-0001", 0.1)], "cve_id string, score double")
    row = detail.with_side_tables(found, aliases, kev, epss).filter("name = 'X-1'").first()
    assert (row.kev_cve_id, row.epss_cve_id, row.score) == ("X-2", "X-1", 0.5)
    changes = spark.createDataFrame([("CVE-2024-0001", datetime(2024, 1, d), 0, d) for d in (1, 2, 3)], "vuln_id string, changed_at timestamp, batch int, seq int")
    assert [r.seq for r in detail.history_of(spark.createDataFrame([("X-2",)], "name string"), aliases, changes, 2).collect()] == [3, 2]


def test_children(spark):
    doc = {"id": "X-1", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N"}] * 2, "affected": [{"package": {"ecosystem": "npm", "name": "A"}}, {"package": {"ecosystem": "NPM", "name": "a"}}], "references": [{"url": "u"}, {"url": "u"}]}
    s, r, a = detail.children(documents.parse_osv(spark.createDataFrame([(json.dumps(doc),)], "content string")))
    assert (s.count(), r.count(), a.count()) == (1, 1, 1) and s.first().score is None and len(a.first().fingerprint) == 32


def test_recorded_source(spark, tmp_path):
    rec = bundle.Recorder(str(tmp_path))
    for i in range(100):
        rec.record(f"https://x/{i:03d}.json", json.dumps({"i": i}).encode(), captured_at=1.0)
    rec.record("https://x/000.json", b'{"i": 1000}', captured_at=2.0)
    rec.record("https://y/a.txt", b"no", captured_at=1.0)
    spark.dataSource.register(recorded.RecordedSource)
    df = spark.read.format("recorded").option("folder", str(tmp_path)).option("pattern", r"\.json$").load()
    assert df.count() == 100 and df.rdd.getNumPartitions() == 2
    assert df.filter("url = 'https://x/000.json'").first().content == '{"i": 1000}'


def test_cursors():
    d = datetime
    assert recorded.page_windows(d(2024, 1, 1), d(2024, 8, 1)) == [(d(2024, 1, 1), d(2024, 4, 20)), (d(2024, 4, 20), d(2024, 8, 1))]
    assert recorded.page_watermark(d(2024, 2, 1), d(2024, 1, 5)) == d(2024, 1, 5) and recorded.page_watermark(d(2024, 2, 1), None) == d(2024, 2, 1)
    assert recorded.baseline_cut(d(2024, 1, 2), d(2024, 1, 1)) == d(2024, 1, 1) and recorded.baseline_cut(None, None) is None
    assert recorded.resumed_walk({"vl_since": "a", "vl_page": "3", "vl_started": "b"}) == ("a", 3, "b") and recorded.resumed_walk({"vl_page": "x"}) is None
    log = [{"fetchTime": "2", "new": [{"cveId": "A"}], "updated": [{"cveId": "B"}, {"cveId": "A"}]}, {"fetchTime": "1", "new": [{"cveId": "C"}]}, {"fetchTime": "0"}]
    assert recorded.delta_runs(log, "0") == ([["C"], ["A", "B"]], "2")


def test_small_parsers(spark):
    tls = spark.createDataFrame([("CN=my Grafana host",), ("CN=grafanas",), (None,)], "subject string")
    assert [tuple(r) for r in inventory.identify_certificates(tls).collect()] == [("CN=my Grafana host", "grafana", "grafana")]
    e = spark.createDataFrame([(json.dumps({"id": "EUVD-2024-1", "aliases": "GHSA-x\ncve-2024-0001", "exploitedSince": "Jan 2, 2024, 3:04:05 PM"}),), (json.dumps({"id": "EUVD-2024-2"}),)], "content string")
    assert [(r.cve_id, str(r.date_added)) for r in documents.euvd_exploited(e).collect()] == [("CVE-2024-0001", "2024-01-02")]


@pytest.mark.parametrize("bad", [{"min_score": 11}, {"min_score": 5, "max_score": 4}, {"limit": 0}, {"limit": 1001}, {"offset": -1}, {"order_by": "x"}, {"ratings": ("x",)}, {"states": ("DISPUTED",)}, {"text": "a\x00"}, {"extra": {"z": 1}}, {"min_epss": 2}])
def test_filter_is_checked(bad):
    with pytest.raises(ValueError):
        ListFilter(**bad)


def test_limits():
    assert [effective_limit(x) for x in (None, 0, 5, 9999)] == [100, 100, 5, 1000]
