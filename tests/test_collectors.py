"""Collectors over recorded pages, the book of their runs, and the schedule."""

import io
import json
import lzma
import zipfile
from datetime import datetime, timedelta, timezone

import pytest

from advisorium.sources import collectors as c
from advisorium.streaming import runs

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def run(pages, cursor=None, backfill=False):
    asked = []

    def fetch(url):
        asked.append(url)
        content = pages[url]
        return content if isinstance(content, bytes) else json.dumps(content).encode()

    r = c.Run(fetch, NOW, dict(cursor or {}), backfill)
    r.asked = asked
    return r


def test_cvelist_baseline_and_delta():
    inner = zipped(**{"cves/CVE-2024-1000.json": "{}", "cves/README.json": "{}"})
    release = {"published_at": "2024-05-30T06:00:00Z", "assets": [{"name": "2024-05-30_all_CVEs_at_midnight.zip.zip", "browser_download_url": "u"}]}
    r = run({c.CVELIST_RELEASE: release, "u": zipped(**{"cves.zip": inner})})
    assert [x.record_id for x in c.cvelist(r)] == ["CVE-2024-1000"] and r.cursor == {"since": "2024-05-30T00:00:00Z"}
    with pytest.raises(c.WalkError, match="no records"):
        list(c.cvelist(run({c.CVELIST_RELEASE: release, "u": zipped(a="x")})))
    entry = lambda at, *ids: {"fetchTime": at, "new": [{"cveId": i, "githubLink": i} for i in ids], "updated": []}
    log = [entry("2024-05-31T12:00:00Z", "CVE-2024-2"), entry("2024-05-31T11:00:00Z", "CVE-2024-1", "CVE-2024-1"), entry("2024-05-30T00:00:00Z", "CVE-2024-0")]
    pages = {c.CVELIST_RAW + "delta.json": log[0], c.CVELIST_RAW + "deltaLog.json": log, "CVE-2024-1": {}, "CVE-2024-2": {}}
    r = run(pages, {"since": "2024-05-31T00:00:00Z"})
    assert [x.record_id for x in c.cvelist(r)] == ["CVE-2024-1", "CVE-2024-2"] and r.cursor["since"] == "2024-05-31T12:00:00Z"
    del pages["CVE-2024-2"]
    r = run(pages, {"since": "2024-05-31T00:00:00Z"})
    with pytest.raises(KeyError):
        list(c.cvelist(r))
    assert r.cursor["since"] == "2024-05-31T11:00:00Z"  # the last run of the log that was whole


def test_nvd_pages_and_windows():
    page = lambda total, *ids: {"totalResults": total, "vulnerabilities": [{"cve": {"id": i, "lastModified": "2024-05-20T00:00:00"}} for i in ids]}
    url = lambda at, w="": f"{c.NVD}?resultsPerPage=2000&startIndex={at}{w}"
    r = run({url(0): page(3, "a", "b"), url(2): page(3, "c")})
    assert [x.record_id for x in c.nvd(r)] == ["a", "b", "c"] and r.cursor == {"last_mod": "2024-06-01T00:00:00Z"}
    r = run({url(0): page(3, "a", "b"), url(2): page(3)})
    with pytest.raises(c.WalkError, match="empty"):
        list(c.nvd(r))
    assert r.cursor["resume"] == "2"
    r = run({url(2): page(3, "c")}, r.cursor)
    assert [x.record_id for x in c.nvd(r)] == ["c"]  # goes on where it was cut off
    w = "&lastModStartDate=2024-04-30T23:00:00Z&lastModEndDate=2024-06-01T00:00:00Z"
    r = run({url(0, w): page(1, "a")}, {"last_mod": "2024-05-01T00:00:00Z"})
    assert len(list(c.nvd(r))) == 1 and r.cursor["last_mod"] == "2024-05-20T00:00:00Z"


def test_arrays_are_streamed():
    doc = '{"n": [1], "cve_items" : [ {"id": "a", "x": "]"}, {"id": "b"} ], "z": 1}'
    for chunk in (1, 3, 1000):
        assert [x["id"] for x in c.stream_array(io.StringIO(doc), "cve_items", chunk)] == ["a", "b"]
    for bad in ('{"cve_items": [{"id": "a"}, {"id"', "{}"):
        with pytest.raises(c.WalkError):
            list(c.stream_array(io.StringIO(bad), "cve_items", 4))
    r = run({f"{c.FKIE}CVE-Modified.json.xz": lzma.compress(doc.encode())}, {"since": "2024-05-01T00:00:00Z"})
    assert [x.record_id for x in c.fkie(r)] == ["a", "b"]


def test_osv_delta_and_export():
    pages = {c.OSV + "modified_id.csv": b"2024-05-31T00:00:00Z,npm/A-2\n2024-05-30T00:00:00Z,npm/A-1\n2024-05-01T00:00:00Z,npm/A-0\n", c.OSV + "npm/A-1.json": {"id": "A-1"}, c.OSV + "npm/A-2.json": {"id": "A-2"}}
    r = run(pages, {"last_mod": "2024-05-29T00:00:00Z"})
    assert [x.record_id for x in c.osv(r)] == ["A-1", "A-2"] and r.cursor["last_mod"] == "2024-05-31T00:00:00Z"
    del pages[c.OSV + "npm/A-2.json"]
    r = run(pages, {"last_mod": "2024-05-29T00:00:00Z"})
    with pytest.raises(KeyError):
        list(c.osv(r))
    assert r.cursor["last_mod"] == "2024-05-29T00:00:00Z"  # a record that failed holds the cursor
    r = run({c.OSV + "all.zip": zipped(**{"A-9.json": '{"modified": "2024-05-11T00:00:00Z"}'})})
    assert len(list(c.osv(r))) == 1 and r.cursor["last_mod"] == "2024-05-11T00:00:00Z"


def test_paged_searches():
    url = lambda p: f"{c.EUVD}search?fromUpdatedDate=2024-05-29&toUpdatedDate=2024-06-01&size=100&page={p}"
    items = [{"id": f"EUVD-2024-{i}"} for i in range(150)]
    r = run({url(0): {"items": items[:100], "total": 150}, url(1): {"items": items[100:], "total": 150}}, {"last_run": "2024-05-31T00:00:00Z"})
    assert len(list(c.euvd(r))) == 150 and r.cursor["last_run"] == c.stamp(NOW)
    r = run({url(0): {"items": items[:40], "total": 150}}, {"last_run": "2024-05-31T00:00:00Z"})
    with pytest.raises(c.WalkError, match="40 items"):
        list(c.euvd(r))
    page = lambda p, since: f"{c.GCVE}?since={since}&per_page=25&page={p}"
    full = [{"id": f"GCVE-1-2024-{i}"} for i in range(25)]
    since = "2024-05-31T00:00:00Z"
    r = run({page(p, since): {"data": full, "total": 2000} for p in range(1, 41)}, {"since": since})
    assert len(list(c.gcve(r))) == 1000 and r.cursor["vl_page"] == "41" and r.cursor["vl_started"] == c.stamp(NOW)
    r = run({page(41, since): [{"cveMetadata": {"cveId": "CVE-2024-1"}}]}, r.cursor)
    assert [x.record_id for x in c.gcve(r)] == ["CVE-2024-1"] and r.cursor == {"since": c.stamp(NOW)}
    with pytest.raises(c.WalkError):
        c.page_items({"rows": []})


def test_csaf_providers():
    pages = {
        "https://a/pm.json": {"distributions": [{"rolie": {"feeds": [{"url": "https://a/feed.json"}]}}, {"directory_url": "https://a/dir/"}]},
        "https://a/feed.json": {"feed": {"entry": [{"updated": "2024-05-03T00:00:00Z", "link": [{"rel": "self", "href": "x/three.json"}, {"rel": "hash", "href": "x/three.json.sha256"}]}]}},
        "https://a/dir/changes.csv": b'"one.json","2024-05-01T00:00:00Z"\n"two.json","2024-05-02T00:00:00Z"\n', "https://a/dir/one.json": {}, "https://a/x/three.json": {},
        "https://b/pm.json": {"distributions": [{"directory_url": "https://b/dir"}]}, "https://b/dir/index.txt": b"only.json\nonly.json.asc\n", "https://b/dir/only.json": {},
    }
    r = run(pages)
    got = []
    with pytest.raises(c.WalkError, match="https://a/pm.json"):
        for x in c.csaf(("https://a/pm.json", "https://b/pm.json"))(r):
            got.append(x.record_id)
    assert got == ["one", "only"]  # the first provider ends before what cannot be had, the other is walked
    assert r.cursor["provider:https://a/pm.json"] == "2024-05-01T00:00:00Z"
    pages["https://a/dir/two.json"] = {}
    r = run(pages, r.cursor)
    assert [x.record_id for x in c.csaf_provider(r, "https://a/pm.json")] == ["two", "three"]


def test_ghsa_tags():
    r = run({c.GHSA_ZIP: zipped(**{"db/advisories/unreviewed/GHSA-1.json": "{}", "db/advisories/github-reviewed/GHSA-2.json": '{"database_specific": {"x": 1}}'})})
    assert {x.record_id: json.loads(x.content)["database_specific"]["tag"] for x in c.ghsa(r)} == {"GHSA-1": "github-unreviewed", "GHSA-2": "github-reviewed"}


def test_runs_and_their_book(spark, tmp_path):
    book = runs.SourceBook(spark, f"file://{tmp_path}/book")
    fetch = lambda url: b""

    def collect(run):
        for i in range(3):
            yield c.Raw("osv", str(i), "{}")
        if run.cursor.get("broken") != "no":
            raise c.WalkError("cut off")
        run.cursor["last_mod"] = "2024-06-01T00:00:00Z"

    sink = runs.landing_sink(f"file://{tmp_path}/landing")
    with pytest.raises(c.WalkError):
        runs.run_one(book, "osv", collect, fetch, sink, NOW)
    row = book.sources(["osv", "never"]).collect()
    assert len(row) == 1 and row[0].last_success_at is None and "cut off" in row[0].last_error and row[0].cursor_json == "{}" and row[0].records_seen == 3
    book.save("osv", {"broken": "no"}, 0, NOW)
    later = NOW + timedelta(hours=1)
    refreshed = []
    work = runs.run_one(book, "osv", collect, fetch, sink, later, after=lambda: refreshed.append(1))
    assert (work.seen, work.written, work.failed) == (3, 3, 0) and refreshed == [1]
    row = book.sources(["osv"]).first()
    assert row.last_success_at == c.stamp(later) and row.last_error is None and row.records_seen == 6 and book.load("osv")["last_mod"]

    def refuse(raw):
        raise OSError("disk")

    with pytest.raises(OSError):
        runs.run_one(book, "osv", collect, fetch, refuse, later)
    assert book.sources(["osv"]).first().last_success_at == c.stamp(later) and spark.read.json(f"file://{tmp_path}/landing").count() == 6


def test_schedule(spark, tmp_path):
    due = runs.next_due(["kev", "osv", "nvd"], {"osv": c.stamp(NOW)}, NOW)
    assert due == [(NOW, "kev"), (NOW + timedelta(seconds=40), "nvd"), (NOW + timedelta(minutes=180), "osv")]
    book, now, ran = runs.SourceBook(spark, f"file://{tmp_path}/book"), [NOW], []

    def turn(source):
        ran.append(source)
        book.save(source, {}, 0, now[0], "x" if source == "osv" else None)
        if source == "osv":
            raise OSError("down")

    def sleep(seconds):
        now[0] += timedelta(seconds=60)

    with pytest.warns(UserWarning, match="osv: down"):
        runs.schedule(book, ["kev", "osv"], turn, lambda: len(ran) >= 3, lambda: now[0], sleep)
    assert ran == ["kev", "osv", "kev"]  # kev is due again after an hour, osv after three
