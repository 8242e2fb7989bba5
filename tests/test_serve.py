"""The HTTP reader without a network, settings, the command line, and what inventories gained."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from advisorium import config, serve
from advisorium.__main__ import main
from advisorium.sinks import exports
from advisorium.sources import bundle, collectors, documents, inventory
from advisorium.streaming import runs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('served')}"
    assert serve.bootstrap(spark, folder) == ["vulnerabilities", "aliases", "kev", "epss", "changes"] and serve.bootstrap(spark, folder) == []
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    known = spark.read.parquet(f"{folder}/vulnerabilities.parquet").schema
    at = datetime(2024, 5, 1)
    row = lambda i, score, **more: tuple(({"record_no": i, "id": f"CVE-2024-{1000 + i}", "title": f'a "title" {i}', "state": "PUBLISHED", "modified": at, "published": at, "primary_score": score, "primary_rating": "HIGH", "sources": ["nvd"], "in_kev": False} | more).get(f.name) for f in known)
    write("vulnerabilities", [row(i, float(i)) for i in range(1, 6)], known)
    write("aliases", [("GHSA-aaaa-bbbb-cccc", "CVE-2024-1001"), ("CVE-2024-1001", "CVE-2024-1001")], "alias string, vuln_id string")
    write("changes", [("CVE-2024-1001", "created", at, 1, 1)], "vuln_id string, change_kind string, changed_at timestamp, batch long, seq long")
    said = spark.sql("select 'CVE-2024-1001' as vuln_id, 'f' as fingerprint, cast(null as string) as vendor, 'left-pad' as product, 'npm' as ecosystem, cast(null as string) as purl, cast(array() as array<string>) as cpes, cast(array() as array<string>) as versions, array(named_struct('introduced', '0', 'fixed', '2.0.0', 'last_affected', cast(null as string), 'type', 'SEMVER', 'cpe', cast(null as string), 'introduced_exclusive', false)) as ranges, cast(null as string) as default_state, cast(null as string) as status, 'osv' as source")
    said.write.parquet(f"{folder}/statements.parquet")
    return serve.Tables(spark, folder)


def ask(tables, target, method="GET", body=b"", token="", **headers):
    a = serve.respond(tables, config.Settings(token=token), method, target, headers, body)
    return a.status, "".join(a.pieces)


def test_routes(tables):
    assert json.loads(ask(tables, "/healthz")[1]) == {"status": "ok"} and ask(tables, "/readyz")[0] == 200
    listed = json.loads(ask(tables, "/v1/vulns?min_score=3&order_by=score&limit=2&offset=1")[1])
    assert listed["total"] == 3 and [r["id"] for r in listed["items"]] == ["CVE-2024-1004", "CVE-2024-1003"]
    assert json.loads(ask(tables, "/v1/vulns?product=LEFT-PAD")[1])["total"] == 1
    one = json.loads(ask(tables, "/v1/vulns/ghsa-AAAA-bbbb-cccc")[1])
    assert one["id"] == "CVE-2024-1001" and one["matched_via"] == "alias"
    assert ask(tables, "/v1/vulns/CVE-1999-0001")[0] == 404
    assert len(json.loads(ask(tables, "/v1/vulns/CVE-2024-1001/history")[1])["items"]) == 1
    assert len(ask(tables, "/v1/export")[1].splitlines()) == 5
    csv = ask(tables, "/v1/export?format=csv")[1].splitlines()
    assert len(csv) == 6 and csv[1].startswith('"CVE-2024-1001","a ""title"" 1"')
    stats = json.loads(ask(tables, "/v1/stats")[1])
    assert stats["vulnerabilities"] == 5 and stats["by_source"] == [{"source": "nvd", "n": 5}]
    assert json.loads(ask(tables, "/v1/sources")[1]) == {"items": []} and len(json.loads(ask(tables, "/v1/attribution")[1])["items"]) == 11
    assert ask(tables, "/v1/feed.atom?limit=2")[1].count("<entry>") == 2


def test_refusals(tables):
    assert ask(tables, "/v1/vulns?nothing=1")[0] == 400 and ask(tables, "/v1/vulns?min_score=x")[0] == 400 and ask(tables, "/v1/export?format=xml")[0] == 400
    assert ask(tables, "/v1/none")[0] == 404 and ask(tables, "/v1/stats", "POST")[0] == 405 and ask(tables, "/v1/scan/target", "POST")[0] == 403
    assert ask(tables, "/v1/none", token="t")[0] == 401 and ask(tables, "/v1/none", token="t", Authorization="Bearer t")[0] == 404 and ask(tables, "/healthz", token="t")[0] == 200


def test_scan_by_post(tables):
    bom = {"bomFormat": "CycloneDX", "components": [{"name": "left-pad", "version": v, "purl": f"pkg:npm/left-pad@{v}"} for v in ("1.3.0", "2.0.0")]}
    status, text = ask(tables, "/v1/scan", "POST", json.dumps(bom).encode())
    assert status == 200 and [(f["vuln_id"], f["confidence"]) for f in json.loads(text)["findings"]] == [("CVE-2024-1001", "confirmed")]
    assert json.loads(text)["by_confidence"] == {"confirmed": 1}
    assert ask(tables, "/v1/scan", "POST", b"<xml/>")[0] == 400


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# no\nexport ADVISORIUM_TOKEN='x'\nADVISORIUM_SOURCES=nvd, osv\nADVISORIUM_PAGE_LIMIT=7\n")
    s = config.load({"ADVISORIUM_PAGE_LIMIT": "9"}, str(env))
    assert (s.token, s.sources, s.page_limit, s.folder) == ("x", ("nvd", "osv"), 9, "data")
    for bad in ({"ADVISORIUM_PAGE_LIMIT": "-1"}, {"ADVISORIUM_SCAN_MINIMUM": "maybe"}):
        with pytest.raises(ValueError):
            config.load(bad, str(tmp_path / "none"))


def test_collect_from_a_bundle(spark, tmp_path, capsys):
    rec = bundle.Recorder(str(tmp_path / "b"))
    rec.record(f"{collectors.FKIE}CVE-Modified.json.xz", __import__("lzma").compress(b'{"cve_items": [{"id": "CVE-2024-1"}]}'), captured_at=1.0)
    rec.record("https://x/api?from=2024-01-01&n=1", b"old", captured_at=1.0)
    rec.record("https://x/api?from=2024-03-01&n=1", b"new", captured_at=1.0)
    fetch = bundle.fetcher(str(tmp_path / "b"))
    assert fetch("https://x/api?from=2024-02-27&n=1") == b"new" and fetch("https://x/api?from=2024-01-01&n=1") == b"old"
    with pytest.raises(KeyError):
        fetch("https://x/other")
    runs.SourceBook(spark, f"{tmp_path}/state/runs").save("fkie", {"since": "2024-01-01T00:00:00Z"}, 0, datetime(2024, 1, 1))
    assert main(["collect", str(tmp_path / "b"), f"{tmp_path}/state", "fkie"]) == 0
    assert main(["sources", f"{tmp_path}/state"]) == 0 and main(["sources", f"{tmp_path}/state", "--terms"]) == 0 and main(["migrate", f"{tmp_path}/m"]) == 0
    out = capsys.readouterr().out
    assert "fkie\tseen 1\twritten 1\tfailed 0" in out and "ENISA" in out
    assert spark.read.json(f"{tmp_path}/state/fkie/landing").first().record_id == "CVE-2024-1"


def test_services_become_components(spark):
    rows = [("10.0.0.1", 80, "apache", "http_server", "2.4.57"), ("fe80::1", 22, "openbsd", "openssh", None), ("fe80::1", 443, "a b", "x:y*z", "1.0~1")]
    got = inventory.service_components(spark.createDataFrame(rows, "ip string, port int, vendor string, product string, version string")).orderBy("name").collect()
    assert [(r.name, r.origin, r.cpe) for r in got] == [("http_server", "10.0.0.1:80", "cpe:2.3:a:apache:http_server:2.4.57:*:*:*:*:*:*:*"), ("x:y*z", "[fe80::1]:443", r"cpe:2.3:a:a_b:x\:y\*z:1.0\~1:*:*:*:*:*:*:*")]


def test_greetings(spark):
    lines = [
        "SSH-2.0-OpenSSH_9.6p1 Debian-3", "SSH-2.0-OpenSSH", "SSH-2.0-dropbear_2022.83", "HTTP/1.1 200 OK\r\nServer: Apache/2.4.58 (Unix)\r\nX-Powered-By: PHP/8.2.1\r\n", "Server: Jetty(11.0.18)", "Server: nginx", "Server: cloudthing/1",
        "220 (vsFTPd 3.0.5)", "220 mail.example ESMTP Exim 4.97 Mon", "220 FileZilla Server 1.8.0", "220 host ESMTP Postfix (2.1)", "+OK Dovecot ready.", "* OK mail Cyrus IMAP 3.8.1 server ready", "redis_version:7.2.4\r\n", "J\x005.7.44-log\x00abcmysql_native_password", None, "", "220 nobody",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, banner string")
    got = sorted((r.i, r.product, r.version) for r in inventory.identify_banners(df).collect())
    assert got == [
        (0, "openssh", "9.6p1"), (1, "openssh", None), (2, "dropbear_ssh", "2022.83"), (3, "http_server", "2.4.58"), (3, "php", "8.2.1"), (4, "jetty", "11.0.18"), (5, "nginx", None), (7, "vsftpd", "3.0.5"),
        (8, "exim", "4.97"), (9, "filezilla_server", "1.8.0"), (10, "postfix", None), (11, "dovecot", None), (12, "imap", "3.8.1"), (13, "redis", "7.2.4"), (14, "mysql", "5.7.44"),
    ]


def test_port_lists(spark):
    port = lambda n, state: f'<port protocol="tcp" portid="{n}"><state state="{state}"/></port>'
    host = lambda ip, *ports: f'<host><address addr="{ip}" addrtype="ipv4"/><ports>{"".join(ports)}</ports></host>'
    xml = f"<nmaprun>{host('10.0.0.10', port(22, 'open'), port(23, 'closed'))}{host('10.0.0.9', port(80, 'open'))}</nmaprun>"
    states = [tuple(r) for r in inventory.nmap_states(spark.createDataFrame([("a", xml)], "path string, content string")).collect()]
    assert states == [("10.0.0.9", 1, 0), ("10.0.0.10", 1, 1)]
    found = '[{"ip": "1.1.1.1", "ports": [{"port": 443, "proto": "tcp", "status": "open"}]}, {"ip": "1.1.1.2", "ports": [{"port": 22, "proto": "tcp", "status": "open"}, {"port": 443, "proto": "tcp", "status": "open"}]},]'
    assert inventory.flat_ports(spark.createDataFrame([("a", found)], "path string, content string")) == [22, 443]
    assert inventory.frequent_ports("# c\nhttp 80/tcp 0.48\nssh 22/tcp 0.18\ndns 53/udp 0.9\nhttps 443/tcp 0.2\n", 2) == [80, 443]


def test_local_inventory(spark, tmp_path):
    (tmp_path / "etc").mkdir()
    (tmp_path / "etc/os-release").write_text('ID=debian\nVERSION_ID="12"\n')
    (tmp_path / "var/lib/dpkg").mkdir(parents=True)
    (tmp_path / "var/lib/dpkg/status").write_text("Package: g++\nStatus: install ok installed\nVersion: 1:12.2-3\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n")
    got = serve.local_inventory(spark, str(tmp_path)).collect()
    assert [(r.name, r.version, r.ecosystem, r.purl) for r in got] == [("g++", "1:12.2-3", "Debian:12", "pkg:deb/debian/g%2B%2B@1:12.2-3")]


def test_report(spark):
    df = spark.createDataFrame([(f"CVE-2024-{i:04}", "x", "possible", "name") for i in range(1_500)], "vuln_id string, name string, confidence string, matched_on string").orderBy("vuln_id")
    lines = list(exports.report_lines(df))
    assert len(lines) == 1_501 and lines[-1] == "1500 findings"
    assert json.loads("".join(exports.report_json(df)))["total"] == 1_500 and json.loads("".join(exports.report_json(df.limit(0))))["findings"] == []


def test_assigner_statements(spark):
    v = lambda **k: {"version": None, "status": None, "lessThan": None, "lessThanOrEqual": None} | k
    data = [
        {"vendor": "acme", "product": "n/a", "packageName": None, "versions": [v(version="1", lessThan="2"), v(version="3", status="affected"), v(version="1.5", status="unaffected"), v(version="9", status="unknown"), v(version="n/a")]},
        {"vendor": "N/A", "product": "", "packageName": "pkg", "versions": [v(version="0", lessThanOrEqual="4", status="UNAFFECTED")]}, {"vendor": "n/a", "product": "n/a", "packageName": None, "versions": None},
    ]
    raw = spark.createDataFrame([(json.dumps({"id": "CVE-2024-1", "affected": [{"affectedData": data}]}),)], "content string")
    a = documents.parse_nvd(raw).select(F.inline("affected")).collect()
    brief = [(r.vendor, r.product, r.status, r.versions, [(x.introduced, x.fixed, x.last_affected) for x in r.ranges]) for r in a]
    assert brief == [("acme", "", None, ["3"], [("1", "2", None)]), ("acme", "", "not_affected", ["1.5"], []), ("", "pkg", None, [], []), ("", "pkg", "not_affected", [], [("0", None, "4")])]
