"""Readers of inventories, archives and feeds."""

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from advisorium.sources import feeds, inventory

BOM = {"bomFormat": "CycloneDX", "metadata": {"component": {"name": "host", "version": 5}}, "components": [
    {"group": "org.apache", "name": "log4j-core", "version": "2.14.1", "purl": "pkg:maven/org.apache/log4j-core@2.14.1", "components": [{"name": "inner", "publisher": "P", "evidence": {"identity": {"field": "cpe", "concludedValue": "cpe:/a:p:inner"}}}]},
    {"version": "1"}]}
SPDX = {"spdxVersion": "SPDX-2.3", "packages": [{"SPDXID": "S", "name": "lib", "versionInfo": "NOASSERTION", "supplier": "Organization: Acme (a@b)", "externalRefs": [{"referenceCategory": "SECURITY", "referenceType": "cpe22Type", "referenceLocator": "cpe:/a:x"}, {"referenceCategory": "PACKAGE_MANAGER", "referenceType": "purl", "referenceLocator": "pkg:npm/%40s/lib@3"}]}]}


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string")


def test_inventories(spark):
    raw = [json.dumps(BOM).encode(), gzip.compress(json.dumps(SPDX).encode()), b"# c\npkg:pypi/A_b@1\n\npkg:npm/x@2\n", b'["pkg:gem/r@1"]', b"<bom/>", json.dumps({"spdxVersion": "SPDX-3.0"}).encode(), b"no\nno\nno", b"", None, b"\x1f\x8bbroken", b"{"]
    df = spark.createDataFrame([(f"f{i}", r) for i, r in enumerate(raw)], "path string, content binary")
    got = {}
    for r in inventory.read_inventories(df).collect():
        got.setdefault(r.path, []).append(r)
    assert [(c.name, c.version, c.vendor, c.cpe) for c in got["f0"]] == [("host", "5", None, None), ("org.apache:log4j-core", "2.14.1", "org.apache", None), ("inner", None, "P", "cpe:/a:p:inner")]
    assert [(c.name, c.version, c.vendor, c.ecosystem, c.cpe) for c in got["f1"]] == [("@s/lib", "3", "Acme", "npm", "cpe:/a:x")]
    assert [(c.name, c.ecosystem) for c in got["f2"]] == [("a-b", "PyPI"), ("x", "npm")] and got["f3"][0].ecosystem == "RubyGems"
    assert all(got[f"f{i}"][0].refused for i in (4, 5, 6, 9, 10)) and "f7" not in got


def test_package_databases(spark):
    tuples = lambda df: sorted((r.name, r.version) for r in df.collect())
    status = "Package: curl\nStatus: install ok installed\nSource: curl-src (7.1)\nVersion: 7.0\nVersion: 9\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n"
    assert tuples(inventory.read_dpkg_status(files(spark, status))) == [("curl", "7.0"), ("curl-src", "7.1")]
    assert tuples(inventory.read_dpkg_query(files(spark, "ii \tbash\t5.1\tamd64\tbash\t5.1\nrc \told\t1\tamd64\t\t\n"))) == [("bash", "5.1")]
    assert tuples(inventory.read_rpm_query(files(spark, "kernel\t0\t5.14\t1.el9\tx86_64\tk.src\nvim\t2\t9\t1\tx\ty\ngpg-pubkey\t0\t1\t1\t\t\n\n"))) == [("kernel", "5.14-1.el9"), ("vim", "2:9-1")]
    assert tuples(inventory.read_apk_installed(files(spark, "P:musl\nV:1.2-r0\no:musl\n\nP:ssl\nV:3-r1\no:openssl\n"))) == [("musl", "1.2-r0"), ("openssl", "3-r1"), ("ssl", "3-r1")]
    assert tuples(inventory.read_apk_info(files(spark, "musl-1.2.3-r0\nlib-x-2-r10\njunk\n"))) == [("lib-x", "2-r10"), ("musl", "1.2.3-r0")]
    assert inventory.os_release('ID=debian\nNAME="De\\"b"\nbad line\n') == {"ID": "debian", "NAME": 'De"b'}


def test_service_scans(spark):
    banners = ["SSH-2.0-OpenSSH_9.3p2 Example-1", "HTTP/1.1 200\r\nServer: Apache/2.4.49 (Unix)\r\nX-Powered-By: PHP/7.4.1", "Server: nginx", "220 mx ESMTP Postfix", "redis_version:6.2.1", "", None, "what"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(banners)], "port int, banner string")
    got = [(r.port, r.product, r.version) for r in inventory.identify_banners(df).orderBy("port", "product").collect()]
    assert got == [(0, "openssh", "9.3p2"), (1, "http_server", "2.4.49"), (1, "php", "7.4.1"), (2, "nginx", None), (3, "postfix", None), (4, "redis", "6.2.1")]
    one = inventory.identify_banners(df).select(inventory.service_cpe(F.col("vendor"), F.col("product"), F.col("version")).alias("c")).filter("c like '%nginx%'").first()
    assert one.c == "cpe:2.3:a:f5:nginx:*:*:*:*:*:*:*:*"
    mass = '[{"ip":"1.2.3.4","ports":[{"port":443,"proto":"tcp","status":"open"}]},{"ip":"1.2.3.4","ports":[{"port":80,"proto":"tcp","status":"open"},{"port":81,"proto":"udp","status":"open"}]},\n]'
    assert [(r.ip, r.ports) for r in inventory.read_masscan(files(spark, mass)).collect()] == [("1.2.3.4", [80, 443])]
    nmap = '<nmaprun><host><address addr="AA" addrtype="mac"/><address addr="10.0.0.1" addrtype="ipv4"/><ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh" product="OpenSSH" version="8"><cpe>cpe:/a:openbsd:openssh:8</cpe></service></port><port protocol="tcp" portid="23"><state state="closed"/></port></ports></host></nmaprun>'
    assert [tuple(r) for r in inventory.read_nmap(files(spark, nmap)).collect()] == [("10.0.0.1", 22, "ssh", "OpenSSH", "8", "cpe:/a:openbsd:openssh:8")]
    assert inventory.parse_ports("80, 22-24,top:1", [443]) == [22, 23, 24, 80, 443] and len(inventory.parse_ports("all")) == 65535
    assert list(inventory.expand_network("10.0.0.0/30")) == ["10.0.0.1", "10.0.0.2"] and list(inventory.expand_network("::1")) == ["::1"]
    with pytest.raises(ValueError):
        inventory.parse_ports("0-5")


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "."), c)
    return out.getvalue()


def test_archives(spark):
    inner = zipped(a__json="{}", b__txt="x")
    df = spark.createDataFrame([("p", zipped(c__json="[1]", deep__zip=inner)), ("bad", b"no zip"), ("none", None)], "path string, content binary")
    got = sorted((r.path, r.member, r.content, bool(r.error)) for r in feeds.read_archives(df).collect())
    assert got == [("bad", "", None, True), ("none", "", None, True), ("p", "c.json", "[1]", False), ("p", "deep.zip!a.json", "{}", False)]


def test_feeds(spark, tmp_path):
    (tmp_path / "epss.csv.gz").write_bytes(gzip.compress(b"#model_version:v2031.01.02,score_date:2025-06-01T00:00:00+0000\ncve,epss,percentile\nCVE-2024-1000,0.5,0.9\ncve-2024-1001,0.1,0.2\n"))
    got = [(r.cve_id, r.score, r.model_version, str(r.score_date)) for r in feeds.read_epss(spark, str(tmp_path / "epss.csv.gz")).collect()]
    assert got == [("CVE-2024-1000", 0.5, "v2031.01.02", "2025-06-01"), ("CVE-2024-1001", 0.1, "v2031.01.02", "2025-06-01")]
    with pytest.raises(ValueError):
        feeds.enough_rows(spark.range(4), 10)
    (tmp_path / "ids.csv").write_text("2099-01-01T00:00:00Z,npm/future\n2024-02-01T00:00:00Z,npm/GHSA-b\n2024-01-01T00:00:00Z,npm/GHSA-a\n")
    fresh, many = feeds.changed_ids(spark, str(tmp_path / "ids.csv"), F.to_timestamp(F.lit("2024-01-15")))
    assert [r.id for r in fresh.collect()] == ["GHSA-b"] and not many
    rolie = json.dumps({"feed": {"entry": [{"updated": "2024", "link": [{"href": "a.json"}, {"href": "a.json.asc"}], "content": {"src": "a.json"}}]}})
    assert [tuple(r) for r in feeds.rolie_entries(files(spark, rolie)).collect()] == [("a.json", "2024")]
    import hashlib

    good = hashlib.sha256(b"x").hexdigest()
    side = spark.createDataFrame([(1, "x", good + "  f"), (2, "x", "0" * 64), (3, "x", None), (4, "x", "short")], "k int, content string, sidecar string")
    assert sorted(r.k for r in feeds.verified(side).collect()) == [1, 3, 4]
    assert feeds.replayed_cursor({"since": "2024-05-05T00:00:00Z", "etag_main": "x", "resume": "500", "mode": "full"}, "2020-01-01T00:00:00Z") == {"since": "2020-01-01T00:00:00Z", "mode": "full"}
