"""Verdicts of hand-made cases, the candidate cap, the reduction, and score formulas."""

import pytest
from pyspark.sql import functions as F

from advisorium.functions import packages, severity
from advisorium.operators import matching, scan


def component(**k):
    return dict.fromkeys(("name", "version", "vendor", "ecosystem", "purl", "cpe", "origin")) | k


def window(introduced=None, fixed=None, last=None, kind=None, cpe=None, exclusive=False):
    return {"introduced": introduced, "fixed": fixed, "last_affected": last, "type": kind, "cpe": cpe, "introduced_exclusive": exclusive}


def statement(*ranges, **k):
    base = dict.fromkeys(("vendor", "product", "ecosystem", "purl", "cpes", "versions", "default_state", "status", "source"))
    return base | {"ranges": list(ranges)} | k


NPM = component(name="tinymd", version="3.7.9", purl="pkg:npm/tinymd@3.7.9")
DEB = component(name="openssl", version="3.0.2-0ubuntu1", ecosystem="Ubuntu:22.04")
CPE = component(name="http_server", version="2.4.49", cpe="cpe:2.3:a:apache:http_server:2.4.49:*:*:*:*:*:*:*")
NPM_ROW = {"purl": "pkg:npm/tinymd", "ecosystem": "npm"}
CASES = [
    (NPM, statement(window("0", "3.7.10", kind="SEMVER"), **NPM_ROW), ("match", "purl", "confirmed", "semver", "")),
    (NPM | {"version": "3.7.10"}, statement(window("0", "3.7.10", kind="SEMVER"), **NPM_ROW), ("no_match", "purl", None, "semver", "out_of_range")),
    (NPM, statement(window("0", "3.7.10"), purl="pkg:npm/other", product="tinymd"), ("no_match", "", None, "", "purl_mismatch")),
    (NPM | {"version": None}, statement(window("0", "5"), **NPM_ROW), ("undecidable", "purl", None, "", "no_component_version")),
    (NPM, statement(**NPM_ROW), ("undecidable", "purl", None, "", "no_version_data")),
    (NPM, statement(window("0", "5"), status="not_affected", **NPM_ROW), ("suppressed", "purl", "confirmed", "semver", "not_affected")),
    (NPM, statement(window("0", "5"), status="investigating", **NPM_ROW), ("undecidable", "purl", None, "semver", "status_under_investigation")),
    (NPM, statement(window("0", "5"), status="conditional", **NPM_ROW), ("undecidable", "purl", None, "semver", "conditional_applicability")),
    (NPM, statement(window(None, "unknown"), **NPM_ROW), ("undecidable", "purl", None, "semver", "sentinel_upper_bound")),
    (NPM, statement(window("0"), **NPM_ROW), ("match", "purl", "possible", "semver", "")),
    (NPM, statement(window("abcdef1", "abcdef2", kind="GIT"), **NPM_ROW), ("undecidable", "purl", None, "opaque", "opaque_scheme:GIT")),
    (NPM, statement(versions=["3.7.9"], **NPM_ROW), ("match", "purl", "confirmed", "semver", "")),
    (NPM, statement(versions=["4.0.8"], **NPM_ROW), ("undecidable", "purl", None, "semver", "open_version_enumeration")),
    (NPM, statement(versions=["4.0.8"], source="cvelist", default_state="unaffected", **NPM_ROW), ("no_match", "purl", None, "semver", "out_of_range")),
    (NPM, statement(versions=["4.0.8"], source="cvelist", default_state="affected", **NPM_ROW), ("match", "purl", "possible", "semver", "")),
    (NPM, statement(window("5"), source="fkie", **NPM_ROW), ("undecidable", "purl", None, "semver", "unknown_default_status")),
    (DEB, statement(window(None, "3.0.2-0ubuntu1.1"), ecosystem="Ubuntu:22.04", product="openssl"), ("match", "ecosystem_name", "confirmed", "debian", "")),
    (DEB, statement(window(None, "3.0.2-0ubuntu1.1"), ecosystem="Ubuntu:20.04", product="openssl"), ("no_match", "", None, "", "release_conflict")),
    (DEB, statement(window(None, "9"), ecosystem="Debian:12", product="openssl"), ("no_match", "", None, "", "ecosystem_conflict")),
    (DEB, statement(window("1"), ecosystem="Ubuntu:22.04", product="openssl"), ("match", "ecosystem_name", "probable", "debian", "")),
    (DEB, statement(window(None, "1:3.1"), ecosystem="Ubuntu:22.04", product="openssl"), ("match", "ecosystem_name", "probable", "debian", "")),
    (DEB, statement(window(None, "9"), product="OpenSSL"), ("undecidable", "name", None, "debian", "distro_package_upstream_statement")),
    (DEB, statement(window(None, "9"), ecosystem="Ubuntu:jammy", product="openssl"), ("match", "ecosystem_name", "possible", "debian", "")),
    (CPE, statement(cpes=["cpe:2.3:a:apache:http_server:2.4.49:*:*:*:*:*:*:*"], source="nvd"), ("match", "cpe", "probable", "generic", "")),
    (CPE, statement(cpes=["cpe:2.3:a:apache:http_server:2.4.50:*:*:*:*:*:*:*"], source="nvd"), ("no_match", "cpe", None, "generic", "out_of_range")),
    (CPE, statement(cpes=["cpe:2.3:a:apache:tomcat:*:*:*:*:*:*:*:*"], product="http_server"), ("no_match", "", None, "", "cpe_mismatch")),
    (CPE, statement(window("2.4.0", "2.4.51"), cpes=["cpe:2.3:a:apache:http_server:*:*:*:*:*:linux:*:*"]), ("match", "cpe", "possible", "generic", "")),
    (CPE, statement(window("2.4.49", "2.4.51", exclusive=True), cpes=["cpe:/a:apache:http_server"]), ("no_match", "cpe", None, "generic", "out_of_range")),
    (CPE, statement(cpes=["cpe:2.3:a:apache:http_server:2.4.*:*:*:*:*:*:*:*"]), ("match", "cpe", "possible", "opaque", "")),
    (component(name="Big_Tool", vendor="The Acme Corp", version="1.0"), statement(window("0", "2"), vendor="acme", product="big tool"), ("match", "vendor_product", "possible", "generic", "")),
    (component(name="x", version="1.0-a"), statement(window("0", "1.0-b"), product="x"), ("undecidable", "name", None, "generic", "generic_refused_tie")),
    (component(), statement(), ("no_match", "", None, "", "no_channel")),
    (component(name="musl", version="1.2.3-r0", ecosystem="Alpine:v3.18"), statement(window("0", "0"), ecosystem="Alpine:v3.18", product="musl"), ("no_match", "ecosystem_name", None, "alpine", "out_of_range")),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_verdict(at):
    c, a, want = CASES[at]
    assert matching.evaluate(c, a)[:5] == want


def test_verdicts_in_spark(spark):
    schema = f"at int, component {matching.COMPONENT}, statement {matching.STATEMENT}"
    pairs = spark.createDataFrame([(i, c, a) for i, (c, a, _) in enumerate(CASES)], schema)
    got = {r["at"]: tuple(r)[1:6] for r in matching.with_verdicts(pairs).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for *_, w in CASES]
    assert matching.with_verdicts(pairs.limit(0)).count() == 0


def test_candidates_and_reduction(spark):
    comps = spark.createDataFrame([(1, "hot", "1", None, "npm", None, None, None), (2, None, "1", None, None, "pkg:npm/rare@1?a=b", None, None), (3, "cold", "1", "v", None, None, None, None)], "comp_id long, name string, version string, vendor string, ecosystem string, purl string, cpe string, origin string")
    rows = [(f"CVE-2024-{i:04d}", "f", None, "Hot", "NPM", None) for i in range(5)] + [("CVE-2024-0009", "f", None, "x", None, "pkg:npm/rare"), ("CVE-2024-0010", "f", "V", "COLD", None, None), ("CVE-2024-0011", "f", None, None, None, None)]
    says = spark.createDataFrame(rows, "vuln_id string, fingerprint string, vendor string, product string, ecosystem string, purl string").withColumns(
        {"cpes": F.array().cast("array<string>"), "versions": F.array(F.lit("1")), "ranges": F.lit(None).cast(f"array<{matching.RANGE}>"), "default_state": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}
    )
    pairs, cut = scan.candidates(comps, says, per_key=3)
    assert sorted(tuple(r)[:2] for r in pairs.collect()) == [(1, f"CVE-2024-{i:04d}") for i in range(3)] + [(2, "CVE-2024-0009"), (3, "CVE-2024-0010")]
    assert sorted(tuple(r) for r in cut.collect()) == [(1, "k_eco", 5), (1, "k_name", 5)]
    judged = scan.judge(pairs, comps, says)
    assert judged.filter("result = 'match'").count() == 5
    verdicts = spark.createDataFrame(
        [(1, "a", "f1", "match", "probable"), (1, "a", "f2", "match", "confirmed"), (1, "a", "f3", "suppressed", "probable"), (1, "b", "f1", "match", "possible"), (1, "b", "f2", "suppressed", "possible"),
         (1, "c", "f1", "undecidable", None), (1, "d", "f1", "suppressed", "confirmed"), (1, "e", "f1", "undecidable", None), (1, "e", "f2", "suppressed", "possible"), (1, "g", "f1", "no_match", None)],
        "comp_id long, vuln_id string, fingerprint string, result string, confidence string",
    ).withColumns({"matched_on": F.lit("purl"), "review": F.lit("r")})
    got = {r.vuln_id: (r.outcome, r.confidence, r.retired_by) for r in scan.reduce_verdicts(verdicts).collect()}
    assert got == {"a": ("finding", "confirmed", "f3"), "b": ("suppressed", "possible", "f2"), "c": ("undecidable", None, None)}
    assert scan.reduce_verdicts(verdicts, "probable").filter("vuln_id = 'b'").count() == 0


def test_scores(spark):
    vectors = [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
        ("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0), ("AV:N/AC:L/Au:N/C:P/I:P/A:P", 7.5), ("AV:N/AC:L/Au:N/C:C/I:C/A:C", 10.0), ("AV:L/AC:H/Au:M/C:N/I:N/A:N", 0.0),
        ("CVSS:4.0/AV:N/AC:L", None), ("CVSS:3.1/AV:N", None), ("junk", None), (None, None), ("CVSS:3.1/AV:P/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N", 6.5),
    ]
    df = spark.createDataFrame([(v,) for v, _ in vectors], "v string")
    assert [r[0] for r in df.select(severity.base_score("v")).collect()] == [s for _, s in vectors]
    scores = spark.createDataFrame([(0.0,), (3.9,), (4.0,), (6.9,), (8.9,), (9.0,), (None,)], "s double")
    assert [r[0] for r in scores.select(severity.rating("s")).collect()] == ["NONE", "LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", None]
    assert [r[0] for r in scores.select(severity.rating("s", v2=True)).collect()][-2] == "HIGH"
    one = spark.sql("select array(named_struct('type','CVSS_V2','score',9.0D,'source','nvd'), named_struct('type','CVSS_V3_1','score',0D,'source','nvd'), named_struct('type','CVSS_V3_1','score',7.0D,'source','osv'), named_struct('type','CVSS_V3_1','score',8.0D,'source','nvd')) as s")
    assert one.select(severity.primary_severity("s").alias("p")).first().p.score == 8.0
    words = spark.createDataFrame([("Known Affected",), ("patched",), ("what",), (None,)], "w string")
    assert [r[0] for r in words.select(severity.status_word("w")).collect()] == ["affected", "fixed", "", ""]


def test_names(spark):
    names = [" The Acme_Corp. Inc ", "a.b/c-d", "the", "", None, "Co", "The The Big Co Ltd", "-x-"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(packages.folded_name("n").alias("a"), packages.folded_vendor("n").alias("b")).collect()
    assert [r.a or "" for r in got] == [packages.fold(n) for n in names] and [r.b or "" for r in got] == [packages.fold_vendor(n) for n in names]
    assert packages.parse_purl("pkg:PyPI/My_Pkg@1%2B2?distro=x#sub").canonical == "pkg:pypi/my-pkg"
    assert packages.parse_purl("pkg:npm/%40scope/Name@1.0").canonical == "pkg:npm/@scope/name"
    assert packages.parse_purl("pkg:npm") is None and packages.parse_purl(None) is None
    assert packages.purl_ecosystem(packages.parse_purl("pkg:deb/debian/curl@1?distro=debian-12.4")) == ("debian", "12")
    assert packages.split_ecosystem("Red Hat:rhel_9:x") == ("redhat", "9") and packages.split_ecosystem("Linux Mint:21") == ("ubuntu", "")
    assert packages.parse_cpe(r"cpe:2.3:a:a\:b:p:1:*:*:*:*:*:*:*")["vendor"] == r"a\:b"
    assert packages.parse_cpe("cpe:/a:v:p:1:u:~e~s~t~h~o")["target_sw"] == "t" and packages.parse_cpe("cpe:2.3:a:b") is None
    keys = spark.createDataFrame([("pkg:npm/%40S/N@1.0?x=1#y",), (None,)], "p string").select(packages.purl_key("p").alias("k")).collect()
    assert [r.k for r in keys] == ["pkg:npm/%40s/n", None]
