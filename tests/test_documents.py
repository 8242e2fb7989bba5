"""Parsers of advisory documents on small documents, and on what is no document."""

import json

from advisorium.sources import documents

OSV = {
    "id": "ghsa-AAAA-bbbb-cccc", "aliases": ["cve-2024-0001"], "related": ["X-1"], "upstream": ["X-2"], "modified": "2024-01-02T03:04:05.123456789Z", "published": "2024-01-01T00:00:00Z",
    "summary": "s", "details": "", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}, {"type": "Ubuntu", "score": "high"}],
    "affected": [{"package": {"ecosystem": "npm", "name": "tinymd", "purl": "pkg:npm/tinymd"}, "ranges": [{"type": "semver", "events": [{"introduced": "0"}, {"fixed": "1"}, {"introduced": "2"}, {"last_affected": "3"}, {"introduced": "4"}]}, {"type": "SEMVER", "events": [{"fixed": "9"}, {"introduced": "8"}]}], "versions": ["0.1"]}],
    "references": [{"type": "WEB", "url": "https://a"}, {"type": "WEB", "url": ""}], "database_specific": {"cwe_ids": ["CWE-79", "CWE-79"]},
}
NVD = {
    "id": "CVE-2024-0002", "published": "2024-01-01T00:00:00.000", "lastModified": "2024-02-01T00:00:00.000", "vulnStatus": "Analyzed", "cveTags": [{"sourceIdentifier": "x", "tags": ["disputed"]}],
    "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "hello"}], "metrics": {"cvssMetricV2": [{"source": "n", "cvssData": {"vectorString": "AV:N", "baseScore": 7.5}}]}, "weaknesses": [{"description": [{"lang": "en", "value": "CWE-20"}, {"lang": "en", "value": "NVD-CWE-Other"}]}],
    "configurations": [
        {"nodes": [{"operator": "OR", "cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "versionStartExcluding": "1", "versionEndIncluding": "2"}, {"vulnerable": True, "criteria": "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "versionEndExcluding": "0.5"}, {"vulnerable": False, "criteria": "cpe:2.3:o:v:os:*:*:*:*:*:*:*:*"}]}]},
        {"operator": "AND", "nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": r"cpe:2.3:h:v\:w:q:*:*:*:*:*:*:*:*"}]}, {"cpeMatch": [{"vulnerable": False, "criteria": "cpe:2.3:a:x:y:*:*:*:*:*:*:*:*"}]}]},
        {"negate": True, "nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:no:no:*:*:*:*:*:*:*:*"}]}]},
    ],
}
CVE5 = {
    "cveMetadata": {"cveId": "cve-2024-0003", "state": "PUBLISHED", "assignerShortName": "acme", "datePublished": "2024-01-01", "dateUpdated": "2024-01-03T00:00:00Z"},
    "containers": {
        "cna": {"title": "t", "providerMetadata": {"shortName": "acme"}, "descriptions": [{"lang": "en-US", "value": "d"}], "problemTypes": [{"descriptions": [{"cweId": "CWE-1"}]}], "references": [{"url": "https://r", "tags": ["x"]}],
                "affected": [{"vendor": "v", "product": "p", "defaultStatus": "unaffected", "versions": [{"version": "1", "status": "affected", "lessThan": "4", "versionType": "semver", "changes": [{"at": "2", "status": "unaffected"}, {"at": "3", "status": "affected"}]}, {"version": "7", "status": "affected"}, {"version": "8", "status": "odd", "lessThanOrEqual": "9"}]}],
                "metrics": [{"cvssV3_1": {"baseScore": 9.8, "vectorString": "CVSS:3.1/x", "baseSeverity": "CRITICAL"}}]},
        "adp": [{"title": "other", "providerMetadata": {"shortName": "cisa"}, "metrics": [{"other": {"type": "ssvc", "content": {"options": [{"EXPLOITATION": "poc"}, {"Automatable": "no"}]}}}]}],
    },
}
CSAF = {
    "document": {"title": "T", "publisher": {"name": "Pub"}, "tracking": {"id": "SA-1", "version": "2", "status": "draft", "initial_release_date": "2024-01-01T00:00:00Z", "current_release_date": "2024-01-02T00:00:00Z"}},
    "product_tree": {"branches": [{"category": "vendor", "name": "Red", "branches": [{"category": "product_version", "name": "kernel-0:5.14-1.el9.x86_64", "product": {"name": "kernel", "product_id": "K", "product_identification_helper": {"purl": "pkg:rpm/red/kernel@5.14"}}}, {"category": "product_name", "name": "OS", "product": {"name": "OS 9", "product_id": "OS"}}]}],
                     "relationships": [{"product_reference": "K", "relates_to_product_reference": "OS", "full_product_name": {"name": "kernel in OS", "product_id": "OS:K"}}, {"product_reference": "bash-0:5.1-2.el9.noarch", "full_product_name": {"product_id": "OS:B"}}]},
    "vulnerabilities": [{"cve": "CVE-2024-0004", "notes": [{"category": "Summary", "text": "n"}], "product_status": {"known_affected": ["OS:K"], "fixed": ["OS:B"]}, "scores": [{"cvss_v3": {"vectorString": "CVSS:3.0/y", "baseScore": 5.0}}]}, {"ids": [{"text": "cve-2024-0005"}]}, {}],
}


def docs(spark, *items):
    return spark.createDataFrame([(x if isinstance(x, str) or x is None else json.dumps(x), "clash") for x in items], "content string, id string")


def test_osv(spark):
    r = documents.timed(documents.parse_osv(docs(spark, OSV, "no json", None, {}))).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.id, r.aliases, r.related, r.cwes, r.state, r.description) == ("GHSA-aaaa-bbbb-cccc", ["CVE-2024-0001"], ["X-1", "X-2"], ["CWE-79"], "PUBLISHED", "s")
    assert [(s.type, s.score, s.rating) for s in r.severities] == [("CVSS_V3_1", 9.8, "CRITICAL"), ("OTHER", None, "HIGH")]
    assert [(w.introduced, w.fixed, w.last_affected) for w in r.affected[0].ranges] == [("0", "1", None), ("2", None, "3"), ("4", None, None), ("8", "9", None)]
    assert str(r.modified).startswith("2024-01-02 03:04:05.123456") and len(r.references) == 1
    two = OSV | {"aliases": ["CVE-2024-0001", "CVE-2024-0009"]}
    r = documents.parse_osv(docs(spark, two)).first()
    assert r.aliases == [] and r.related == ["CVE-2024-0001", "CVE-2024-0009", "X-1", "X-2"]


def test_nvd(spark):
    r = documents.parse_nvd(docs(spark, NVD, {"id": "CVE-1"}, None)).collect()
    assert len(r) == 2
    r = r[0]
    assert (r.description, r.cwes, r.tags) == ("hello", ["CWE-20"], ["disputed"])
    assert [(a.vendor, a.product, a.status, len(a.cpes), [(w.introduced, w.introduced_exclusive, w.fixed, w.last_affected) for w in a.ranges]) for a in r.affected] == [
        ("v", "p", None, 1, [("1", True, None, "2"), (None, False, "0.5", None)]), ("v:w", "q", "conditional", 1, [])]
    assert (r.severities[0].type, r.severities[0].rating) == ("CVSS_V2", "HIGH")


def test_cve5(spark):
    r = documents.parse_cve5(docs(spark, CVE5, "[]", "{", {"cveMetadata": {}})).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.id, r.title, r.description, r.cwes, r.ssvc.exploitation, r.ssvc.source) == ("CVE-2024-0003", "t", "d", ["CWE-1"], "poc", "cvelist/cisa")
    got = {a.status: ([(w.introduced, w.fixed, w.last_affected) for w in a.ranges], a.versions, a.default_state) for a in r.affected}
    assert got == {"affected": ([("1", "2", None), ("3", "4", None)], ["7"], "unaffected"), "not_affected": ([("2", "3", None)], [], None), "under_investigation": ([("8", None, "9")], [], None)}


def test_csaf(spark):
    r = documents.parse_csaf(docs(spark, CSAF)).collect()
    assert [x.id for x in r] == ["CVE-2024-0004", "CVE-2024-0005", "SA-1#3"]
    assert [(a.status, a.product, a.versions, a.purl) for a in r[0].affected] == [("affected", "kernel", ["5.14"], "pkg:rpm/red/kernel@5.14"), ("fixed", "bash", ["5.1-2.el9"], None)]
    assert r[0].description == "n" and r[0].tags == ["csaf-draft"] and r[0].record_id == "SA-1@2#CVE-2024-0004"


def test_any_and_kev(spark):
    mixed = docs(spark, CVE5, CSAF, OSV, {"id": "GCVE-0-2024-0077", "summary": "x", "published": "2024-01-01"}, "junk", None)
    out = {r.id: r for r in documents.parse_any(mixed).collect()}
    assert set(out) == {"CVE-2024-0003", "CVE-2024-0004", "CVE-2024-0005", "SA-1#3", "GHSA-aaaa-bbbb-cccc", "GCVE-0-2024-0077"}
    assert out["GCVE-0-2024-0077"].aliases == ["CVE-2024-0077"] and {r.source for r in out.values()} == {"gcve"}
    assert tuple(documents.unreadable(mixed).first()) == (6, 2)
    kev = docs(spark, {"catalogVersion": "2024.01.01", "vulnerabilities": [{"cveID": " cve-2024-0001", "dateAdded": "2024-01-01", "knownRansomwareCampaignUse": "Known", "cwes": None}, {"cveID": ""}]})
    r = documents.parse_kev(kev).collect()
    assert [(x.cve_id, str(x.date_added), x.known_ransomware, x.cwes) for x in r] == [("CVE-2024-0001", "2024-01-01", True, [])]
    e = docs(spark, {"id": "EUVD-2024-1", "aliases": "CVE-2024-0001\nGHSA-aaaa-bbbb-cccc\n", "references": "https://a\nhttps://b", "baseScore": 0, "baseScoreVector": "", "datePublished": "Jan 2, 2024, 3:04:05 PM", "enisaIdProduct": [{"product": {"name": "p"}, "product_version": "1"}], "enisaIdVendor": [{"vendor": {"name": "v"}}]})
    r = documents.timed(documents.parse_euvd(e)).first()
    assert (r.aliases, len(r.references), r.severities, str(r.published), r.affected[0].vendor) == (["CVE-2024-0001", "GHSA-aaaa-bbbb-cccc"], 2, [], "2024-01-02 15:04:05", "v")
