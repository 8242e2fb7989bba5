"""Documents whose meaning lies in nesting or order: CVE 5, CSAF, CycloneDX and SPDX, one text at a time."""

from __future__ import annotations

import json
import re

from advisorium.functions.packages import parse_purl
from advisorium.functions.severity import STATUS_WORDS

_STATUS = {w: s for s, words in STATUS_WORDS.items() for w in words}
STATUS_ORDER = ("affected", "not_affected", "fixed", "under_investigation", "conditional")
NEVRA = re.compile(r"^(?P<name>.+?)-(?:(?P<epoch>\d+):)?(?P<version>[^-:]+)-(?P<release>[^-]+)\.(?:x86_64|i[3-6]86|aarch64|ppc64le|s390x|noarch|src|armv7hl)$")
MAX_DEPTH = 64


def record(**known) -> dict:
    texts = ("id", "title", "description", "state", "published_text", "modified_text", "withdrawn_text", "assigner", "ssvc", "source", "record_id")
    lists = ("aliases", "related", "cwes", "tags", "severities", "references", "affected")
    return dict.fromkeys(texts) | {k: [] for k in lists} | known


def window(introduced=None, fixed=None, last=None, kind=None) -> dict:
    text = lambda x: (x or "").strip() or None
    return {"introduced": text(introduced), "fixed": text(fixed), "last_affected": text(last), "type": (kind or "").upper() or None, "cpe": None, "introduced_exclusive": False}


def affected(**known) -> dict:
    base = dict.fromkeys(("vendor", "product", "ecosystem", "purl", "default_state", "status", "source"))
    return base | {"cpes": [], "versions": [], "ranges": []} | known


def normalized(text: str | None) -> str:
    t = (text or "").strip()
    if re.fullmatch(r"(?i)GHSA(-[a-z0-9]{4}){3}", t):
        return "GHSA-" + t[5:].lower()
    return t.upper() if re.fullmatch(r"(?i)(CVE-\d{4}-\d{4,}|EUVD-\d{4}-\d+|GCVE-\d+-\d{4}-\d+)", t) else t


def _word(raw: str | None) -> str:
    t = (raw or "").strip()
    return _STATUS.get(t.replace(" ", "_").lower(), "under_investigation") if t else "affected"


def cve5_affected(a: dict, source: str) -> list[dict]:
    """Rows of one affected entry, one per status. Changes cut a version into consecutive intervals."""
    rows: dict[str, dict] = {}

    def row(raw: str | None) -> dict:
        s = _word(raw)
        return rows.setdefault(s, affected(vendor=a.get("vendor"), product=a.get("product") or a.get("packageName"), purl=a.get("packageURL"), cpes=sorted({*(a.get("cpes") or [])}), status=s, source=source, default_state=a.get("defaultStatus") if s == "affected" else None))

    def add(raw: str | None, *bounds) -> None:
        w = window(*bounds)
        if w["introduced"] or w["fixed"] or w["last_affected"]:
            row(raw)["ranges"].append(w)
        else:
            row(raw)

    versions = a.get("versions") or []
    for v in versions:
        kind, changes = v.get("versionType"), [c for c in v.get("changes") or [] if (c.get("at") or "").strip()]
        upper = (v.get("lessThan"), v.get("lessThanOrEqual"))
        if v.get("changes"):
            cuts = [(v.get("version"), v.get("status")), *((c["at"], c.get("status")) for c in changes)]
            for (start, status), (end, _) in zip(cuts, cuts[1:]):
                add(status, start, end, None, kind)
            add(cuts[-1][1], cuts[-1][0], *upper, kind)
        elif any(upper):
            add(v.get("status"), v.get("version"), upper[0], None if upper[0] else upper[1], kind)
        elif v.get("version"):
            row(v.get("status"))["versions"].append(v["version"])
        else:
            row(v.get("status"))
    if not versions or _STATUS.get((a.get("defaultStatus") or "").strip().lower()) == "affected":
        row("affected")
    named = lambda r: r["vendor"] or r["product"] or r["cpes"] or r["purl"]
    return [rows[s] for s in STATUS_ORDER if s in rows and named(rows[s]) and (s == "affected" or rows[s]["ranges"] or rows[s]["versions"])]


_METRICS = (("cvssV4_0", "CVSS_V4_0"), ("cvssV3_1", "CVSS_V3_1"), ("cvssV3_0", "CVSS_V3_0"), ("cvssV2_0", "CVSS_V2"))


def cve5_severities(metric: dict, provider: str | None, source: str) -> list[dict]:
    blocks = [(metric[k], t) for k, t in _METRICS if metric.get(k)]
    return [{"type": t, "score": b.get("baseScore"), "vector": b.get("vectorString"), "rating": b.get("baseSeverity"), "provider": provider, "source": source} for b, t in blocks if b.get("vectorString") or (b.get("baseScore") or 0) > 0]


def ssvc_of(metric: dict, provider: str | None, source: str) -> dict | None:
    """Decision points of an SSVC metric, names compared without letter case; None if nothing is stated."""
    other = metric.get("other") or {}
    if (other.get("type") or "").lower() != "ssvc":
        return None
    points = {k.strip().lower(): v for o in (other.get("content") or {}).get("options") or [] for k, v in o.items()}
    named = {"exploitation": points.get("exploitation"), "automatable": points.get("automatable"), "technical_impact": points.get("technical impact")}
    return {**named, "source": f"{source}/{provider}" if provider else source} if any(named.values()) else None


def cve5_records(text: str, source: str) -> list[dict]:
    """A CVE 5 document. The CNA's title and description count first; other containers only add."""
    doc = json.loads(text)
    meta, parts = doc["cveMetadata"], doc.get("containers") or {}
    cna = parts.get("cna") or {}
    rejected = (meta.get("state") or "").upper() == "REJECTED"
    out = record(id=normalized(meta.get("cveId")), title=cna.get("title"), state=(meta.get("state") or "PUBLISHED").upper(), published_text=meta.get("datePublished"), modified_text=meta.get("dateUpdated"), withdrawn_text=meta.get("dateRejected") if rejected else None, assigner=meta.get("assignerShortName"), source=source, record_id=meta.get("cveId"))
    if not out["id"]:
        return []
    cwes = set()
    for c in (cna, *(parts.get("adp") or [])):
        provider = (c.get("providerMetadata") or {}).get("shortName")
        english = next((d.get("value") for d in c.get("descriptions") or [] if (d.get("lang") or "").lower().startswith("en")), None)
        if rejected and c is cna:
            english = next((d.get("value") for d in c.get("rejectedReasons") or [] if (d.get("lang") or "").lower().startswith("en")), english)
        out["description"] = out["description"] or english
        out["tags"] += c.get("tags") or []
        cwes |= {d["cweId"] for p in c.get("problemTypes") or [] for d in p.get("descriptions") or [] if d.get("cweId")}
        out["references"] += [{"url": r["url"], "name": r.get("name"), "tags": r.get("tags") or [], "source": source} for r in c.get("references") or [] if r.get("url")]
        for a in c.get("affected") or []:
            out["affected"] += cve5_affected(a, source)
        for m in c.get("metrics") or []:
            out["severities"] += cve5_severities(m, provider, source)
            out["ssvc"] = out["ssvc"] or ssvc_of(m, provider, source)
    out["cwes"] = sorted(cwes)
    return [out]


def split_nevra(text: str | None) -> tuple[str, str] | None:
    m = NEVRA.match((text or "").strip())
    return (m["name"], f"{m['version']}-{m['release']}") if m else None


def _leaf(leaf: dict, path: dict) -> dict:
    helper = leaf.get("product_identification_helper") or {}
    p = {"vendor": path.get("vendor"), "product": leaf.get("name") or path.get("product_name"), "version": path.get("product_version"), "purl": helper.get("purl"), "cpe": helper.get("cpe")}
    purl = parse_purl(p["purl"])
    if purl:
        return p | {"product": purl.name, "version": purl.version or None}
    nevra = split_nevra(leaf.get("name")) or split_nevra(path.get("product_version"))
    return p | {"product": nevra[0], "version": nevra[1]} if nevra else p


def product_tree(tree: dict) -> dict[str, dict]:
    """Products by identifier: leaves of the branches, full names, and relationships that place one in another."""
    out: dict[str, dict] = {}
    stack = [(b, {}, 0) for b in reversed(tree.get("branches") or [])]
    while stack:  # depth first, without recursion
        b, path, depth = stack.pop()
        here = path | ({b["category"]: b.get("name")} if b.get("category") else {})
        if (b.get("product") or {}).get("product_id"):
            out[b["product"]["product_id"]] = _leaf(b["product"], here)
        if depth < MAX_DEPTH:
            stack += [(x, here, depth + 1) for x in reversed(b.get("branches") or [])]
    for p in tree.get("full_product_names") or []:
        if p.get("product_id"):
            out[p["product_id"]] = _leaf(p, {})
    for rel in tree.get("relationships") or []:
        name, ref = rel.get("full_product_name") or {}, rel.get("product_reference")
        if not name.get("product_id"):
            continue
        known, nevra = out.get(ref), split_nevra(ref)
        if nevra and not (known and known["purl"]):
            p = {"vendor": known and known["vendor"], "product": nevra[0], "version": nevra[1], "purl": None, "cpe": known and known["cpe"]}
        else:
            p = dict(known or {"vendor": None, "product": ref, "version": None, "purl": None, "cpe": None})
        out[name["product_id"]] = p | {"product": p["product"] or name["product_id"]}
    return out


_CSAF_STATUS = {"affected": ("known_affected",), "fixed": ("fixed", "first_fixed"), "not_affected": ("known_not_affected",), "under_investigation": ("under_investigation",)}


def csaf_records(text: str, source: str) -> list[dict]:
    """A CSAF document, one record per vulnerability: named by its CVE, else a CVE among its ids, else the document's id."""
    doc = json.loads(text)
    head, found = doc["document"], doc.get("vulnerabilities") or []
    tracking, publisher = head.get("tracking") or {}, (head.get("publisher") or {}).get("name")
    products = product_tree(doc.get("product_tree") or {})
    out = []
    for i, v in enumerate(found, 1):
        aliases = sorted({normalized(x["text"]) for x in v.get("ids") or [] if (x.get("text") or "").strip()})
        base = (tracking.get("id") or "").strip()
        name = normalized(v.get("cve")) or next((a for a in aliases if a.startswith("CVE-")), "") or (f"{base}#{i}" if base and len(found) > 1 else base)
        if not name:
            continue
        notes = [n.get("text") for n in [*(v.get("notes") or []), *(head.get("notes") or [])] if (n.get("category") or "").lower() in ("description", "summary")]
        r = record(
            id=name, title=v.get("title") or head.get("title"), description=notes[0] if notes else None, state="PUBLISHED", published_text=tracking.get("initial_release_date"), modified_text=tracking.get("current_release_date"),
            aliases=aliases, cwes=[v["cwe"]["id"]] if (v.get("cwe") or {}).get("id") else [], tags=["csaf-draft"] if (tracking.get("status") or "").lower() == "draft" else [], source=source,
            record_id="#".join((base + (f"@{tracking['version']}" if tracking.get("version") else ""), name)),
        )
        for s in v.get("scores") or []:
            for k, fixed_type in (("cvss_v4", "CVSS_V4_0"), ("cvss_v3", None), ("cvss_v2", "CVSS_V2")):
                b = s.get(k) or {}
                if b.get("vectorString"):
                    kind = fixed_type or ("CVSS_V3_1" if b["vectorString"].startswith("CVSS:3.1") else "CVSS_V3_0" if b["vectorString"].startswith("CVSS:3.0") else "OTHER")
                    r["severities"].append({"type": kind, "score": b.get("baseScore"), "vector": b["vectorString"], "rating": b.get("baseSeverity"), "provider": publisher, "source": source})
        r["references"] = [{"url": x["url"], "name": x.get("summary"), "tags": [(x.get("category") or "").lower()], "source": source} for x in v.get("references") or [] if x.get("url")]
        for status, fields in _CSAF_STATUS.items():
            for pid in (p for f in fields for p in (v.get("product_status") or {}).get(f) or []):
                p = products.get(pid) or {"vendor": None, "product": pid, "version": None, "purl": None, "cpe": None}
                r["affected"].append(affected(vendor=p["vendor"] or publisher, product=p["product"], purl=p["purl"], cpes=[p["cpe"]] if p["cpe"] else [], versions=[p["version"]] if p["version"] else [], status=status, source=source))
        r["affected"].sort(key=lambda a: (a["status"], a["product"] or ""))
        out.append(r)
    return out
