"""Components against statements of advisories: does the statement name the component, and does its version fit.

A verdict is one of match, no_match, undecidable and suppressed; what is unknown never becomes a yes. The first
identity channel with data on both sides decides, also negatively.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from advisorium.functions import packages as P
from advisorium.functions.severity import STATUS_WORDS
from advisorium.session import ship_package
from advisorium.versions import order

NONE, WEAK, MODERATE, STRONG, EXACT = range(5)
UNDECIDABLE, UNBOUNDED, PATTERN, LITERAL, GENERIC, ORDERED = range(6)
CONFIDENCES = ("possible", "probable", "confirmed")
OUT, IN, OPEN = "out", "in", "open"

COMPONENT = "struct<name:string,version:string,vendor:string,ecosystem:string,purl:string,cpe:string,origin:string>"
RANGE = "struct<introduced:string,fixed:string,last_affected:string,type:string,cpe:string,introduced_exclusive:boolean>"
STATEMENT = f"struct<vendor:string,product:string,ecosystem:string,purl:string,cpes:array<string>,versions:array<string>,ranges:array<{RANGE}>,default_state:string,status:string,source:string>"
VERDICT = "result string, matched_on string, confidence string, scheme string, review string, notes array<string>"

_STATUS = {w: s for s, words in STATUS_WORDS.items() for w in words}
_CPE_CONSTRAINTS = ("edition", "language", "sw_edition", "target_sw", "target_hw", "other")


def status_of(text: str | None) -> str:
    """Status of a statement: none stated is affected, an unknown word under investigation."""
    t = (text or "").strip()
    return _STATUS.get(t.replace(" ", "_").lower(), "under_investigation") if t else "affected"


def stated(text: str | None) -> str:
    return (text or "").strip()


@dataclass
class Identity:
    grade: int = NONE
    channel: str = ""
    why: str = ""
    unproven: list[str] = field(default_factory=list)
    component_family: str = ""
    row_family: str = ""
    ecosystem: str = ""
    versions: list[tuple[str, list[str]]] = field(default_factory=list)
    patterns: list[tuple[str, list[str]]] = field(default_factory=list)


@dataclass
class Test:
    """Outcome of one element of a statement's version scope."""

    verdict: str
    grade: int = UNDECIDABLE
    scheme: str = ""
    heuristic: bool = False
    elided: bool = False
    review: str = ""
    notes: list[str] = field(default_factory=list)
    unproven: list[str] = field(default_factory=list)


def cpe_relation(row: str, own: str) -> str:
    """``yes``, ``no`` or ``unproven`` for one attribute of a statement's platform against the component's."""
    if row == "*" or row == own == "-":
        return "yes"
    if row == "-" or own == "-":
        return "no"
    if own == "*":
        return "unproven"
    if P.has_wildcard(row):
        return "yes" if P.glob_match(row, P.unescaped(own)) else "no"
    return "yes" if P.unescaped(row).lower() == P.unescaped(own).lower() else "no"


def cpe_constraints(row: dict, own: dict) -> tuple[list[str], bool]:
    """(attributes left unproven, whether one contradicts). The update counts only where the row states no version."""
    names = (*_CPE_CONSTRAINTS, *(("update",) if row["version"] in "*-" else ()))
    relations = {n: cpe_relation(row[n], own[n]) for n in names}
    return [f"{n}={P.unescaped(row[n])}" for n in names if relations[n] == "unproven"], "no" in relations.values()


def match_cpes(own_text: str, row_texts: list[str]) -> tuple[str, Identity]:
    """Relation of the component's platform name to those of a statement, with the versions those name."""
    found = Identity(EXACT, "cpe")
    own = P.parse_cpe(own_text)
    decided, matched, fewest = False, False, None
    for row in filter(None, map(P.parse_cpe, row_texts)) if own else ():
        if "*" in (row["vendor"], row["product"]):
            continue
        relations = [cpe_relation(row[n], own[n]) for n in ("part", "vendor", "product")]
        decided = decided or "no" in relations or relations == ["yes"] * 3
        if relations != ["yes"] * 3:
            continue
        unproven, contradicted = cpe_constraints(row, own)
        if contradicted:
            continue
        if row["version"] not in "*-":
            version = row["version"] + (f"-{row['update']}" if row["update"] not in "*-" else "")
            target = found.patterns if P.has_wildcard(version) else found.versions
            target.append((version if target is found.patterns else P.unescaped(version), unproven))
        if not matched or len(unproven) < len(fewest):
            fewest = unproven
        matched = True
    found.unproven = fewest or []
    found.grade = STRONG if found.unproven else EXACT
    return "yes" if matched else "no" if decided else "unproven", found


def _ecosystems(c: dict, a: dict, purls: list[P.Purl], row: P.Purl | None) -> tuple[str, str, str, str]:
    f, r = P.split_ecosystem(c["ecosystem"])
    by_purl = [P.purl_ecosystem(p) for p in purls]
    if not f:
        f, r = next((e for e in by_purl if e[0]), ("", ""))
    elif not r:
        r = next((e[1] for e in by_purl if e[0] == f and e[1]), "")
    rf, rr = P.split_ecosystem(a["ecosystem"])
    if not rf and row:
        rf, rr = P.purl_ecosystem(row)
    return (f, r, "", "") if rf == "git" else (f, r, rf, rr)


def identify(c: dict, a: dict) -> Identity:
    """How surely the statement is about the component."""
    purls = [p for p in (P.parse_purl(c["purl"]), P.parse_purl(c["origin"])) if p]
    row = P.parse_purl(a["purl"])
    f, r, rf, rr = _ecosystems(c, a, purls, row)
    if f and rf and f != rf:
        return Identity(why="ecosystem_conflict")
    unknown_release = False
    if f and f == rf and rr and r != rr:
        if r[:1].isdigit() and rr[:1].isdigit():
            return Identity(why="release_conflict")
        unknown_release = True

    def settle(found: Identity) -> Identity:
        found.component_family, found.row_family, found.ecosystem = f, rf, rf or f
        if unknown_release:
            found.grade = max(found.grade - 1, WEAK)
            found.unproven = [*found.unproven, "distro_release"]
        found.unproven = sorted(found.unproven)
        return found

    if row and purls:
        return settle(Identity(EXACT, "purl")) if any(p.canonical == row.canonical for p in purls) else Identity(why="purl_mismatch")
    if stated(c["cpe"]) and a["cpes"]:
        relation, found = match_cpes(c["cpe"], a["cpes"])
        if relation != "unproven":
            return settle(found) if relation == "yes" else Identity(why="cpe_mismatch")
    name, product = c["name"] or "", a["product"] or ""
    if not name or not product:
        return Identity(why="no_channel")
    if f and rf:
        if P.ecosystem_name(f, name) != P.ecosystem_name(rf, product):
            return Identity(why="name_mismatch")
        return settle(Identity(EXACT if rf in P.LANGUAGES or rf in P.DISTROS else STRONG, "ecosystem_name"))
    if c["vendor"] and a["vendor"]:
        same = P.fold_vendor(c["vendor"]) == P.fold_vendor(a["vendor"]) and P.fold(name) == P.fold(product)
        return settle(Identity(MODERATE, "vendor_product")) if same else Identity(why="vendor_product_mismatch")
    return settle(Identity(WEAK, "name")) if P.fold(name) == P.fold(product) else Identity(why="name_mismatch")


def scheme_of(kind: str | None, ecosystem: str, *operands: str | None) -> tuple[str, str]:
    """(scheme, note): commits have no order; a packaging ecosystem overrides a declared type that differs."""
    declared = stated(kind).upper()
    if declared in ("GIT", "ORIGINAL_COMMIT_FOR_FIX") or any(order.is_commit(o) for o in operands):
        return "opaque", ""
    by_type = order.scheme_for(kind, ecosystem)
    f = P.split_ecosystem(ecosystem)[0]
    if f in P.LANGUAGES or f in (P.DISTROS - {"minimos", "echo", "root", "cleanstart"}):
        by_ecosystem = order.scheme_for("", f if f in order.ECOSYSTEM_SCHEME else {"cargo": "crates.io", "azurelinux": "azure linux", "bellsoft": "bellsoft hardened containers"}.get(f, ecosystem))
        return by_ecosystem, f"scheme_source:ecosystem_override:{declared or 'CUSTOM'}" if by_ecosystem != by_type else ""
    return by_type, ""


def compared(scheme: str, a: str, b: str) -> tuple[int, bool, bool] | None:
    """(order, heuristic, epoch elided) or None. Where one side alone states an epoch both go without."""
    import re

    a, b = a.strip(), b.strip()
    elided = False
    if scheme in ("rpm", "debian"):
        bare = [re.sub(r"^\d+:(?=.)", "", x) for x in (a, b)]
        elided = (bare[0] != a) != (bare[1] != b)
        if elided:
            a, b = bare
    answer = order.compare(scheme, a, b)
    if answer is None or (scheme == "generic" and not answer.exact):
        return None
    return answer.cmp, not answer.exact, elided


def _grade(scheme: str, opaque: int = UNDECIDABLE) -> int:
    return opaque if scheme == "opaque" else GENERIC if scheme == "generic" else ORDERED


def _numbered(v: str) -> bool:
    t = v.strip()
    t = t[1:] if len(t) > 1 and t[0] in "vV" else t
    return t[:1].isdigit()


def test_range(scheme: str, v: str, r: dict) -> Test:
    """Window ``[introduced, fixed)`` or up to and with last_affected."""
    low, fixed, last = (stated(r[k]) for k in ("introduced", "fixed", "last_affected"))
    exclusive = bool(r.get("introduced_exclusive"))
    if any(order.sentinel(x) in ("all", "unknown") for x in (fixed, last)):
        return Test(OPEN, scheme=scheme, review="sentinel_upper_bound")
    has_low = bool(low) and (exclusive or not order.sentinel(low))
    kind = stated(r["type"]).upper() or "CUSTOM"
    out = Test(IN, _grade(scheme), scheme, notes=["conflicting_upper_bounds"] if fixed and last else [])
    if not has_low and not fixed and not last:
        if scheme == "opaque":
            return Test(OPEN, scheme=scheme, review=f"opaque_scheme:{kind}")
        if not _numbered(v) or order.is_commit(v):
            return Test(OPEN, scheme=scheme, review="unparseable_version:component")
        out.grade = UNBOUNDED
        return out
    outside = {"low": lambda c: c < 0 or (c == 0 and exclusive), "fixed": lambda c: c >= 0, "last": lambda c: c > 0}
    for name, bound, given in (("low", low, has_low), ("fixed", fixed, bool(fixed)), ("last", last, bool(last))):
        if not given:
            continue
        got = compared(scheme, v, bound)
        if got is None:
            if scheme == "opaque":
                review = f"opaque_scheme:{kind}"
            elif scheme == "generic" and _numbered(v) and _numbered(bound):
                review = "generic_refused_tie"
            else:
                review = "unparseable_version:bound"
            return Test(OPEN, scheme=scheme, review=review)
        out.heuristic = out.heuristic or got[1]
        if got[2] and not out.elided:
            out.elided = True
            out.notes.append("epoch_elided")
        if outside[name](got[0]):
            out.verdict = OUT
            return out
    return out


def test_list(scheme: str, v: str, listed: list[tuple[str, list[str]]], claims_all: bool, closed: bool) -> Test:
    """Membership in a list of versions; absence counts only where the list is complete."""
    refused = False
    for value, unproven in listed:
        if scheme == "opaque":
            got = (0, False, False) if v.strip().lower() == value.strip().lower() else (1, False, False)
        else:
            got = compared(scheme, v, value)
        if got is None:
            refused = True
        elif got[0] == 0:
            return Test(IN, _grade(scheme, LITERAL), scheme, got[1], got[2], notes=["epoch_elided"] if got[2] else [], unproven=list(unproven))
    if claims_all:
        return Test(OPEN, scheme=scheme, review="unbounded_default_affected")
    if refused:
        return Test(OPEN, scheme=scheme, review="unparseable_version:bound")
    return Test(OUT, _grade(scheme, LITERAL), scheme) if closed else Test(OPEN, scheme=scheme, review="open_version_enumeration")


def union(tests: list[Test]) -> Test:
    """The strongest positive, else the first undecided, else the first negative."""
    hits = [t for t in tests if t.verdict == IN]
    if hits:
        return min(hits, key=lambda t: (-t.grade, t.heuristic, len(t.unproven)))
    return next((t for t in tests if t.verdict == OPEN), tests[0])


def test_versions(c: dict, a: dict, who: Identity) -> Test:
    """All elements of a statement's version scope against the component's version."""
    v, eco = c["version"], who.ecosystem
    ranges = a["ranges"] or []
    source = stated(a["source"]).lower()
    enumerates = source in ("cvelist", "vulnrichment", "fkie")
    status, default = status_of(a["status"]), _STATUS.get(stated(a["default_state"]).replace(" ", "_").lower(), "")
    closed = enumerates and (status != "affected" or default == "not_affected")
    kinds = {t for r in ranges if (t := stated(r["type"]).upper()) not in ("", "ORIGINAL_COMMIT_FOR_FIX")}
    declared = kinds.pop() if len(kinds) == 1 else ""
    tests: list[Test] = []
    notes: list[str] = []

    def scheme(kind: str | None, *operands: str | None) -> str:
        s, note = scheme_of(kind, eco, *operands)
        if note and note not in notes:
            notes.append(note)
        return s

    for r in ranges:
        if stated(r["type"]).upper() == "ORIGINAL_COMMIT_FOR_FIX":
            notes.append("fix_commit")
            continue
        if not (r["introduced"] or r["fixed"] or r["last_affected"]):
            continue
        s = scheme(r["type"], v, r["introduced"], r["fixed"], r["last_affected"])
        if s == "alpine" and stated(r["fixed"]) == "0":
            tests.append(Test(OUT, ORDERED, s, notes=["alpine_fixed_zero"]))
            continue
        t = test_range(s, v, r)
        carrier = P.parse_cpe(r.get("cpe"))
        if carrier:
            unproven, contradicted = cpe_constraints(carrier, P.parse_cpe(c["cpe"]) or dict.fromkeys(P.CPE_FIELDS, "*"))
            t = Test(OUT, _grade(s), s) if contradicted else t
            t.unproven = [] if contradicted else unproven
        tests.append(t)

    def lists(items: list[tuple[str, list[str]]], claims_all: bool, complete: bool) -> None:
        commits = [i for i in items if order.is_commit(i[0])]
        releases = [i for i in items if not order.is_commit(i[0])]
        if claims_all or releases:
            tests.append(test_list(scheme(declared, v), v, releases, claims_all, complete))
        if commits:
            tests.append(test_list("opaque", v, commits, False, complete))

    listed = [x.strip() for x in a["versions"] or [] if x and not order.sentinel(x)]
    claims_all = any(order.sentinel(x) == "all" for x in a["versions"] or [])
    if listed or claims_all:
        lists([(x, []) for x in listed], claims_all, closed)
    closed_cpes = closed or source == "nvd"
    if who.versions:
        lists(who.versions, False, closed_cpes)
    if who.patterns:
        hit = next((p for p in who.patterns if P.glob_match(p[0], v.strip())), None)
        if hit:
            tests.append(Test(IN, PATTERN, "opaque", unproven=list(hit[1])))
        else:
            tests.append(Test(OUT, PATTERN, "opaque") if closed_cpes else Test(OPEN, scheme="opaque", review="open_version_enumeration"))
    if status == "affected" and enumerates and default == "affected":
        s = scheme(declared, v)
        if s == "opaque":
            tests.append(Test(OPEN, scheme=s, review=f"opaque_scheme:{declared or 'CUSTOM'}"))
        elif not _numbered(v) or order.is_commit(v):
            tests.append(Test(OPEN, scheme=s, review="unparseable_version:component"))
        else:
            tests.append(Test(IN, UNBOUNDED, s))
    if not tests:
        return Test(OPEN, review="no_version_data", notes=notes)
    result = union(tests)
    if result.verdict == OUT and status == "affected" and enumerates and default not in ("affected", "not_affected"):
        result = Test(OPEN, scheme=result.scheme, review="unknown_default_status", notes=result.notes)
    result.notes = [*notes, *result.notes]
    return result


def confidence(who: Identity, t: Test) -> str:
    """The weaker of identity and version evidence, capped by what is unproven, lowered for each convention used."""
    level = 2 if (who.grade, t.grade) == (EXACT, ORDERED) else 1 if (who.grade, t.grade) in ((EXACT, GENERIC), (STRONG, ORDERED)) else 0
    if who.grade == WEAK or who.unproven or t.unproven or t.grade in (UNBOUNDED, LITERAL, PATTERN):
        level = 0
    return CONFIDENCES[max(0, level - t.heuristic - t.elided)]


#: Answers a worker remembers of each kind; when so many are held it begins anew.
REMEMBERED = 100_000
_identities: dict[tuple, Identity] = {}
_tests: dict[tuple, Test] = {}


def _remembered(held: dict, key: tuple, make):
    found = held.get(key)
    if found is None:
        if len(held) >= REMEMBERED:
            held.clear()
        found = held[key] = make()
    return found


def known_identity(c: dict, a: dict) -> Identity:
    """``identify``, once for each pair of names: the same few names meet again and again in a batch."""
    key = (c["name"], c["vendor"], c["ecosystem"], c["purl"], c["cpe"], c["origin"], a["vendor"], a["product"], a["ecosystem"], a["purl"], tuple(a["cpes"] or ()))
    return _remembered(_identities, key, lambda: identify(c, a))


def known_test(c: dict, a: dict, who: Identity) -> Test:
    """``test_versions``, once for each version and scope."""
    scope = tuple(tuple(r.values()) for r in a["ranges"] or ())
    named = (tuple((v, *u) for v, u in who.versions), tuple((v, *u) for v, u in who.patterns))
    key = (c["version"], c["cpe"], who.ecosystem, scope, tuple(a["versions"] or ()), a["source"], a["status"], a["default_state"], *named)
    return _remembered(_tests, key, lambda: test_versions(c, a, who))


def evaluate(c: dict, a: dict) -> tuple[str, str, str | None, str, str, list[str]]:
    """(result, matched_on, confidence, scheme, review, notes) of one component against one statement."""
    who = known_identity(c, a)
    if who.grade == NONE:
        return "no_match", "", None, "", who.why, []
    if order.sentinel(c["version"]) in ("empty", "all", "unknown") or stated(c["version"]).upper() == "NOASSERTION":
        return "undecidable", who.channel, None, "", "no_component_version", []
    status = status_of(a["status"])
    t = known_test(c, a, who)
    if t.verdict == OUT:
        return "no_match", who.channel, None, t.scheme, "out_of_range", t.notes
    if status in ("under_investigation", "conditional"):
        return "undecidable", who.channel, None, t.scheme, "conditional_applicability" if status == "conditional" else "status_under_investigation", t.notes
    if t.verdict == OPEN:
        return "undecidable", who.channel, None, t.scheme, t.review, t.notes
    if status != "affected":
        return "suppressed", who.channel, confidence(who, t), t.scheme, status, t.notes
    if who.grade == WEAK and who.component_family in P.DISTROS:
        return "undecidable", who.channel, None, t.scheme, "distro_package_upstream_statement", t.notes
    level = confidence(who, t)
    open_ended = bool(a["ranges"]) and not any(stated(r["fixed"]) or stated(r["last_affected"]) for r in a["ranges"])
    if level == "confirmed" and who.row_family in P.DISTROS and open_ended:
        level = "probable"
    return "match", who.channel, level, t.scheme, "", t.notes


def with_verdicts(pairs: DataFrame, component: str = "component", statement: str = "statement") -> DataFrame:
    """``pairs`` (keys, component struct, statement struct) with a verdict per row instead of the structs.

    One Arrow pass: pairs come from the candidate lookup, and each is judged on its own.
    """
    keys = [c for c in pairs.columns if c not in (component, statement)]
    ship_package(pairs.sparkSession)
    names = ["result", "matched_on", "confidence", "scheme", "review", "notes"]
    types = [pa.string()] * 5 + [pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [evaluate(c, a) for c, a in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = [pa.array([j[i] for j in judged], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(list(chain(b.columns[:-2], columns)), names=[*keys, *names])

    held = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, component, statement).mapInArrow(run, ", ".join(x for x in (held, VERDICT) if x))
