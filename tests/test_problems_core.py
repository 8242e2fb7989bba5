"""The general problems against plain Python versions over whole tables."""

from collections import defaultdict

import brute
import pytest

from advisorium.plans import problems

ZONES = {"nvd_cve": "America/New_York", "euvd_items": "Europe/Brussels", "osv_records": "Australia/Sydney", "kev_entries": "America/New_York"}
TEXTS = {"nvd_cve": ("row_no", "published"), "euvd_items": ("item_no", "date_published"), "osv_records": ("rec_no", "modified"), "kev_entries": ("entry_no", "date_added")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_p1_found(spark, sf, duck):
    zones = dict(duck.execute("select source_name, local_zone from sources").fetchall())
    want = []
    for t, (key, text) in TEXTS.items():
        zone = zones[{"nvd_cve": "nvd", "euvd_items": "euvd", "osv_records": "osv", "kev_entries": "kev"}[t]]
        for k, v in duck.execute(f"select {key}, {text} from {t}").fetchall():
            if (at := brute.read_time(v, zone)) is not None:
                want.append((t, k, at[0]))
    assert rows(problems.p1_found(spark, sf)) == sorted(want)


def test_p2_found(spark, sf, duck):
    want = []
    for no, a, r in duck.execute("select item_no, aliases, reference_list from euvd_items").fetchall():
        for field, text in (("aliases", a), ("reference_list", r)):
            want += [(no, field, i, p) for i, p in enumerate(brute.split_list(text, field != "aliases"), 1)]
    assert rows(problems.p2_found(spark, sf)) == sorted(want)


def test_p4_found(spark, sf, duck):
    data = duck.execute("select vuln_id, snapshot_at, loaded_at, epss_score, in_kev, primary_score from vuln_snapshots").fetchall()
    times = sorted({r[1] for r in data})
    stands = {}
    for v, at, loaded, e, k, s in data:
        if (i := brute.norm_id(v)) and ((i, at) not in stands or loaded > stands[i, at][0]):
            stands[i, at] = (loaded, (e if e is None else round(e, 5), k, s if s is None else round(s, 1)))
    chains = defaultdict(dict)
    for (i, at), (_, v) in stands.items():
        chains[i][at] = v
    want = []
    for i, chain in chains.items():
        start = None
        for at, nxt in zip(times, [*times[1:], None]):
            if at in chain and start is None:
                start = at
            if start is not None and (nxt is None or nxt not in chain or chain[nxt] != chain[at]):
                want.append((i, str(start), str(nxt) if nxt else "9999-12-31 00:00:00"))
                start = None
    assert rows(problems.p4_found(spark, sf)) == sorted(want)


def test_p5_found(spark, sf, duck):
    best = {}
    for no, v, at in duck.execute("select delivery_no, catalog_version, fetched_at from kev_catalogs where fetch_status = 'complete'").fetchall():
        k = tuple(map(int, v.split(".")))
        best[k] = max(best.get(k, (at, no)), (at, no))
    order = [best[k][1] for k in sorted(best)]
    held = defaultdict(dict)
    for no, c, day, use in duck.execute("select delivery_no, cve_id, date_added, known_ransomware_use from kev_entries order by entry_no").fetchall():
        if i := brute.norm_id(c):
            t = brute.read_time(day, "UTC")
            held[no].setdefault(i, (t and t[1], (use or "").strip().lower() or None))
    want = []
    for a, b in zip(order, order[1:]):
        for i in held[a].keys() | held[b].keys():
            x, y = held[a].get(i), held[b].get(i)
            if x != y:
                want.append((a, b, i, "added" if x is None else "removed" if y is None else "changed"))
    assert rows(problems.p5_found(spark, sf)) == sorted(want)


def test_p7_found(spark, sf, duck):
    zone = duck.execute("select local_zone from sources where source_name = 'nvd'").fetchone()[0]
    runs = duck.execute("select source_name, run_no, min(started_at) from source_runs where run_no in (select run_no from source_runs where finished_at is not null and error_text is null) group by all order by 3").fetchall()
    items = []
    for no, c, m, at in duck.execute("select row_no, cve_id, last_modified, landed_at from nvd_cve").fetchall():
        t = brute.read_time(m, zone)
        items.append(("nvd", brute.norm_id(c), no, at, t and t[0]))
    for no, c, m, at in duck.execute("select record_no, id, modified, updated_at from vulnerabilities").fetchall():
        items.append(("republish", brute.norm_id(c), no, at, brute.us(m) if m and m <= at else None))
    went = defaultdict(list)
    for s, i, no, at, t in items:
        run = next((r for r in runs if r[0] == s and at <= r[2]), None)
        if run and i and t is not None:
            went[s, i, run[1]].append((t, -no))
    want = []
    for s, i in {k[:2] for k in went}:
        seen = None
        for src, r, _ in runs:
            if src == s and (s, i, r) in went:
                t, no = max(went[s, i, r])
                if seen is None or t > seen:
                    want.append((s, r, -no))
                seen = t if seen is None else max(seen, t)
    assert rows(problems.p7_found(spark, sf)) == sorted(want)
