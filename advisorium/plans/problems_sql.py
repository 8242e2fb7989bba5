"""SQL counterparts of the problem queries that SQL can express."""

from __future__ import annotations

# As in advisorium.functions.ids.
_STAND_INS = "'-', '--', '?', '...', 'n/a', 'na', 'n.a.', 'nil', 'none', 'null', 'unknown', 'tbd', 'tba', 'todo', 'pending', 'unassigned', 'not assigned', 'not available', 'undefined', 'no cve', 'cve-xxxx-xxxx', 'cve-yyyy-nnnn', 'ghsa-xxxx-xxxx-xxxx'"


def sql_trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}\x{{feff}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}\x{{feff}}]+$', '', 'g')"


def sql_id(c: str) -> str:
    t = sql_trim(c)
    return rf"""CASE WHEN {t} = '' OR lower({t}) IN ({_STAND_INS}) OR regexp_full_match({t}, '(?i)(CVE|EUVD|GCVE|GHSA)(-0+)+') THEN NULL
        WHEN regexp_full_match({t}, '(?i)(CVE-\d{{4}}-\d{{4,}}|EUVD-\d{{4}}-\d+|GCVE-\d+-\d{{4}}-\d+)') THEN upper({t})
        WHEN regexp_full_match({t}, '(?i)GHSA-[a-z0-9]{{4}}-[a-z0-9]{{4}}-[a-z0-9]{{4}}') THEN 'GHSA-' || lower(substr({t}, 6)) ELSE {t} END"""


def sql_form(c: str) -> str:
    """The spelling of an identifier, stand-ins included."""
    t = sql_trim(c)
    return rf"""CASE WHEN regexp_full_match({t}, '(?i)(CVE-\d{{4}}-\d{{4,}}|EUVD-\d{{4}}-\d+|GCVE-\d+-\d{{4}}-\d+)') THEN upper({t})
        WHEN regexp_full_match({t}, '(?i)GHSA-[a-z0-9]{{4}}-[a-z0-9]{{4}}-[a-z0-9]{{4}}') THEN 'GHSA-' || lower(substr({t}, 6)) ELSE {t} END"""


_SPELLED = r"^\D*(\d{4})(?:\D+(\d{1,2})\D+(\d{1,2})|(\d{2})(\d{2}))\D*$"
_VERSIONS = rf"""c AS (SELECT delivery_no, fetched_at, regexp_extract(catalog_version, '{_SPELLED}', ['y', 'm', 'd', 'n', 'e']) AS p FROM kev_catalogs
  WHERE lower({sql_trim("fetch_status")}) = 'complete' AND regexp_matches(catalog_version, '{_SPELLED}')),
v AS (SELECT CAST(p.y AS INTEGER) * 10000 + CAST(p.m || p.n AS INTEGER) * 100 + CAST(p.d || p.e AS INTEGER) AS version, arg_max(delivery_no, struct_pack(f := fetched_at, n := delivery_no)) AS delivery_no FROM c GROUP BY 1),
steps AS (SELECT lag(delivery_no) OVER (ORDER BY version) AS from_delivery, delivery_no AS to_delivery FROM v),
held AS (SELECT DISTINCT delivery_no, {sql_id("cve_id")} AS cve_id FROM kev_entries WHERE {sql_id("cve_id")} IS NOT NULL)"""

_CHAINS = f"""
WITH stand AS (
  SELECT {sql_id("vuln_id")} AS vuln_id, snapshot_at AS snap, round(epss_score, 5) AS e, in_kev AS k, round(primary_score, 1) AS s,
         row_number() OVER (PARTITION BY {sql_id("vuln_id")}, snapshot_at ORDER BY loaded_at DESC NULLS LAST, row_no DESC) AS rn
  FROM vuln_snapshots WHERE snapshot_at IS NOT NULL),
calendar AS (SELECT snap, row_number() OVER (ORDER BY snap) AS seq, lead(snap) OVER (ORDER BY snap) AS next_at FROM (SELECT DISTINCT snapshot_at AS snap FROM vuln_snapshots WHERE snapshot_at IS NOT NULL)),
marked AS (
  SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(e) OVER w IS NOT DISTINCT FROM e AND lag(k) OVER w IS NOT DISTINCT FROM k AND lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS begins
  FROM stand JOIN calendar USING (snap) WHERE rn = 1 AND vuln_id IS NOT NULL WINDOW w AS (PARTITION BY vuln_id ORDER BY seq)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY vuln_id ORDER BY seq) AS version FROM marked),
chains AS (
  SELECT vuln_id, strftime(min(snap), '%Y-%m-%d %H:%M:%S') AS valid_from, max(seq) AS last_seq,
         arg_min(e, seq) AS e, arg_min(k, seq) AS k, arg_min(s, seq) AS s
  FROM numbered GROUP BY vuln_id, version)
"""

ORACLES: dict[str, str] = {
    "p5_moves": f"""WITH {_VERSIONS}
SELECT from_delivery, to_delivery, h.cve_id, 'added' AS change_kind FROM steps JOIN held h ON h.delivery_no = to_delivery
  WHERE from_delivery IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held o WHERE o.delivery_no = from_delivery AND o.cve_id = h.cve_id)
UNION ALL SELECT from_delivery, to_delivery, h.cve_id, 'removed' FROM steps JOIN held h ON h.delivery_no = from_delivery
  WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.delivery_no = to_delivery AND o.cve_id = h.cve_id)""",
    "p7_republish": f"""WITH ok AS (SELECT run_no, min(started_at) AS started FROM source_runs WHERE source_name = 'republish' AND run_no IS NOT NULL AND started_at IS NOT NULL
    GROUP BY 1 HAVING bool_or(finished_at IS NOT NULL AND error_text IS NULL)),
  item AS (SELECT record_no, {sql_id("id")} AS id, modified AS at_, updated_at AS landed FROM vulnerabilities WHERE {sql_id("id")} IS NOT NULL AND modified <= updated_at),
  went AS (SELECT i.*, r.run_no, r.started FROM item i ASOF JOIN ok r ON i.landed <= r.started),
  top AS (SELECT id, run_no, started, max(at_) AS at_, arg_min(record_no, struct_pack(t := -epoch_us(at_), n := record_no)) AS row_no FROM went GROUP BY ALL),
  seen AS (SELECT *, max(at_) OVER (PARTITION BY id ORDER BY started, run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM top)
SELECT 'republish' AS source_name, run_no, row_no FROM seen WHERE before IS NULL OR at_ > before""",
    "p4_found": _CHAINS
    + """SELECT vuln_id, valid_from, coalesce(strftime((SELECT c.next_at FROM calendar c WHERE c.seq = last_seq), '%Y-%m-%d %H:%M:%S'), '9999-12-31 00:00:00') AS valid_to FROM chains""",
    "p4_open_versions": _CHAINS
    + """SELECT c.vuln_id, n.e AS epss_score, n.k AS in_kev, n.s AS primary_score, c.valid_from
    FROM chains c JOIN marked n ON n.vuln_id = c.vuln_id AND n.seq = c.last_seq WHERE last_seq = (SELECT max(seq) FROM calendar)""",
    "p7_ledger": """
WITH runs AS (SELECT source_name, run_no, min(started_at) AS started, max(CASE WHEN finished_at IS NOT NULL AND error_text IS NULL THEN 1 ELSE 0 END) AS ok
  FROM source_runs WHERE source_name IS NOT NULL AND run_no IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY started, run_no) AS token FROM runs),
spans AS (SELECT source_name, run_no, lag(started) OVER (PARTITION BY source_name ORDER BY token) AS after FROM numbered WHERE ok = 1)
SELECT n.source_name, n.run_no, CASE WHEN ok = 1 THEN 'done' ELSE 'pending' END AS state, CAST(token AS INTEGER) AS token,
  strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(after, '%Y-%m-%d %H:%M:%S') AS takes_after
FROM numbered n LEFT JOIN spans s ON s.source_name = n.source_name AND s.run_no = n.run_no""",
}
