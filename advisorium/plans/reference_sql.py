"""SQL counterparts of the corpus queries."""

from __future__ import annotations

from advisorium.plans.problems_sql import sql_form, sql_id, sql_trim

_PRODUCT = "lower(replace(p_name, ' ', '-'))"
_STATEMENTS = f"""said AS (
  SELECT 'CVE-2024-' || lpad(CAST(l_orderkey AS VARCHAR), 7, '0') AS vuln_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fingerprint,
    'vendor-' || l_suppkey AS vendor, {_PRODUCT} AS product, l_linenumber AS low, CAST(trunc(l_quantity) AS INTEGER) AS high, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_COMPONENTS = f"comps AS (SELECT p_partkey AS comp_id, {_PRODUCT} AS name, p_size AS version, 'vendor-' || (p_partkey % 10 + 1) AS vendor FROM part)"
_NAMES = f"""names AS (SELECT DISTINCT {sql_id("alias")} AS alias, {sql_id("vuln_id")} AS vuln_id FROM vuln_aliases
  WHERE {sql_id("alias")} IS NOT NULL AND {sql_id("vuln_id")} IS NOT NULL)"""
_KEV = f"""kev AS (SELECT {sql_id("vuln_id")} AS cve_id, min(snapshot_at) AS date_added FROM vuln_snapshots WHERE in_kev AND {sql_id("vuln_id")} IS NOT NULL GROUP BY 1)"""
_EPSS = f"""epss AS (SELECT {sql_id("vuln_id")} AS cve_id, epss_score AS score, snapshot_at AS score_date, row_no FROM vuln_snapshots WHERE epss_score IS NOT NULL AND {sql_id("vuln_id")} IS NOT NULL)"""
_FLAGGED = f"""flagged AS (SELECT record_no, {sql_id("id")} AS id, in_kev, epss_score FROM vulnerabilities)"""
RECORDS = """records AS (
  SELECT event_id AS seq, user_id % 500 AS flaw, CASE event_type WHEN 'purchase' THEN 'cvelist' WHEN 'signup' THEN 'nvd' WHEN 'click' THEN 'csaf' WHEN 'view' THEN 'osv' ELSE 'other' END AS source,
    CAST(user_id AS VARCHAR) AS record_id, CASE WHEN event_id % 17 <> 0 THEN ts END AS modified, ts AS published,
    CASE WHEN event_id % 3 <> 0 THEN event_type || '-' || event_id END AS title, event_type AS assigner, 'A-' || (event_id % 7) AS alias, event_type AS cwe
  FROM events),
epochs AS (SELECT *, sum(CASE WHEN modified IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source, record_id ORDER BY seq) AS epoch FROM records),
guarded AS (SELECT *, coalesce(modified < max(modified) OVER (PARTITION BY source, record_id, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale,
    CASE source WHEN 'cvelist' THEN 0 WHEN 'nvd' THEN 2 WHEN 'csaf' THEN 4 WHEN 'osv' THEN 8 ELSE 100 END AS rank FROM epochs)"""
_OFFERED = f"""{_STATEMENTS}, {_COMPONENTS},
asked AS (SELECT comp_id, 'k_vendor' AS channel, vendor || '|' || name AS key FROM comps UNION ALL SELECT comp_id, 'k_name', name FROM comps),
offered AS (SELECT vuln_id, fingerprint, 'k_vendor' AS channel, vendor || '|' || product AS key FROM said UNION ALL SELECT vuln_id, fingerprint, 'k_name', product FROM said),
ranked AS (SELECT *, row_number() OVER (PARTITION BY channel, key ORDER BY vuln_id, fingerprint) AS at_, count(*) OVER (PARTITION BY channel, key) AS n FROM offered)"""


def _list(where: str, order: str, limit: int, offset: int = 0, more: str = "") -> str:
    return f"SELECT record_no, id{more} FROM vulnerabilities WHERE {where} ORDER BY {order}, record_no LIMIT {limit} OFFSET {offset}"


def _safe(c: str) -> str:
    t = f"coalesce({c}, '')"
    return rf"CASE WHEN regexp_matches({t}, '^[=+\-@\t\r]') THEN chr(39) || {t} ELSE {t} END"


def _metric(name: str) -> str:
    return rf"regexp_extract('/' || upper(trim(base_score_vector)), '.*/\s*{name}\s*:\s*([^/]*?)\s*(?:/|$)', 1)"


def _weight(name: str, **values: float) -> str:
    return f"CASE {_metric(name)} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + " END"


# The published formulas of CVSS 3 and 2, stated here by themselves.
_LOSS = "1 - (1 - ({c})) * (1 - ({i})) * (1 - ({a}))"
_LOSS3 = _LOSS.format(**{n.lower(): _weight(n, H=0.56, L=0.22, N=0.0) for n in "CIA"})
_LOSS2 = _LOSS.format(**{n.lower(): _weight(n, N=0.0, P=0.275, C=0.66) for n in "CIA"})
_EASY3 = f"CAST(8.22 AS DOUBLE) * ({_weight('AV', N=0.85, A=0.62, L=0.55, P=0.2)}) * ({_weight('AC', L=0.77, H=0.44)}) * (CASE WHEN {_metric('S')} = 'C' THEN {_weight('PR', N=0.85, L=0.68, H=0.5)} ELSE {_weight('PR', N=0.85, L=0.62, H=0.27)} END) * ({_weight('UI', N=0.85, R=0.62)})"
_EASY2 = f"CAST(20.0 AS DOUBLE) * ({_weight('AV', L=0.395, A=0.646, N=1.0)}) * ({_weight('AC', H=0.35, M=0.61, L=0.71)}) * ({_weight('AU', M=0.45, S=0.56, N=0.704)})"
_SCORES = f"""WITH v AS (SELECT item_no, trim(base_score_vector) AS v, {_metric('S')} = 'C' AS changed, {_LOSS3} AS iss, {_EASY3} AS easy, CAST(10.41 AS DOUBLE) * ({_LOSS2}) AS impact2, {_EASY2} AS easy2 FROM euvd_items),
      w AS (SELECT *, CASE WHEN changed THEN CAST(7.52 AS DOUBLE) * (iss - CAST(0.029 AS DOUBLE)) - CAST(3.25 AS DOUBLE) * pow(iss - CAST(0.02 AS DOUBLE), 15) ELSE CAST(6.42 AS DOUBLE) * iss END AS impact FROM v),
      x AS (SELECT *, CASE WHEN (impact + easy) * (CASE WHEN changed THEN CAST(1.08 AS DOUBLE) ELSE 1 END) > 10 THEN 10 ELSE (impact + easy) * (CASE WHEN changed THEN CAST(1.08 AS DOUBLE) ELSE 1 END) END AS raw,
        (CAST(0.6 AS DOUBLE) * impact2 + CAST(0.4 AS DOUBLE) * easy2 - CAST(1.5 AS DOUBLE)) * (CASE WHEN impact2 = 0 THEN 0 ELSE CAST(1.176 AS DOUBLE) END) AS raw2 FROM w)"""

ORACLES: dict[str, str] = {
    "base_scores": f"""{_SCORES} SELECT item_no, CASE WHEN v LIKE 'CVSS:3.1%' OR v LIKE 'CVSS:3.0%' THEN CASE WHEN impact <= 0 AND easy IS NOT NULL THEN 0
        WHEN v LIKE 'CVSS:3.1%' THEN CASE WHEN CAST(round(raw * 100000) AS BIGINT) % 10000 = 0 THEN round(raw * 100000) / 100000 ELSE (floor(round(raw * 100000) / 10000) + 1) / 10 END ELSE ceil(raw * 10) / 10 END
      WHEN v LIKE 'AV:%' THEN floor(greatest(raw2, 0) * 10 + 0.5) / 10 END AS score FROM x""",
    "list_modified": _list("modified >= TIMESTAMP '2025-06-01'", "modified DESC NULLS LAST, id", 200),
    "list_published": _list("published >= TIMESTAMP '2025-06-01'", "published DESC NULLS LAST, id", 50, 25),
    "list_score": _list("primary_score BETWEEN 5 AND 9", "primary_score DESC NULLS LAST, id", 100, 50, ", primary_score"),
    "list_epss_kev": _list("in_kev AND epss_score >= 0.01", "epss_score DESC NULLS LAST, id", 100),
    "list_ratings": _list("upper(primary_rating) IN ('HIGH', 'CRITICAL') AND upper(state) = 'PUBLISHED'", "id", 1000),
    "list_sources": _list("list_has_any(sources, ['nvd', 'osv']) AND list_has_any(cwes, ['CWE-79', 'CWE-89'])", "id", 500),
    "list_text": _list(r"list_has_all(string_split_regex(lower(concat_ws(' ', id, title, description, array_to_string(aliases, ' '))), '[^\p{L}\p{N}]+'), ['cache', 'authorization'])", "id", 1000),
    "list_total": "SELECT count(*) AS total FROM vulnerabilities WHERE primary_score >= 5 AND list_contains(sources, 'nvd')",
    "list_children": f"""WITH {_STATEMENTS} SELECT 'CVE-2024-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS id FROM orders o
      WHERE EXISTS (SELECT 1 FROM said s WHERE s.vuln_id = 'CVE-2024-' || lpad(CAST(o.o_orderkey AS VARCHAR), 7, '0') AND s.vendor = 'vendor-1')
        AND EXISTS (SELECT 1 FROM said s WHERE s.vuln_id = 'CVE-2024-' || lpad(CAST(o.o_orderkey AS VARCHAR), 7, '0') AND s.vendor = 'vendor-2')""",
    "kev_first": f"WITH {_NAMES}, {_KEV} SELECT vuln_id, strftime(min(date_added), '%Y-%m-%d') AS kev_date_added FROM kev JOIN names ON alias = cve_id GROUP BY vuln_id",
    "epss_best": f"WITH {_NAMES}, {_EPSS} SELECT vuln_id, round(max(score), 6) AS epss_score FROM epss JOIN names ON alias = cve_id GROUP BY vuln_id",
    "kev_stale": f"WITH {_NAMES}, {_KEV}, {_FLAGGED} SELECT record_no, id FROM flagged f WHERE in_kev AND NOT EXISTS (SELECT 1 FROM kev JOIN names ON alias = cve_id WHERE vuln_id = f.id)",
    "kev_resync": f"""WITH {_NAMES}, {_KEV}, {_EPSS}, {_FLAGGED},
      k AS (SELECT vuln_id, min(date_added) AS at_ FROM kev JOIN names ON alias = cve_id GROUP BY 1), p AS (SELECT vuln_id, max(score) AS score FROM epss JOIN names ON alias = cve_id GROUP BY 1)
      SELECT k.at_ IS NOT NULL AS in_kev, (f.in_kev IS DISTINCT FROM (k.at_ IS NOT NULL) OR f.epss_score IS DISTINCT FROM p.score) AS changed, count(*) AS n
      FROM flagged f LEFT JOIN k ON k.vuln_id = f.id LEFT JOIN p ON p.vuln_id = f.id GROUP BY 1, 2""",
    "stats": """SELECT count(*) AS vulnerabilities, count(*) FILTER (WHERE primary_score IS NULL) AS unscored, count(*) FILTER (WHERE in_kev) AS exploited,
      (SELECT count(*) FROM vuln_aliases) AS aliases, (SELECT count(*) FROM kev_entries) AS kev_entries,
      strftime(max(modified), '%Y-%m-%d %H:%M:%S') AS newest_modified, strftime(min(published), '%Y-%m-%d %H:%M:%S') AS oldest_published FROM vulnerabilities""",
    "counts_by_rating": "SELECT coalesce(upper(primary_rating), 'UNSCORED') AS rating, count(*) AS n FROM vulnerabilities GROUP BY 1",
    "counts_by_source": "SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM vulnerabilities) GROUP BY 1",
    "vendor_ranks": f"WITH {_STATEMENTS} SELECT product, vendor, count(DISTINCT vuln_id) AS n FROM said GROUP BY ALL",
    "vendor_top": f"""WITH {_STATEMENTS}, r AS (SELECT product, vendor, count(DISTINCT vuln_id) AS n FROM said GROUP BY ALL)
      SELECT product, vendor, n FROM r QUALIFY row_number() OVER (PARTITION BY product ORDER BY n DESC, vendor) <= 5""",
    "version_guard": f"WITH {RECORDS} SELECT source, count(*) AS n, count(*) FILTER (WHERE stale) AS n_stale FROM guarded GROUP BY 1",
    "newest_contributions": f"WITH {RECORDS} SELECT source, record_id, max(seq) AS seq FROM guarded WHERE NOT stale GROUP BY ALL",
    "fold_documents": f"""WITH {RECORDS},
      live AS (SELECT *, coalesce(min(rank) OVER w, 1000) AS best, count(title) OVER w AS titles FROM guarded WHERE NOT stale
        WINDOW w AS (PARTITION BY flaw ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      docs AS (SELECT flaw, arg_max(title, seq) FILTER (WHERE title IS NOT NULL AND (rank <= best OR titles = 0)) AS title, arg_max(assigner, seq) FILTER (WHERE rank <= best) AS assigner,
        arg_min(source, struct_pack(r := rank, s := seq)) AS source, strftime(min(published), '%Y-%m-%d %H:%M:%S') AS published, strftime(max(modified), '%Y-%m-%d %H:%M:%S') AS modified,
        array_to_string(list_sort(list_distinct(list(cwe))), ',') AS cwes FROM live GROUP BY flaw),
      named AS (SELECT flaw, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases FROM guarded GROUP BY flaw)
      SELECT flaw, title, assigner, source, aliases, cwes, published, modified FROM docs JOIN named USING (flaw)""",
    "top_statements": f"WITH {_OFFERED} SELECT DISTINCT comp_id, vuln_id, fingerprint FROM asked JOIN ranked USING (channel, key) WHERE at_ <= 3",
    "truncated_lookups": f"WITH {_OFFERED} SELECT DISTINCT comp_id, channel, n AS n_statements FROM asked JOIN ranked USING (channel, key) WHERE n > 3",
    "capped_lookups": f"WITH {_OFFERED} SELECT DISTINCT comp_id, channel, n AS n_statements FROM asked JOIN ranked USING (channel, key) WHERE n > 2000",
    "scan_findings": f"""WITH {_STATEMENTS}, {_COMPONENTS} SELECT DISTINCT comp_id, vuln_id, 'finding' AS outcome, 'possible' AS confidence, 'vendor_product' AS matched_on
      FROM comps JOIN said ON name = product AND comps.vendor = said.vendor WHERE version >= low AND version < high""",
    "scan_counts": f"""WITH {_STATEMENTS}, {_COMPONENTS}, f AS (SELECT DISTINCT comp_id, vuln_id FROM comps JOIN said ON name = product AND comps.vendor = said.vendor WHERE version >= low AND version < high)
      SELECT 'possible' AS confidence, count(*) AS n FROM f HAVING count(*) > 0""",
    "id_lists": rf"""SELECT record_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([id], coalesce(aliases, [])), lambda x: {sql_form("x")}), lambda x: x <> ''))), '|') AS identifiers FROM vulnerabilities""",
    "scan_report": f"""WITH {_STATEMENTS}, {_COMPONENTS}, f AS (SELECT DISTINCT comp_id, name, vuln_id FROM comps JOIN said ON name = product AND comps.vendor = said.vendor WHERE version >= low AND version < high),
      o AS (SELECT 'CVE-2024-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS vuln_id, o_orderstatus = 'F' AS in_kev, o_totalprice / 1e6 AS epss, (o_orderkey % 100) / 10 AS score FROM orders)
      SELECT comp_id, vuln_id, name, in_kev FROM f LEFT JOIN o USING (vuln_id) ORDER BY coalesce(in_kev, false) DESC, coalesce(epss, 0) DESC, coalesce(score, 0) DESC, vuln_id, name, comp_id LIMIT 200""",
    "channel_lookups": f"""WITH {_STATEMENTS}, {_COMPONENTS},
      asked AS (SELECT comp_id, unnest([{{c: 1, k: 'pkg:npm/' || name}}, {{c: 2, k: 'npm|' || name}}, {{c: 3, k: vendor || '|' || name}}, {{c: 4, k: name}}], recursive := true) FROM comps),
      offered AS (SELECT vuln_id, fingerprint, 4 AS c, product AS k FROM said UNION ALL SELECT vuln_id, fingerprint, 1, 'pkg:npm/' || product FROM said WHERE low % 4 = 0
        UNION ALL SELECT vuln_id, fingerprint, 2, 'npm|' || product FROM said WHERE low % 4 = 1 UNION ALL SELECT vuln_id, fingerprint, 3, vendor || '|' || product FROM said WHERE low % 4 = 2),
      ranked AS (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY c, k ORDER BY vuln_id, fingerprint) <= 3)
      SELECT DISTINCT comp_id, vuln_id, fingerprint FROM asked JOIN ranked USING (c, k)""",
    "flaw_details": f"""WITH {_NAMES}, {_KEV}, {_EPSS}, best AS (SELECT cve_id, max(score) AS score FROM epss GROUP BY 1),
      own AS (SELECT {sql_id("id")} AS id, count(*) AS n_records FROM vulnerabilities WHERE {sql_id("id")} IS NOT NULL GROUP BY 1),
      asked AS (SELECT DISTINCT {sql_id("alias")} AS name FROM vuln_aliases WHERE {sql_id("alias")} IS NOT NULL),
      ways AS (SELECT name, 'id' AS via, 0 AS r, name AS id FROM asked WHERE name IN (SELECT id FROM own) UNION ALL SELECT name, 'alias', 1, vuln_id FROM asked JOIN names ON alias = name),
      led AS (SELECT name, arg_min(id, struct_pack(r := r, i := id)) AS id, arg_min(via, r) AS matched_via FROM ways GROUP BY 1),
      k AS (SELECT vuln_id AS id, arg_min(cve_id, struct_pack(d := date_added, c := cve_id)) AS kev_cve_id, min(date_added) AS date_added FROM kev JOIN names ON alias = cve_id GROUP BY 1),
      p AS (SELECT vuln_id AS id, arg_min(cve_id, struct_pack(s := -score, c := cve_id)) AS epss_cve_id, max(score) AS score FROM best JOIN names ON alias = cve_id GROUP BY 1)
      SELECT name, id, matched_via, n_records, kev_cve_id, strftime(date_added, '%Y-%m-%d') AS date_added, epss_cve_id, round(score, 6) AS score FROM led JOIN own USING (id) LEFT JOIN k USING (id) LEFT JOIN p USING (id)""",
    "merged_children": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1",
    "version_windows": f"WITH {_STATEMENTS} SELECT p_size >= low AND p_size < high AS inside, count(*) AS n FROM said GROUP BY 1",
    "verdict_batch": f"""WITH {_STATEMENTS} SELECT CASE WHEN p_size >= low AND p_size < high THEN 'match' ELSE 'no_match' END AS result, CASE WHEN p_size >= low AND p_size < high THEN 'possible' END AS confidence, count(*) AS n FROM said GROUP BY ALL""",
    "id_forms": rf"""SELECT record_no, {sql_id("id")} AS identifier, CASE WHEN regexp_full_match({sql_trim("id")}, '(?i)CVE-\d{{4}}-\d{{4,}}') THEN 0 WHEN regexp_full_match({sql_trim("id")}, '(?i)GHSA(-[a-z0-9]{{4}}){{3}}') THEN 1
      WHEN regexp_full_match({sql_trim("id")}, '(?i)EUVD-\d{{4}}-\d+') THEN 2 WHEN regexp_full_match({sql_trim("id")}, '(?i)GCVE-\d+-\d{{4}}-\d+') THEN 3 ELSE 4 END AS rank FROM vulnerabilities""",
    "ratings": """SELECT item_no, CASE WHEN base_score IS NULL THEN NULL WHEN base_score <= 0 THEN 'NONE' WHEN base_score < 4 THEN 'LOW' WHEN base_score < 7 THEN 'MEDIUM' WHEN base_score < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS rating,
      CASE WHEN base_score IS NULL THEN NULL WHEN base_score <= 0 THEN 'NONE' WHEN base_score < 4 THEN 'LOW' WHEN base_score < 7 THEN 'MEDIUM' ELSE 'HIGH' END AS rating_v2,
      CASE WHEN trim(base_score_vector) LIKE 'CVSS:4.0%' THEN 'CVSS_V4_0' WHEN trim(base_score_vector) LIKE 'CVSS:3.1%' THEN 'CVSS_V3_1' WHEN trim(base_score_vector) LIKE 'CVSS:3.0%' THEN 'CVSS_V3_0' WHEN trim(base_score_vector) LIKE 'AV:%' THEN 'CVSS_V2' ELSE 'OTHER' END AS vector_type FROM euvd_items""",
    "purl_keys": """SELECT rec_no, lower(regexp_replace(split_part(split_part('pkg:' || ecosystem || '/' || package_name || '@1.0?arch=x#y', '?', 1), '#', 1), '@[^/@]*$', '')) AS purl_key FROM osv_records""",
    "folded_names": r"""SELECT item_no, trim(regexp_replace(lower(trim(product_name)), '[ \t_./-]+', '-', 'g'), '-') AS folded FROM euvd_items""",
    "document_hashes": "SELECT CAST(doc_id AS VARCHAR) AS record_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1",
    "snapshot_changes_last": f"""WITH r AS (SELECT {sql_id("cve_id")} AS id, row_no, vuln_status AS s, base_score AS v FROM nvd_cve WHERE {sql_id("cve_id")} IS NOT NULL),
      a AS (SELECT id, max(row_no) AS row_no FROM r GROUP BY 1), b AS (SELECT r.id, max(r.row_no) AS row_no FROM r JOIN a ON a.id = r.id AND r.row_no < a.row_no GROUP BY 1)
      SELECT a.id, CASE WHEN b.id IS NULL THEN 'created' ELSE 'updated' END AS change_kind FROM a JOIN r x ON x.row_no = a.row_no LEFT JOIN b ON b.id = a.id LEFT JOIN r y ON y.row_no = b.row_no
      WHERE b.id IS NULL OR x.s IS DISTINCT FROM y.s OR x.v IS DISTINCT FROM y.v""",
    "epss_upserts": f"WITH {_EPSS} SELECT cve_id, round(arg_max(score, struct_pack(d := score_date, r := row_no)), 6) AS score, strftime(max(score_date), '%Y-%m-%d') AS score_date FROM epss GROUP BY cve_id",
    "kev_replace_all": rf"""WITH c AS (SELECT delivery_no, fetched_at, regexp_extract(catalog_version, '^\D*(\d{{4}})(?:\D+(\d{{1,2}})\D+(\d{{1,2}})|(\d{{2}})(\d{{2}}))\D*$', ['y', 'm', 'd', 'n', 'e']) AS p FROM kev_catalogs
        WHERE lower({sql_trim("fetch_status")}) = 'complete' AND regexp_matches(catalog_version, '^\D*(\d{{4}})(?:\D+(\d{{1,2}})\D+(\d{{1,2}})|(\d{{2}})(\d{{2}}))\D*$')),
      v AS (SELECT CAST(p.y AS INTEGER) * 10000 + CAST(p.m || p.n AS INTEGER) * 100 + CAST(p.d || p.e AS INTEGER) AS version, arg_max(delivery_no, struct_pack(f := fetched_at, n := delivery_no)) AS delivery_no FROM c GROUP BY 1),
      e AS (SELECT DISTINCT ON (version, id) version, id, nullif({sql_trim("product")}, '') AS product, entry_no, lower({sql_trim("known_ransomware_use")}) = 'known' AS known
        FROM (SELECT *, {sql_id("cve_id")} AS id FROM kev_entries) JOIN v USING (delivery_no) WHERE id IS NOT NULL ORDER BY version, id, entry_no),
      filled AS (SELECT DISTINCT version FROM e), every_id AS (SELECT DISTINCT id FROM e),
      gone AS (SELECT i.id, max(f.version) AS version FROM every_id i CROSS JOIN filled f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = i.id AND e.version = f.version) GROUP BY 1)
      SELECT e.id AS cve_id, arg_min(e.product, e.version) FILTER (WHERE e.product IS NOT NULL) AS product, min(e.entry_no) AS date_added, coalesce(bool_or(e.known), false) AS known_ransomware, 'cisa' AS kev_sources
      FROM e LEFT JOIN gone g ON g.id = e.id WHERE g.version IS NULL OR e.version > g.version GROUP BY e.id""",
    "text_tokens": r"SELECT doc_id, len(list_filter(list_distinct(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')), lambda x: x <> '')) AS n_distinct FROM documents",
    "distinct_arrays": "SELECT record_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(cwes, []), lambda x: trim(x)), lambda x: x <> ''))), ',') AS cwes FROM vulnerabilities",
    "osv_parsed": rf"""WITH r AS (SELECT CASE WHEN regexp_full_match({sql_trim("id")}, '(?i)GHSA(-[a-z0-9]{{4}}){{3}}') THEN 'GHSA-' || lower(substr({sql_trim("id")}, 6))
        WHEN regexp_full_match({sql_trim("id")}, '(?i)(CVE-\d{{4}}-\d{{4,}}|EUVD-\d{{4}}-\d+|GCVE-\d+-\d{{4}}-\d+)') THEN upper({sql_trim("id")}) ELSE {sql_trim("id")} END AS id, summary, package_name,
        len(list_distinct(list_filter(list_transform(coalesce(aliases, []), lambda x: upper({sql_trim("x")})), lambda x: x <> ''))) AS k FROM osv_records WHERE {sql_trim("coalesce(id, '')")} <> '')
      SELECT id, count(*) AS n, max(summary) AS title, max(package_name) AS product, max(k) AS n_names FROM r GROUP BY id""",
    "nvd_parsed": rf"""WITH r AS (SELECT upper(trim(replace(replace(cve_id, chr(10), ''), chr(9), ''))) AS id, CASE WHEN upper(vuln_status) = 'REJECTED' THEN 'REJECTED' ELSE 'PUBLISHED' END AS state, base_score FROM nvd_cve WHERE trim(coalesce(cve_id, '')) <> '')
      SELECT id, state, count(*) AS n, max(base_score) AS score, max(CASE WHEN base_score IS NULL THEN NULL WHEN base_score <= 0 THEN 'NONE' WHEN base_score < 4 THEN 'LOW' WHEN base_score < 7 THEN 'MEDIUM' WHEN base_score < 9 THEN 'HIGH' ELSE 'CRITICAL' END) AS rating FROM r GROUP BY ALL""",
    "csv_export": rf"""SELECT {_safe("id")} AS id, {_safe("title")} AS title, {_safe("state")} AS state, coalesce(strftime(published, '%Y-%m-%dT%H:%M:%SZ'), '') AS published, coalesce(strftime(modified, '%Y-%m-%dT%H:%M:%SZ'), '') AS modified,
      {_safe("primary_rating")} AS rating, coalesce(format('{{:.1f}}', primary_score), '') AS score, coalesce(format('{{:.5f}}', epss_score), '') AS epss, CASE WHEN in_kev THEN 'true' ELSE 'false' END AS in_kev,
      {_safe("array_to_string(sources, ';')")} AS sources, {_safe("array_to_string(cwes, ';')")} AS cwes FROM vulnerabilities""",
    "service_vendors": f"""WITH {_STATEMENTS}, {_COMPONENTS}, r AS (SELECT product, vendor, count(DISTINCT vuln_id) AS n FROM said GROUP BY ALL),
      t AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n DESC, vendor) AS at_ FROM r QUALIFY at_ <= 5), k AS (SELECT product, list(vendor ORDER BY at_) AS vendors FROM t GROUP BY 1)
      SELECT comp_id, name AS product, CASE WHEN vendors IS NULL OR list_contains(vendors, vendor) THEN vendor ELSE vendors[1] END AS vendor FROM comps LEFT JOIN k ON k.product = name""",
    "bundle_windows": """WITH a AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events), k AS (SELECT * FROM a WHERE day(day) % 3 = 0),
      p AS (SELECT a.event_type, a.day, k.day AS near, row_number() OVER (PARTITION BY a.event_type, a.day ORDER BY abs(a.day - k.day), k.day) AS at_ FROM a LEFT JOIN k ON k.event_type = a.event_type)
      SELECT 'https://host.invalid/' || event_type || '?from=' || strftime(day, '%Y-%m-%d') || '&page=1' AS url, 'https://host.invalid/' || event_type || '?from=' || strftime(near, '%Y-%m-%d') || '&page=1' AS recorded_url, day = near AS exact FROM p WHERE at_ = 1""",
    "banner_services": r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, trim(unnest(x), ' ') AS b FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]') AS x FROM documents WHERE text IS NOT NULL)),
      m AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(b, '(?i)^\d+/(?:tcp|udp)\s+open\s+([a-z][\w.-]*)\s+(\d[\w.-]*)') THEN regexp_extract(b, '(?i)^\d+/(?:tcp|udp)\s+open\s+([a-z][\w.-]*)\s+(\d[\w.-]*)', ['p', 'v'])
        WHEN regexp_matches(b, '(?i)^SSH-[\d.]+-([a-z]\w*?)_(\d[\w.-]*)') THEN regexp_extract(b, '(?i)^SSH-[\d.]+-([a-z]\w*?)_(\d[\w.-]*)', ['p', 'v'])
        WHEN regexp_matches(b, '(?i)^Server:\s*([a-z][\w-]*)/(\d[\w.-]*)') THEN regexp_extract(b, '(?i)^Server:\s*([a-z][\w-]*)/(\d[\w.-]*)', ['p', 'v'])
        WHEN regexp_matches(b, '(?i)^220[ -]\S+\s+([a-z][\w ]*?)\s+(\d[\w.-]*)(?:\s+ready)?\s*$') THEN regexp_extract(b, '(?i)^220[ -]\S+\s+([a-z][\w ]*?)\s+(\d[\w.-]*)(?:\s+ready)?\s*$', ['p', 'v']) END AS s FROM l)
      SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(regexp_replace(lower(trim(s.p)), '[ \t_./-]+', '-', 'g'), '-') AS product, s.v AS version FROM m WHERE s IS NOT NULL""",
}
