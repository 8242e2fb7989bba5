"""SQL for DuckDB of the queries that SQL can express over whole tables."""

from __future__ import annotations

from advisorium.plans.problems_sql import sql_id, sql_trim

_SAYS = f"lower({sql_trim('description')})"
# The stand-ins for a description that the tables hold, in lower case and without a full stop at the end.
_NOTHING = """'', 'to be published', 'no description', '-', '--', '?', '??', 'n/a', 'na', 'n.a', 'nil', 'none', 'null', 'tbd', 'tba', 'todo', 'unknown', 'pending', '(no text)', 'no description available',
  'description pending', 'to be determined', 'see references', 'placeholder entry, text will be supplied later', '** reserved ** details follow once the vendor has published'"""
_STEM = rf"trim(regexp_replace({_SAYS}, '[.…]+$', ''))"

_CHOSEN = f"""WITH r AS (
  SELECT {sql_id("id")} AS vuln_id, record_no, updated_at,
    CASE WHEN description IS NOT NULL AND {_STEM} NOT IN ({_NOTHING}) THEN 1 END AS says,
    CASE WHEN modified <= updated_at THEN modified END AS m,
    CASE WHEN published <= updated_at AND published >= TIMESTAMP '1999-01-01' THEN published END AS p,
    coalesce((SELECT min(coalesce(s.authority_rank, 100)) FROM unnest(v.sources) AS u(x) LEFT JOIN sources s ON s.source_name = lower(trim(u.x))), 100) AS rank,
    list_filter(list_transform(coalesce(sources, []), lambda x: lower(trim(x))), lambda x: x <> '') AS names
  FROM vulnerabilities v),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY vuln_id ORDER BY says NULLS LAST, rank, m DESC NULLS LAST, record_no) AS d_at,
    row_number() OVER (PARTITION BY vuln_id ORDER BY p NULLS LAST, record_no) AS p_at,
    row_number() OVER (PARTITION BY vuln_id ORDER BY m DESC NULLS LAST, record_no) AS m_at
  FROM r WHERE vuln_id IS NOT NULL)
SELECT vuln_id,
  coalesce(max(record_no) FILTER (WHERE d_at = 1 AND says = 1), 0) AS description_from,
  coalesce(max(record_no) FILTER (WHERE p_at = 1 AND p IS NOT NULL), 0) AS published_from,
  coalesce(max(record_no) FILTER (WHERE m_at = 1 AND m IS NOT NULL), 0) AS modified_from,
  array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS all_sources
FROM ordered GROUP BY vuln_id HAVING count(*) >= 2"""

ORACLES: dict[str, str] = {
    "p3_found": _CHOSEN,
    "p3_records": f"""SELECT c.vuln_id, d.description, strftime(p.published, '%Y-%m-%d %H:%M:%S.%f') AS published, strftime(m.modified, '%Y-%m-%d %H:%M:%S.%f') AS modified, c.all_sources
  FROM ({_CHOSEN}) c LEFT JOIN vulnerabilities d ON d.record_no = c.description_from LEFT JOIN vulnerabilities p ON p.record_no = c.published_from LEFT JOIN vulnerabilities m ON m.record_no = c.modified_from""",
}
