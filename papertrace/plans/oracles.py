"""DuckDB SQL that states, on its own, what the queries must return."""

from __future__ import annotations

from . import rulings

_SUMS = """
items AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem),
sums AS (SELECT l_orderkey AS k, sum(CASE WHEN l_partkey % 50 <> 0 THEN v END) AS total, sum(v) + CASE WHEN k % 7 = 0 THEN 6 WHEN k % 5 = 0 THEN 5 ELSE 0 END AS target,
  bool_or(l_partkey % 50 = 0) AS gone, bool_or(l_partkey % 50 <> 0 AND l_orderkey % 3 = 0 AND l_linenumber = 2) AS misread, count_if(l_partkey % 50 = 0 OR (l_orderkey % 3 = 0 AND l_linenumber = 2)) AS notes FROM items GROUP BY 1),
judged AS (SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN gone THEN 'INCOMPLETE' WHEN abs(total - target) > 5 THEN 'BROKEN' WHEN misread THEN 'SURVIVES' ELSE 'HOLDS' END AS status, total, target, gone, notes FROM sums)
"""
#: Where a figure is missing, the nearest word of its length is as far off as it is long.
_GRADES = """
s AS (SELECT s_suppkey AS k, 'run' || (s_nationkey % 3) AS parser, 's' || s_suppkey AS doc_id, CAST(s_suppkey * 7919 + 1000000 AS VARCHAR) AS v, CAST(s_suppkey * 104729 + 20000000 AS VARCHAR) AS a, CAST(s_suppkey * 1299709 + 500000000 AS VARCHAR) AS b FROM supplier),
g AS (
  SELECT parser, doc_id, 'title' AS field, 'Statement of account' AS printed, 'OK' AS status, NULL AS got, NULL AS distance, NULL::BOOLEAN AS typed FROM s UNION ALL
  SELECT parser, doc_id, 'due', v, CASE k % 4 WHEN 0 THEN 'OK' WHEN 2 THEN 'ABSENT' ELSE 'CORRUPT' END,
    CASE k % 4 WHEN 1 THEN v[1:4] || 'x' || v[6:] WHEN 3 THEN v[1:4] || ((CAST(v[5:5] AS INT) + 5) % 10) || v[6:] END, CASE k % 4 WHEN 0 THEN NULL WHEN 2 THEN 7 ELSE 1 END, CASE k % 4 WHEN 1 THEN false WHEN 3 THEN true END FROM s UNION ALL
  SELECT parser, doc_id, 'rows[0].total', a, CASE WHEN k % 5 = 0 THEN 'MISPLACED' ELSE 'OK' END, CASE WHEN k % 5 = 0 THEN a END, CASE WHEN k % 5 = 0 THEN 0 END, NULL FROM s UNION ALL
  SELECT parser, doc_id, 'rows[1].total', b, CASE WHEN k % 5 = 0 THEN 'MISPLACED' ELSE 'OK' END, CASE WHEN k % 5 = 0 THEN b END, CASE WHEN k % 5 = 0 THEN 0 END, NULL FROM s)
"""

ORACLE_SQL = {
    "rule_sums": f"WITH {_SUMS} SELECT doc_id, 'order total' AS rule, status, CASE WHEN NOT gone THEN CAST(total AS DOUBLE) END AS total, CASE WHEN NOT gone THEN CAST(target AS DOUBLE) END AS target, CAST(notes + CASE WHEN gone THEN 0 ELSE 1 END AS INT) AS n_notes FROM judged",
    "rule_counts": f"""WITH {_SUMS} SELECT o_orderpriority AS priority, count_if(status = 'HOLDS') AS holds, count_if(status = 'SURVIVES') AS survives, count_if(status = 'BROKEN') AS broken, count_if(status = 'INCOMPLETE') AS incomplete
FROM judged JOIN orders ON doc_id = CAST(o_orderkey AS VARCHAR) GROUP BY 1""",
    "rule_rows": """WITH i AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross, CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS off, CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS wrong FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'net[line ' || l_linenumber || ']' AS rule, 'cells' AS form, CASE WHEN wrong = 1 THEN 'BROKEN' ELSE 'HOLDS' END AS status FROM i WHERE l_linenumber <> 3 UNION ALL
SELECT CAST(l_orderkey AS VARCHAR), 'parts[line ' || l_linenumber || ']', 'row', CASE WHEN abs(gross - off + wrong + CASE WHEN l_linenumber = 3 THEN 0 ELSE off END - gross) > 0.5 THEN 'BROKEN' ELSE 'HOLDS' END FROM i""",
    "rule_identities": """WITH per AS (SELECT n_nationkey, n_regionkey, coalesce(sum(CAST(round(c_acctbal * 100) AS BIGINT)), 0) AS v FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
t AS (SELECT r_name, r_regionkey, sum(v) AS total, CASE r_regionkey WHEN 2 THEN total + 7 WHEN 3 THEN 12345 ELSE total END AS target FROM per JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name AS rule, CASE WHEN abs(total - target) > 0.005 THEN 'BROKEN' ELSE 'HOLDS' END AS status, CAST(total AS DOUBLE) AS total, CAST(target AS DOUBLE) AS target FROM t""",
    "figures": """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '($' || format('{:,.2f}', abs(c_acctbal)) || ')' ELSE '$' || format('{:,.2f}', abs(c_acctbal)) END AS printed, CAST(format('{:.2f}', c_acctbal) AS DOUBLE) AS value,
CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:.2f}', abs(c_acctbal)) AS canon, false AS is_numeric FROM customer""",
    "shapes": """WITH v AS (SELECT unnest([o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), 'PO-' || o_orderkey, 'LN-' || lpad(CAST(o_orderkey AS VARCHAR), 3, '0'), format('{:,.2f}', o_totalprice)]) AS v FROM orders)
SELECT CASE WHEN regexp_matches(v, '^-?[0-9 ,]+(\\.[0-9]+)?$') THEN 'money' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN regexp_matches(v, '(?i)^PO[-\\s]?\\w+$') THEN 'po' WHEN regexp_matches(v, '(?i)^[A-Z]{2}[-\\s]?[0-9]{2,4}\\w*$') THEN 'sku' ELSE 'text' END AS shape,
count(*) AS n, count_if(contains(trim(v), ' ')) AS multiword FROM v GROUP BY 1""".replace("\\\\", "\\"),
    "regrouped": "SELECT o_orderkey, 'sum ' || (o_orderkey * 1009 + 1000000) || repeat('205', CAST(o_orderkey % 13 AS INT)) || CASE o_orderkey % 3 WHEN 0 THEN ' 110.5' WHEN 1 THEN ' 1104' ELSE '' END || ' due' AS joined, o_orderkey % 2 = 0 AS adjacent FROM orders",
    "nearest": """WITH c AS (SELECT c_custkey, c_mktsegment[1:2] || 'x' || c_mktsegment[4:] || CASE WHEN c_custkey % 2 = 0 THEN 's' ELSE '' END AS spelt FROM customer),
n AS (SELECT m, row_number() OVER (ORDER BY m) AS pos FROM (SELECT DISTINCT c_mktsegment AS m FROM customer)),
d AS (SELECT c_custkey, spelt, min({'d': levenshtein(lower(m), lower(spelt)), 'pos': pos, 'm': m}) AS b FROM c LEFT JOIN n ON abs(length(m) - length(spelt)) <= 1 GROUP BY 1, 2)
SELECT c_custkey, spelt, b.d AS distance, b.m AS got, b.m IS NOT NULL AS typed FROM d""",
    "table_rows": "SELECT n_regionkey, string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1",
    "page_lines": """WITH l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '<[^>]+>', chr(10), 'g'), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'),
lambda x: trim(regexp_replace(x, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'), ' ')), lambda x: x <> '') AS l FROM pages)
SELECT page_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM l""",
    "passages": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) AND b.text <> ''",
    "grades": f"WITH {_GRADES} SELECT * FROM g",
    "grade_summary": f"""WITH {_GRADES}, c AS (SELECT parser, 300 AS dpi, count(DISTINCT doc_id) AS pages, count(*) AS fields, count_if(status = 'OK') AS ok, count_if(status = 'ABSENT') AS absent, count_if(status = 'CORRUPT') AS corrupt,
count_if(status = 'CORRUPT' AND typed) AS corrupt_typed, count_if(status = 'MISPLACED') AS misplaced FROM g GROUP BY 1)
SELECT *, corrupt - corrupt_typed AS corrupt_junk, round_even(ok / fields, 4) AS recovery, CASE WHEN fields > ok THEN round_even((corrupt_typed + misplaced) / (fields - ok), 4) END AS quiet_fraction, 2 * pages AS rows_anchored, 2 * pages AS rows FROM c""",
    "recovery": """WITH p AS (SELECT p_brand AS doc_id, l_returnflag AS f, count_if(l_quantity > 10) AS ok, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT doc_id, round_even(100.0 * sum(ok) FILTER (f = 'A') / sum(n) FILTER (f = 'A'), 1) AS "A", round_even(100.0 * sum(ok) FILTER (f = 'N') / sum(n) FILTER (f = 'N'), 1) AS "N", round_even(100.0 * sum(ok) FILTER (f = 'R') / sum(n) FILTER (f = 'R'), 1) AS "R" FROM p GROUP BY ROLLUP (doc_id)""",
    "costs": """WITH price(p, a, b) AS (VALUES ('click', 5.0, 25.0), ('click-1', 2.0, 8.0), ('view', 1.0, 4.0), ('purchase-3', 3.0, 15.0)),
u AS (SELECT event_id, 'run' || (user_id % 3) AS run, event_type || '-' || (user_id % 7) AS model, event_id % 1000 AS i, event_id % 300 AS o FROM events),
x AS (SELECT u.*, a, b FROM u LEFT JOIN price ON starts_with(model, p) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY length(p) DESC) = 1)
SELECT run, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round_even(CAST(sum(coalesce((i * a + o * b) / 1e6, 0)) AS DOUBLE), 6) AS cost, CAST(floor(avg(i)) AS BIGINT) AS mean_input, CAST(floor(avg(o)) AS BIGINT) AS mean_output,
coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (a IS NULL), '') AS unpriced FROM x GROUP BY ROLLUP (run)""",
    "dead_runs": """SELECT concat_ws('/', source, lang) AS parser, count(*) AS n_pages FROM documents WHERE doc_id % 10 <> 0
GROUP BY 1 HAVING NOT bool_or(coalesce(lang <> 'en', true) AND regexp_matches(coalesce(text, ''), '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]'))""",
    "upserts": """WITH f AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT event_id, user_id, event_type, value FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = e.user_id AND f.event_type = e.event_type) UNION ALL SELECT * FROM f""",
    "job_list": "SELECT doc_id, source, dpi FROM documents CROSS JOIN (VALUES (CAST(150 AS INT)), (300)) AS v(dpi)",
    "durations": "SELECT event_type AS parser, CASE WHEN event_id % 2 = 0 THEN 150 ELSE 300 END AS dpi, round_even(avg(floor(value)), 2) AS seconds_per_page FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2",
    "page_classes": """SELECT p_partkey, p_size * 40 > 1000 AND p_size * 50 > 1000 AS page_backed, CASE WHEN CASE WHEN p_partkey % 10 < 3 THEN p_partkey % 10 + 99 ELSE p_partkey % 200 END <= 100 THEN 'none' WHEN p_size * 40 > 1000 THEN 'ocr' ELSE 'typeset' END AS layer, round_even(least(1.0::DOUBLE, 1500.0::DOUBLE / (p_size * 50)), 6) AS scale FROM part""",
}
ORACLE_SQL["stored_verdicts"] = ORACLE_SQL["grades"]
ORACLE_SQL["rates_shown"] = f"""WITH {_GRADES}, c AS (SELECT parser, count(*) AS n, count_if(status = 'OK') AS ok, count_if(status = 'CORRUPT' AND typed) + count_if(status = 'MISPLACED') AS quiet FROM g GROUP BY 1)
SELECT parser, 300 AS dpi, format('{{:.1f}}%', round_even(100.0 * ok / n, 1)) AS recovered, CASE WHEN n > ok THEN CAST(CAST(round_even(100 * round_even(quiet / (n - ok), 4), 0) AS INT) AS VARCHAR) || '%' ELSE '-' END AS quiet FROM c"""
ORACLE_SQL |= rulings.ORACLE_SQL
