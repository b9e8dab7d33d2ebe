"""DuckDB equivalents of the queries on scans, workbooks, crowded pictures and readings."""

#: A code per nation.
DICTIONARY = "(SELECT lpad((n_nationkey * 7 % 97)::VARCHAR, 2, '0') || substr('ABGOI', (n_nationkey % 5 + 1)::INT, 1) || lpad((n_nationkey * 2 + 1)::VARCHAR, 2, '0') AS code FROM nation)"

_ID = "l_orderkey, l_linenumber, l_partkey"


_LINES = "SELECT l_partkey * 100 + l_suppkey AS box_id, (l_partkey * 100 + l_suppkey) % 25 AS picture, (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 90)::DOUBLE AS y, (20 + l_linenumber * 3)::DOUBLE AS w, 10 + l_quantity AS h, l_discount AS score FROM lineitem"
_ORDERS = "SELECT o_orderkey AS box_id, o_orderkey % 40 AS picture, (o_custkey % 100)::DOUBLE AS x, (o_orderkey % 30)::DOUBLE AS y, (o_orderkey % 5 * 3 + 20)::DOUBLE AS w, (o_custkey % 9 + 10)::DOUBLE AS h, 0 AS score FROM orders"


def _greedy(boxes: str, conflict: str, first: str, most: str = "") -> str:
    """Boxes in order, one per step and picture; kept ones travel in a list."""
    return f"""WITH RECURSIVE b AS ({boxes}),
o AS (SELECT *, row_number() OVER (PARTITION BY picture ORDER BY {first}, box_id, x, y, w, h, score) AS i, {{'x': x, 'y': y, 'w': w, 'h': h}} AS box FROM b),
s(picture, i, kept, stays) AS (SELECT DISTINCT picture, 0::BIGINT, []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[], false FROM o UNION ALL
  SELECT picture, i, CASE WHEN good THEN list_append(kept, box) ELSE kept END, good
  FROM (SELECT o.picture, o.i, s.kept, o.box, len(list_filter(s.kept, lambda k: {conflict})) = 0 {most} AS good FROM s JOIN o ON o.picture = s.picture AND o.i = s.i + 1))
SELECT o.picture, box_id, x, y, w, h"""


_CENTRES = "sqrt(pow(k.x + k.w / 2 - o.x - o.w / 2, 2) + pow(k.y + k.h / 2 - o.y - o.h / 2, 2)) < 28"
_EQUALS = "abs(k.x + k.w / 2 - o.x - o.w / 2) <= 3 AND abs(k.y + k.h / 2 - o.y - o.h / 2) <= 3 AND abs(k.w - o.w) <= 5 AND abs(k.h - o.h) <= 5"
_END = " FROM s JOIN o USING (picture, i) WHERE stays"

_RAW = """r AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN left(props, len(props) - 1) WHEN event_id % 11 = 0 THEN '{"k": "n/a", "extra": [1, 2], "value": "' || value::DECIMAL(12, 2) || '"}'
  WHEN event_id % 5 = 0 THEN replace(props, '"k"', '"key"') ELSE props END AS raw FROM events),
j AS (SELECT *, coalesce(json_valid(raw), false) AS good FROM r),
v AS (SELECT *, CASE WHEN good THEN coalesce(json_extract_string(raw, '$.k'), json_extract_string(raw, '$.key')) END AS k, CASE WHEN good THEN json_extract_string(raw, '$.value') END AS value FROM j)"""


def _scan(parent: str, kinds: str) -> str:
    return f"""WITH RECURSIVE {parent}, p AS (SELECT *, role || ':' || turn AS name FROM par),
links AS (SELECT conv_id AS doc, conv_id * 1000 + parent_pos AS parent, 1 AS ord, turn AS item, conv_id * 1000 + turn AS child, name FROM p WHERE parent_pos IS NOT NULL
  UNION ALL SELECT conv_id, conv_id * 1000 + turn - 2, 2, turn, conv_id * 1000 + turn, name FROM p WHERE turn % 3 = 2
  UNION ALL SELECT p.conv_id, p.conv_id * 1000 + p.turn, 3, 0, p.conv_id * 1000, f.name FROM p JOIN p f ON f.conv_id = p.conv_id AND f.turn = 0 WHERE p.turn % 2 = 1),
walk(doc, node, path) AS (SELECT conv_id, conv_id * 1000 + turn, [{{'o': 0, 'i': turn, 'n': conv_id * 1000 + turn, 'name': name}}] FROM p WHERE parent_pos IS NULL
  UNION ALL SELECT w.doc, l.child, list_append(w.path, {{'o': l.ord, 'i': l.item, 'n': l.child, 'name': l.name}}) FROM walk w JOIN links l ON l.doc = w.doc AND l.parent = w.node
  WHERE l.ord IN ({kinds}) AND NOT list_contains(list_transform(w.path, lambda s: s.n), l.child)),
best AS (SELECT doc, node, arg_min(path, list_transform(path, lambda s: {{'o': s.o, 'i': s.i}})) AS path FROM walk GROUP BY 1, 2),
c AS (SELECT doc AS d, path[-2].n AS above, count(*) AS children FROM best WHERE len(path) > 1 GROUP BY 1, 2)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY list_transform(path, lambda s: {{'o': s.o, 'i': s.i}}))::INT AS position, node, CASE WHEN len(path) > 1 THEN path[-2].n END AS parent, (len(path) - 1)::INT AS level,
  array_to_string(list_transform(path, lambda s: s.name), ' > ') AS path, coalesce(children, 0) AS children FROM best LEFT JOIN c ON d = doc AND above = node"""


def oracle(parent: str, plausibility: str, noisy: str) -> dict[str, str]:
    comma = lambda x: f"replace({x}::VARCHAR, '.', ',')"
    letters = "(l_returnflag || CASE WHEN l_partkey % 4 = 0 THEN 'BC' ELSE '' END)"
    return {
        "object_scan": _scan(parent, "1, 2, 3"),
        "object_tree": _scan(parent, "1"),
        "record_scan": f"""WITH {_RAW}, w AS (SELECT *, CASE WHEN raw IS NULL THEN 'EMPTY' WHEN NOT good THEN 'ERROR' WHEN k IS NOT NULL AND TRY_CAST(k AS INT) IS NULL THEN 'PARTIAL' ELSE 'OK' END AS s FROM v)
SELECT event_id, TRY_CAST(k AS INT) AS k, TRY_CAST(value AS DOUBLE) AS value, s AS read_status, CASE s WHEN 'EMPTY' THEN 'no record' WHEN 'ERROR' THEN 'no JSON: ' || left(raw, 40) WHEN 'PARTIAL' THEN 'k: not a int: ' || k ELSE '' END AS diagnostic FROM w""",
        "record_audit": f"""WITH {_RAW}, m AS (SELECT event_id, member, json_extract_string(raw, '$.' || member) AS raw_value, CASE WHEN member IN ('k', 'key') THEN 'k' WHEN member = 'value' THEN 'value' ELSE '' END AS field
  FROM (SELECT * FROM v WHERE good), unnest(json_keys(raw)) AS u(member)),
n AS (SELECT *, CASE field WHEN 'k' THEN TRY_CAST(raw_value AS INT)::VARCHAR WHEN 'value' THEN TRY_CAST(raw_value AS DOUBLE)::VARCHAR END AS normalised_value FROM m)
SELECT event_id, member, raw_value, field, normalised_value, CASE WHEN field = '' THEN 'unused' WHEN normalised_value IS NULL THEN 'invalid' ELSE 'ok' END AS validation_status, CASE WHEN field <> '' AND normalised_value IS NULL THEN 'not readable: ' || raw_value ELSE '' END AS error FROM n
UNION ALL SELECT event_id, '', raw, '', NULL, 'not_available', CASE WHEN raw IS NULL THEN 'no record' ELSE 'no JSON' END FROM v WHERE NOT good""",
        "workbook_tree": f"""WITH {parent}, f AS (SELECT 4 + count(*) // 200000 AS files FROM t),
o AS (SELECT (conv_id % files)::INT AS book, row_number() OVER (PARTITION BY conv_id % files ORDER BY conv_id, turn) AS line, conv_id || '-' || turn AS node_id, level, role || ' ' || turn AS text FROM t, f),
u AS (SELECT a.book, a.line, max(b.line) AS up FROM o a JOIN o b ON b.book = a.book AND b.line < a.line AND b.level < a.level GROUP BY 1, 2)
SELECT o.book, o.line, o.node_id, coalesce(q.node_id, '') AS parent_id, o.level, o.text FROM o LEFT JOIN u ON u.book = o.book AND u.line = o.line LEFT JOIN o q ON q.book = o.book AND q.line = u.up""",
        "recognised_rows": f"""WITH c AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN '07B02' WHEN l_partkey % 2 = 0 THEN '05A01' END AS code FROM lineitem)
SELECT {_ID}, code AS series_code, CASE WHEN l_linenumber = 2 THEN 4 ELSE l_linenumber END AS multiplicity, CASE WHEN l_linenumber = 1 THEN l_discount ELSE 1 + round(l_tax, 2) END AS tolerance_value,
  {", ".join(f"contains({letters}, '{c.upper()}') AS datum_{c}" for c in "abcde")}, 'OCR' AS kind FROM c""",
        "crowded_centres": _greedy(_LINES, _CENTRES, "-w * h", "AND len(s.kept) < 18") + _END,
        "crowded_equals": _greedy(_ORDERS, _EQUALS, "-w * h") + _END,
        "tolerance_cascade": f"""WITH s AS (SELECT *, l_linenumber % 4 AS a, l_linenumber % 3 = 0 AS sized FROM lineitem)
SELECT {_ID}, CASE a WHEN 0 THEN l_tax WHEN 1 THEN NULL ELSE l_quantity END AS value, CASE WHEN a < 2 THEN 'limit' WHEN sized THEN 'dimension' ELSE 'text' END AS source,
  CASE WHEN a > 0 AND sized THEN -1.5::DOUBLE END AS lower, CASE WHEN a > 1 THEN l_discount END AS upper FROM s""",
        "record_field_cascade": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END::VARCHAR AS display, CASE WHEN o_orderkey % 3 = 0 THEN 'mm' ELSE '' END AS unit, '' AS kind,
  concat_ws(' | ', o_orderpriority, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'mm' END) AS combined FROM orders""",
        "visible_labels": "SELECT p_partkey, contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'redring') OR (regexp_matches(lower(p_name), '(^| )bl') AND regexp_matches(lower(p_name), '(^| )(bol|wid)')) AS visible FROM part",
        "tree_report": f"""WITH RECURSIVE {parent}, up(conv_id, line, above, path) AS (SELECT conv_id, turn, parent_pos, role || ':' || turn FROM par
  UNION ALL SELECT u.conv_id, u.line, p.parent_pos, p.role || ':' || p.turn || ' > ' || u.path FROM up u JOIN par p ON p.conv_id = u.conv_id AND p.turn = u.above)
SELECT conv_id, line, level, role || ':' || turn AS text, path AS full_path, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS object_name, CASE WHEN turn % 3 = 0 THEN 'PARTIAL' ELSE 'OK' END AS read_status
FROM up JOIN par USING (conv_id) WHERE above IS NULL AND turn = line""",
        "crop_options": f"""WITH p AS ({plausibility}), l(lane, i) AS (VALUES (5.0::DOUBLE, 0), (19.0::DOUBLE, 1), (33.0::DOUBLE, 2), (47.0::DOUBLE, 3)),
n AS (SELECT p_partkey, txt, points, short FROM {noisy} JOIN p USING (p_partkey)),
q AS (SELECT n.*, lane, i FROM n, l QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_partkey % 50 - lane), i) = 1),
g AS (SELECT *, greatest(-24, 12 - 1.5::DOUBLE * abs(p_partkey % 60 - lane)) AS fit FROM q)
SELECT p_partkey, lane AS crop_lane, i AS level, (lane - 14)::INT AS branch_x, round(fit, 6) AS geometry_alignment, round(p_partkey % 100 + points + fit + CASE WHEN p_partkey % 2 = 1 THEN 0 WHEN short THEN 14 WHEN NOT regexp_matches(txt, '[A-Za-z]') THEN -45 ELSE -8 END, 6) AS score, 'line_batch_raw' AS method FROM g""",
        "unique_tokens": """WITH w AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag || '-' END AS text, l_linenumber * 10 AS "left", trunc(l_quantity)::INT AS top, 8 AS width, 9 AS height, l_returnflag AS f FROM lineitem)
SELECT l_suppkey, pos, text, "left", top, width, height FROM w QUALIFY row_number() OVER (PARTITION BY l_suppkey, f, "left", top ORDER BY pos, text) = 1""",
        "label_repairs": """WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, c_custkey % 3 AS p, c_name, c_custkey % 5 = 0 AS low FROM customer),
r AS (SELECT *, CASE WHEN k = 0 AND p = 0 THEN 'CPC SPRINGBACK' WHEN k = 0 AND p = 1 THEN 'CTF SPRINGBACK' WHEN k = 1 THEN 'REF A|B-C|D-E' WHEN k = 2 AND p = 2 THEN 'Elément de référence.5 (E)' END AS fixed FROM c)
SELECT c_custkey, coalesce(fixed, CASE k WHEN 0 THEN 'Springback' WHEN 2 THEN 'Elément de référence.S (E)' ELSE c_name END) AS text,
  concat_ws('|', CASE WHEN low THEN 'low_confidence' END, CASE WHEN fixed IS NULL THEN NULL WHEN k = 2 THEN 'reference_label_normalised' ELSE 'capture_label_from_structure' END) AS reasons FROM r""",
        "code_manifest": """SELECT s_suppkey AS "order", lpad((s_suppkey % 97)::VARCHAR, 2, '0') || 'A01' AS series_code, s_name AS ref_parent, s_nationkey AS functional_group, 'a > b' AS tree_path FROM supplier WHERE s_suppkey % 3 > 0
QUALIFY row_number() OVER (PARTITION BY s_suppkey % 97 ORDER BY s_suppkey) = 1""",
        "value_cells": """WITH w AS (SELECT DISTINCT l_orderkey, l_quantity * 7 AS x, l_orderkey % 90 AS e, greatest(l_orderkey % 40, 8) AS h FROM lineitem),
r AS (SELECT *, lead(x) OVER k AS x1, lead(x, 2) OVER k AS x2 FROM w WINDOW k AS (PARTITION BY l_orderkey ORDER BY x))
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(x - e), x, x1, x2)::INT AS rank, x AS x0, x1, x2 FROM r
WHERE x1 - x BETWEEN 0.35::DOUBLE * h AND 4.2::DOUBLE * h AND x2 - x1 BETWEEN 0.35::DOUBLE * h AND 5.0::DOUBLE * h AND abs(x - e) <= 4 * h QUALIFY rank <= 2""",
        "picture_registration": """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: round(v, 3)) AS e FROM embeddings),
p AS (SELECT k, vec_id - k * 30 AS y, e FROM e, unnest([vec_id // 30, vec_id // 30 - 1]) AS u(k) WHERE k >= 0 AND vec_id < k * 30 + 40),
n AS (SELECT k, least(count(*), (SELECT count(*) FROM p q WHERE q.k = p.k + 1)) AS h FROM p GROUP BY k),
m AS (SELECT n.k, s, a.e AS a, b.e AS b FROM n, unnest(range(1 - h, h)) AS u(s) JOIN p a ON a.k = n.k JOIN p b ON b.k = n.k + 1 AND b.y = a.y - s WHERE abs(s) BETWEEN 1 AND h - greatest(8, round_even(h * 0.18::DOUBLE, 0)) AND a.y < h AND b.y < h),
c AS (SELECT k, s, round(coalesce(corr(x, y), -1), 9) AS r, count(*) FILTER (x <> 0) AS f, count(*) FILTER (y <> 0) AS g FROM (SELECT k, s, unnest(a) AS x, unnest(b) AS y FROM m) GROUP BY 1, 2),
d AS (SELECT k, s, CASE WHEN least(f, g) >= 80 AND NOT isnan(r) THEN r ELSE -1 END AS r FROM c),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC, s DESC) = 1),
o AS (SELECT b.k, max(d.r) AS second FROM b JOIN d ON d.k = b.k AND abs(d.s - b.s) > 2 GROUP BY 1)
SELECT n.k, CASE WHEN r >= 0.22 AND round(r - coalesce(second, -1), 9) >= 0.015 THEN s::INT END AS shift, round(coalesce(r, -1), 6)::DOUBLE AS score, round(coalesce(second, -1), 6)::DOUBLE AS second
FROM n LEFT JOIN b USING (k) LEFT JOIN o USING (k) WHERE EXISTS (SELECT 1 FROM p q WHERE q.k = n.k + 1)""",
    }
