"""DuckDB equivalents of the registered queries, written independently of them."""

from . import oracle_evidence, oracle_scans

_OBS = "(SELECT user_id, floor(value) / 2 AS v, (event_id % 100) / 100.0::DOUBLE AS conf, event_id AS pos FROM events)"
_TALK = "(SELECT conv_id, turn, role, ((conv_id * 7 + turn * 3) % 5)::INT AS level FROM conversations)"
_PARENT = f"""t AS {_TALK},
par AS (SELECT c.*, (SELECT max(p.turn) FROM t p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.level < c.level) AS parent_pos FROM t c)"""
_NODES = f"""{_PARENT}, e AS (SELECT conv_id * 100 + turn AS node, conv_id * 100 + parent_pos AS parent, conv_id, role, turn, level FROM par)"""
_CODE = "lpad((p_partkey % 97)::VARCHAR, 2, '0') || substr('ABGOI', (p_partkey % 5 + 1)::INT, 1) || lpad(p_size::VARCHAR, 2, '0')"
_NOISY = f"""(SELECT p_partkey, {_CODE} AS code, CASE p_partkey % 3 WHEN 0 THEN translate({_CODE}, '015', 'OIS') WHEN 1 THEN 'x ' || {_CODE} || ' y' ELSE {_CODE} END AS txt FROM part)"""
_ID = "l_orderkey, l_linenumber, l_partkey"


def _votes(weight: str) -> str:
    return f"""obs AS {_OBS},
s AS (SELECT user_id, v, sum({weight}) AS w, min(pos) AS first, count(*) AS n FROM obs GROUP BY user_id, v),
b AS (SELECT user_id, v, conf, pos FROM obs QUALIFY row_number() OVER (PARTITION BY user_id, v ORDER BY conf DESC, pos) = 1),
x AS (SELECT s.user_id, s.v, round(s.w + CASE WHEN s.v % 1 <> 0 THEN coalesce(0.35 * i.w, 0) ELSE 0 END, 9) AS weight, s.first, s.n, b.conf, b.pos
  FROM s JOIN b USING (user_id, v) LEFT JOIN s i ON i.user_id = s.user_id AND i.v = trunc(s.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, first) AS k, sum(n) OVER (PARTITION BY user_id) AS n_obs FROM x)"""


ORACLE: dict[str, str] = {
    "vote_consensus": f"""WITH {_votes('greatest(0.2::DOUBLE, conf)')}
SELECT user_id, v AS winner, round(weight, 6) AS top_weight, n_obs::BIGINT AS n_obs, conf AS confidence, pos AS best_pos FROM r WHERE k = 1""",
    "vote_consensus_conflict": f"""WITH {_votes('conf')},
p AS (SELECT a.*, c.v AS second, c.weight AS second_weight, coalesce(abs(a.v - c.v) > 1e-4 AND c.weight / greatest(a.weight, 1e-6) > 0.65 AND c.weight >= 0.75, false) AS clash
  FROM r a LEFT JOIN r c ON c.user_id = a.user_id AND c.k = 2 WHERE a.k = 1)
SELECT user_id, v AS winner, round(weight, 6) AS top_weight, second, round(second_weight, 6) AS second_weight, n_obs::BIGINT AS n_obs, pos AS best_pos,
  CASE WHEN clash THEN least(0.6::DOUBLE, conf) ELSE conf END AS confidence, CASE WHEN clash THEN 'CONFLICT' ELSE 'OK' END AS status FROM p""",
    "vote_flags_union": """SELECT *, concat_ws(' | ', CASE WHEN "A" THEN 'A' END, CASE WHEN "B" THEN 'B' END, CASE WHEN "C" THEN 'C' END) AS letters FROM
(SELECT user_id, bool_or(event_type = 'click' AND value > 100) AS "A", bool_or(event_type = 'view' AND value > 100) AS "B", bool_or(event_type = 'error' AND value > 100) AS "C" FROM events GROUP BY user_id)""",
    "vote_mode_tie_smallest": """SELECT l_suppkey, l_quantity AS winner, n AS votes FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1""",
    "vote_strict_majority": """WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, max(n) AS votes FROM c GROUP BY 1)
SELECT l_suppkey, min(l_quantity) AS winner, min(votes) AS votes FROM c JOIN m USING (l_suppkey) WHERE n = votes GROUP BY 1 HAVING count(*) = 1 AND min(votes) >= 2""",
    "vote_histogram_shift": """WITH o AS (SELECT o_custkey, o_totalprice AS x, o_orderkey, (o_orderkey % 10 + 1) / 10.0::DOUBLE AS w FROM orders),
b AS (SELECT o_custkey, round_even(x / 50000.0::DOUBLE, 0) * 50000.0::DOUBLE AS bin, count(DISTINCT o_orderkey) AS items, round(sum(w), 6) AS w, sum(x * w) AS xw, sum(w) AS sw FROM o GROUP BY ALL),
r AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY items DESC, w DESC, bin) = 1)
SELECT o_custkey, bin, items, round(xw / sw, 8) AS mean FROM r WHERE items >= 2 AND w >= 0.8""",
    "keep_best_first_on_tie": """SELECT user_id, floor(value) AS value, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) = 1""",
    "rank_margin_accept": """WITH c AS (SELECT p_size, p_brand, count(*) / 10.0::DOUBLE AS score FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY score DESC, p_brand) AS k, lead(score) OVER (PARTITION BY p_size ORDER BY score DESC, p_brand) AS s FROM c)
SELECT p_size, CASE WHEN score >= 0.9 OR (score >= 0.3 AND round(score - coalesce(s, 0), 9) >= 0.1) THEN p_brand ELSE '' END AS accepted, score, round(score - coalesce(s, 0), 9) AS margin FROM r WHERE k = 1""",
    "confirmed_best_score": """SELECT user_id, event_type, count(*) FILTER (s >= 0.3) AS confirmations, round(CASE WHEN count(*) FILTER (s >= 0.3) >= 2 THEN least(1.0::DOUBLE, max(s) + 0.06) ELSE max(s) END, 6) AS best
FROM (SELECT user_id, event_type, floor(value) / 500 AS s FROM events) GROUP BY 1, 2""",
    "evidence_text_choice": """WITH e AS (SELECT user_id, upper(event_type) AS norm, event_type || '-' || json_extract_string(props, '$.k') AS txt, floor(value / 10) AS s, event_id % 7 AS image, event_id FROM events),
f AS (SELECT user_id, norm, count(DISTINCT image) AS images FROM e GROUP BY 1, 2),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, norm ORDER BY s DESC, event_id) = 1),
r AS (SELECT b.*, images, s + least(18, 6 * (images - 1)) AS rank_score, count(*) OVER (PARTITION BY user_id) AS forms FROM b JOIN f USING (user_id, norm))
SELECT user_id, txt AS text, round(rank_score, 6)::DOUBLE AS rank_score, images, least(99.0::DOUBLE, s + 5 * (images - 1)) AS confidence, forms FROM r
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, event_id) = 1""",
    "island_clusters": """WITH d AS (SELECT DISTINCT o_orderpriority, trunc(o_totalprice)::INT AS x FROM orders),
f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY o_orderpriority ORDER BY x) > 200 THEN 1 ELSE 0 END AS fresh FROM d),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY o_orderpriority ORDER BY x) AS cluster FROM f)
SELECT o_orderpriority, cluster::BIGINT AS cluster, min(x) AS low, max(x) AS high, count(*) AS n FROM c GROUP BY 1, 2""",
    "segment_offsets": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN floor(value) END AS shift, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT *, sum(CASE WHEN shift IS NULL AND k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS segment FROM e)
SELECT user_id, event_id, shift, segment, sum(coalesce(shift, 0)) OVER (PARTITION BY user_id, segment ORDER BY event_id) AS "offset" FROM s""",
    "nearest_lane": f"""WITH r AS (SELECT row_number() OVER () AS r, {_ID}, l_quantity FROM lineitem), lanes(i, v) AS (VALUES (0,2.0),(1,7.0),(2,12.0),(3,18.0),(4,22.0),(5,28.0),(6,33.0),(7,39.0),(8,44.0),(9,50.0))
SELECT {_ID}, l_quantity, i AS lane_index, v::DOUBLE AS lane FROM r, lanes QUALIFY row_number() OVER (PARTITION BY r ORDER BY abs(l_quantity - v), i) = 1""",
    "interval_assign": """WITH b AS (SELECT i::INT AS ord, 40000.0::DOUBLE * i + 1000 AS low, 40000.0::DOUBLE * i + 45000 AS high, 'band' || i AS name FROM range(12) AS x(i))
SELECT o_orderkey, o_totalprice, ord, low, high, name FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) = 1""",
    "tree_parents": f"""WITH {_PARENT}
SELECT c.conv_id, c.turn, c.level, c.parent_pos, CASE WHEN c.level = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM t x WHERE x.conv_id = c.conv_id AND x.turn < c.turn AND x.level = 0) THEN 'root_level_unconfirmed' ELSE 'root' END
  WHEN c.parent_pos IS NULL THEN 'parent_unknown' WHEN p.level = c.level - 1 THEN 'direct' ELSE 'parent_inferred_gap' END AS hierarchy_status
FROM par c LEFT JOIN t p ON p.conv_id = c.conv_id AND p.turn = c.parent_pos""",
    "tree_paths": f"""WITH RECURSIVE {_PARENT}, w(conv_id, turn, full_path) AS (SELECT conv_id, turn, role || ':' || turn FROM par WHERE parent_pos IS NULL
UNION ALL SELECT c.conv_id, c.turn, w.full_path || ' > ' || c.role || ':' || c.turn FROM par c JOIN w ON c.conv_id = w.conv_id AND c.parent_pos = w.turn) SELECT * FROM w""",
    "tree_descendants": f"""WITH RECURSIVE {_NODES}, w(node, depth) AS (SELECT node, 0 FROM e WHERE parent IS NULL UNION ALL SELECT e.node, depth + 1 FROM e JOIN w ON e.parent = w.node) SELECT node, depth FROM w""",
    "region_paths": """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
w(node, path, depth) AS (SELECT node, name, 0 FROM e WHERE parent IS NULL UNION ALL SELECT e.node, w.path || ' > ' || e.name, depth + 1 FROM e JOIN w ON e.parent = w.node) SELECT * FROM w""",
    "nearest_ancestor": f"""WITH RECURSIVE {_PARENT}, w AS (SELECT conv_id, turn, parent_pos AS up FROM par UNION ALL SELECT w.conv_id, w.turn, p.parent_pos FROM w JOIN par p ON p.conv_id = w.conv_id AND p.turn = w.up WHERE w.up IS NOT NULL)
SELECT w.conv_id, w.turn, max(CASE WHEN p.role = 'user' THEN up END) AS nearest_pos FROM w LEFT JOIN par p ON p.conv_id = w.conv_id AND p.turn = w.up GROUP BY 1, 2""",
    "sibling_order": "SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS sibling_no FROM nation",
    "promote_siblings": f"""WITH {_NODES} SELECT c.node, CASE WHEN p.level = 1 AND p.parent IS NOT NULL THEN p.parent ELSE c.parent END AS parent,
CASE WHEN p.level = 1 AND p.parent IS NOT NULL THEN c.level - 1 ELSE c.level END AS level FROM e c LEFT JOIN e p ON p.node = c.parent""",
    "level_clamp": f"""WITH RECURSIVE t AS {_TALK}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t),
w(conv_id, turn, k, clamped) AS (SELECT conv_id, turn, k, 0 FROM n WHERE k = 1 UNION ALL SELECT n.conv_id, n.turn, n.k, least(greatest(1, n.level), w.clamped + 1) FROM n JOIN w ON n.conv_id = w.conv_id AND n.k = w.k + 1)
SELECT conv_id, turn, clamped FROM w""",
    "outlier_flatten": f"""WITH t AS (SELECT conv_id, turn, level % 2 AS level FROM {_TALK}), n AS (SELECT *, lag(level) OVER w AS b, lead(level) OVER w AS a FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN a = b AND level > b THEN b ELSE level END AS flat FROM n""",
    "section_fill": f"""WITH t AS {_TALK} SELECT c.conv_id, c.turn, (SELECT arg_max(role, turn) FROM t p WHERE p.conv_id = c.conv_id AND p.turn <= c.turn AND p.level = 0) AS section FROM t c""",
    "first_boundary": f"""WITH t AS {_TALK}, l AS (SELECT a.conv_id, a.turn, a.level, r.level AS root FROM t a JOIN t r ON r.conv_id = a.conv_id AND r.turn = 0 WHERE a.turn > 0)
SELECT conv_id, min(turn) AS boundary FROM l x WHERE level <= root AND EXISTS (SELECT 1 FROM l y WHERE y.conv_id = x.conv_id AND y.turn < x.turn AND y.level > y.root) GROUP BY 1""",
    "orphan_duplicate_drop": f"""WITH {_NODES}, h AS (SELECT e.*, node IN (SELECT parent FROM e WHERE parent IS NOT NULL) AS has_child FROM e)
SELECT node, has_child FROM h QUALIFY has_child OR NOT bool_or(has_child) OVER (PARTITION BY conv_id, role)""",
    "median_gap": """WITH d AS (SELECT DISTINCT o_custkey, floor(o_totalprice / 1000) AS x FROM orders), g AS (SELECT o_custkey, x - lag(x) OVER (PARTITION BY o_custkey ORDER BY x) AS gap FROM d)
SELECT o_custkey, coalesce(median(CASE WHEN gap BETWEEN 16 AND 42 THEN gap END), 28.0)::DOUBLE AS step FROM g GROUP BY 1""",
    "stable_stop": """WITH d AS (SELECT user_id, event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) < 15, false) AS calm FROM events),
p AS (SELECT *, lag(calm) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM d) SELECT user_id, min(event_id) AS stop_pos FROM p WHERE calm AND before GROUP BY 1""",
    "reconcile_status": """WITH c AS (SELECT c_custkey::VARCHAR AS k, c_custkey AS left_id FROM customer WHERE c_custkey % 7 <> 0),
o AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey::VARCHAR ELSE '' END AS k, o_orderkey AS right_id FROM orders)
SELECT coalesce(c.k, o.k) AS k, left_id, right_id, CASE WHEN right_id IS NULL THEN 'LEFT_ONLY' WHEN left_id IS NOT NULL THEN 'MATCHED' WHEN o.k = '' THEN 'RIGHT_NO_KEY' ELSE 'RIGHT_ONLY' END AS status FROM c FULL JOIN o ON c.k = o.k""",
    "left_placeholder_frame_index": """WITH r AS (SELECT l_partkey AS k, l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2)
SELECT p_partkey AS k, p_brand, coalesce(l_suppkey, -1) AS l_suppkey, coalesce(q, 0) AS q, row_number() OVER (PARTITION BY p_partkey ORDER BY l_suppkey)::INT AS frame_index FROM part LEFT JOIN r ON k = p_partkey""",
    "lookup_update_gate": """SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NOT NULL AS updated FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1""",
    "known_and_missing": "SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer",
    "union_if_empty": "SELECT doc_id FROM labels WHERE quality > 5 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 AND NOT EXISTS (SELECT 1 FROM labels WHERE quality > 5)",
    "rescue_cascade": """SELECT doc_id, CASE WHEN quality = 0 THEN 1 WHEN toxic = 1 THEN 2 ELSE 3 END AS "pass" FROM documents JOIN labels USING (doc_id)""",
    "loosest_match": """WITH p AS (SELECT p_size, p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'ring' WHEN 2 THEN 'blue bolt' ELSE 'dget' END AS code FROM part),
h AS (SELECT *, CASE WHEN p_name = code THEN 1 WHEN starts_with(p_name, code) THEN 2 WHEN contains(p_name, code) THEN 3 END AS tier FROM p)
SELECT * FROM h WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY p_size)""",
    "code_extract": f"""SELECT p_partkey, nullif(regexp_extract(upper(txt), '\\b([0-9]{{2}}[A-Z][0-9]{{2}})\\b', 1), '') AS found FROM {_NOISY}""",
    "code_confusion_fix": f"""WITH s AS (SELECT p_partkey, upper(regexp_replace(txt, '[^A-Za-z0-9]', '', 'g')) AS s FROM {_NOISY}),
f AS (SELECT p_partkey, s, translate(substr(s, 1, 2), 'OQDILZSGTBA', '00011256784') || translate(substr(s, 3, 1), '4', 'A') || translate(substr(s, 4, 2), 'OQDILZSGTBA', '00011256784') AS x FROM s)
SELECT p_partkey, CASE WHEN len(s) = 5 AND regexp_full_match(x, '[0-9]{{2}}[A-Z][0-9]{{2}}') THEN x END AS fixed FROM f""",
    "label_normalise": """WITH h AS (SELECT doc_id, replace(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss') AS h FROM documents)
, w AS (SELECT doc_id, regexp_extract_all(h, '[a-z0-9]+') AS w, regexp_replace(h, '[^a-z0-9]+', '', 'g') AS key FROM h)
SELECT doc_id, key, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS anchors FROM w""",
    "number_parse": f"""SELECT {_ID}, l_extendedprice::DECIMAL(12, 2)::DOUBLE AS n, NULL::DOUBLE AS bad, CASE WHEN trunc(l_quantity - 10)::INT >= 1 THEN trunc(l_quantity - 10)::INT END AS whole FROM lineitem""",
    "multiplicity_parse": f"SELECT {_ID}, greatest(1, l_linenumber) AS m FROM lineitem",
    "datum_flags": f"""SELECT {_ID}, l_returnflag = 'A' AS "A", l_linenumber > 3 AS "B", l_linenumber > 3 AS "C", false AS "D", false AS "E" FROM lineitem""",
    "tolerance_parse": f"SELECT {_ID}, l_tax AS tol FROM lineitem",
    "numeric_reading_vote": """WITH r AS (SELECT l_suppkey, l_linenumber::VARCHAR AS t, l_linenumber / 10.0::DOUBLE AS w FROM lineitem
UNION ALL SELECT l_suppkey, l_tax::VARCHAR, l_linenumber / 10.0::DOUBLE FROM lineitem),
s AS (SELECT l_suppkey, t::DOUBLE AS v, round(sum(w + CASE WHEN contains(t, '.') THEN 0.34 ELSE 0 END), 6) AS w FROM r WHERE t::DOUBLE > 0 GROUP BY 1, 2),
d AS (SELECT * FROM s WHERE v % 1 <> 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, v) = 1),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, v) = 1),
j AS (SELECT m.l_suppkey, m.v AS mv, m.w AS mw, d.v AS dv, d.w AS dw, coalesce(d.w >= 0.9 OR round(d.w + 0.55, 6) >= coalesce(i.w, 0), false) AS dec
  FROM m LEFT JOIN d USING (l_suppkey) LEFT JOIN s i ON i.l_suppkey = d.l_suppkey AND i.v = floor(d.v))
SELECT l_suppkey, CASE WHEN dec THEN dv ELSE mv END AS value, CASE WHEN dec THEN dw ELSE mw END AS weight FROM j""",
    "natural_sort_key": """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_brand || ' ' || p_name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS key FROM part""",
    "word_filter_rows": f"""SELECT {_ID}, l_linenumber + trunc(l_quantity)::INT / 2.0::DOUBLE AS center_y, true AS again FROM lineitem WHERE l_quantity - 5 >= 0 AND l_quantity BETWEEN 7 AND 45""",
    "line_assembly": """SELECT l_orderkey, string_agg(l_shipdate::DATE::VARCHAR, ' ' ORDER BY l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR) AS line, round(avg(l_quantity), 6) AS mean_conf, min(l_partkey) AS box_left, min(l_suppkey) AS box_top,
max(l_partkey + l_linenumber) AS box_right, max(l_suppkey + l_linenumber) AS box_bottom, count(*) AS n_words FROM lineitem GROUP BY 1""",
    "audit_unpivot": """WITH c AS (SELECT c_custkey AS record_id, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)
SELECT record_id, 'c_name' AS field, c_name AS raw_value, CASE WHEN coalesce(trim(c_name), '') = '' THEN 'MISSING' ELSE 'READ' END AS validation_status FROM c
UNION ALL SELECT record_id, 'c_mktsegment', c_mktsegment, CASE WHEN coalesce(trim(c_mktsegment), '') = '' THEN 'MISSING' ELSE 'READ' END FROM c""",
    "review_queue": """SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 5 = 0 THEN 'seg' END, CASE WHEN c_custkey % 3 = 0 THEN 'name' END) AS review_reason, 'TO_REVIEW' AS status, '' AS decision FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0""",
    "manifest_counts": """SELECT 'rows' AS field, count(*) AS value FROM customer UNION ALL SELECT 'negative', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'building', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "coverage_report": "SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_totalprice) <= 400000",
    "classify_nodes": """SELECT p_partkey, CASE WHEN ends_with(p_name, 'ring') THEN 'RING' WHEN starts_with(p_name, 'red ') THEN 'RED' WHEN len(p_name) >= 11 THEN 'LONG' ELSE 'OTHER' END AS "class" FROM part""",
    "enum_lookup": """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '5-LOW' THEN 'last' WHEN '2-HIGH' THEN 'high' WHEN '4-NOT SPECIFIED' THEN 'none' ELSE '' END AS symbol FROM orders""",
    "array_overlap_corr": """WITH l AS (SELECT vec_id, embedding AS e, lag FROM embeddings, unnest([1, 2, 3, 4]) AS x(lag)), p AS (SELECT vec_id, lag, e[i]::DOUBLE AS x, e[i + lag]::DOUBLE AS y FROM l, unnest(range(1, len(e) - lag + 1)) AS z(i))
SELECT vec_id, lag, round(corr(x, y), 6) AS corr FROM p GROUP BY 1, 2""",
    "json_explode": "SELECT event_id, 'k' AS field, json_extract(props, '$.k')::INT AS value FROM events",
    # Each row's digest is cut into five numbers of twelve hexadecimal digits, which are summed.
    "row_signature": """WITH d AS (SELECT sha256(concat_ws(chr(31), l_orderkey, l_linenumber, l_partkey, l_returnflag)) AS h FROM lineitem),
n AS (SELECT count(*) AS n, [sum(('0x' || substr(h, 1, 12))::BIGINT), sum(('0x' || substr(h, 13, 12))::BIGINT), sum(('0x' || substr(h, 25, 12))::BIGINT), sum(('0x' || substr(h, 37, 12))::BIGINT), sum(('0x' || substr(h, 49, 12))::BIGINT)] AS s FROM d)
SELECT sha256('(''1'', ''' || n || ''', ' || array_to_string(list_transform(s, lambda x: '''' || x || ''''), ', ') || ')') AS signature FROM n""",
    "angles_and_boxes": f"""WITH o AS (SELECT {_ID}, l_quantity * 13 AS a, l_linenumber * 29.0::DOUBLE AS b FROM lineitem),
i AS (SELECT *, greatest(0, 40 - abs(a % 50 - b % 50)) * 20 AS inter FROM o)
SELECT {_ID}, least(abs(a - b) % 180, 180 - abs(a - b) % 180) AS difference, (a + 90) % 180 - 90 AS normal, round(inter / (2400 - inter), 6) AS iou FROM i""",
    "code_score_match": f"""WITH RECURSIVE n AS {_NOISY}, known AS (SELECT DISTINCT code FROM n),
s AS (SELECT p_partkey, regexp_replace(upper(txt), '[^A-Z0-9|]', '', 'g') AS s FROM n),
w AS (SELECT p_partkey, substr(s, i, 5) AS w, 0 AS lost FROM s, unnest(range(1, len(s) - 3)) AS x(i) UNION ALL SELECT p_partkey, substr(s, i, 4), 1 FROM s, unnest(range(1, len(s) - 2)) AS x(i)),
c(o, e, letter, cost) AS (VALUES ('O','0',false,0.12),('Q','0',false,0.18),('D','0',false,0.30),('I','1',false,0.12),('L','1',false,0.18),('|','1',false,0.18),('T','1',false,0.35),('P','2',false,0.35),
('Z','2',false,0.22),('S','5',false,0.20),('G','6',false,0.35),('G','9',false,0.40),('B','8',false,0.15),('A','4',false,0.40),('4','A',true,0.12),('8','B',true,0.12),('6','G',true,0.25),('0','O',true,0.30),('1','I',true,0.35)),
p AS (SELECT p_partkey, w, lost, code, i, substr(w, i - lost, 1) AS o, substr(code, i, 1) AS e FROM w JOIN known ON lost = 0 OR starts_with(code, '0'), unnest(range(1 + lost, 6)) AS x(i)),
q AS (SELECT p.*, CASE WHEN p.o = p.e THEN 0 WHEN c.cost IS NOT NULL THEN c.cost WHEN i <> 3 AND regexp_matches(p.o, '[0-9]') AND regexp_matches(p.e, '[0-9]') THEN 0.95 ELSE 1.30 END AS k
  FROM p LEFT JOIN c ON c.o = p.o AND c.e = p.e AND c.letter = (i = 3)),
t AS (SELECT p_partkey, code, w, lost, sum(k) + 0.42 * lost AS cost FROM q GROUP BY p_partkey, code, w, lost)
SELECT p_partkey, code, round(greatest(0, 1 - min(cost) / 2.6), 9)::DOUBLE AS score FROM t GROUP BY 1, 2 HAVING round(greatest(0, 1 - min(cost) / 2.6), 9) > 0""",
    "text_plausibility": rf"""WITH v AS (SELECT p_partkey, trim(txt) AS v, len(regexp_replace(trim(txt), '[^\pL\pN]', '', 'g')) AS an, len(regexp_replace(trim(txt), '[^\pL]', '', 'g')) AS al FROM {_NOISY})
SELECT p_partkey, round(CASE WHEN an = 0 THEN -70 ELSE least(an, 24) * 0.8::DOUBLE + CASE WHEN al >= 3 THEN 7 ELSE 0 END + CASE WHEN regexp_full_match(v, '[A-Za-z]{{1,3}}[0-9]+[A-Za-z0-9.-]*') THEN 12 ELSE 0 END
  - CASE WHEN regexp_full_match(v, '[0-9.]+') THEN 30 ELSE 0 END - CASE WHEN an = 1 AND NOT regexp_matches(v, '[0-9]') THEN 28 ELSE 0 END - CASE WHEN contains(v, '?') THEN 18 ELSE 0 END
  - CASE WHEN regexp_matches(v, '^[^A-Za-z0-9]') THEN 12 ELSE 0 END END, 6)::DOUBLE AS points, regexp_full_match(regexp_replace(v, '[^A-Za-z0-9_.-]', '', 'g'), '[A-Za-z]{{1,3}}[0-9]+[A-Za-z0-9_.-]*') AS short FROM v""",
    "clean_labels": r"""WITH a AS (SELECT doc_id, regexp_replace(replace(translate(coalesce(text, ''), '‘’', ''), chr(12), ' '), '[^\pL\pN_ .|/()''-]+', '', 'g') AS v FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(v, '^[\])}|]+', ''), '[\[({|]+$', ''), '\s+', ' ', 'g')) AS v FROM a),
w AS (SELECT doc_id, list_transform(string_split(v, ' '), lambda x: CASE WHEN len(regexp_replace(x, '[^\pL]', '', 'g')) >= 2
  AND len(regexp_replace(x, '[^\p{Lu}]', '', 'g')) >= len(regexp_replace(x, '[^\pL]', '', 'g')) - 1 THEN upper(replace(x, 'ß', 'SS')) ELSE x END) AS w FROM b) SELECT doc_id, array_to_string(w, ' ') AS label FROM w""",
}

ORACLE |= oracle_evidence.oracle(_NOISY)
ORACLE |= oracle_scans.oracle(_PARENT, ORACLE["text_plausibility"], _NOISY)
