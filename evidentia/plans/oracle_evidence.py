"""DuckDB equivalents of the queries on evidence."""

from .oracle_scans import DICTIONARY

LOOKS, MEANT = "OQDILZSGTBA", "00011256784"
COSTS = """c(o, e, letter, cost) AS (VALUES ('O','0',false,0.12),('Q','0',false,0.18),('D','0',false,0.30),('I','1',false,0.12),('L','1',false,0.18),('|','1',false,0.18),('T','1',false,0.35),('P','2',false,0.35),
('Z','2',false,0.22),('S','5',false,0.20),('G','6',false,0.35),('G','9',false,0.40),('B','8',false,0.15),('A','4',false,0.40),('4','A',true,0.12),('8','B',true,0.12),('6','G',true,0.25),('0','O',true,0.30),('1','I',true,0.35))"""
COST = "CASE WHEN p.o = p.e THEN 0 WHEN c.cost IS NOT NULL THEN c.cost WHEN NOT p.letter AND regexp_matches(p.o, '[0-9]') AND regexp_matches(p.e, '[0-9]') THEN 0.95 ELSE 1.30 END"


def like(x: str) -> str:
    """The codes that a text may mean."""
    digits = lambda at: f"translate(substr(t, {at}, 2), '{LOOKS}', '{MEANT}')"
    tokens = f"list_filter(regexp_extract_all(upper({x}), '\\b([0-9OQDLIZSGBT]{{2}}[A-Z4][0-9OQDLIZSGBT]{{2}})\\b', 1), lambda t: regexp_matches(t, '[0-9]'))"
    return f"list_transform({tokens}, lambda t: {digits(1)} || translate(substr(t, 3, 1), '4', 'A') || {digits(4)})"


def strict(x: str) -> str:
    return f"regexp_extract_all(upper({x}), '\\b([0-9]{{2}}[A-Z][0-9]{{2}})\\b', 1)"


HEAD = "split_part({0}, '(', 1)".format
TAIL = "CASE WHEN contains({0}, '(') THEN substr({0}, strpos({0}, '(') + 1) ELSE '' END".format


def oracle(noisy: str) -> dict[str, str]:
    displays = f"""n AS {noisy}, w AS (SELECT *, translate(code, '0152', 'OISZ') AS wrong FROM n),
s AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN wrong WHEN 1 THEN wrong || ' (' || code || '...)' WHEN 2 THEN 'GE ' || translate(code, 'ABGOI', '44444') ELSE code END AS text FROM w),
d AS (SELECT p_partkey, text, txt || ' | ' || text || CASE WHEN p_partkey % 6 = 0 THEN ' | ' || code || ' (' || code || ')' ELSE '' END AS others, p_partkey % 5 > 0 AS within FROM s)"""
    votes = f"""{displays}, l AS (SELECT p_partkey, list_prepend(text, regexp_split_to_array(others, '\\s+\\|\\s+')) AS l FROM d),
u AS (SELECT p_partkey, trim(unnest(l)) AS o, generate_subscripts(l, 1) - 1 AS i FROM l), o AS (SELECT p_partkey, o, min(i) AS i FROM u WHERE o <> '' GROUP BY 1, 2),
z AS (SELECT p_partkey, i, {like('o')} AS al, {like(HEAD('o'))} AS lead, {like(TAIL('o'))} AS ins, {strict(HEAD('o'))} AS sl, {strict(TAIL('o'))} AS si FROM o),
e AS (SELECT *, unnest(list_distinct(al)) AS code FROM z),
ev AS (SELECT p_partkey, code, min(i * 1000 + list_position(al, code)) AS ord, sum(1 + CASE WHEN list_contains(lead, code) THEN 0.75 ELSE 0 END + CASE WHEN list_contains(ins, code) THEN 2 ELSE 0 END
 + CASE WHEN list_contains(sl, code) THEN 3 ELSE 0 END + CASE WHEN list_contains(si, code) THEN 5 ELSE 0 END + CASE WHEN list_contains(lead, code) AND list_contains(ins, code) THEN 3 ELSE 0 END
 + CASE WHEN i = 0 THEN 0.75 ELSE 0 END)::DOUBLE AS score FROM e GROUP BY 1, 2)"""
    first = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey, CASE WHEN l_linenumber % 3 < 2 THEN round(l_tax * 100 + l_linenumber / 10.0, 1) END)"
    return {
        "code_evidence": f"WITH {votes} SELECT p_partkey, code, score FROM ev",
        "code_recovery": f"""WITH {votes}, a AS (SELECT p_partkey, text, within, {like('text')}[1] AS own, {like(TAIL('text'))}[1] AS again, len({strict(HEAD('text'))}) > 0 AS strict, len({like('text')}) > 0 AS any_code,
  regexp_replace(upper({HEAD('text')}), '[^A-Z0-9]', '', 'g') AS compact, contains(text, '(') AS twice FROM d),
b AS (SELECT a.*, regexp_extract(compact, '[0-9]{{5}}$') AS digits, own IS NOT NULL AND again IS NOT NULL AND NOT strict AS rep FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, ord) AS k, max(score) OVER (PARTITION BY p_partkey) AS most, count(*) OVER (PARTITION BY p_partkey) AS many FROM ev),
g AS (SELECT b.p_partkey, arg_min(r.code, k) AS top, arg_min(r.code, k) FILTER (WHERE r.code IS DISTINCT FROM b.own) AS other, bool_or(r.code = b.own AND r.score = r.most) AS held, any_value(most) AS most, any_value(many) AS many FROM b JOIN r USING (p_partkey) GROUP BY 1),
h AS (SELECT b.*, most, many, CASE WHEN rep THEN again WHEN digits <> '' THEN coalesce(other, top) WHEN held THEN own ELSE top END AS pick, CASE WHEN digits <> '' THEN digits ELSE compact END AS shape FROM b JOIN g USING (p_partkey)),
m AS (SELECT *, regexp_full_match(shape, '[A-Z0-9]{{2,6}}') AND ((regexp_matches(shape, '[A-Z]') AND regexp_matches(shape, '[0-9]')) OR regexp_full_match(shape, '[0-9]{{5}}')) AS bad, any_code AND len(compact) <= 9 AS shown FROM h),
t AS (SELECT *, CASE WHEN strict THEN CASE WHEN within AND shown THEN own END WHEN within AND (bad OR shown) AND (own IS NOT NULL OR many = 1 OR most >= 3) THEN pick END AS code FROM m),
v AS (SELECT *, CASE WHEN code IS NULL THEN text WHEN twice THEN code || ' (' || regexp_replace(substr(text, strpos(text, '(') + 1), '^[A-Z0-9]{{3,8}}', code) ELSE code END AS recovered FROM t)
SELECT d.p_partkey, coalesce(recovered, d.text) AS recovered, CASE WHEN recovered IS NULL OR recovered = d.text THEN '' WHEN strict OR own IS NOT DISTINCT FROM pick THEN 'identifier_normalised' WHEN rep THEN 'identifier_from_repeated_display' ELSE 'identifier_from_alternatives' END AS marker
FROM d LEFT JOIN v USING (p_partkey)""",
        "display_guards": f"""WITH {displays} SELECT p_partkey, len({strict(HEAD('text'))}) > 0 AS strict_head, len({strict('text')}) > 0 AS strict, len({like('text')}) > 0 AND len(regexp_replace(upper({HEAD('text')}), '[^A-Z0-9]', '', 'g')) <= 9 AS display,
regexp_full_match(regexp_replace(upper({HEAD('text')}), '\\s+', '', 'g'), '[XYZKVT7][0-9OQDLIZSGBTA]{{1,2}}') AS short, within AS context FROM d""",
        "standard_tolerance": f"""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber * 1000000 + l_partkey AS pos, CASE WHEN {first} = 1 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS w, round(l_tax * 100 + l_linenumber / 10.0, 1)::DOUBLE AS v FROM lineitem),
t AS (SELECT *, floor(v)::INT AS a, round(v * 10)::INT % 10 AS b, {{'p': pos, 't': CASE WHEN n % 3 < 2 THEN v END, 'i': 0}} AS o FROM f),
x AS (SELECT k, o, v, 1.45 * w AS w FROM t WHERE n % 3 = 0 UNION ALL SELECT k, struct_update(o, i := 1), v, 1.12 * w FROM t WHERE n % 3 < 2
  UNION ALL SELECT k, struct_update(o, i := 2), (CASE WHEN b > 0 THEN b ELSE a END)::DOUBLE, 0.82 * w FROM t WHERE n % 3 = 0 AND a + b > 0 UNION ALL SELECT k, struct_update(o, i := 2), n::DOUBLE, 0.82 * w FROM t WHERE n % 3 = 2),
y AS (SELECT k, v, sum(w) AS w, min(o) AS o FROM x WHERE v > 0 GROUP BY 1, 2),
z AS (SELECT y.k, y.v, y.o, round(y.w + CASE WHEN y.v % 1 <> 0 THEN coalesce(i.w, 0) * 0.45 ELSE 0 END, 9) AS t FROM y LEFT JOIN y i ON i.k = y.k AND i.v = floor(y.v))
SELECT k AS l_orderkey, v AS value, round(least(0.99, 0.60 + t / 4), 6)::DOUBLE AS confidence FROM z QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, o) = 1""",
        "conditional_tolerance": """WITH f AS (SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS pos, l_linenumber % 3 = 0 AS half, trunc(l_tax * 100) AS a FROM lineitem),
x AS (SELECT k, {'p': pos, 't': a, 'i': 0} AS o, a + 0.5 AS v FROM f WHERE half UNION ALL SELECT k, {'p': pos, 't': a, 'i': 1}, CASE WHEN half THEN 5.0 ELSE a END FROM f WHERE half OR a > 0),
y AS (SELECT k, v::DOUBLE AS v, count(*) AS n, min(o) AS o FROM x GROUP BY 1, 2)
SELECT k AS l_orderkey, v AS value, CASE WHEN v % 1 = 0 THEN 0.90 ELSE 0.96 END::DOUBLE AS confidence FROM y QUALIFY row_number() OVER (PARTITION BY k ORDER BY v % 1 = 0, n DESC, o) = 1""",
        "conditional_suffix": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 2 OR l_partkey % 4 = 3 THEN '' ELSE substr('AB', (l_linenumber % 3 + 1)::INT, 1) || '0' || substr('127', (l_partkey % 4 + 1)::INT, 1) END AS suffix FROM lineitem""",
        "lane_conflict": """WITH s AS (SELECT user_id, event_id, (event_id % 2)::INT AS lane, event_type AS t, event_id % 5 = 0 AS part, round(floor(value) + least(24, len(regexp_replace(event_type, '[^a-z]', '', 'g'))) * 0.8::DOUBLE + 7 + CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END, 6) AS s FROM events),
b AS (SELECT user_id, lane AS bl, t AS bt, s AS bs FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) = 1)
SELECT user_id, any_value(bl) AS lane, count(DISTINCT lane) AS lanes, bool_or(lane <> bl AND NOT (ends_with(t, bt) OR ends_with(bt, t)) AND s >= bs - 7) AND count(DISTINCT lane) > 1 AS conflict FROM s JOIN b USING (user_id) WHERE NOT part GROUP BY 1""",
        "fragment_completion": f"""WITH n AS {noisy}, known AS {DICTIONARY}, {COSTS},
f AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr(code, 2, 4) ELSE substr(code, 1, 4) END AS f FROM n),
p AS (SELECT p_partkey, code, lost, i, substr(f, i, 1) AS o, substr(code, i + lost, 1) AS e, i + lost = 3 AS letter FROM f, known, unnest([0, 1]) AS a(lost), unnest([1, 2, 3, 4]) AS b(i)),
q AS (SELECT p_partkey, code, lost, round(greatest(0, 1 - (sum({COST}) + CASE WHEN lost = 1 THEN 0.12 ELSE 0.14 END) / 2.2::DOUBLE), 9) AS s FROM p LEFT JOIN c ON c.o = p.o AND c.e = p.e AND c.letter = p.letter GROUP BY 1, 2, 3),
g AS (SELECT p_partkey, code, max(s) AS s FROM q WHERE s >= 0.78 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS next FROM g WINDOW w AS (PARTITION BY p_partkey ORDER BY s DESC))
SELECT p_partkey, code, s AS score FROM r WHERE k = 1 AND s >= 0.82 AND (next IS NULL OR round(s - next, 9) >= 0.18)""",
        "code_location": f"""WITH w AS (SELECT l_orderkey AS k, l_linenumber % 2 AS line, l_linenumber * 100 AS x, l_partkey AS y, CASE l_partkey % 4 WHEN 0 THEN '03' WHEN 1 THEN 'A01' WHEN 2 THEN 'O3A' ELSE '01' END AS t FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY k, line ORDER BY x, y) AS i FROM w),
r AS (SELECT a.k, a.line, a.i, n, string_agg(b.t, '' ORDER BY b.i) AS s, min(b.x) AS l, min(b.y) AS t, max(b.x + 40) AS r, max(b.y + 10) AS b FROM i a, unnest([1, 2, 3, 4]) AS q(n), i b
  WHERE b.k = a.k AND b.line = a.line AND b.i BETWEEN a.i AND a.i + n - 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = n),
{COSTS}, u AS (SELECT DISTINCT s FROM r), g AS (SELECT s, j, lost FROM u, unnest([0, 1]) AS q(lost), unnest(range(1, 20)) AS z(j) WHERE j + 4 - lost <= len(s)),
p AS (SELECT s, j, lost, substr(s, j + m - 1 - lost, 1) AS o, substr('03A01', m, 1) AS e, m = 3 AS letter FROM g, unnest([1, 2, 3, 4, 5]) AS z(m) WHERE m > lost),
q AS (SELECT s, j, lost, sum({COST}) + 0.42 * lost AS cost FROM p LEFT JOIN c ON c.o = p.o AND c.e = p.e AND c.letter = p.letter GROUP BY 1, 2, 3),
v AS (SELECT s, greatest(round(greatest(0, 1 - min(cost) / 2.6::DOUBLE), 9), CASE WHEN contains(s, '03A01') THEN 0.99 ELSE 0 END) AS score FROM q GROUP BY 1)
SELECT k AS l_orderkey, score::DOUBLE AS score, l AS "left", t AS top, r AS "right", b AS bottom FROM r JOIN v USING (s) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, line, n, i) = 1""",
        "frame_registration": """WITH a AS (SELECT vec_id, embedding[1:24]::DOUBLE[] AS a FROM embeddings), b AS (SELECT *, a[4:24] || a[1:3] AS b FROM a),
c AS (SELECT vec_id, s * d AS k, round(coalesce(corr(a[j + greatest(s * d, 0)], b[j + greatest(-s * d, 0)]), -1), 9) AS c FROM b, unnest(range(1, 13)) AS x(s), unnest([1, -1]) AS y(d), unnest(range(1, 24)) AS z(j) WHERE j <= 24 - s GROUP BY 1, 2),
m AS (SELECT vec_id, k AS bk, c AS score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, k DESC) = 1),
n AS (SELECT vec_id, any_value(bk) AS bk, any_value(score) AS score, max(c) AS second FROM c JOIN m USING (vec_id) WHERE abs(k - bk) > 2 GROUP BY 1)
SELECT vec_id, CASE WHEN score >= 0.22 AND round(score - second, 9) >= 0.015 THEN bk::INT END AS shift, round(score, 6) AS score, round(second, 6) AS second FROM n""",
        "support_axis": """WITH a AS (SELECT DISTINCT o_custkey AS k, floor(o_totalprice / 5000)::DOUBLE AS a FROM orders),
s AS (SELECT a.k, a.a, count(b.a) AS n FROM a LEFT JOIN a b ON b.k = a.k AND b.a > a.a AND abs((b.a - a.a) / 28 - round_even((b.a - a.a) / 28, 0)) < 0.16 GROUP BY 1, 2)
SELECT k AS o_custkey, a AS axis FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, a) = 1""",
        "prefix_repair": """SELECT l_orderkey, max(struct_pack(l := l_quantity, t := l_returnflag || l_linenumber::VARCHAR)).t AS prefix, max(l_quantity) AS prefix_left FROM lineitem
WHERE l_linenumber % 2 = 0 AND l_quantity < 40 AND abs(l_quantity - 22) <= 10.08 AND l_quantity + 9 >= 29 GROUP BY 1""",
        "median_default": "SELECT user_id, coalesce(median(floor(value)) FILTER (WHERE event_type = 'error'), 60)::DOUBLE AS median FROM events GROUP BY 1",
        "flags_of_two_sources": """WITH l AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.text) % 2 = 0, false) OR coalesce(l.q, false) AS quality, coalesce(l.t, false) AS toxic FROM documents d LEFT JOIN l USING (doc_id)""",
        "value_cascade": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_custkey::DOUBLE ELSE CASE WHEN o_orderkey % 2 = 0 THEN try_cast(regexp_extract(o_orderpriority, '[0-9]') AS DOUBLE) END END AS value,
CASE o_orderkey % 3 WHEN 0 THEN 'limit' WHEN 1 THEN 'dimension' ELSE CASE WHEN o_orderkey % 2 = 0 AND regexp_matches(o_orderpriority, '[0-9]') THEN 'text' ELSE '' END END AS source FROM orders""",
        "quantity_cascade": """WITH l AS (SELECT *, l_linenumber::VARCHAR AS n, floor(l_quantity)::INT::VARCHAR AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN n || 'X' WHEN l_linenumber % 4 = 0 THEN q || 'X' WHEN l_linenumber % 4 = 1 THEN n || ' x' WHEN l_linenumber % 4 = 2 THEN 'Separate' WHEN l_returnflag = 'N' THEN 'multiple' ELSE '1X' END AS display,
CASE WHEN l_partkey % 5 = 0 THEN n WHEN l_linenumber % 4 = 0 THEN q WHEN l_linenumber % 4 = 1 THEN n WHEN l_linenumber % 4 = 2 OR l_returnflag = 'N' THEN '' ELSE '1' END AS count FROM l""",
        "ordered_distinct": "SELECT p_partkey, p_brand || '|' || p_name || '|end' AS texts FROM part",
        "structural_labels": """WITH c AS (SELECT c_custkey, c_custkey % 4 AS a, c_custkey % 3 AS b, CASE c_custkey % 4 WHEN 0 THEN 'Springback' WHEN 1 THEN 'a | b-c d-e' WHEN 2 THEN 'Elément de référence.S (E)' ELSE c_name END AS x FROM customer)
SELECT c_custkey, CASE WHEN a = 0 AND b = 0 THEN 'CPC SPRINGBACK' WHEN a = 0 AND b = 1 THEN 'CTF SPRINGBACK' WHEN a = 1 THEN 'REF A|B-C|D-E' ELSE x END AS capture, CASE WHEN a = 2 AND b = 2 THEN 'Elément de référence.5 (E)' ELSE x END AS reference FROM c""",
    }
