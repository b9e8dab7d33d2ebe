"""The queries opN_<name> with production parameters, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from .attention_lm import lm_scores
from .conversation_repair import repair_conversations
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .jaccard_join import jaccard_join
from .mixing import mix
from .packing import pack
from .quality_model import quality_classifier
from .quality_rules import quality_rules
from .store import table
from .substring_dedup import substring_dedup
from .token_store import token_files
from .toxicity import toxicity
from .url_filters import url_filters

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", "rate", "shuffle_key")


def op6_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_url_filters(spark, sf_dir):
    return url_filters(table(spark, sf_dir, "pages"), URL_RULES)


def op11_token_orc(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_conversation_repair(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    names = (
        op1_substring_dedup, op2_ngram_jaccard_join, op3_toxicity, op4_lm_scoring, op5_source_mixing, op6_best_fit_packing, op7_exact_dedup, op8_quality_classifier, op9_quality_rules, op10_url_filters,
        op11_token_orc, op12_conversation_repair, op13_filter_audit,
    )
    return {f.__name__: f for f in names}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = """
WITH RECURSIVE s AS (SELECT source, sum(len(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE sum(chars) OVER () * sqrt(chars) / sum(sqrt(chars)) OVER () / chars END AS rate FROM s),
d AS (SELECT row_number() OVER () AS n, doc_id, d.source, rate, ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
walk(n, rate, u, k, term, total) AS (SELECT n, rate, u, 0, exp(-rate), exp(-rate) FROM d
  UNION ALL SELECT n, rate, u, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM walk WHERE total <= u),
c AS (SELECT n, max(k) AS times FROM walk GROUP BY n)
SELECT doc_id, source, copy, rate, md5('17/' || doc_id || '/' || copy) AS shuffle_key FROM d JOIN c USING (n), unnest(range(times)) AS x(copy)
"""

_OP7 = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""

_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, sum(least(3, coalesce(i - prev, 3))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM p) GROUP BY r),
lines AS (SELECT r, doc_id, host, x FROM d, unnest(string_split(t, chr(10))) AS u(x) WHERE len(regexp_extract(x, '[^\x20\x09-\x0D]')) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY r),
norm AS (SELECT r, doc_id, host, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS y FROM lines),
over_limit AS (SELECT host, y FROM norm GROUP BY host, y HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'row ' || r)) > 100),
gone AS (SELECT r, sum(len(y) - len(replace(y, ' ', '')) + 1) AS n FROM norm JOIN over_limit USING (host, y) GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM b
"""

_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)


def _parts(url: str) -> str:
    lower = f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"{lower} AS host, coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"


_MUTE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_TAGS = r"""(?is)<(?:link|meta|base)\b(?:[^>"'']+|"[^"]*"|''[^'']*'')*>"""
_PARTS = r"""(?is)"[^"]*"|''[^'']*''|([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?"""


def _attribute(name: str) -> str:
    v = f"v[list_position(n, '{name}')]"
    bare = f"CASE WHEN left({v}, 1) IN (chr(34), chr(39)) THEN substr({v}, 2, len({v}) - 2) ELSE {v} END"
    return f"replace(coalesce({bare}, ''), '&amp;', '&')"


def _joined(source: str, base: str) -> str:
    """Urls that t names on a base, with site, segments and query taken apart, and dots taken out."""
    return rf"""{source}_parts AS (SELECT r, url, {base} AS base, t, regexp_extract({base}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) AS scheme, regexp_extract({base}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site,
  regexp_extract({base}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM {source} WHERE t <> '' AND NOT starts_with(t, '#')),
{source}_joined AS (SELECT r, url, t, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR site = '' THEN NULL
  WHEN starts_with(t, '//') THEN scheme || t WHEN starts_with(t, '/') THEN site || t
  WHEN starts_with(t, '?') THEN site || path || t ELSE site || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS u FROM {source}_parts),
{source}_cut AS (SELECT row_number() OVER () AS k, r, url, regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site,
  string_split(regexp_extract(u, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[2:] AS seg, regexp_extract(u, '(?s)^[^?#]*(\?[^#]*)', 1) AS query FROM {source}_joined WHERE u IS NOT NULL),
{source}_dots(k, i, done) AS (SELECT k, 1, []::VARCHAR[] FROM {source}_cut UNION ALL
  SELECT d.k, i + 1, CASE WHEN seg[i] IN ('.', '..') THEN (CASE WHEN seg[i] = '..' THEN done[1:greatest(0, len(done) - 1)] ELSE done END) || (CASE WHEN i = len(seg) THEN [''] ELSE []::VARCHAR[] END)
    ELSE done || [seg[i]] END FROM {source}_dots d JOIN {source}_cut c ON c.k = d.k WHERE i <= len(seg)),
{source}_aimed AS (SELECT r, url, site || '/' || array_to_string(done, '/') || query AS u FROM {source}_cut JOIN {source}_dots USING (k) WHERE i = len(seg) + 1)"""


def _node(url: str) -> str:
    """A url's alias name in DuckDB: no fragment, scheme and host in lower case, no default port, a path at least."""
    site = f"translate(regexp_extract({url}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = f"regexp_replace({url}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$', '', 'g')"
    bare = f"CASE WHEN {site} LIKE 'http://%' THEN regexp_replace({site}, ':(80)?$', '') WHEN {site} LIKE 'https://%' THEN regexp_replace({site}, ':(443)?$', '') ELSE {site} END"
    return f"CASE WHEN {site} = '' THEN string_split({url}, '#')[1] ELSE {bare} || CASE WHEN starts_with({rest}, '/') THEN '' ELSE '/' END || {rest} END"


_OP10 = rf"""
WITH RECURSIVE rules(verdict, rule, h, p) AS (VALUES {_RULES}),
pieces AS (SELECT r, url, i, ts[i] AS tag FROM (SELECT row_number() OVER () AS r, url, regexp_extract_all(regexp_replace(html, '{_MUTE}', ' ', 'g'), '{_TAGS}') AS ts FROM pages WHERE url IS NOT NULL), unnest(range(1, len(ts) + 1)) AS x(i)),
read AS (SELECT r, url, i, list_transform(regexp_extract_all(tag, '{_PARTS}', 1), lambda x: lower(x)) AS n, regexp_extract_all(tag, '{_PARTS}', 2) AS v FROM pieces),
kinds AS (SELECT r, url, i, CASE WHEN n[1] = 'base' THEN 'base' WHEN n[1] = 'link' AND list_contains(regexp_split_to_array(lower({_attribute('rel')}), '\s+'), 'canonical') THEN 'link'
  WHEN n[1] = 'meta' AND lower(trim({_attribute('http-equiv')})) = 'refresh' THEN 'refresh' END AS kind, trim({_attribute('href')}) AS href, {_attribute('content')} AS content FROM read),
aims AS (SELECT r, url, i, kind, CASE kind WHEN 'refresh' THEN trim(regexp_extract(content, '(?is)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1)) ELSE href END AS t FROM kinds WHERE kind IS NOT NULL),
firsts AS (SELECT r, url, arg_min(t, i) AS t FROM aims WHERE kind = 'base' AND t <> '' GROUP BY r, url),
{_joined('firsts', 'url')},
links AS (SELECT a.r, a.url, a.t, coalesce(b.u, a.url) AS base FROM (SELECT DISTINCT r, url, t FROM aims WHERE kind <> 'base') a LEFT JOIN firsts_aimed b ON b.r = a.r),
{_joined('links', 'base')},
aimed AS (SELECT * FROM links_aimed),
both_ends AS (SELECT DISTINCT {_node('url')} AS a, {_node('u')} AS b FROM aimed),
edges AS (SELECT a, b FROM both_ends WHERE a <> b UNION SELECT b, a FROM both_ends WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
node AS (SELECT DISTINCT b, {_parts('b')} FROM edges),
judged AS (SELECT b, arg_max(verdict, (len(rule), rule)) AS v FROM node JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY b),
alias AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v
  FROM reach JOIN judged USING (b) GROUP BY a),
base AS (SELECT row_number() OVER () AS r, page_id, {_node('url')} AS n, {_parts('url')} FROM pages),
own AS (SELECT r, arg_max(rule, (len(rule), rule)) AS rule, arg_max(verdict, (len(rule), rule)) AS verdict FROM base JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(own.verdict, alias.v, 'allow') AS verdict
FROM base LEFT JOIN own USING (r) LEFT JOIN alias ON base.n = alias.a
"""


# The checksum of "id:turn", byte by byte over a table of 256 remainders that the polynomial gives.
_CRC = """
bits(b, k, x) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8),
keys AS (SELECT row_number() OVER () AS r, *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS c FROM keys, crc_table)
"""

_OP12 = rf"""
WITH RECURSIVE {_CRC},
damage AS (SELECT r, conv_id, turn, c % 20 AS kind, CASE c % 20 WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE c % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM keys JOIN crc USING (r)),
rows_ AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) AS pos
  FROM damage, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, left(role, 1) AS ini, regexp_replace(text, '[ 	-
]+$', '') AS bare FROM rows_),
fault AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM fault GROUP BY conv_id),
after(st, ini, nxt) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
put(st, nxt, word) AS (SELECT st, nxt, CASE ini WHEN 'u' THEN 'user' ELSE 'assistant' END FROM after WHERE ini <> 's'),
ins(st, nxt, k, add) AS (SELECT DISTINCT st, st, 0, []::VARCHAR[] FROM after UNION ALL SELECT i.st, p.nxt, k + 1, list_append(add, p.word || ':') FROM ins i JOIN put p ON i.nxt = p.st WHERE k < 3),
dp(conv_id, pos, st, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT conv_id, pos, st, min(k) FROM (
    SELECT d.conv_id, f.pos, e.nxt AS st, {{'cost': (d.best.cost + 2 * i.k + e.cost)::BIGINT, 'audit': d.best.audit || repeat('I', i.k) || e.op, 'lines': d.best.lines || i.add || e.line}} AS k
    FROM dp d JOIN fault f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1 JOIN ins i ON i.st = d.st,
    LATERAL (SELECT i.nxt, 3 AS cost, 'D' AS op, []::VARCHAR[] AS line
      UNION ALL SELECT a.nxt, (f.fault = 'truncated')::INT, 'K', [f.role || ':' || f.text] FROM after a WHERE a.st = i.nxt AND a.ini = f.ini AND f.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT p.nxt, 2 + (f.fault = 'truncated')::INT, 'R', [p.word || ':' || f.text] FROM put p WHERE p.st = i.nxt AND f.fault NOT IN ('blank', 'duplicate')) e
  ) GROUP BY conv_id, pos, st),
ended AS (SELECT d.conv_id, min({{'cost': (d.best.cost + 2 * i.k)::BIGINT, 'audit': d.best.audit || repeat('I', i.k), 'lines': d.best.lines || i.add}}) AS e
  FROM dp d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id JOIN ins i ON i.st = d.st WHERE d.pos = coalesce(c.n, 0) AND i.nxt IN ('', 'a') GROUP BY d.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.e.cost AS cost, e.e.audit AS audit, sha256(array_to_string(e.e.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, doc_id, part, t, regexp_extract_all(t, '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS m FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, m),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS z(step)),
per AS (SELECT part, filter_order, step, own, n, good, toxic, m, contains(m, own) AS has, len(m) - len(translate(m, earlier, '')) > 0 AS before FROM s, g),
t AS (SELECT part, filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (NOT has AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (has AND NOT before), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (has AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (has AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (has AND NOT before), 0)::BIGINT AS toxic_lost FROM per GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": _OP5, "op7_exact_dedup": _OP7, "op9_quality_rules": _OP9, "op10_url_filters": _OP10, "op12_conversation_repair": _OP12, "op13_filter_audit": _OP13}
