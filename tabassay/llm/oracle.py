"""SQL twins of those queries that SQL can express on whole tables."""

from __future__ import annotations

from tabassay.llm.queries import URL_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _url(x: str) -> dict[str, str]:
    part = lambda g: f"coalesce(regexp_extract({x}, '{_URL}', {g}), '')"
    return {"host": _low(part(1)), "path": part(2), "query": part(3)}


def _op1() -> str:
    u = _url("url")
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    node = _url("'x://' || n")
    tags = (
        (r"""(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>""", r"""(?is)\bhref\s*=\s*["'']?([^"''\s>]+)"""),
        (r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>""", r"""(?is)\bcontent\s*=\s*["'']?[^"''>;]*;\s*url\s*=\s*["'']?([^"''\s>]+)"""),
    )
    links = " UNION ALL ".join(f"SELECT key, host, path, regexp_extract(regexp_extract(html, '{tag}'), '{place}', 1) AS href FROM urls" for tag, place in tags)
    t = _url("target")
    fit = "(u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)"
    best = "arg_max({what}, (length(h) + length(p), length(h), action = 'allow'))"
    return rf"""WITH RECURSIVE urls AS (SELECT page_id, url, html, {u['host']} AS host, {u['path']} AS path, CASE WHEN {u['host']} <> '' THEN {u['host']} || {u['path']} || {u['query']} END AS key FROM pages),
rules(h, p, action) AS (VALUES {rules}),
links AS (SELECT key, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN 'x:' || href WHEN starts_with(href, '/') THEN 'x://' || host || href
  WHEN starts_with(href, '?') THEN 'x://' || host || path || href ELSE 'x://' || host || regexp_replace(path, '[^/]*$', '') || href END AS target
  FROM (SELECT key, host, path, replace(href, '&amp;', '&') AS href FROM ({links})) WHERE href <> '' AND NOT starts_with(href, '#')),
edges AS (SELECT key AS a, {t['host']} || {t['path']} || {t['query']} AS b FROM links WHERE {t['host']} <> ''),
sym AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach AS (SELECT a AS s, a AS n FROM sym UNION SELECT reach.s, sym.b FROM reach JOIN sym ON reach.n = sym.a),
nodes AS (SELECT n, {node['host']} AS host, {node['path']} AS path FROM (SELECT DISTINCT a AS n FROM sym)),
decided AS (SELECT n, {best.format(what='action')} AS action FROM nodes u JOIN rules r ON {fit} GROUP BY 1),
aliases AS (SELECT s AS key, CASE WHEN bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS alias FROM reach JOIN decided USING (n) GROUP BY 1),
own AS (SELECT host, path, {best.format(what='h || p')} AS rule, {best.format(what='action')} AS action FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r ON {fit} GROUP BY 1, 2)
SELECT page_id, urls.host, urls.path, rule, coalesce(action, alias, 'allow') AS verdict FROM urls LEFT JOIN own ON own.host = urls.host AND own.path = urls.path LEFT JOIN aliases USING (key)"""


_WORDS = r"regexp_extract_all(coalesce({x}, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x=_low('text'))} AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS s, doc_id AS r FROM w UNION SELECT reach.s, sym.y FROM reach JOIN sym ON reach.r = sym.x)
SELECT s AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, min(r) = s AS kept FROM reach LEFT JOIN n ON n.doc_id = s GROUP BY s"""

_OP6 = rf"""WITH w AS (SELECT doc_id, {_WORDS.format(x='text')} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) AS t FROM w WHERE len(ws) >= 35),
dup AS (SELECT t FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN dup USING (t)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_OP8 = r"""WITH w AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ls) - 1)) AS i, unnest(list_transform(range(1, len(ls) - 1), lambda i: array_to_string(ls[i:i + 2], chr(10)))) AS t FROM w WHERE len(ls) >= 3),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM w),
again AS (SELECT doc_id, i FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 8 QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, unnest(range(i, i + 3)) AS i FROM later UNION SELECT doc_id, i FROM again),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_ITEM_WORDS = r"regexp_extract_all(coalesce({x}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP9 = rf"""WITH w AS (SELECT doc_id, {_ITEM_WORDS.format(x=_low('text'))} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS.format(x=_low('text'))} AS ws FROM benchmark),
item_windows AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS t, least(len(ws), 13) AS n FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM item_windows),
win AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS t FROM w, sizes WHERE len(ws) >= n),
found AS (SELECT doc_id, win.i, win.n, item FROM win JOIN item_windows USING (t, n)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id"""

_OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

_OP12 = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_low('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 5) t(m) WHERE len(ws) >= m),
f AS (SELECT lang, string_split(phrase, ' ') AS p, phrase, m, f FROM (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30)),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
c AS (SELECT lang, p, phrase, m, f AS a FROM f WHERE m >= 2),
cut AS (SELECT c.lang, c.phrase, k, a, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score FROM c JOIN range(1, 4) t(k) ON k < c.m JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m]),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT c.lang, array_to_string(c.p[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM c JOIN range(2, 4) t(s) ON s < m JOIN range(1, 4) u(i) ON i + s - 1 <= m GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest LEFT JOIN longer USING (lang, phrase) JOIN total USING (lang) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


def oracle_sql() -> dict[str, str]:
    """By query name. Trained models, tokenizers and packing are beyond SQL and are tested otherwise."""
    return {
        "op1_url_filters": _op1(), "op3_near_dedup": _OP3, "op6_substring_dedup": _OP6, "op8_line_dedup": _OP8,
        "op9_benchmark_decontamination": _OP9, "op10_exact_top_k": _OP10, "op12_phrase_collocations": _OP12,
    }
