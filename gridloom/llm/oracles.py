"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .license_scan import BASE, all_templates
from .url_rules import Rule

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({lowered('coalesce(text, ' + repr('') + ')')}, '{WORD}') AS w FROM {table}"


def url_filter(rules: list[Rule]) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    host, path = "regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)", "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

    def key(c: str) -> str:
        query = f"regexp_extract({c}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1)"
        return f"CASE WHEN contains({c}, '://') THEN 'x://' || {lowered(host.format(c))} || coalesce(nullif({path.format(c)}, ''), '/') || {query} END"

    judged = lambda t, k: f"SELECT {k}, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM {t} JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1"
    return f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {values}),
u AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN {lowered(host.format('url'))} ELSE '' END AS host, CASE WHEN contains(url, '://') THEN {path.format('url')} ELSE '' END AS path, {key('url')} AS k FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM u WHERE regexp_matches(html, '(?i)canonical|refresh')),
links AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b') THEN regexp_extract(tag, '(?is)[\\s"'']href\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) END AS t FROM tags),
resolved AS (SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || t END AS t FROM links),
e AS (SELECT {key('url')} AS a, {key('t')} AS b FROM resolved WHERE url IS NOT NULL AND t IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
node AS (SELECT DISTINCT a AS k, {lowered(host.format('a'))} AS host, {path.format('a')} AS path FROM reach),
named AS ({judged('node', 'k')}), spread AS (SELECT a AS k, min(verdict) AS verdict FROM reach JOIN named ON named.k = b GROUP BY 1),
own AS ({judged('u', 'page_id')})
SELECT u.page_id, u.host, u.path, own.rule, coalesce(own.verdict, spread.verdict, 'allow') AS verdict FROM u LEFT JOIN own USING (page_id) LEFT JOIN spread ON u.k = spread.k"""


DECONTAMINATE = rf"""
WITH d AS ({words('documents', 'doc_id')}), b AS ({words('benchmark', 'item_id')}),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[CAST(k + 1 AS INT):CAST(k + least(10, len(w)) AS INT)], ' ') AS s FROM (SELECT *, unnest(range(greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, k, array_to_string(w[CAST(k + 1 AS INT):CAST(k + n AS INT)], ' ') AS s FROM (SELECT *, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE n <= len(w))),
h AS (SELECT doc_id, k, x.n, item FROM x JOIN i ON x.n = i.n AND x.s = i.s),
c AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM h, range(10) t(o) WHERE o < n GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

VECTOR_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS ({words('documents', 'doc_id')}),
g AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(k + 1 AS INT):CAST(k + 5 AS INT)], ' ') AS s FROM (SELECT *, unnest(range(greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN m ON m.a = doc_id LEFT JOIN k ON k.a = doc_id"""


def license_scan() -> str:
    """Base phrases by their places, other parts by their presence in the line of words."""
    known = all_templates()
    holds = lambda p: f"contains(line, ' {' '.join(p)} ')"
    columns, label, longest = [], [], []
    for t, (name, parts, keys, least, of_base) in enumerate(known):
        if of_base:
            at = " AND ".join(f"w[i + {j + 1}] = '{p}'" for j, p in enumerate(parts[0]))
            columns.append(f"CASE WHEN {holds(parts[0])} THEN list_filter(range(len(w)), lambda i: coalesce({at}, false)) ELSE [] END AS h{t}")
        found = " + ".join(f"CAST({holds(p)} AS INT)" for p in parts)
        fits = " AND ".join([f"{found} >= {least}", *map(holds, keys)])
        label.append(f"CASE WHEN {fits} THEN ['{name}'] ELSE [] END")
        words = " + ".join(f"CASE WHEN {holds(p)} THEN {len(p)} ELSE 0 END" for p in parts)
        longest.append(f"CASE WHEN {fits} THEN {words} ELSE 0 END")
    n = len(BASE)
    base = " || ".join(f"h{t}" for t in range(n))
    joined = lambda parts: f"array_to_string(list_sort(list_distinct({' || '.join(parts)})), ',')"
    return f"""
WITH d AS ({words_sql()}), l AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d), h AS (SELECT *, greatest({', '.join(longest)}) AS most, {', '.join(columns)} FROM l)
SELECT doc_id, len(w) AS n_words, CAST(len({base}) AS BIGINT) AS n_base, list_min({base}) AS first_word, list_max({base}) AS last_word, {joined(label[:n])} AS base_labels, {joined(label)} AS labels,
  most / (most + 1) AS score FROM h"""


def words_sql() -> str:
    return words("documents", "doc_id")
