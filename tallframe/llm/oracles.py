"""DuckDB SQL of the results of operators that SQL can express."""

from __future__ import annotations

#: unsigned CRC-32 (reflected polynomial) of the decimal digits of c, a bit at a time
CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
 lambda acc, b: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(acc, b)), CAST(4294967295 AS BIGINT)))"""

OP11 = f"""
WITH t AS (SELECT conv_id AS c, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS s, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(s)) - 1 AS i FROM t),
v AS (SELECT c, c - c % 100 AS base, {CRC} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
w AS (SELECT v.*, least(h, (SELECT count(*) FROM o WHERE o.c = v.base)) AS nb FROM v),
b AS (SELECT w.c, o.i + 1 AS d, s, n FROM w JOIN o ON o.c = w.base AND o.i < w.h UNION ALL
  SELECT w.c, o.i - w.h + w.nb + 1, s, n FROM w JOIN o ON o.c = w.c AND o.i >= w.h),
r AS (SELECT w.c, coalesce(list(s ORDER BY d) FILTER (s IS NOT NULL), []) AS seq, coalesce(list(n ORDER BY d) FILTER (s IS NOT NULL), []) AS lens FROM w LEFT JOIN b ON b.c = w.c GROUP BY 1),
p AS (SELECT c, d, seq[1:d] AS k, CASE WHEN d > 0 THEN seq[1:d - 1] END AS up, CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS n, d = len(seq) AS ends
  FROM r, unnest(range(0, len(seq) + 1)) AS u(d)),
g AS (SELECT k, any_value(d) AS d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
  sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM p GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY 1),
x AS (SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids USING (k)),
a AS (SELECT x.k[1:e] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM x, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children,
  CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN a USING (k) LEFT JOIN g q ON q.k = x.up"""


def _op12(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    parts = [
        f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM k QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""d{r} AS (SELECT vec_id, k.v, c, list_sum(list_transform(range(1, {dim + 1}), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i]))) AS distance FROM k, c{r} m),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, {dim + 1})) AS u(i) GROUP BY 1, 2),
n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c))"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} m USING (c)"""
    )


OP12 = _op12()

#: items of a URL as ``url_rules.items_of`` gives them
_ITEMS = """list_distinct(list_concat(
  list_transform(range(1, len(labels) + 1), lambda i: 'host=' || array_to_string(labels[i:], '.')),
  list_transform(list_filter(regexp_split_to_array(host, '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'word=' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(lower(x), '\\d+', '#', 'g')),
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'query=' || regexp_extract(x, '^([^=]*)', 1))))"""

#: every set of items of every labelled page is counted, up to the 12 items that say most
OP13 = f"""
WITH q AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
f AS (SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path, coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1, 's'), '') AS query FROM q),
h AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM f),
i AS MATERIALIZED (SELECT page_id, url, host, path, CASE WHEN host <> '' OR path <> '' THEN {_ITEMS} ELSE [] END AS items FROM h),
l AS (SELECT doc_id, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
j AS MATERIALIZED (SELECT row_number() OVER () AS r, items, CASE WHEN bad THEN 'block' ELSE 'allow' END AS verdict
  FROM i JOIN l ON l.doc_id = TRY_CAST(regexp_extract(i.path, '^.*?(\\d+)\\D*$', 1, 's') AS BIGINT) WHERE url IS NOT NULL),
n AS (SELECT count(*) AS total, greatest(20, 0.001 * count(*)) AS enough, count(*) FILTER (verdict = 'block') / count(*) AS base FROM j),
s AS (SELECT item, count(*) AS n, count(*) FILTER (verdict = 'block') AS b FROM (SELECT unnest(items) AS item, verdict FROM j) GROUP BY 1),
w AS (SELECT item, abs(s.b / s.n - n.base) * sqrt(s.n) AS weight FROM s, n WHERE greatest(b, s.n - b) >= enough),
k AS (SELECT r, verdict, list_sort((list(item ORDER BY -weight, item))[1:12]) AS best FROM (SELECT r, verdict, unnest(items) AS item FROM j) JOIN w USING (item) GROUP BY 1, 2),
u AS (SELECT list_filter(best, lambda x, p: (m >> (p - 1)) & 1 = 1) AS needed, verdict FROM k, unnest(range(1, CAST(1 << len(best) AS BIGINT))) AS z(m)),
c AS (SELECT needed, count(*) AS n, count(*) FILTER (verdict = 'block') AS b FROM u GROUP BY 1),
e AS (SELECT needed, 'block' AS verdict, b AS m, n FROM c UNION ALL SELECT needed, 'allow', n - b, n FROM c),
rules AS MATERIALIZED (SELECT needed, e.verdict, m, m / e.n AS confidence FROM e, n WHERE m >= enough AND m / e.n >= 0.8),
met AS (SELECT url, arg_max(verdict, (confidence, m, len(needed), verdict = 'block')) AS learned FROM (SELECT DISTINCT url, items FROM i WHERE url IS NOT NULL) JOIN rules ON list_has_all(items, needed) GROUP BY 1),
st AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS v(verdict, host, path)),
best AS (SELECT page_id, url, arg_max(st.host || st.path, length(st.host || st.path)) AS rule, arg_max(st.verdict, length(st.host || st.path)) AS stated
  FROM i JOIN st ON (i.host = st.host OR ends_with(i.host, '.' || st.host)) AND starts_with(i.path, st.path) GROUP BY 1, 2)
SELECT i.page_id, i.host, i.path, best.rule, coalesce(best.stated, met.learned, 'allow') AS verdict
FROM i LEFT JOIN best USING (page_id, url) LEFT JOIN met USING (url)"""
