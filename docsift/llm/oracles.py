"""DuckDB SQL of the vector codes and URL verdicts, with their rounds and levels written out."""

from __future__ import annotations

from docsift.llm.url_templates import DEPTH, MIN_ROWS, PURITY, SMOOTH, Z
from docsift.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE


def vector_codes_sql() -> str:
    dot = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
    d2 = f"{dot.format('p.q', 'p.q')} - 2 * {dot.format('p.q', 'c.q')} + {dot.format('c.q', 'c.q')}"

    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, p.part, any_value(p.label) AS label, any_value(p.q) AS q, arg_min(e, d * {ENTRIES} + e) AS e, min(d)::BIGINT AS d
  FROM (SELECT p.vec_id, p.part, p.label, p.q, c.e, {d2} AS d FROM p JOIN c{r} AS c ON c.part = p.part) AS p GROUP BY vec_id, p.part)"""

    steps = [assign(0)]
    for r in range(ROUNDS):
        steps.append(f"""m{r} AS (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT part, e, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM a{r}) GROUP BY part, e, i),
n{r} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM m{r} GROUP BY part, e),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(n.q, c.q) AS q FROM c{r} AS c LEFT JOIN n{r} AS n ON n.part = c.part AND n.e = c.e)""")
        steps.append(assign(r + 1))
    steps = ",\n".join(steps)
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS q FROM k, range({PARTS}) AS t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, q FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})),
{steps},
f AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, i)) AS s FROM (SELECT part, e, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM f, h
"""


def url_verdicts_sql(rules: list[tuple[str, str]]) -> str:
    fits = []
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"))):
        host, _, rest = text.partition("/")
        fits.append((f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')", text, verdict))
    rule = " ".join(f"{w} THEN '{t}'" for w, t, _ in fits)
    ruled = " ".join(f"{w} THEN '{v}'" for w, _, v in fits)
    steps = []
    for d in range(DEPTH + 1):
        steps.append(f"""t{d} AS MATERIALIZED (SELECT *, tokens[{d + 1}] AS token, CASE WHEN len(tokens) = {d + 1} THEN n ELSE 0 END AS ends FROM n{d} WHERE len(tokens) > {d}),
k{d} AS (SELECT host, node, token, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, sum(ends) AS ends FROM t{d} GROUP BY ALL),
kb{d} AS MATERIALIZED (SELECT *, CASE WHEN n >= {MIN_ROWS} THEN token ELSE '?' END AS branch FROM k{d}),
b{d} AS (SELECT host, node, branch, sum(n) AS n, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS k, sum(ends) AS ends FROM kb{d} GROUP BY ALL),
w{d} AS (SELECT *, sum(l) OVER (PARTITION BY host, node) AS al, sum(k) OVER (PARTITION BY host, node) AS ak FROM b{d}),
j{d} AS (SELECT host, node, branch, (8 * ends + n) // (2 * n) AS quarter, CASE WHEN branch = '?' THEN '?' WHEN l = 0 THEN 'none'
  WHEN (k * al - ak * l) * (k * al - ak * l) <= {Z * Z} * l * ak * (al - ak) THEN 'alike' WHEN k * al - ak * l > 0 THEN 'above' ELSE 'below' END AS side FROM w{d}),
g{d} AS MATERIALIZED (SELECT *, min(branch) OVER g AS first, count(*) OVER g AS members FROM j{d} WINDOW g AS (PARTITION BY host, node, side, quarter)),
n{d + 1} AS MATERIALIZED (SELECT t.host, t.shape, t.tokens, t.n, t.labelled, t.blocked, t.node || '/' || CASE WHEN members = 1 THEN first ELSE first || '?' || members END AS node
  FROM t{d} AS t JOIN kb{d} AS c ON c.host = t.host AND c.node = t.node AND c.token = t.token JOIN g{d} AS g ON g.host = t.host AND g.node = t.node AND g.branch = c.branch
  UNION ALL SELECT host, shape, tokens, n, labelled, blocked, node FROM n{d} WHERE len(tokens) <= {d})""")
    steps = ",\n".join(steps)
    return f"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM v),
s AS (SELECT host, shape, count(*) AS n, count(rule) AS labelled, count(CASE WHEN ruled = 'block' THEN 1 END) AS blocked, string_split(shape[2:], '/') AS x FROM r GROUP BY host, shape),
n0 AS MATERIALIZED (SELECT host, shape, n, labelled, blocked, '' AS node, CASE WHEN shape = '' THEN [] WHEN len(x) > {DEPTH} THEN list_concat(x[1:{DEPTH}], ['??']) ELSE x END AS tokens FROM s),
{steps},
leaf AS (SELECT host, node, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS k FROM n{DEPTH + 1} GROUP BY ALL),
a AS (SELECT sum(l) AS al, sum(k) AS ak FROM leaf),
o AS (SELECT host, node, CASE WHEN l > 0 AND 100 * (k * al + {SMOOTH} * ak) >= {PURITY} * (l + {SMOOTH}) * al THEN 'block' ELSE 'allow' END AS judged FROM leaf, a)
SELECT page_id, r.host, path, rule, coalesce(ruled, judged) AS verdict, r.host || n.node AS template
FROM r JOIN n{DEPTH + 1} AS n ON n.host = r.host AND n.shape = r.shape JOIN o ON o.host = n.host AND o.node = n.node
"""
