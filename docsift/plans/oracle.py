"""DuckDB SQL for the registered queries (the correctness oracle).

Each statement reads the driver's tables (views named after the parquet
files) and re-derives the result independently of Spark.  Shared pieces are
CTE fragments built from the same fixed values the library uses.
"""

from __future__ import annotations

from docsift.plans.bindings import VECTOR_GROUPS
from docsift.functions.text import STOPWORD_SET, WHITESPACE_CLASS

WS = WHITESPACE_CLASS
STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORD_SET) + "]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def prefilter(e: str) -> str:
    return (f"list_transform(list_filter(regexp_extract_all({e}, '[A-Za-z0-9]+'), "
            f"lambda t: NOT regexp_full_match(t, '[0-9]+')), lambda t: lower(t))")


def alnum(e: str) -> str:
    return f"list_filter({prefilter(e)}, lambda t: NOT list_contains({STOP_LIST}, t))"


def coherence(e: str) -> str:
    return (f"list_filter(regexp_extract_all(lower(coalesce({e}, '')), '[a-z0-9-]+'), "
            f"lambda t: length(t) >= 3)")


CORPUS = """corpus AS (
  SELECT doc_id,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1)
              ELSE text END AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END
              AS abstract,
         lang, source
  FROM documents)"""

CLEAN = CORPUS + f""",
clean AS (
  SELECT doc_id, coalesce(title, '') AS title, abstract, lang, source,
         {strip("coalesce(title, '') || ' ' || abstract")} AS title_abstract
  FROM corpus
  WHERE abstract IS NOT NULL AND {strip("abstract")} <> '')"""

# Labels by setting, derived from the documents (stand-in for density labels):
# (lang, source) groups for 5 and 10, source for 20, lang for 30; a group
# smaller than the setting is noise (-1); ids by dense rank of the group.
LABELS = CLEAN + """,
grp AS (
  SELECT doc_id, s.cs,
         CASE WHEN s.cs <= 10 THEN lang || '/' || source WHEN s.cs = 20 THEN source ELSE lang END AS g
  FROM clean, (VALUES (5), (10), (20), (30)) s(cs)),
grp_n AS (SELECT cs, g, count(*) AS n FROM grp GROUP BY cs, g),
grp_id AS (
  SELECT cs, g, CAST(dense_rank() OVER (PARTITION BY cs ORDER BY g) - 1 AS INTEGER) AS gid
  FROM grp_n WHERE n >= cs),
labels_cs AS (
  SELECT grp.doc_id, CAST(grp.cs AS INTEGER) AS min_cluster_size,
         CAST(coalesce(grp_id.gid, -1) AS INTEGER) AS cluster
  FROM grp LEFT JOIN grp_id ON grp.cs = grp_id.cs AND grp.g = grp_id.g)"""


def _top10_cols() -> str:
    return ", ".join(f"coalesce(lst[{j}].term, '') AS Word_{j}, "
                     f"CAST(coalesce(lst[{j}].n, 0) AS BIGINT) AS Count_{j}" for j in range(1, 11))


def _pct(b: str, a: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round_even((1 - {a} / {b}) * 100, 2) ELSE 0.0 END"


ORACLE: dict[str, str] = {
    "clean_corpus": f"WITH {CLEAN} SELECT doc_id, title, abstract, title_abstract FROM clean",
    "before_view": f"""WITH {CLEAN}
SELECT doc_id AS DocIndex, title AS Title, abstract AS Abstract,
       {strip("title || ' ' || abstract")} AS Title_Abstract FROM clean""",
    "ws_normalise": f"""WITH {CORPUS}
SELECT doc_id, {strip(f"regexp_replace(title, '{WS}+', ' ', 'g')")} AS title,
       {strip(f"regexp_replace(abstract, '{WS}+', ' ', 'g')")} AS abstract FROM corpus""",
    "dedupe_exact": f"""WITH {CLEAN}
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY title, abstract ORDER BY doc_id) AS rn
                    FROM clean) WHERE rn = 1""",
    "after_view": f"""WITH {CLEAN},
a AS (SELECT doc_id, array_to_string({alnum("title")}, ' ') AS tc,
             array_to_string({alnum("abstract")}, ' ') AS ac FROM clean)
SELECT doc_id AS DocIndex, tc AS Title_Clean, ac AS Abstract_Clean,
       {strip("tc || ' ' || ac")} AS Title_Abstract_Clean FROM a""",
    "doc_term_freq": f"""WITH {CLEAN},
t AS (SELECT doc_id, {alnum("title_abstract")} AS toks FROM clean),
u AS (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM t)
SELECT doc_id, term, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos FROM u GROUP BY doc_id, term""",
    "top10_words": f"""WITH {CLEAN},
t AS (SELECT doc_id, {alnum("title_abstract")} AS toks FROM clean),
u AS (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM t),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS fp FROM u GROUP BY doc_id, term),
l AS (SELECT doc_id, list(struct_pack(term := term, n := n) ORDER BY n DESC, fp) AS lst
      FROM c GROUP BY doc_id),
j AS (SELECT clean.doc_id, clean.title, l.lst FROM clean LEFT JOIN l ON clean.doc_id = l.doc_id)
SELECT doc_id AS DocIndex, title AS Title, {_top10_cols()} FROM j""",
    "word_counts": f"""WITH {CLEAN},
t AS (SELECT doc_id, title, {prefilter("title_abstract")} AS pre FROM clean),
per AS (SELECT doc_id AS DocIndex, title AS Title, CAST(len(pre) AS BIGINT) AS Words_Before,
               CAST(len(list_filter(pre, lambda x: NOT list_contains({STOP_LIST}, x))) AS BIGINT)
                 AS Words_After FROM t),
tot AS (SELECT CAST(coalesce(sum(Words_Before), 0) AS BIGINT) AS b,
               CAST(coalesce(sum(Words_After), 0) AS BIGINT) AS a FROM per)
SELECT DocIndex, Title, Words_Before, Words_After, {_pct("Words_Before", "Words_After")} AS Pct_Removed
FROM per
UNION ALL
SELECT CAST(NULL AS BIGINT), '__TOTAL__', b, a, {_pct("b", "a")} FROM tot""",
}

_AUDIT = f"""a0 AS (SELECT doc_id, title, {strip(f"array_to_string({alnum('title')}, ' ') || ' ' || array_to_string({alnum('abstract')}, ' ')")} AS tac FROM clean),
a1 AS (SELECT doc_id, title, list_filter(regexp_split_to_array(tac, '{WS}+'), lambda x: x <> '') AS pieces FROM a0),
audit AS (SELECT doc_id AS DocIndex, title AS Title, CAST(len(pieces) AS BIGINT) AS Words_in_Clean_Input,
          CAST(coalesce(list_sum(list_transform(pieces, lambda p: CAST(ceil(length(p) / 4) AS BIGINT))), 0) + 2 AS BIGINT)
            AS Tokens_in_Clean_Input FROM a1)"""

ORACLE.update({
    "token_audit": f"""WITH {CLEAN}, {_AUDIT}
SELECT *, Tokens_in_Clean_Input > 384 AS Exceeds_384, Tokens_in_Clean_Input > 512 AS Exceeds_512 FROM audit""",
    "token_distribution": f"""WITH {CLEAN}, {_AUDIT}
SELECT count(*) AS n_docs, min(Tokens_in_Clean_Input) AS min_tokens,
       round(quantile_cont(Tokens_in_Clean_Input, 0.5), 6) AS median_tokens,
       max(Tokens_in_Clean_Input) AS max_tokens, round(avg(Words_in_Clean_Input), 6) AS mean_words,
       round(avg(CAST(Tokens_in_Clean_Input > 384 AS DOUBLE)), 6) AS share_over_384,
       round(avg(CAST(Tokens_in_Clean_Input > 512 AS DOUBLE)), 6) AS share_over_512 FROM audit""",
    "coherence_tokens": f"""WITH {CLEAN},
t AS (SELECT doc_id, {coherence("abstract")} AS toks FROM clean)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t""",
})


# --- topics ---------------------------------------------------------------------------
def _r(e: str) -> str:
    return f"round({e}, 6)"


TOPIC = LABELS + f""",
t_sizes AS (SELECT min_cluster_size, cluster, count(*) AS n FROM labels_cs WHERE cluster <> -1 GROUP BY ALL),
t_ids AS (SELECT min_cluster_size, cluster,
                 CAST(row_number() OVER (PARTITION BY min_cluster_size ORDER BY n DESC, cluster) - 1 AS INTEGER) AS topic
          FROM t_sizes),
assign AS (SELECT l.min_cluster_size, l.doc_id, l.cluster, CAST(coalesce(t_ids.topic, -1) AS INTEGER) AS topic
           FROM labels_cs l LEFT JOIN t_ids USING (min_cluster_size, cluster)),
dtf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({alnum("title_abstract")}) AS term FROM clean)
        GROUP BY ALL),
tf AS (SELECT a.min_cluster_size, a.topic, d.term, CAST(sum(d.n) AS BIGINT) AS tf
       FROM dtf d JOIN assign a USING (doc_id) GROUP BY ALL),
fq AS (SELECT min_cluster_size, term, sum(tf) AS f FROM tf GROUP BY ALL),
aa AS (SELECT min_cluster_size, sum(tf) / count(DISTINCT topic) AS A FROM tf GROUP BY ALL),
ct AS (SELECT tf.min_cluster_size, topic, term, tf, tf * ln(1 + A / f) AS weight
       FROM tf JOIN fq USING (min_cluster_size, term) JOIN aa USING (min_cluster_size)),
words AS (SELECT * FROM (SELECT min_cluster_size, topic,
                 CAST(row_number() OVER (PARTITION BY min_cluster_size, topic ORDER BY weight DESC, term) AS INTEGER) AS rank,
                 term, weight AS score FROM ct) WHERE rank <= 10),
nm AS (SELECT min_cluster_size, topic, string_agg(term, '_' ORDER BY rank) AS nm FROM words WHERE rank <= 4 GROUP BY ALL),
rep AS (SELECT min_cluster_size, topic, string_agg(term, ' ' ORDER BY rank) AS representation FROM words GROUP BY ALL),
freq AS (SELECT min_cluster_size, topic, count(*) AS count FROM assign GROUP BY ALL),
info AS (SELECT freq.min_cluster_size, freq.topic, count, concat_ws('_', CAST(freq.topic AS VARCHAR), nm) AS name,
                coalesce(representation, '') AS representation
         FROM freq LEFT JOIN nm USING (min_cluster_size, topic) LEFT JOIN rep USING (min_cluster_size, topic)),
lbl AS (SELECT min_cluster_size, topic, string_agg(term, ' ' ORDER BY rank) AS label FROM words WHERE rank <= 3 GROUP BY ALL),
idf AS (SELECT min_cluster_size, topic, term, weight, weight / tf AS idf FROM ct),
tnorm AS (SELECT min_cluster_size, topic, sqrt(sum(weight * weight)) AS tn FROM ct GROUP BY ALL),
dper AS (SELECT a.min_cluster_size, a.topic, d.doc_id, sum(d.n * idf.idf * idf.weight) AS dot,
                sqrt(sum((d.n * idf.idf) * (d.n * idf.idf))) AS dn
         FROM dtf d JOIN assign a USING (doc_id) JOIN idf ON idf.min_cluster_size = a.min_cluster_size
              AND idf.topic = a.topic AND idf.term = d.term GROUP BY ALL),
reps AS (SELECT * FROM (SELECT dper.min_cluster_size, dper.topic, dper.doc_id, dot / (dn * tn) AS similarity,
                CAST(row_number() OVER (PARTITION BY dper.min_cluster_size, dper.topic
                     ORDER BY round(dot / (dn * tn), 9) DESC, dper.doc_id) AS INTEGER) AS rank
                FROM dper JOIN tnorm USING (min_cluster_size, topic)) WHERE rank <= 3)"""

PROMPT_SQL = "'" + __import__("docsift.operators.topics", fromlist=["x"]).PROMPT_TEMPLATE.replace("'", "''") + "'"

ORACLE.update({
    "topic_ids": f"WITH {TOPIC} SELECT min_cluster_size, doc_id, cluster, topic FROM assign",
    "ctfidf": f"WITH {TOPIC} SELECT min_cluster_size, topic, term, tf, {_r('weight')} AS weight FROM ct",
    "topic_words": f"WITH {TOPIC} SELECT min_cluster_size, topic, rank, term, {_r('score')} AS score FROM words",
    "topic_info": f"WITH {TOPIC} SELECT * FROM info",
    "topic_freq": f"WITH {TOPIC} SELECT * FROM freq",
    "doc_assignments": f"""WITH {TOPIC}
SELECT a.min_cluster_size, a.doc_id, c.title, a.topic FROM assign a JOIN clean c USING (doc_id)""",
    "titles_report": f"""WITH {TOPIC}
SELECT a.min_cluster_size, a.topic, 1 AS part, a.doc_id, '- ' || c.title AS line FROM assign a JOIN clean c USING (doc_id)
UNION ALL SELECT DISTINCT min_cluster_size, topic, 0, CAST(-1 AS BIGINT), 'Topic ' || CAST(topic AS VARCHAR) || ':' FROM assign
UNION ALL SELECT DISTINCT min_cluster_size, topic, 2, CAST(-1 AS BIGINT), '' FROM assign""",
    "representative_docs": f"""WITH {TOPIC}
SELECT min_cluster_size, topic, rank, doc_id, {_r('similarity')} AS similarity FROM reps""",
    "topic_diff": f"""WITH {TOPIC},
dtf2 AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({coherence("title_abstract")}) AS term FROM clean) GROUP BY ALL),
tf2 AS (SELECT a.min_cluster_size, a.topic, d.term, CAST(sum(d.n) AS BIGINT) AS tf FROM dtf2 d JOIN assign a USING (doc_id) GROUP BY ALL),
fq2 AS (SELECT min_cluster_size, term, sum(tf) AS f FROM tf2 GROUP BY ALL),
aa2 AS (SELECT min_cluster_size, sum(tf) / count(DISTINCT topic) AS A FROM tf2 GROUP BY ALL),
ct2 AS (SELECT tf2.min_cluster_size, topic, term, tf * ln(1 + A / f) AS weight FROM tf2 JOIN fq2 USING (min_cluster_size, term) JOIN aa2 USING (min_cluster_size)),
w2 AS (SELECT * FROM (SELECT min_cluster_size, topic, row_number() OVER (PARTITION BY min_cluster_size, topic ORDER BY weight DESC, term) AS rank, term FROM ct2) WHERE rank <= 5),
o1 AS (SELECT min_cluster_size, topic, string_agg(term, ' | ' ORDER BY rank) AS original FROM words WHERE rank <= 5 GROUP BY ALL),
o2 AS (SELECT min_cluster_size, topic, string_agg(term, ' | ' ORDER BY rank) AS updated FROM w2 GROUP BY ALL)
SELECT min_cluster_size, topic, coalesce(original, '') AS original, coalesce(updated, '') AS updated
FROM o1 FULL OUTER JOIN o2 USING (min_cluster_size, topic) WHERE topic <> -1""",
    "label_prompt": f"""WITH {TOPIC},
kw AS (SELECT min_cluster_size, topic, string_agg(term, ', ' ORDER BY rank) AS kw FROM words GROUP BY ALL),
dd AS (SELECT r.min_cluster_size, r.topic, string_agg('- ' || c.title, chr(10) ORDER BY r.rank) AS docs
       FROM reps r JOIN clean c USING (doc_id) GROUP BY ALL)
SELECT kw.min_cluster_size, kw.topic,
       replace(replace({PROMPT_SQL}, '[DOCUMENTS]', coalesce(dd.docs, '')), '[KEYWORDS]', kw.kw) AS prompt
FROM kw LEFT JOIN dd USING (min_cluster_size, topic)""",
    "topic_labels": f"WITH {TOPIC} SELECT * FROM lbl",
    "label_changes": f"""WITH {TOPIC}
SELECT i.min_cluster_size, i.topic, i.name AS old_label, coalesce(l.label, '') AS new_label
FROM info i LEFT JOIN lbl l USING (min_cluster_size, topic) WHERE i.name <> coalesce(l.label, '')""",
    "topics_to_show": f"""WITH {TOPIC}
SELECT min_cluster_size, topic FROM (SELECT min_cluster_size, topic,
       row_number() OVER (PARTITION BY min_cluster_size ORDER BY topic) AS r
       FROM (SELECT DISTINCT min_cluster_size, topic FROM assign WHERE topic <> -1)) WHERE r <= 17""",
    "barchart_data": f"""WITH {TOPIC}
SELECT min_cluster_size, topic, rank, term, {_r('score')} AS score FROM words
WHERE topic >= 0 AND topic < 8 AND rank <= 5""",
    "topic_similarity": f"""WITH {TOPIC},
nrm AS (SELECT min_cluster_size, topic, sqrt(sum(weight * weight)) AS n FROM ct GROUP BY ALL),
dt AS (SELECT a.min_cluster_size, a.topic AS topic_a, b.topic AS topic_b, sum(a.weight * b.weight) AS dot
       FROM ct a JOIN ct b ON a.min_cluster_size = b.min_cluster_size AND a.term = b.term GROUP BY ALL)
SELECT na.min_cluster_size, na.topic AS topic_a, nb.topic AS topic_b, {_r('coalesce(dot, 0.0) / (na.n * nb.n)')} AS similarity
FROM nrm na JOIN nrm nb ON na.min_cluster_size = nb.min_cluster_size
     LEFT JOIN dt ON dt.min_cluster_size = na.min_cluster_size AND dt.topic_a = na.topic AND dt.topic_b = nb.topic""",
    "heatmap_k": f"""WITH {TOPIC},
nt AS (SELECT min_cluster_size, count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS n_topics FROM assign GROUP BY ALL)
SELECT min_cluster_size, n_topics,
       CAST(CASE WHEN n_topics > 1 THEN greatest(1, least(15, n_topics - 1)) END AS INTEGER) AS n_groups FROM nt""",
})

# --- coherence ------------------------------------------------------------------------
COH = TOPIC + f""",
ctoks AS (SELECT doc_id, {coherence("abstract")} AS toks FROM clean),
lists AS (SELECT min_cluster_size, topic, rank, term FROM (
            SELECT *, count(*) OVER (PARTITION BY min_cluster_size, topic) AS c FROM words
            WHERE topic <> -1 AND rank <= 10) WHERE c >= 2),
vocab AS (SELECT DISTINCT min_cluster_size, term FROM lists),
dv AS (SELECT v.min_cluster_size, t.doc_id, t.term
       FROM (SELECT doc_id, unnest(list_distinct(toks)) AS term FROM ctoks) t JOIN vocab v USING (term)),
wdf AS (SELECT min_cluster_size, term, count(*) AS df FROM dv GROUP BY ALL),
tp AS (SELECT a.min_cluster_size, a.topic, a.rank AS rank_i, a.term AS term_i, b.rank AS rank_j, b.term AS term_j
       FROM lists a JOIN lists b ON a.min_cluster_size = b.min_cluster_size AND a.topic = b.topic AND a.rank > b.rank),
prs AS (SELECT DISTINCT min_cluster_size, least(term_i, term_j) AS a, greatest(term_i, term_j) AS b FROM tp
        WHERE term_i <> term_j),
pdf AS (SELECT p.min_cluster_size, p.a, p.b, count(*) AS df_ab FROM prs p
        JOIN dv da ON da.min_cluster_size = p.min_cluster_size AND da.term = p.a
        JOIN dv db ON db.min_cluster_size = p.min_cluster_size AND db.doc_id = da.doc_id AND db.term = p.b
        GROUP BY ALL),
nd AS (SELECT count(*) AS N FROM ctoks),
st AS (SELECT tp.*, coalesce(pdf.df_ab, 0) AS df_ab, coalesce(wi.df, 0) AS df_i, coalesce(wj.df, 0) AS df_j, nd.N
       FROM tp LEFT JOIN pdf ON pdf.min_cluster_size = tp.min_cluster_size AND pdf.a = least(term_i, term_j)
                            AND pdf.b = greatest(term_i, term_j)
       LEFT JOIN wdf wi ON wi.min_cluster_size = tp.min_cluster_size AND wi.term = term_i
       LEFT JOIN wdf wj ON wj.min_cluster_size = tp.min_cluster_size AND wj.term = term_j, nd),
pt AS (SELECT min_cluster_size, topic,
              avg(CASE WHEN df_ab = 0 OR df_i = 0 OR df_j = 0 THEN -1.0 WHEN df_ab = N THEN 1.0
                       ELSE ln((df_ab / N) / ((df_i / N) * (df_j / N))) / (-ln(df_ab / N)) END) AS npmi,
              avg(CASE WHEN df_j > 0 THEN ln((df_ab + 1.0) / df_j) END) AS umass
       FROM st GROUP BY ALL)"""

ORACLE.update({
    "word_df": f"WITH {COH} SELECT * FROM wdf",
    "pair_df": f"WITH {COH} SELECT * FROM pdf",
    "npmi": f"WITH {COH} SELECT min_cluster_size, topic, {_r('npmi')} AS npmi FROM pt",
    "umass": f"WITH {COH} SELECT min_cluster_size, topic, {_r('umass')} AS umass FROM pt",
    "coherence_summary": f"""WITH {COH},
s AS (SELECT DISTINCT min_cluster_size FROM assign),
g AS (SELECT min_cluster_size, avg(npmi) AS cn, avg(umass) AS cu, count(*) AS n FROM pt GROUP BY ALL)
SELECT s.min_cluster_size, {_r('cn')} AS coherence_npmi, {_r('cu')} AS coherence_umass,
       coalesce(n, 0) AS n_topics_evaluated FROM s LEFT JOIN g USING (min_cluster_size)""",
})

# --- quality --------------------------------------------------------------------------
ORACLE.update({
    "size_metrics": f"""WITH {LABELS},
base AS (SELECT min_cluster_size, count(*) AS N_docs, avg(CAST(cluster <> -1 AS DOUBLE)) AS coverage
         FROM labels_cs GROUP BY ALL),
sz AS (SELECT min_cluster_size, cluster, count(*) AS n FROM labels_cs WHERE cluster <> -1 GROUP BY ALL),
szr AS (SELECT *, row_number() OVER (PARTITION BY min_cluster_size ORDER BY n, cluster) AS i,
               count(*) OVER (PARTITION BY min_cluster_size) AS k,
               sum(n) OVER (PARTITION BY min_cluster_size) AS tot FROM sz),
ag AS (SELECT min_cluster_size, count(*) AS n_clusters, max(n) AS max_cluster_size,
              sum((2 * i - k - 1) * n) / (any_value(k) * any_value(tot)) AS gini_sizes,
              -sum(n / tot * ln(n / tot)) + 0.0 AS entropy_sizes,
              stddev_samp(n) / avg(n) AS cv_sizes FROM szr GROUP BY ALL)
SELECT base.min_cluster_size, N_docs, {_r('coverage')} AS coverage,
       CAST(coalesce(n_clusters, 0) AS BIGINT) AS n_clusters,
       CAST(coalesce(max_cluster_size, 0) AS BIGINT) AS max_cluster_size,
       {_r('gini_sizes')} AS gini_sizes, {_r('entropy_sizes')} AS entropy_sizes,
       {_r('CASE WHEN n_clusters > 1 THEN entropy_sizes / ln(n_clusters) WHEN n_clusters IS NOT NULL THEN 0.0 END')}
         AS entropy_sizes_normalized,
       {_r('cv_sizes')} AS cv_sizes
FROM base LEFT JOIN ag USING (min_cluster_size)""",
    "silhouette_cosine": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE label <> -1),
ok AS (SELECT label FROM e GROUP BY label HAVING count(*) >= 2),
e2 AS (SELECT * FROM e WHERE label IN (SELECT label FROM ok) AND list_dot_product(v, v) > 0),
pr AS (SELECT a.vec_id, a.label AS la, b.label AS lb, 1 - list_cosine_similarity(a.v, b.v) AS d
       FROM e2 a JOIN e2 b ON a.vec_id <> b.vec_id),
per AS (SELECT vec_id, la, lb, avg(d) AS md FROM pr GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM per GROUP BY vec_id)
SELECT {_r('CASE WHEN (SELECT count(DISTINCT label) FROM e2) >= 2 AND (SELECT count(*) FROM e2) > 10 THEN avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) END')} AS silhouette_cosine FROM ab""",
    "davies_bouldin": f"""WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS dim
           FROM embeddings WHERE label <> -1),
cen AS (SELECT label, dim, avg(v) AS mu FROM x GROUP BY ALL),
dist AS (SELECT x.vec_id, x.label, sqrt(sum((v - mu) * (v - mu))) AS d FROM x JOIN cen USING (label, dim) GROUP BY ALL),
sc AS (SELECT label, avg(d) AS s FROM dist GROUP BY ALL),
cd AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS d
       FROM cen a JOIN cen b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL),
r AS (SELECT la, max(CASE WHEN cd.d > 0 THEN (s1.s + s2.s) / cd.d ELSE 0.0 END) AS r
      FROM cd JOIN sc s1 ON s1.label = la JOIN sc s2 ON s2.label = lb GROUP BY la)
SELECT {_r('CASE WHEN (SELECT count(*) FROM sc) < 2 THEN NULL WHEN (SELECT max(s) FROM sc) = 0 THEN 0.0 ELSE avg(r) END')} AS davies_bouldin FROM r""",
    "calinski_harabasz": f"""WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS dim
           FROM embeddings WHERE label <> -1),
cn AS (SELECT label, count(*) AS n FROM embeddings WHERE label <> -1 GROUP BY ALL),
cen AS (SELECT label, dim, avg(v) AS mu FROM x GROUP BY ALL),
gm AS (SELECT dim, avg(v) AS g FROM x GROUP BY ALL),
bb AS (SELECT sum(cn.n * (mu - g) * (mu - g)) AS B FROM cen JOIN gm USING (dim) JOIN cn USING (label)),
ww AS (SELECT sum((v - mu) * (v - mu)) AS W FROM x JOIN cen USING (label, dim)),
kk AS (SELECT count(*) AS k, sum(n) AS n FROM cn)
SELECT {_r('CASE WHEN k < 2 THEN NULL WHEN W = 0 THEN 1.0 ELSE (B / (k - 1)) / (W / (n - k)) END')} AS calinski_harabasz
FROM bb, ww, kk""",
    "ari_vi_adjacent": f"""WITH {LABELS},
settings AS (SELECT DISTINCT min_cluster_size AS cs FROM labels_cs),
pr AS (SELECT cs AS cs_a, lead(cs) OVER (ORDER BY cs) AS cs_b FROM settings),
pairs AS (SELECT * FROM pr WHERE cs_b IS NOT NULL),
common AS (SELECT p.cs_a, p.cs_b, a.cluster AS la, b.cluster AS lb FROM pairs p
           JOIN labels_cs a ON a.min_cluster_size = p.cs_a AND a.cluster <> -1
           JOIN labels_cs b ON b.min_cluster_size = p.cs_b AND b.doc_id = a.doc_id AND b.cluster <> -1),
cont AS (SELECT cs_a, cs_b, la, lb, CAST(count(*) AS DOUBLE) AS nij FROM common GROUP BY ALL),
ra AS (SELECT cs_a, cs_b, la, sum(nij) AS ai FROM cont GROUP BY ALL),
rb AS (SELECT cs_a, cs_b, lb, sum(nij) AS bj FROM cont GROUP BY ALL),
nn AS (SELECT cs_a, cs_b, sum(nij) AS n, sum(nij * nij) AS sq FROM cont GROUP BY ALL),
sa AS (SELECT cs_a, cs_b, sum(ai * ai) AS sa FROM ra GROUP BY ALL),
sb AS (SELECT cs_a, cs_b, sum(bj * bj) AS sb FROM rb GROUP BY ALL),
mi AS (SELECT c.cs_a, c.cs_b, sum(nij / n * ln(n * nij / (ai * bj))) AS I FROM cont c
       JOIN ra USING (cs_a, cs_b, la) JOIN rb USING (cs_a, cs_b, lb) JOIN nn USING (cs_a, cs_b) GROUP BY ALL),
ha AS (SELECT ra.cs_a, ra.cs_b, sum(-(ai / n) * ln(ai / n)) AS Ha FROM ra JOIN nn USING (cs_a, cs_b) GROUP BY ALL),
hb AS (SELECT rb.cs_a, rb.cs_b, sum(-(bj / n) * ln(bj / n)) AS Hb FROM rb JOIN nn USING (cs_a, cs_b) GROUP BY ALL),
st AS (SELECT * FROM nn JOIN sa USING (cs_a, cs_b) JOIN sb USING (cs_a, cs_b) JOIN mi USING (cs_a, cs_b)
       JOIN ha USING (cs_a, cs_b) JOIN hb USING (cs_a, cs_b)),
f AS (SELECT *, sq - n AS tp, sb - sq AS fp, sa - sq AS fn, n * n - (sb - sq) - (sa - sq) - sq AS tn FROM st)
SELECT p.cs_a, p.cs_b,
       {_r('CASE WHEN coalesce(n, 0) >= 5 THEN CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END END')} AS ARI,
       {_r('CASE WHEN coalesce(n, 0) >= 5 THEN Ha + Hb - 2 * I END')} AS VI,
       CAST(coalesce(n, 0) AS BIGINT) AS n_common
FROM pairs p LEFT JOIN f USING (cs_a, cs_b)""",
})

RUNS = CLEAN + """,
runs AS (SELECT c.doc_id, CAST(r.run AS INTEGER) AS run, c.lang, c.source FROM clean c, range(8) r(run)
         WHERE CAST('0x' || substr(md5(CAST(c.doc_id AS VARCHAR) || '|' || CAST(r.run AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 900),
rgrp AS (SELECT run, doc_id, s.cs,
                CASE WHEN s.cs <= 10 THEN lang || '/' || source WHEN s.cs = 20 THEN source ELSE lang END AS g
         FROM runs, (VALUES (5), (10), (20), (30)) s(cs)),
rn AS (SELECT run, cs, g, count(*) AS n FROM rgrp GROUP BY ALL),
rid AS (SELECT run, cs, g, dense_rank() OVER (PARTITION BY run, cs ORDER BY g) - 1 AS gid FROM rn WHERE n >= cs),
rl AS (SELECT rgrp.run, rgrp.cs, rgrp.doc_id, coalesce(rid.gid, -1) AS cl FROM rgrp LEFT JOIN rid USING (run, cs, g)),
rsz AS (SELECT run, cs, cl, count(*) AS n FROM rl WHERE cl <> -1 GROUP BY ALL),
rl2 AS (SELECT rl.run, rl.cs, rl.doc_id, CASE WHEN coalesce(rsz.n, 0) >= 2 THEN rl.cl ELSE -1 END AS cl
        FROM rl LEFT JOIN rsz USING (run, cs, cl)),
pp AS (SELECT a.cs, a.doc_id AS i, b.doc_id AS j, sum(CASE WHEN a.cl <> -1 AND a.cl = b.cl THEN 1 ELSE 0 END) AS co,
              count(*) AS pres
       FROM rl2 a JOIN rl2 b ON a.run = b.run AND a.cs = b.cs AND a.doc_id < b.doc_id GROUP BY ALL),
mm AS (SELECT cs, count(DISTINCT doc_id) AS M FROM rl2 GROUP BY ALL),
hist AS (SELECT cs, CAST(co AS INTEGER) AS co_runs, CAST(pres AS INTEGER) AS present_runs, count(*) AS n_pairs
         FROM pp GROUP BY ALL
         UNION ALL
         SELECT mm.cs, 0, 0, CAST(M * (M - 1) / 2 - coalesce((SELECT count(*) FROM pp WHERE pp.cs = mm.cs), 0) AS BIGINT)
         FROM mm),
diag AS (SELECT cs, doc_id, count(*) AS pres, sum(CASE WHEN cl <> -1 THEN 1 ELSE 0 END) AS co FROM rl2 GROUP BY ALL)"""

ORACLE.update({
    "consensus_pairs": f"""WITH {RUNS}
SELECT CAST(cs AS INTEGER) AS min_cluster_size, co_runs, present_runs, CAST(n_pairs AS BIGINT) AS n_pairs
FROM hist WHERE n_pairs > 0""",
    "pac": f"""WITH {RUNS},
hs AS (SELECT cs, sum(CASE WHEN present_runs > 0 THEN n_pairs END) AS copres,
              sum(CASE WHEN present_runs > 0 AND co_runs / present_runs > 0.1 AND co_runs / present_runs < 0.9 THEN n_pairs ELSE 0 END) AS amb,
              sum(CASE WHEN present_runs > 0 AND co_runs / (co_runs + present_runs) > 0.1
                        AND co_runs / (co_runs + present_runs) < 0.9 THEN n_pairs ELSE 0 END) AS amb_c
       FROM hist GROUP BY ALL),
ds AS (SELECT cs, count(*) AS M, sum(CASE WHEN co / (co + pres) > 0.1 AND co / (co + pres) < 0.9 THEN 1 ELSE 0 END) AS amb_d
       FROM diag GROUP BY ALL)
SELECT CAST(ds.cs AS INTEGER) AS min_cluster_size, {_r('amb / copres')} AS pac,
       {_r('(2 * coalesce(amb_c, 0) + amb_d) / (M * M)')} AS pac_compat, CAST(M AS BIGINT) AS N_used
FROM ds LEFT JOIN hs USING (cs)""",
})


# --- vectors --------------------------------------------------------------------------
_EMB = "SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
_KNN = f"""e AS ({_EMB}),
pr AS (SELECT a.doc_id, b.doc_id AS nbr, greatest(least(1 - list_cosine_similarity(a.v, b.v), 2.0), 0.0) AS dist
       FROM e a JOIN e b ON a.doc_id <> b.doc_id),
knn AS (SELECT * FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(dist, 9), nbr) AS INTEGER) AS rank,
        nbr, dist FROM pr) WHERE rank <= 10)"""


def _wide(n: int) -> str:
    return ", ".join(f"round(v[{i + 1}], 6) AS d{i}" for i in range(n))


ORACLE.update({
    "l2_normalise": f"""WITH e AS ({_EMB}),
n AS (SELECT doc_id, v, sqrt(list_dot_product(v, v)) AS nr FROM e),
u AS (SELECT doc_id, unnest(v) AS x, unnest(range(len(v))) AS dim, nr FROM n)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN nr > 0 THEN x / nr ELSE 0.0 END, 6) AS value FROM u""",
    "melt_embedding": f"""WITH e AS ({_EMB}),
u AS (SELECT doc_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM e)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS value FROM u""",
    "embedding_meta": f"""WITH e AS ({_EMB}),
a AS (SELECT count(*) AS n, max(len(v)) AS d, avg(CAST(abs(sqrt(list_dot_product(v, v)) - 1) < 1e-3 AS DOUBLE)) AS u FROM e)
SELECT 'model' AS key, 'given' AS value UNION ALL SELECT 'input', 'embeddings'
UNION ALL SELECT 'n_docs', CAST(n AS VARCHAR) FROM a UNION ALL SELECT 'dim', CAST(d AS VARCHAR) FROM a
UNION ALL SELECT 'unit_share', CAST(round(u, 6) AS VARCHAR) FROM a""",
    "scatter_split": f"""WITH e AS ({_EMB})
SELECT doc_id, round(v[1], 6) AS x, round(v[2], 6) AS y, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster,
       label = 9 AS is_noise FROM e""",
    "knn_exact": f"WITH {_KNN} SELECT doc_id, rank, nbr, round(dist, 6) AS dist FROM knn",
    "core_distance": f"WITH {_KNN} SELECT doc_id, round(max(dist), 6) AS core FROM knn WHERE rank <= 4 GROUP BY doc_id",
    "mutual_reach": f"""WITH {_KNN},
core AS (SELECT doc_id, max(dist) AS core FROM knn WHERE rank <= 4 GROUP BY doc_id),
ed AS (SELECT least(doc_id, nbr) AS lo, greatest(doc_id, nbr) AS hi, min(dist) AS d FROM knn WHERE rank <= 4 GROUP BY ALL)
SELECT lo, hi, round(d, 6) AS d, round(greatest(c1.core, c2.core, d), 6) AS w
FROM ed JOIN core c1 ON c1.doc_id = lo JOIN core c2 ON c2.doc_id = hi""",
})


ORACLE["wide_embedding"] = f"SELECT doc_id, {_wide(64)} FROM ({_EMB})"
ORACLE["alignment_report"] = """SELECT coalesce(d.doc_id, e.vec_id) AS key,
       CASE WHEN e.vec_id IS NULL THEN 'doc_only' ELSE 'vector_only' END AS side
FROM documents d FULL OUTER JOIN embeddings e ON d.doc_id = e.vec_id
WHERE d.doc_id IS NULL OR e.vec_id IS NULL"""

ORACLE.update({
    "preview": f"WITH {TOPIC} SELECT * FROM info ORDER BY min_cluster_size, topic LIMIT 10",
    "numeric_labels": f"WITH {TOPIC} SELECT DISTINCT min_cluster_size, topic, CAST(topic AS VARCHAR) AS label FROM assign",
})
ORACLE["knn_ivf"] = ORACLE["knn_exact"]

#: Spanning tree of mutual reachability (Euclidean, m = 5) by adding the nearest point one at a time:
#: the state is one row (distances of all points to the tree; null once inside).
ORACLE["mst_edges"] = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM ({_EMB})),
d AS MATERIALIZED (SELECT a.i, b.i AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.i <> b.i),
core AS (SELECT i, max(d) AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d) WHERE r <= 4 GROUP BY i),
m AS MATERIALIZED (SELECT d.i, list(greatest(d, a.core, b.core) ORDER BY j) AS w FROM (SELECT * FROM d UNION ALL SELECT i, i, 0.0 FROM e) d
     JOIN core a ON a.i = d.i JOIN core b ON b.i = d.j GROUP BY d.i),
t AS (SELECT 1 AS step, list_transform(w, lambda x, k: CASE WHEN k = 1 THEN NULL ELSE x END) AS w, 0.0::DOUBLE AS total FROM m WHERE i = 1
      UNION ALL
      SELECT step + 1, list_transform(list_zip(t.w, m.w), lambda z, k: CASE WHEN k = m.i OR z[1] IS NULL THEN NULL ELSE least(z[1], z[2]) END),
             total + list_min(t.w)
      FROM t JOIN m ON m.i = list_position(t.w, list_min(t.w)) WHERE list_min(t.w) IS NOT NULL)
SELECT max(step) - 1 AS n_edges, round(max(total), 6) AS total_weight FROM t"""

#: Spanning tree of each setting's topics by adding the nearest topic one at a time (state as in `mst_edges`),
#: then the parts held by distances up to the k-th heaviest tree edge.
ORACLE["topic_hierarchy"] = f"""WITH RECURSIVE sim AS MATERIALIZED (SELECT min_cluster_size AS s, topic_a, topic_b, greatest(0.0, 1 - similarity) AS w
  FROM ({ORACLE["topic_similarity"].replace(_r('coalesce(dot, 0.0) / (na.n * nb.n)'), 'coalesce(dot, 0.0) / (na.n * nb.n)')}) WHERE topic_a <> -1 AND topic_b <> -1),
m AS MATERIALIZED (SELECT s, topic_a AS topic, row_number() OVER (PARTITION BY s ORDER BY topic_a) AS i, list(w ORDER BY topic_b) AS w FROM sim GROUP BY s, topic_a),
t AS (SELECT s, list_transform(w, lambda x, k: CASE WHEN k = 1 THEN NULL ELSE x END) AS w, NULL::DOUBLE AS e FROM m WHERE i = 1
      UNION ALL
      SELECT t.s, list_transform(list_zip(t.w, m.w), lambda z, k: CASE WHEN k = m.i OR z[1] IS NULL THEN NULL ELSE least(z[1], z[2]) END), list_min(t.w)
      FROM t JOIN m ON m.s = t.s AND m.i = list_position(t.w, list_min(t.w)) WHERE list_min(t.w) IS NOT NULL),
k AS (SELECT min_cluster_size AS s, coalesce(n_groups, 1) AS k FROM ({ORACLE["heatmap_k"]})),
x AS (SELECT s, e, row_number() OVER (PARTITION BY s ORDER BY e DESC) AS r FROM t WHERE e IS NOT NULL),
cut AS (SELECT k.s, coalesce(max(CASE WHEN r = k THEN e END), -1.0) AS lim FROM k LEFT JOIN x ON x.s = k.s GROUP BY k.s),
l AS (SELECT sim.s, topic_a, topic_b FROM sim JOIN cut ON cut.s = sim.s WHERE w <= lim + 1e-12 OR topic_a = topic_b),
r AS (SELECT s, topic, topic AS o FROM m UNION SELECT r.s, r.topic, l.topic_b FROM r JOIN l ON l.s = r.s AND l.topic_a = r.o),
f AS (SELECT s, topic, min(o) AS first FROM r GROUP BY s, topic)
SELECT s AS min_cluster_size, topic, CAST(dense_rank() OVER (PARTITION BY s ORDER BY first) - 1 AS INTEGER) AS "group" FROM f"""


#: DBCV by cluster (s, c): tree edges by adding the nearest point one at a time, with each point's nearest tree point.
_DBCV = """WITH RECURSIVE lab AS ({labels}),
pts AS MATERIALIZED (SELECT s, c, v, row_number() OVER (PARTITION BY s, c ORDER BY doc_id) AS i FROM lab WHERE c <> -1),
n AS (SELECT s, c, count(*) AS n FROM pts GROUP BY s, c),
d AS MATERIALIZED (SELECT a.s, a.c, a.i, b.i AS j, greatest(least(1 - list_cosine_similarity(a.v, b.v), 2.0), 0.0) AS d FROM pts a JOIN pts b ON a.s = b.s AND a.c = b.c),
x AS (SELECT s, c, i, -len(v) * ln(d) AS t FROM d JOIN pts USING (s, c, i) WHERE i <> j AND d > 1e-12),
y AS (SELECT s, c, i, m + ln(sum(exp(t - m))) AS lse FROM (SELECT *, max(t) OVER (PARTITION BY s, c, i) AS m FROM x) GROUP BY s, c, i, m),
core AS MATERIALIZED (SELECT s, c, i, v, coalesce(exp(-(lse - ln(n - 1)) / len(v)), 0.0) AS core FROM pts JOIN n USING (s, c) LEFT JOIN y USING (s, c, i)),
m AS MATERIALIZED (SELECT d.s, d.c, d.i, list(greatest(CASE WHEN d.i = d.j THEN 0.0 ELSE d END, a.core, b.core) ORDER BY d.j) AS w
  FROM d JOIN core a ON a.s = d.s AND a.c = d.c AND a.i = d.i JOIN core b ON b.s = d.s AND b.c = d.c AND b.i = d.j GROUP BY d.s, d.c, d.i),
t AS (SELECT s, c, list_transform(w, lambda x, k: CASE WHEN k = 1 THEN NULL ELSE {{'w': x, 'lo': 1::BIGINT, 'hi': k::BIGINT, 'at': k::BIGINT}} END) AS w,
      NULL::BIGINT AS u, NULL::BIGINT AS o, NULL::DOUBLE AS e FROM m WHERE i = 1
  UNION ALL
  SELECT t.s, t.c, list_transform(list_zip(t.w, m.w), lambda z, k: CASE WHEN k = m.i OR z[1] IS NULL THEN NULL ELSE
      least(z[1], {{'w': z[2], 'lo': least(k, m.i)::BIGINT, 'hi': greatest(k, m.i)::BIGINT, 'at': k::BIGINT}}) END), list_min(t.w).lo, list_min(t.w).hi, list_min(t.w).w
  FROM t JOIN m ON m.s = t.s AND m.c = t.c AND m.i = list_min(t.w).at WHERE list_min(t.w) IS NOT NULL),
tree AS MATERIALIZED (SELECT s, c, u, o, e FROM t WHERE e IS NOT NULL),
inn AS MATERIALIZED (SELECT s, c, i FROM (SELECT s, c, u AS i FROM tree UNION ALL SELECT s, c, o FROM tree) GROUP BY s, c, i HAVING count(*) > 1),
dsc AS (SELECT tree.s, tree.c, coalesce(max(CASE WHEN a.i IS NOT NULL AND b.i IS NOT NULL THEN e END), max(e)) AS dsc
  FROM tree LEFT JOIN inn a ON a.s = tree.s AND a.c = tree.c AND a.i = u LEFT JOIN inn b ON b.s = tree.s AND b.c = tree.c AND b.i = o GROUP BY tree.s, tree.c),
nodes AS (SELECT core.* FROM core LEFT JOIN inn USING (s, c, i) WHERE inn.i IS NOT NULL OR NOT EXISTS (SELECT 1 FROM inn q WHERE q.s = core.s AND q.c = core.c)),
sep AS (SELECT a.s, a.c, min(greatest(greatest(least(1 - list_cosine_similarity(a.v, b.v), 2.0), 0.0), a.core, b.core)) AS sep
  FROM nodes a JOIN nodes b ON a.s = b.s AND a.c <> b.c GROUP BY a.s, a.c),
g AS (SELECT s, sum(n * CASE WHEN greatest(sep, dsc) = 0 THEN 0.0 ELSE (sep - dsc) / greatest(sep, dsc) END) AS z FROM sep JOIN dsc USING (s, c) JOIN n USING (s, c) GROUP BY s)
SELECT lab.s, round(CASE WHEN count(DISTINCT CASE WHEN c <> -1 THEN c END) >= 2 THEN coalesce(any_value(z), 0.0) / count(*) END, 6) AS DBCV FROM lab LEFT JOIN g ON g.s = lab.s GROUP BY lab.s"""
_VECTOR_LABELS = " UNION ALL ".join(
    f"SELECT {m} AS s, vec_id AS doc_id, CASE WHEN label = -1 THEN -1 ELSE label % {k} END AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
    for m, k in VECTOR_GROUPS.items())
ORACLE["dbcv_sweep"] = ("SELECT s AS min_cluster_size, DBCV FROM (" + _DBCV.format(labels=_VECTOR_LABELS) + ")")
ORACLE["dbcv"] = ("SELECT DBCV FROM (" + _DBCV.format(
    labels="SELECT 0 AS s, vec_id AS doc_id, label AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings") + ")")


def _at_setting(m: int, k: int) -> str:
    rows = f"(SELECT vec_id, embedding, CASE WHEN label = -1 THEN -1 ELSE label % {k} END AS label FROM embeddings)"
    one = [f"({ORACLE[q].replace('FROM embeddings', f'FROM {rows}')})"
           for q in ("silhouette_cosine", "davies_bouldin", "calinski_harabasz")]
    return f"SELECT {m} AS min_cluster_size, * FROM {one[0]}, {one[1]}, {one[2]}"


ORACLE["separation_sweep"] = " UNION ALL ".join(_at_setting(m, k) for m, k in VECTOR_GROUPS.items())
_PARTS = ("size_metrics", "pac", "coherence_summary", "separation_sweep", "dbcv_sweep")
ORACLE["eval_summary"] = "WITH " + ", ".join(f"s_{q} AS ({ORACLE[q]})" for q in _PARTS) + (
    " SELECT * FROM s_size_metrics " + " ".join(f"LEFT JOIN s_{q} USING (min_cluster_size)" for q in _PARTS[1:]))

ORACLE["truncate_tokens"] = f"""WITH {CLEAN},
t AS (SELECT doc_id, list_filter(string_split_regex(title_abstract, '{WS}+'), lambda x: x <> '') AS t FROM clean)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(least(len(t), 512) AS BIGINT) AS n_kept,
       array_to_string(t[1:512], ' ') AS text FROM t"""
