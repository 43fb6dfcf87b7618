"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.alignment import tokenizer_alignment
from docsift.llm.decontam import contamination
from docsift.llm.importance import importance_resample
from docsift.llm.line_dedup import line_duplicates
from docsift.llm.ngram_join import ngram_components
from docsift.llm.oracles import url_verdicts_sql, vector_codes_sql
from docsift.llm.packing import pack
from docsift.llm.pii import PATTERNS, pseudonymise
from docsift.llm.quality_rules import quality_rules
from docsift.llm.substring_dedup import substring_dedup
from docsift.llm.suffix_dedup import suffix_dedup
from docsift.llm.tables import read
from docsift.llm.token_counts import edit_counts
from docsift.llm.url_templates import url_verdicts
from docsift.llm.vector_codes import vector_codes


#: Key of the registered query only; callers of `pseudonymise` bring their own.
PSEUDONYM_KEY = "docsift-example-key"
#: Fixed rules of the registered query; callers of `url_verdicts` bring their own.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(read(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "rule")


def op7_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts(read(spark, sf_dir, "documents"), tokenizer_path()).drop("text", "version", "bounds", "sums")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    # mean weights: by the sum, long documents with a few toxic passages outweigh them (figures in README)
    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), length=100.0)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents"), PSEUDONYM_KEY).select(
        "doc_id", "text", *(f"n_{kind}" for kind in PATTERNS))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                               tokenizer_path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_line_dedup, op3_ngram_jaccard_join, op4_best_fit_packing, op5_decontamination,
    op6_quality_rules, op7_edit_aware_counts, op8_importance_resampling, op9_pseudonyms, op10_substring_dedup,
    op11_tokenizer_alignment, op12_vector_codes, op13_url_filter)}

_JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

_BYTES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(len(x) // 2 - 199, 0))) AS s FROM d),
h AS (SELECT w.doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM w JOIN d USING (doc_id)),
r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000000) > 200 AS new FROM r),
i AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM g),
runs AS (SELECT doc_id, g, min(s) AS a, max(s) + 200 AS z FROM i GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs
         UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(len(x)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f, t) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_DECONTAM = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM ik, unnest(range(1, len(w) - k + 2)) AS t(i)),
ks AS (SELECT DISTINCT k FROM items),
hits AS (SELECT doc_id, i - 1 AS p0, k, win FROM (SELECT doc_id, i, ks.k, array_to_string(w[i:i + ks.k - 1], ' ') AS win FROM dw, ks, unnest(range(1, greatest(len(w) - ks.k + 2, 1))) AS t(i)) JOIN (SELECT DISTINCT k, win FROM items) USING (k, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(p0, p0 + k)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits JOIN items USING (k, win) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_WORDS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, greatest(len(w) - 48, 1))) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS m FROM h) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, p FROM r, unnest(range(i, i + 50)) AS t(p)),
kept AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)),
s AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE = {"op1_suffix_array_dedup": _BYTES, "op3_ngram_jaccard_join": _JACCARD, "op5_decontamination": _DECONTAM, "op10_substring_dedup": _WORDS,
          "op12_vector_codes": vector_codes_sql(), "op13_url_filter": url_verdicts_sql(URL_RULES)}
