"""Corpus operators (filters, null handling, views).  All `DataFrame -> DataFrame`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import collapse_ws, is_blank, join_text


def clean_corpus(df: DataFrame) -> DataFrame:
    """Drop null and blank abstracts, fill null titles with ''.

    Blank = empty after a Python-style strip (all Unicode whitespace), not
    only spaces.  Adds `title_abstract` = strip(title + ' ' + abstract).
    """
    out = (df.filter(F.col("abstract").isNotNull())
             .filter(~is_blank("abstract"))
             .withColumn("title", F.coalesce(F.col("title").cast("string"), F.lit("")))
             .withColumn("abstract", F.col("abstract").cast("string")))
    return out.withColumn("title_abstract", join_text("title", "abstract"))


def before_view(clean: DataFrame) -> DataFrame:
    """DocIndex, Title, Abstract, Title_Abstract of the cleaned corpus."""
    return clean.select(F.col("doc_id").alias("DocIndex"), F.col("title").alias("Title"),
                        F.col("abstract").alias("Abstract"),
                        join_text("title", "abstract").alias("Title_Abstract"))


def normalise_whitespace(df: DataFrame, cols=("title", "abstract")) -> DataFrame:
    """Collapse whitespace runs and strip (the promised, optional cleaning step)."""
    for c in cols:
        df = df.withColumn(c, collapse_ws(c))
    return df


def dedupe_exact(df: DataFrame, keys=("title", "abstract"), order: str = "doc_id") -> DataFrame:
    """Keep the first row (lowest `order`) of each exact (title, abstract) repeat.

    The first key per text is a `min` aggregate (combined map-side, so a text
    repeated in a third of all rows is reduced before the shuffle, never
    sorted in one task); rows are then kept by a semi join on that key.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def drop_noise(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.filter(F.col(label) != -1)


def only_noise(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.filter(F.col(label) == -1)


def drop_singletons(df: DataFrame, by=("cluster",)) -> DataFrame:
    """Keep rows whose group has at least two members.

    Counted by a partial aggregate and a join on the (small) size table, so
    a giant cluster never becomes one window partition.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    return df.join(sizes, list(by), "left_semi")


def nan_to_num(c, big: float = 3.4028234663852886e38):
    """NaN -> 0, +/-Inf -> +/- largest float, element-wise over an array column."""
    return F.transform(c, lambda x: F.when(F.isnan(x), F.lit(0.0))
                       .when(x == float("inf"), F.lit(big))
                       .when(x == float("-inf"), F.lit(-big)).otherwise(x))


def alignment_report(docs: DataFrame, vecs: DataFrame, doc_key: str = "doc_id",
                     vec_key: str = "vec_id") -> DataFrame:
    """Rows present on one side only (vectors vs documents), by key.

    Returns `(key, side)` with side in {'doc_only', 'vector_only'}; empty means
    aligned.  `check_aligned` raises if not empty.
    """
    d = docs.select(F.col(doc_key).alias("key")).withColumn("d", F.lit(True))
    v = vecs.select(F.col(vec_key).alias("key")).withColumn("v", F.lit(True))
    j = d.join(v, "key", "full_outer")
    return (j.filter(F.col("d").isNull() | F.col("v").isNull())
             .select("key", F.when(F.col("v").isNull(), F.lit("doc_only"))
                     .otherwise(F.lit("vector_only")).alias("side")))


def check_aligned(docs: DataFrame, vecs: DataFrame, **kw) -> None:
    bad = alignment_report(docs, vecs, **kw)
    sample = bad.limit(5).collect()
    if sample:
        raise ValueError(f"documents and vectors are not aligned, e.g. {sample}")
