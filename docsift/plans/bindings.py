"""Bindings of the driver's tables to the engine's inputs.

* corpus      : `documents` -> (doc_id, title, abstract, lang, source)
* labels      : per-setting document labels derived from the documents'
                classes, a SQL-checkable stand-in for density labels
* topics      : `lang` / `source` as the document's topic class
* bootstrap   : integer-hash inclusion rule per run, identical in any engine
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.operators.corpus import clean_corpus
from docsift.session import cut_lineage
from docsift.sources.corpus import documents_corpus, read_table

SETTINGS = (5, 10, 20, 30)


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_corpus(documents_corpus(spark, sf_dir))


def labels_by_setting(clean: DataFrame, settings=SETTINGS, extra=()) -> DataFrame:
    """(doc_id, min_cluster_size, cluster): class groups, -1 below the setting.

    group = (lang, source) for settings <= 10, source for 20, lang above; a
    group with fewer members than the setting is noise; ids = dense rank of
    the group name within the setting.  The group table is small (one row per
    class and setting), the document side is never shuffled by a window.
    """
    extra = list(extra)
    # the classes are read several times: written once, so that texts are filtered once
    clean = cut_lineage(clean.select(*extra, "doc_id", "lang", "source"))
    grp = (clean.select(*extra, "doc_id", "lang", "source",
                        F.explode(F.array(*[F.lit(int(s)) for s in settings])).alias("min_cluster_size"))
           .select(*extra, "doc_id", "min_cluster_size",
                   F.when(F.col("min_cluster_size") <= 10, F.concat_ws("/", "lang", "source"))
                   .when(F.col("min_cluster_size") == 20, F.col("source"))
                   .otherwise(F.col("lang")).alias("g")))
    sizes = grp.groupBy(*extra, "min_cluster_size", "g").agg(F.count(F.lit(1)).alias("n"))
    ids = (sizes.filter(F.col("n") >= F.col("min_cluster_size"))
           .withColumn("gid", (F.dense_rank().over(
               Window.partitionBy(*extra, "min_cluster_size").orderBy("g")) - 1).cast("int"))
           .select(*extra, "min_cluster_size", "g", "gid"))
    # ids: one row per class and setting; AQE broadcasts it when its measured size is small
    return (grp.join(ids, extra + ["min_cluster_size", "g"], "left")
            .select(*extra, "doc_id", F.col("min_cluster_size").cast("int"),
                    F.coalesce("gid", F.lit(-1)).cast("int").alias("cluster")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def bootstrap_labels(clean: DataFrame, runs: int = 8, settings=SETTINGS) -> DataFrame:
    """(run, doc_id, min_cluster_size, cluster): labels re-derived on each run's draw."""
    from docsift.operators.quality import bootstrap_members
    clean = cut_lineage(clean.select("doc_id", "lang", "source"))
    members = bootstrap_members(clean, runs)
    drawn = members.join(clean.hint("merge"), "doc_id")     # its file is small, its rows are not: never broadcast
    return labels_by_setting(drawn, settings, extra=["run"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as (doc_id, vec) and its labels as (doc_id, cluster)."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"),
        F.col("label").cast("int").alias("cluster"))


#: Per setting, labels of the vectors are merged to label % groups: coarser clusters for larger settings.
VECTOR_GROUPS = {5: 10, 10: 7, 20: 4, 30: 2}


def vector_labels_by_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, min_cluster_size, cluster) of all vectors at all settings; -1 stays noise."""
    pairs = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in VECTOR_GROUPS.items()))
    return vectors(spark, sf_dir).select("doc_id", "cluster", F.explode(pairs).alias("x")).select(
        "doc_id", F.col("x.m").alias("min_cluster_size"),
        F.when(F.col("cluster") == -1, -1).otherwise(F.col("cluster") % F.col("x.k")).alias("cluster"))
