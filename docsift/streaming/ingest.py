"""Incremental corpus ingestion with Structured Streaming.

New document files landing in a folder are cleaned and counted with the same
column expressions as the batch operators (they are stateless per row), and
corpus totals are kept as streaming state.  Checkpoints go under the
cluster's `spark.checkpoint.dir`, so a restarted query resumes exactly.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import STOPWORD_SET, tokens_prefilter
from docsift.operators.corpus import clean_corpus
from docsift.session import ensure_checkpoint_dir

DOCUMENTS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents_stream(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """Streaming `documents` rows -> corpus schema (title = first line, abstract = rest)."""
    d = (spark.readStream.schema(DOCUMENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
         .parquet(folder))
    text = F.col("text")
    nl = F.instr(text, "\n")
    return d.select("doc_id", F.substring_index(text, "\n", 1).alias("title"),
                    F.when(nl > 0, text.substr(nl + 1, F.length(text))).alias("abstract"),
                    "lang", "source")


def word_count_rows(corpus: DataFrame, stopwords=STOPWORD_SET) -> DataFrame:
    """Per-document Words_Before / Words_After (stateless, works on streams)."""
    pre = tokens_prefilter("title_abstract")
    return clean_corpus(corpus).select(
        F.col("doc_id").alias("DocIndex"), F.col("title").alias("Title"),
        F.size(pre).cast("long").alias("Words_Before"),
        F.size(F.filter(pre, lambda t: ~t.isin(list(stopwords)))).cast("long").alias("Words_After"))


def start_word_counts(spark: SparkSession, folder: str, out_dir: str, name: str = "word_counts"):
    """Start two queries: per-document rows appended to Parquet, and one running total
    over all documents (complete mode, to the in-memory sink `name`_totals)."""
    ck = ensure_checkpoint_dir(spark)
    rows = word_count_rows(documents_stream(spark, folder))
    q1 = (rows.writeStream.format("parquet").option("path", out_dir)
          .option("checkpointLocation", os.path.join(ck, f"{name}_rows")).outputMode("append").start())
    totals = (word_count_rows(documents_stream(spark, folder)).agg(
        F.sum("Words_Before").alias("Words_Before"), F.sum("Words_After").alias("Words_After"),
        F.count(F.lit(1)).alias("n_docs")))
    q2 = (totals.writeStream.format("memory").queryName(f"{name}_totals")
          .option("checkpointLocation", os.path.join(ck, f"{name}_totals")).outputMode("complete").start())
    return q1, q2
