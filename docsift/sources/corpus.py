"""Corpus sources: the title/abstract CSV and the driver's `documents` table.

A corpus DataFrame has at least `doc_id LONG, title STRING, abstract STRING`;
other input columns are carried along.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions.text import NA_STRINGS, col_of


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out to all cores by `key` where the scan has fewer partitions than cores.

    One file of one row group is one task however many cores wait.  Large
    inputs have more partitions than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.select(key).rdd.getNumPartitions() < cores else df


def resolve_columns(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Case-insensitive lookup of required columns; error naming what is missing."""
    lower = {c.lower(): c for c in df.columns}
    missing = [w for w in wanted if w.lower() not in lower]
    if missing:
        raise ValueError(f"input lacks required column(s) {missing}; found {df.columns}")
    return {w: lower[w.lower()] for w in wanted}


def null_if_na(c, na_strings=NA_STRINGS):
    """pandas-style null spellings (NA, NaN, null, empty ...) become NULL."""
    c = col_of(c)
    return F.when(c.isin(list(na_strings)), F.lit(None).cast("string")).otherwise(c)


def with_doc_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Attach a contiguous row key in scan order (before any filter), JVM-side.

    Row position inside a partition comes from `monotonically_increasing_id`
    (low 33 bits), the partition's offset from a per-partition count: one row
    per input split, so the broadcast offsets table is bounded by the number
    of splits.  Same files and splits give the same keys.
    """
    if key in df.columns:
        return df
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(key, (F.col("_off") + pos).cast("long")).drop("_pid", "_mid", "_off"))


def read_corpus_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                    title: str = "title", abstract: str = "abstract",
                    utf8_fallback: bool = False) -> DataFrame:
    """Read the title/abstract CSV.

    Header row, quoted cells that may span lines, every column kept as text
    (no type inference), pandas null spellings mapped to NULL, the two
    required columns resolved case-insensitively and renamed to
    `title`/`abstract`, and a `doc_id` in file order.  A missing path raises
    Spark's PATH_NOT_FOUND error.  With `utf8_fallback`, the file is decoded
    as UTF-8 first and re-read as `encoding` if any replacement character
    shows up.
    """
    def _read(enc: str) -> DataFrame:
        return (spark.read.option("header", True).option("multiLine", True)
                .option("escape", '"').option("encoding", enc)
                .option("inferSchema", False).csv(path))

    df = None
    if utf8_fallback:
        df = _read("UTF-8")
        bad = df.select(F.greatest(*[F.instr(F.coalesce(F.col(f"`{c}`"), F.lit("")), "�")
                                     for c in df.columns]).alias("b")).filter("b > 0").limit(1)
        if bad.count() > 0:
            df = None
    if df is None:
        df = _read(encoding)
    cols = resolve_columns(df, title, abstract)
    df = df.select(*[null_if_na(F.col(f"`{c}`")).alias(c) for c in df.columns])
    df = df.withColumnRenamed(cols[title], "title").withColumnRenamed(cols[abstract], "abstract")
    return with_doc_id(df)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bind the driver's `documents` table to the corpus schema.

    title = text before the first newline, abstract = the rest (NULL when the
    text has no newline).  `lang` and `source` are kept as document classes.
    """
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    text = F.col("text")
    nl = F.instr(text, "\n")
    return d.select(
        "doc_id",
        F.substring_index(text, "\n", 1).alias("title"),
        F.when(nl > 0, text.substr(nl + 1, F.length(text))).alias("abstract"),
        "lang", "source")
