"""Sinks: tables, ordered text reports, per-setting layout, topic-model bundles.

Everything is written by executors in parallel (Parquet by default, CSV on
request); the driver only issues the write.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import delete_path

MODEL_TABLES = ("assignments", "ctfidf", "topic_words", "topic_info", "clusters")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet, or CSV with a header and quoted cells (UTF-8)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("quoteAll", False).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_per_setting(df: DataFrame, path: str, key: str = "min_cluster_size",
                      fmt: str = "parquet") -> None:
    """One folder per setting named `mincs_%03d` (partition pruning on read)."""
    out = df.withColumn("setting", F.format_string("mincs_%03d", F.col(key)))
    write_table(out, path, fmt, partition_by=["setting"])


def write_lines(report: DataFrame, path: str, order=("topic", "part", "doc_id"),
                keys: list[str] | None = None) -> None:
    """Text file(s) of the `line` column in report order.

    A global `orderBy` range-partitions the lines, so part files are in
    order and a huge topic is spread over several tasks.  With `keys`, one
    folder per setting.
    """
    keys = keys or []
    sorted_df = report.orderBy(*keys, *order)
    if keys:
        sorted_df.select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(path)
    else:
        sorted_df.select("line").write.mode("overwrite").text(path)


def save_vectors(vecs: DataFrame, path: str) -> None:
    write_table(vecs.select("doc_id", "vec"), path)


def load_vectors(spark: SparkSession, path: str, docs: DataFrame | None = None) -> DataFrame:
    """Read saved vectors; with `docs`, fail if keys do not line up (both sides reported)."""
    v = spark.read.parquet(path)
    if docs is not None:
        from docsift.operators.corpus import check_aligned
        check_aligned(docs, v, vec_key="doc_id")
    return v


def save_topic_model(path: str, **tables: DataFrame) -> None:
    """A topic model = its tables (assignments, ctfidf, words, info, clusters) under one folder.

    Tables go to a new version folder; the manifest that names it, with each
    table's rows, is written last.  Until then readers see the version before,
    and afterwards that one is deleted.
    """
    unknown = set(tables) - set(MODEL_TABLES)
    if unknown or not tables:
        raise ValueError(f"unknown model tables {sorted(unknown)}" if unknown else "no model tables")
    spark = next(iter(tables.values())).sparkSession
    old = _manifest(spark, path)
    version = f"v-{uuid.uuid4().hex[:12]}"
    rows = []
    for name, df in tables.items():
        at = os.path.join(path, version, name)
        write_table(df, at)
        rows.append((name, version, spark.read.parquet(at).count()))
    manifest = spark.createDataFrame(rows, "name string, version string, rows long").coalesce(1)
    manifest.write.mode("overwrite").json(os.path.join(path, "manifest"))
    for gone in {v for v, _ in old.values()} - {version}:
        delete_path(spark, os.path.join(path, gone))


def _manifest(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """{table: (version, rows)} of a complete save, else empty."""
    try:
        rows = spark.read.schema("name string, version string, rows long").json(os.path.join(path, "manifest")).collect()
    except AnalysisException:                             # no manifest: never saved, or stopped before its end
        return {}
    return {r["name"]: (r["version"], r["rows"]) for r in rows}


def load_topic_model(spark: SparkSession, path: str,
                     refit: Callable[[], dict[str, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """The tables of a complete save; every table the manifest names must be there with all its rows.

    A missing or incomplete model is fitted anew and saved if `refit` (returning
    the tables by name) is given, else FileNotFoundError.
    """
    out, manifest = {}, _manifest(spark, path)
    whole = bool(manifest)
    for name, (version, n) in manifest.items():
        try:
            out[name] = spark.read.parquet(os.path.join(path, version, name))
            whole = whole and out[name].count() == n
        except (PySparkException, Py4JJavaError):         # missing, or cut short on its way to disk
            whole = False
    if whole:
        return out
    if refit is None:
        raise FileNotFoundError(f"no complete topic model under {path}")
    save_topic_model(path, **refit())
    return load_topic_model(spark, path)
