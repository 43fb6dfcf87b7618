"""Keyed validity and separation, per-run projections, saved models, table life times, plans without one-task windows."""
import os
import tempfile
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift import session
from docsift.operators import coherence as H
from docsift.operators import density, quality, topics, vectors
from docsift.operators.validity import dbcv
from docsift.plans import queries as Q
from docsift.sources import sinks

KEYS = ["min_cluster_size"]
SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dbcv_of_all_settings(spark):
    xs = [0, 1, 2, 3, 10, 11, 12, 13, 100]
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(xs)], "doc_id long, vec array<double>")
    labels = [0, 0, 0, 0, 1, 1, 1, 1, -1]
    rows = [(5, i, c) for i, c in enumerate(labels)] + [(10, i, 0) for i in range(9)] + [(20, i, -1) for i in range(9)]
    lab = spark.createDataFrame(rows, "min_cluster_size int, doc_id long, cluster int")
    got = {r.min_cluster_size: r.DBCV for r in
           dbcv(lab, v, metric="euclidean", normalise_first=False, keys=KEYS, block_rows=3).collect()}
    assert got == {5: pytest.approx(0.7703703703703703, abs=1e-12), 10: None, 20: None}


def test_separation_does_not_depend_on_list_length(spark, monkeypatch):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(90, 6))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "doc_id long, vec array<double>")
    lab = spark.createDataFrame([(s, i, int(rng.integers(-1, 12))) for s in (5, 10) for i in range(90)],
                                "min_cluster_size int, doc_id long, cluster int")
    metrics = [quality.silhouette_cosine, quality.davies_bouldin]
    whole = [sorted(tuple(r) for r in m(lab, v, keys=KEYS).collect()) for m in metrics]
    monkeypatch.setattr(quality, "LIST_CLUSTERS", 3)
    monkeypatch.setattr(quality, "BLOCK_POINTS", 20)
    cut = [sorted(tuple(r) for r in m(lab, v, keys=KEYS).collect()) for m in metrics]
    for a, b in zip(whole, cut):
        assert [r[0] for r in a] == [r[0] for r in b] == [5, 10]
        assert [r[1] for r in a] == pytest.approx([r[1] for r in b], abs=1e-12)


def test_no_window_over_all_clusters(spark):
    lab = spark.createDataFrame([(i, i % 7) for i in range(60)], "doc_id long, cluster int")
    for df in (topics.topic_ids(lab), quality.size_metrics(lab)):
        assert "Window" not in _plan(df) and "SinglePartition" not in _plan(topics.topic_ids(lab))


def test_word_counts_do_not_shuffle_documents(spark):
    plan = _plan(Q.QUERIES["word_counts"](spark, SF))
    assert "Expand" not in plan and "hashpartitioning(DocIndex" not in plan


def test_projection_of_each_run_is_its_own(spark):
    rng = np.random.default_rng(1)
    runs = {r: rng.normal(size=(40, 5)) * rng.permutation([5, 3, 1, 0.1, 0.1]) for r in range(3)}
    rows = [(r, i, x.tolist()) for r, X in runs.items() for i, x in enumerate(X)]
    got = vectors.reduce_by_run(spark.createDataFrame(rows, "run long, doc_id long, vec array<double>").repartition(4), 2)
    out = {(r.run, r.doc_id): r.vec for r in got.collect()}
    for r, X in runs.items():
        one = vectors.reduce_dims(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)],
                                                        "doc_id long, vec array<double>"), 2)
        for row in one.collect():
            assert out[r, row.doc_id] == pytest.approx(row.vec, abs=1e-8)


def test_bootstrap_of_planted_clusters_agrees(spark):
    rng = np.random.default_rng(4)
    X = np.concatenate([c + rng.normal(scale=0.02, size=(20, 6)) for c in np.eye(6)[:3]])
    pts = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "doc_id long, vec array<double>")
    runs = density._ckpt(density.bootstrap_labels(pts, (5,), runs=3, refit_dims=3))
    for r in runs.groupBy("run").agg(F.countDistinct("cluster").alias("k"), F.min("cluster").alias("low")).collect():
        assert (r.k, r.low) == (3, 0)
    pac = quality.pac(quality.consensus_histogram(runs, KEYS, runs=3), runs, KEYS).first()
    assert pac.pac == 0.0


def test_interrupted_save_is_fitted_anew(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="docsift-out-"), "model")
    df = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, topic int")
    broken = df.withColumn("topic", F.raise_error(F.lit("stopped")).cast("int"))
    with pytest.raises(FileNotFoundError):
        sinks.load_topic_model(spark, path)
    with pytest.raises(Exception):
        sinks.save_topic_model(path, assignments=df, ctfidf=broken)
    with pytest.raises(FileNotFoundError):
        sinks.load_topic_model(spark, path)                    # tables without a manifest are no model
    got = sinks.load_topic_model(spark, path, refit=lambda: {"assignments": df, "ctfidf": df})
    assert {k: t.count() for k, t in got.items()} == {"assignments": 2, "ctfidf": 2}
    with pytest.raises(Exception):
        sinks.save_topic_model(path, assignments=broken)
    assert sinks.load_topic_model(spark, path)["assignments"].count() == 2       # the version before still stands
    version = next(d for d in os.listdir(path) if d.startswith("v-") and
                   os.path.isdir(os.path.join(path, d, "ctfidf", )) and os.path.exists(os.path.join(path, d, "ctfidf", "_SUCCESS")))
    for f in os.listdir(os.path.join(path, version, "ctfidf")):
        if f.startswith("part-"):
            os.truncate(os.path.join(path, version, "ctfidf", f), 0)
    assert set(sinks.load_topic_model(spark, path, refit=lambda: {"assignments": df})) == {"assignments"}


def test_round_trips(spark):
    base = tempfile.mkdtemp(prefix="docsift-out-")
    df = spark.createDataFrame([(1, 'a "quoted", cell', 0.5), (2, "", None)], "doc_id long, text string, x double")
    for fmt, read in (("parquet", spark.read.parquet), ("csv", lambda p: spark.read.schema(df.schema).option(
            "header", True).option("escape", '"').option("emptyValue", "").csv(p))):
        sinks.write_table(df, os.path.join(base, fmt), fmt)
        got = sorted((r.doc_id, r.text or "", r.x) for r in read(os.path.join(base, fmt)).collect())
        assert got == [(1, 'a "quoted", cell', 0.5), (2, "", None)]
    vecs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 4.0])], "doc_id long, vec array<double>")
    sinks.save_vectors(vecs, os.path.join(base, "v"))
    assert sorted(map(tuple, sinks.load_vectors(spark, os.path.join(base, "v"), df).collect())) == [
        (1, [1.0, 2.0]), (2, [0.0, 4.0])]
    with pytest.raises(ValueError):
        sinks.load_vectors(spark, os.path.join(base, "v"), df.filter("doc_id = 1"))


def test_tables_live_as_long_as_their_workspace(spark):
    folder = os.path.join(session.ensure_checkpoint_dir(spark).removeprefix("file:"), "tables")
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before, built = tables(), []
    with session.workspace(spark) as shared:
        for _ in range(3):
            assert shared("ten", lambda: built.append(1) or spark.range(10)).count() == 10
        Q.QUERIES["coherence_summary"](spark, SF).collect()
        assert len(built) == 1 and tables() > before
    assert tables() == before
    t = session.cut_lineage(spark.range(3))
    session.drop_table(t, None, spark.range(2))
    assert tables() == before


def test_texts_are_read_at_most_twice(spark, monkeypatch):
    reads = []
    real = Q.bind.documents_corpus
    monkeypatch.setattr(Q.bind, "documents_corpus", lambda *a: reads.append(1) or real(*a))
    Q.QUERIES["coherence_summary"](spark, SF).collect()
    assert len(reads) <= 2


def test_one_measure_alone(spark):
    toks = spark.createDataFrame([(0, ["aaa", "bbb"]), (1, ["aaa"])], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "aaa", 1.0), (0, 2, "bbb", 1.0)], "topic int, rank int, term string, score double")
    both = H.npmi_umass(toks, words).first()
    assert H.npmi_umass(toks, words, measures=("umass",)).columns == ["topic", "umass"]
    assert H.npmi_umass(toks, words, measures=("npmi",)).first().npmi == both.npmi


def test_width_warning_and_metadata(spark):
    wide = spark.createDataFrame([(1, 0.5, 1.5)], "doc_id long, d0 double, d1 double")
    with pytest.warns(UserWarning, match="expected 3"):
        assert vectors.from_wide(wide, expect=3).first().vec == [0.5, 1.5]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        v = vectors.from_wide(wide, expect=2)
    meta = {r.key: r.value for r in vectors.embedding_meta(v, normalize_embeddings=True, max_seq_length=512,
                                                           time_stamp=True).collect()}
    assert meta["normalize_embeddings"] == "true" and meta["max_seq_length"] == "512" and meta["created_at"][:2] == "20"
