import os
import tempfile

import __spark_entry__ as E
from docsift.sources import sinks


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_words_plan_limits_and_prunes(spark):
    p = _plan(E.queries()["top10_words"](spark, "/root/testdata/sf0.01"))
    assert "WindowGroupLimit" in p
    assert "n_chars" not in p  # column pruning reaches the scan


def test_write_lines_in_report_order(spark):
    df = spark.createDataFrame([(1, 1, 5, "- b"), (0, 0, -1, "Topic 0:"), (1, 0, -1, "Topic 1:"),
                                (0, 1, 3, "- a"), (0, 2, -1, ""), (1, 2, -1, "")],
                               "topic int, part int, doc_id long, line string")
    out = os.path.join(tempfile.mkdtemp(prefix="docsift-out-"), "titles")
    sinks.write_lines(df, out)
    lines = []
    for f in sorted(os.listdir(out)):
        if f.startswith("part-"):
            with open(os.path.join(out, f)) as fh:
                lines += fh.read().splitlines()
    assert lines == ["Topic 0:", "- a", "", "Topic 1:", "- b", ""]


def test_per_setting_layout_and_model_bundle(spark):
    base = tempfile.mkdtemp(prefix="docsift-out-")
    df = spark.createDataFrame([(5, 1, 0), (10, 2, 1)], "min_cluster_size int, doc_id long, topic int")
    sinks.write_per_setting(df, os.path.join(base, "assign"))
    assert sorted(d for d in os.listdir(os.path.join(base, "assign")) if d.startswith("setting=")) == \
        ["setting=mincs_005", "setting=mincs_010"]
    sinks.save_topic_model(os.path.join(base, "model"), assignments=df)
    got = sinks.load_topic_model(spark, os.path.join(base, "model"))
    assert set(got) == {"assignments"} and got["assignments"].count() == 2


def test_nan_to_num_and_sample(spark):
    from docsift.operators import vectors as V
    df = spark.createDataFrame([(0, [float("nan"), float("inf"), -float("inf"), 1.5])], "doc_id long, vec array<double>")
    got = V.nan_to_num(df).first().vec
    assert got[0] == 0.0 and got[1] > 1e300 and got[2] < -1e300 and got[3] == 1.5
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    a = [r.doc_id for r in V.sample_rows(rows, 10, seed=7).collect()]
    b = [r.doc_id for r in V.sample_rows(rows.repartition(5), 10, seed=7).collect()]
    assert len(a) == 10 and sorted(a) == sorted(b)


def test_alignment_report_and_binned_melt(spark):
    import pytest
    from docsift.operators import corpus as B
    from docsift.operators import vectors as V
    docs = spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")
    vecs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (5, [0.0, 0.0])], "vec_id long, vec array<double>")
    rep = {(r.key, r.side) for r in B.alignment_report(docs, vecs).collect()}
    assert rep == {(0, "doc_only"), (5, "vector_only")}
    with pytest.raises(ValueError):
        B.check_aligned(docs, vecs)
    m = {(r.row_bin, r.dim): r.value
         for r in V.melt_binned(vecs.withColumnRenamed("vec_id", "doc_id"), 2).collect()}
    assert m[(0, 0)] == 1.0 and m[(1, 1)] == 4.0 and m[(2, 0)] == 0.0


def test_documents_are_embedded_once(spark):
    from docsift.plans import bindings as bind
    from docsift.plans import queries as Q
    vecs = Q._doc_vectors(spark, "/root/testdata/sf0.001", bind.clean_documents(spark, "/root/testdata/sf0.001"))
    assert getattr(vecs, "_docsift_table", None)
    assert "regexp_extract_all" not in vecs._jdf.queryExecution().optimizedPlan().toString()
