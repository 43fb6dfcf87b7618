"""Topic similarity as a full matrix and the hierarchy of all topics, disjoint and single ones included."""
import numpy as np
import pytest

from docsift.operators import topics as T

CT = "min_cluster_size int, topic int, term string, tf long, weight double"


def table(spark, rows):
    return spark.createDataFrame([(s, t, w, 1, float(x)) for s, t, w, x in rows], CT)


ROWS = [(5, 0, "a", 1), (5, 0, "b", 2), (5, 1, "b", 1), (5, 2, "c", 3), (5, -1, "a", 1),
        (10, 4, "z", 1),                                      # one topic
        (20, -1, "q", 1),                                     # noise alone
        (30, 0, "x", 1), (30, 1, "y", 1), (30, 2, "z", 1)]    # nothing shared


@pytest.mark.parametrize("split", [{}, {"block_topics": 1, "task_entries": 1}, {"chunk_terms": 1}])
def test_full_matrix(spark, split):
    got = {(r.min_cluster_size, r.topic_a, r.topic_b): r.similarity
           for r in T.topic_similarity(table(spark, ROWS), ["min_cluster_size"], **split).collect()}
    want = {}
    for s in {r[0] for r in ROWS}:
        terms = sorted({r[2] for r in ROWS})
        vec = {t: np.zeros(len(terms)) for t in {r[1] for r in ROWS if r[0] == s}}
        for _, t, w, x in (r for r in ROWS if r[0] == s):
            vec[t][terms.index(w)] = x
        for a in vec:
            for b in vec:
                want[s, a, b] = vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_without_keys(spark):
    ct = table(spark, [r for r in ROWS if r[0] == 5]).drop("min_cluster_size")
    assert T.topic_similarity(ct).count() == 16
    merges, groups = T.topic_hierarchy(T.topic_similarity(ct))
    assert {(r.topic, r.group) for r in groups.collect()} == {(0, 0), (1, 0), (2, 0)}
    assert merges.filter("topic IS NULL").count() == 2


def test_hierarchy_keeps_all_topics(spark):
    keys = ["min_cluster_size"]
    sim = T.topic_similarity(table(spark, ROWS), keys)
    k = spark.createDataFrame([(5, 2), (10, None), (20, None), (30, 2)], "min_cluster_size int, n_groups int")
    merges, groups = T.topic_hierarchy(sim, k, keys)
    assert {(r.min_cluster_size, r.topic, r.group) for r in groups.collect()} == {
        (5, 0, 0), (5, 1, 0), (5, 2, 1), (10, 4, 0), (30, 0, 0), (30, 1, 0), (30, 2, 0)}
    inner = {(r.min_cluster_size, round(r.distance, 6), r["size"]) for r in merges.filter("topic IS NULL").collect()}
    assert inner == {(5, round(1 - 2 / 5 ** 0.5, 6), 2), (5, 1.0, 3), (30, 1.0, 3)}
    one, none = (T.topic_hierarchy(sim.filter(f"min_cluster_size = {s}"), None, keys)[1] for s in (10, 20))
    assert [(r.topic, r.group) for r in one.collect()] == [(4, 0)] and none.count() == 0


def test_groups_do_not_exceed_k(spark):
    rng = np.random.default_rng(3)
    rows = [(5, t, f"w{w}", rng.integers(1, 4)) for t in range(14) for w in rng.choice(9, 4, replace=False)]
    sim = T.topic_similarity(table(spark, rows), ["min_cluster_size"])
    for k in (1, 3, 6, 14):
        n = spark.createDataFrame([(5, k)], "min_cluster_size int, n_groups int")
        groups = T.topic_hierarchy(sim, n, ["min_cluster_size"])[1].collect()
        assert len(groups) == 14 and 1 <= len({r.group for r in groups}) <= k
