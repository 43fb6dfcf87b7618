"""Block pairs of many tiles, blocks that grow with the rows, what a written table leaves behind."""
import time

import numpy as np
import pandas as pd
import pytest

from docsift import session
from docsift.operators import knn, validity
from docsift.plans import bindings as bind

RNG = np.random.default_rng(5)
X = RNG.normal(size=(60, 3))
X[31] = X[4]
CORE, G = RNG.random(60), RNG.integers(0, 4, 60)


def _rows(ids, side):
    return pd.DataFrame({"id": ids, "vec": list(X[ids]), "core": CORE[ids], "g": G[ids], "side": side})


BLOCKS = [(np.arange(60), np.arange(0)), (np.arange(40), np.arange(40, 60))]


def _dist(a, b):
    return np.sqrt(((X[a][:, None] - X[b][None]) ** 2).sum(-1))


@pytest.mark.parametrize("a,b", BLOCKS)
def test_block_pair_of_many_tiles(a, b, monkeypatch):
    monkeypatch.setattr(knn, "TILE_ROWS", 7)
    pdf = pd.concat([_rows(RNG.permutation(a), 0), _rows(RNG.permutation(b), 1)], ignore_index=True)
    got = knn._near(pdf, 4, "euclidean").groupby("id")["nbr"].apply(set)
    lse = validity._lse(pdf, 3, "euclidean").set_index("id")["lse"]
    sep = validity._apart(pdf, "euclidean").set_index("g")["sep"]
    least = {}
    for own, other in ((a, b), (b, a)) if len(b) else ((a, a),):
        d = _dist(own, other)
        d[own[:, None] == other[None]] = np.inf
        for i, row in zip(own, d):
            assert got[i] == set(other[np.argsort(row, kind="stable")[:4]])
            with np.errstate(divide="ignore"):
                terms = np.where((row > 0) & np.isfinite(row), -3 * np.log(row), -np.inf)
            assert lse[i] == pytest.approx(np.logaddexp.reduce(terms))
            w = np.maximum(np.maximum(row, CORE[i]), CORE[other])[G[other] != G[i]]
            least[G[i]] = min([least.get(G[i], np.inf), *w])
    assert sep.to_dict() == pytest.approx(least)


def test_blocks_grow_with_the_rows():
    """Copies of a point are the blocks: at 600,000 rows of 64 numbers 37, not 293."""
    assert [knn._block_rows(n, 64) for n in (1, 10_000, 60_000, 600_000)] == [2048, 2048, 5000, 16384]


def test_written_table_leaves_no_shuffle_files(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = files()
    t = session.cut_lineage(spark.range(1000).selectExpr("id % 100 as k").groupBy("k").count())
    until = time.time() + 20
    while (left := {f for f in files() - before if f.startswith("shuffle")}) and time.time() < until:
        time.sleep(0.2)
    assert not left and t.count() == 100
    session.drop_table(t)


def test_draws_are_not_broadcast(spark, monkeypatch):
    """(F6, F8) A draw's join with the documents is a shuffle, however small the file; copies and null ids as before."""
    docs = spark.createDataFrame([(i % 40, "en", "web") for i in range(50)] + [(None, "de", "x")],
                                 "doc_id long, lang string, source string")
    plans, real = [], bind.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(bind, "cut_lineage", kept)
    got = bind.bootstrap_labels(docs, runs=2, settings=(5,)).collect()
    assert "SortMergeJoin" in plans[1] and "Broadcast" not in plans[1]
    drawn = {(r.run, r.doc_id) for r in got}
    counts = pd.Series([(r.run, r.doc_id) for r in got]).value_counts()
    assert drawn and all(counts[k] == (4 if k[1] < 10 else 1) for k in drawn)
