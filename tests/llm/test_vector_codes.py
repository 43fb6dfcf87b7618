"""Vector codes against plain exact assignment; tree search against a full scan."""
import hashlib
import math
import random

import numpy as np
import pytest

from docsift.llm import vector_codes as V


def plain(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, code, error, label_error, sha)] by full scans over Python integers."""
    kept = [(i, [math.floor(x * 1024) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda k: (d2(v, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p]), []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for i, v, lab in kept:
        idx = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in idx), sum(d2(cut(v, p), books[p][k]) for p, k in enumerate(idx)), lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    big = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, big(e), big(total[lab]) if all(x[2] < 1 << 63 for x in out if x[3] == lab) else None, sha)
                   for i, c, e, lab in out), key=repr)


def coded(spark, rows, schema="vec_id long, embedding array<double>, label int", **kw):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in V.vector_codes(df, **kw).collect()), key=repr)


def vectors(n, dim, seed, scale=1.0, grid=None):
    rng = random.Random(seed)
    one = lambda: rng.gauss(0, scale) if grid is None else rng.randrange(grid) / 1024
    return [(i * 3, [one() for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(300, 8, 1), vectors(280, 4, 2, grid=3), vectors(40, 16, 3),
    [*vectors(30, 8, 4), (None, [0.5] * 8, 1), (3, [0.25] * 8, 2), (3, [0.25] * 8, None),
     (900, None, 0), (901, [None] * 8, 0), (902, [float("nan")] * 8, 0), (903, [float("inf")] + [0.0] * 7, 0)],
    [(i, [1.0] * 4, 0) for i in range(20)], vectors(50, 8, 5, scale=1e9)])
def test_equals_full_scan(spark, rows):
    assert coded(spark, rows, entries=32) == plain(rows, entries=32)


def test_float_vectors_and_256_entries(spark):
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in vectors(400, 8, 6)]
    assert coded(spark, rows, "vec_id long, embedding array<float>, label int") == plain(rows)


def test_empty_clashing_and_bad_lengths(spark):
    schema = "vec_id long, embedding array<float>, label string, v int, rows int, error string, _join_key int"
    df = spark.createDataFrame([(1, [0.1] * 4, "a", 1, 2, "e", 3), (2, [0.2] * 4, "a", 1, 2, "e", 3)], schema)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert V.vector_codes(df).columns == names and V.vector_codes(df).count() == 2
    assert V.vector_codes(df.limit(0)).columns == names and V.vector_codes(df.limit(0)).count() == 0
    for bad in ([0.1] * 8, [0.1] * 6, []):
        both = spark.createDataFrame([(1, [0.1] * 4, 1), (2, bad, 1)], "vec_id long, embedding array<float>, label int")
        with pytest.raises(ValueError):
            V.vector_codes(both)


@pytest.mark.parametrize("kind", [float, object])
def test_tree_is_exact(kind):
    rng = np.random.default_rng(1)
    for dim, high in ((1, 4), (2, 5), (3, 50), (16, 900)):
        entries = rng.integers(-high, high, (150, dim)).astype(kind)
        q = np.concatenate([rng.integers(-high, high, (300, dim)).astype(kind), entries])
        index, best = V.Tree(entries, splits=4, leaf=3).nearest(q)
        d2 = V.squared(q, entries)
        assert (index == np.argmin(d2.astype(float), axis=1)).all() and (best == d2.min(axis=1)).all()


def test_tree_drops_subtrees(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-100_000, 100_000, (12, 8))
    entries = (centres[rng.integers(0, 12, 256)] + rng.integers(-50, 50, (256, 8))).astype(float)
    q = (centres[rng.integers(0, 12, 2000)] + rng.integers(-50, 50, (2000, 8))).astype(float)
    asked, whole = [], V.squared
    tree = V.Tree(entries)
    monkeypatch.setattr(V, "squared", lambda a, b: asked.append(len(a) * len(b)) or whole(a, b))
    index, best = tree.nearest(q)
    assert sum(asked) < 0.4 * len(q) * len(entries)
    assert (best == whole(q, entries).min(axis=1)).all()
