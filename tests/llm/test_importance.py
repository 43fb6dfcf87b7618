import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from docsift.llm.importance import BUCKETS, SMOOTH, importance_resample, kth_largest


def tables(spark, n=400, words=200):
    rng = random.Random(1)
    good = [f"g{i}" for i in range(words)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(good) for _ in range(rng.randint(30, 120))]
        if bad:
            w = [x if rng.random() < 0.6 else rng.choice(["ugly", "vile", "awful"]) for x in w]
        docs.append((i, " ".join(w), "e"))
        if i % 2 or i % 8 == 0:
            labels.append((i, int(not bad), 0))
    docs += [(9001, None, "e"), (9002, "", "e"), (9003, "g1 " * 5000, "e")]
    return (spark.createDataFrame(docs, "doc_id long, text string, kept string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return [w, list(zip(w, w[1:]))]


def noise(doc_id, seed):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=h)
    return -math.log(-math.log(((h >> 12) + 0.5) / (1 << 52)))


@pytest.mark.parametrize("length", [None, 100.0])
def test_weights_noise_and_kept_rows_equal_plain_python(spark, length):
    docs, labels = tables(spark, 60, words=9)         # few n-grams: none share a bucket
    docs = docs.unionByName(spark.createDataFrame(
        [(None, "g1 G2 vile", "e"), (1, "other text of an equal id", "e"), (9003, "g1 " * 5000, "e")], docs.schema))
    rows = docs.collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    models = []
    for side in ([r for r in rows if r.doc_id in good], rows):
        own = [Counter(g for r in side for g in grams(r.text)[k]) for k in (0, 1)]
        models.append([{g: math.log((n + SMOOTH) / (sum(c.values()) + SMOOTH * BUCKETS)) for g, n in c.items()}
                       | {None: math.log(SMOOTH / (sum(c.values()) + SMOOTH * BUCKETS))} for c in own])
    want = []
    for r in rows:
        parts = [models[0][k].get(g, models[0][k][None]) - models[1][k][g] for k in (0, 1) for g in grams(r.text)[k]]
        weight = sum(parts) if length is None else length * sum(parts) / max(1, len(parts))
        want.append((r.doc_id, len(parts), weight, weight + noise(r.doc_id, 17)))
    got = importance_resample(docs, labels, share=0.5, length=length).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:2] == w[:2] and g.log_weight == pytest.approx(w[2], abs=1e-6 * max(1, w[1])) \
            and g.score - g.log_weight == pytest.approx(w[3] - w[2], abs=1e-6)
    least = sorted((r.score for r in got), reverse=True)[-(-len(got) // 2) - 1]
    assert all(r.kept == (r.score >= least) for r in got)


@pytest.mark.parametrize("length", [None, 100.0])
def test_held_out_documents(spark, length):
    docs, labels = tables(spark)
    got = {r.doc_id: r for r in importance_resample(docs, labels, share=0.75, length=length).collect()}
    held = [d for d in got if d < 9000 and d % 2 == 0 and d % 8]
    good = [got[d].kept for d in held if d % 4]
    bad = [got[d].kept for d in held if d % 4 == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1
    assert sum(r.kept for r in got.values()) == -(-len(got) * 3 // 4)
    assert got[9001].log_weight == got[9002].log_weight == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    v = [rng.choice([0.0, -1e9, 3.5]) if rng.random() < 0.3 else rng.gauss(0, 1) for _ in range(700)]
    df = spark.createDataFrame([(x,) for x in v], "s double").cache()
    for k in (1, 2, 100, 350, 699, 700):
        assert kth_largest(df, "s", k, bins=16) == sorted(v, reverse=True)[k - 1]
    assert kth_largest(df.limit(0), "s", 1) is None


def test_no_labels_and_no_documents(spark):
    docs, labels = tables(spark, 20)
    none = importance_resample(docs, labels.limit(0)).collect()
    assert len(none) == 23
    assert importance_resample(docs.limit(0), labels).count() == 0
