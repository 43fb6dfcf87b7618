import random
import re

import numpy as np
import pytest

from docsift.llm import ngram_join as J

from .util import ROWS, corpus


def brute(rows, k=5):
    sets = {}
    for d, t, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (
            frozenset([tuple(w)]) if w else frozenset())
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def family(seed):
    """Near copies at every similarity around the threshold, of sizes 1 to 300."""
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 10, 12, 20, 35, 60, 120, 300]))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 16))):
                t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows) * 2, " ".join(t), "en", "z"))
    return rows


@pytest.mark.parametrize("seed,group", [(1, 16), (2, 2)])
def test_components_equal_brute_force(spark, seed, group):
    rows = [(d + 1000, *r) for d, *r in corpus(seed)] + family(seed)
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(df, group=group).collect()}
    assert got == brute(rows)


def test_linked_sets_always_meet():
    """Signatures alone: any two sets with J >= 3/4 share one, whatever their sizes."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 63, 64, 65, 85, 86, 127, 128, 170, 171, 300, 700]:
        for _ in range(30):
            x = rng.integers(1, 2**63, n, dtype=np.uint64)
            cut = rng.integers(0, n // 4 + 1)
            add = 0
            while (add + 1 + cut) * 7 <= 2 * n - cut + add + 1:
                add += 1
            add = int(rng.integers(0, add + 1))
            if (add + cut) * 7 > 2 * n - cut + add:
                continue
            y = np.r_[x[cut:], rng.integers(1, 2**63, add, dtype=np.uint64)]
            doc, e = np.r_[np.zeros(n, np.int64), np.ones(len(y), np.int64)], np.r_[np.sort(x), np.sort(y)]
            t, sig, *_ = J.signatures(doc, e, np.array([n, len(y)]))
            assert np.intersect1d(sig[t == 0], sig[t == 1]).size, (n, cut, add)


def test_empty_table(spark):
    assert J.ngram_components(spark.createDataFrame([], ROWS)).count() == 0
