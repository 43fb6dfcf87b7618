import random
import re
from collections import Counter, defaultdict

import pytest

from docsift.llm.suffix_dedup import lcp_intervals, suffix_dedup
from docsift.llm.substring_dedup import substring_dedup

from .util import ROWS, corpus


def brute_bytes(rows, size):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i:i + size] for i in range(len(b) - size + 1))
    out = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (kept, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
    return out


def brute_words(rows, size):
    least = defaultdict(lambda: 1 << 62)
    words = {d: (t or "").encode().split() for d, t, *_ in rows}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            least[k] = min(least[k], d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        out[d] = (b" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    return out


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_bytes_equal_brute_force(spark, group_rows):
    rows = corpus(1)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans)
           for r in suffix_dedup(df, 200, 32, group_rows).collect()}
    assert got == brute_bytes(rows, 200)


def test_bytes_other_sizes(spark):
    rows = corpus(2, 30)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans)
           for r in suffix_dedup(df, 60, 12).collect()}
    assert got == brute_bytes(rows, 60)


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_words_equal_brute_force(spark, group_rows):
    rows = corpus(3)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {r.doc_id: (bytes(r.kept), r.n_words, r.n_removed)
           for r in substring_dedup(df, 50, 8, group_rows).collect()}
    assert got == brute_words(rows, 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert suffix_dedup(df).count() == 0 and substring_dedup(df).count() == 0


def test_interval_tree():
    # suffixes a, ab, abab, abb sorted with common prefixes 1, 2, 2
    assert sorted(lcp_intervals(__import__("numpy").array([1, 2, 2]))) == [(1, 0, 3), (2, 1, 3)]




def test_null_ids_and_long_texts(spark):
    from docsift.llm.substring_dedup import substring_dedup
    from docsift.llm.suffix_dedup import suffix_dedup
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(150_000))                       # 900 KB, more than a chunk
    rows = [(None, "x " + passage), (2**60 + 1, "y " + passage), (2**60 + 3, long + " " + passage + " " + long[:3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup(df).collect()}
    assert set(got) == {None, 2**60 + 1, 2**60 + 3}
    assert bytes(got[None].kept) == b"x" and bytes(got[2**60 + 1].kept) == b"y"      # " " + passage repeats everywhere
    assert got[2**60 + 3].n_removed >= len(passage) + 6000
    words = {r.doc_id: r for r in substring_dedup(df).collect()}
    assert {k: r.n_removed for k, r in words.items()} == {None: 0, 2**60 + 1: 60, 2**60 + 3: 60}
