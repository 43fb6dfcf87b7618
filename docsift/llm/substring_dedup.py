"""Word-exact substring dedup over prefix-partitioned suffix trees.

The suffixes that can start a shared window are split by a prefix into groups
that fit a task: the anchor's k words first, and for k-grams with too many
contexts the whole window (`repeats.compare_hot`).  Inside a group the suffix
tree is built level by level, by doubling: the nodes of depth 2d are the pairs
of depth-d nodes, so after log2 steps every suffix knows its node of depth
`size`.  Nodes at that depth with two or more suffixes are the deep internal
nodes: their suffixes are repeats of `size` words or more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from docsift.llm.repeats import CHUNK, Scheme, body_buffers, coded, digest, intervals
from docsift.llm.tables import documents
from docsift.llm.words import Words, chunks

#: Windows of 50 words, anchors of 8.
MIN_WORDS, GRAM = 50, 8


def deep_nodes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Node of each suffix at `depth` symbols (suffixes shorter than that share nothing useful)."""
    node = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, span = len(node), 1

    def step(a, b):
        return np.unique(a * (n + 1) + b, return_inverse=True)[1].astype(np.int64)

    while span * 2 <= depth:
        node = step(node, np.r_[node[span:], np.zeros(min(span, n), np.int64)])
        span *= 2
    if span < depth:
        k = min(depth - span, n)
        node = step(node, np.r_[node[k:], np.zeros(k, np.int64)])
    return node


def compare(c: dict, s: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) covered around each anchor by windows of smaller documents."""
    raw, off = body_buffers(c["body"])
    m = len(c["lo"])
    # the arrays of a chunk's bytes go with the chunk; only words stay
    parts = [(w.n, w.h) for w in (Words(raw, off, i, j) for i, j in chunks(off, CHUNK))]
    n_words, hashes = (np.concatenate(x) for x in zip(*parts))
    first = np.r_[0, np.cumsum(n_words)]
    node = deep_nodes(hashes, s.size)
    count = np.maximum(n_words - s.size + 1, 0)
    t = np.repeat(np.arange(m), count)
    k = np.arange(len(t)) - np.repeat(np.cumsum(count) - count, count)
    leaf = node[first[t] + k]
    least = np.full(leaf.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, leaf, c["doc_id"][t])
    on = c["doc_id"][t] > least[leaf]
    t, k = t[on], k[on]
    lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    np.maximum.at(lo, t, c["lo"][t] - k)
    np.maximum.at(hi, t, k + s.size - c["lo"][t])
    return lo, hi


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM,
                    group_rows: int = 20_000) -> DataFrame:
    """Remove each word inside a `min_words` window that also starts in a smaller doc_id.

    Returns (doc_id, kept binary: kept words joined by one space, n_words,
    n_removed, spans: flat word bounds of the removed runs).  Null and empty
    texts have no words; repeats inside one document stay; rows with equal
    doc_id count as one document.  A null doc_id is the least id.
    """
    s = Scheme(min_words, gram, words=True, earlier=True, group_rows=group_rows)
    docs = coded(documents(docs))

    def row(text: bytes, runs):
        words = text.split()
        kept, at = [], 0
        for a, z in runs:
            kept += words[at:a]
            at = z
        kept += words[at:]
        return b" ".join(kept), len(words), len(words) - len(kept), [x for r in runs for x in r]

    return digest(docs, intervals(docs, s, compare), row,
                  {"kept": "binary", "n_words": "long", "n_removed": "long", "spans": "spans"})
