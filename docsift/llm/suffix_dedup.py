"""Byte-exact substring dedup over an enhanced suffix array (sparse, anchored).

For the contexts of one k-gram the suffixes starting at the anchors are sorted
(suffix array) and their longest common prefixes taken (enhanced suffix
array).  A stack scan of the LCP array yields its interval tree: every
interval is a common prefix of depth d with all its occurrences.  Inside an
interval the left contexts are sorted too; members that share at least
`size - d` bytes to the left form a repeat of `size` bytes or more that can be
extended neither to the right (the interval ends) nor to the left (the left
contexts differ beyond their common part): a maximal repeat with *all* its
occurrences, not just neighbours in the array.  An interval whose members all
have the same byte before them (no left-extension diversity) is reported with
that common part included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from docsift.llm.repeats import Scheme, coded, digest, intervals
from docsift.llm.tables import documents

#: 200-byte windows, anchors of 32 bytes: one position in about 85 is an anchor.
MIN_BYTES, GRAM = 200, 32


def lcp_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the LCP-interval tree, children before parents.

    lcp[i] is the common prefix of array entries i and i + 1; one stack scan.
    """
    out, stack = [], [(0, 0)]
    for i, d in enumerate(lcp.tolist() + [-1]):
        left = i
        while stack and stack[-1][0] > d:
            depth, left = stack.pop()
            if depth >= 0 and i > left:
                out.append((depth, left, i))
        if not stack or stack[-1][0] < d:
            stack.append((d, left))
    return [x for x in out if x[0] > 0]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    ne = a != b
    first = ne.argmax(axis=1)
    return np.where(ne.any(axis=1), first, a.shape[1])


def _matrix(bodies: list[bytes], frm: np.ndarray, to: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Rows of bytes [frm, to) of each body (reversed if `back`), padded with 0xFF (never in UTF-8)."""
    out = np.full((len(bodies), width), 255, np.uint8)
    for r, (b, x, y) in enumerate(zip(bodies, frm.tolist(), to.tolist())):
        part = np.frombuffer(b, np.uint8, y - x, x)
        out[r, :y - x] = part[::-1] if back else part
    return out


def compare(c: dict, s: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) covered around each anchor; rows of one k-gram are neighbours."""
    lo, hi, m = c["lo"].astype(np.int64), c["hi"].astype(np.int64), len(c["lo"])
    right = _matrix(c["body"], lo, lo + hi, s.size, False)
    left = _matrix(c["body"], np.zeros(m, np.int64), lo, s.size - s.gram, True)
    group = np.cumsum(np.r_[True, np.diff(c["gram"]) != 0]) - 1
    tag = group.astype(">u4").view(np.uint8).reshape(m, 4)
    sa = np.argsort(np.ascontiguousarray(np.hstack([tag, right])).view(f"S{4 + s.size}").ravel(), kind="stable")
    la = np.argsort(np.ascontiguousarray(np.hstack([tag, left])).view(f"S{4 + left.shape[1]}").ravel(),
                    kind="stable")
    left_rank = np.empty(m, np.int64)
    left_rank[la] = np.arange(m)
    out_lo, out_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    lcp = _common(right[sa[:-1]], right[sa[1:]])
    lcs2 = _common(left[sa[:-1]], left[sa[1:]])
    bounds = np.r_[0, np.flatnonzero(np.diff(group)) + 1, m]
    sizes = np.diff(bounds)

    def cover(rows, best, depth):
        b, d = np.minimum(best, lo[rows]), np.minimum(depth, hi[rows])
        on = b + d >= s.size
        r = rows[on]
        out_lo[r] = np.maximum(out_lo[r], b[on])
        out_hi[r] = np.maximum(out_hi[r], d[on])

    pairs = bounds[:-1][sizes == 2]                      # groups of two: one interval each
    for x in (pairs, pairs + 1):
        cover(sa[x], lcs2[pairs], lcp[pairs])
    for a, z in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist()):
        for depth, i, j in lcp_intervals(lcp[a:z - 1]):
            rows = sa[a + i:a + j + 1]
            rows = rows[np.argsort(left_rank[rows])]
            same = _common(left[rows[:-1]], left[rows[1:]])
            # a neighbour in left order shares most; depth holds for the whole interval
            cover(rows, np.maximum(np.r_[0, same], np.r_[same, 0]), depth)
    return out_lo, out_hi


def suffix_dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM,
                 group_rows: int = 20_000) -> DataFrame:
    """Remove every byte covered by a `min_bytes` string that also starts elsewhere.

    Returns (doc_id, kept binary, n_bytes, n_removed, n_spans, spans): spans are
    flat [start, end, start, end, ...] byte bounds of the maximal removed runs.
    Null and empty texts give an empty `kept`; copies (equal doc_id included)
    remove each other; strings never cross texts; ties do not arise.  A null doc_id
    is an id like others.
    """
    s = Scheme(min_bytes, gram, words=False, earlier=False, group_rows=group_rows)
    docs = coded(documents(docs))

    def row(text: bytes, runs):
        kept, at = [], 0
        for a, z in runs:
            kept.append(text[at:a])
            at = z
        kept.append(text[at:])
        kept = b"".join(kept)
        return kept, len(text), len(text) - len(kept), len(runs), [x for r in runs for x in r]

    return digest(docs, intervals(docs, s, compare), row,
                  {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "spans"})
