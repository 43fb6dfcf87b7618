"""Importance resampling: target / raw ratio of hashed n-gram models, Gumbel top-k.

The raw model counts the hashed unigrams and bigrams of every document; the
target model those of labelled good documents (a bounded sample: `SAMPLE`).  A
document's log weight is the log of target / raw, the sum over its n-grams;
with `length` their mean times that many, the weight of a passage of one length.
Adding Gumbel noise, keyed by doc_id, and keeping the k largest draws k documents
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.tables import documents
from docsift.llm.words import U64, Words, chunks, mix, text_buffers
from docsift.session import cut_lineage

#: Buckets of unigrams, and of bigrams; labelled target documents at most.
BUCKETS, SAMPLE, SMOOTH = 1 << 19, 20_000, 0.5


def _grams(raw, off, i, j):
    """(text index, bucket) of the unigrams and bigrams of texts i..j-1."""
    w = Words(raw, off, i, j, lower=True)
    g, inside = w.grams(2)
    at = np.flatnonzero(inside)
    low = U64(BUCKETS - 1)
    return (np.r_[w.doc, w.doc[at]],
            np.r_[(mix(w.h) & low).astype(np.int64), (mix(g[at]) & low).astype(np.int64) + BUCKETS])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): n-gram counts over all of `docs`; a map task sends each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                total += np.bincount(_grams(raw, off, i, j)[1], minlength=2 * BUCKETS)
        full = np.flatnonzero(total)
        for a in range(0, len(full), 100_000):
            f = full[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(total[f])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratio(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket; unigrams and bigrams are models of their own.

    The driver receives at most 2 * BUCKETS rows a model, whatever the input.
    """
    out = []
    for side in (target, docs):
        t = gram_counts(side).toArrow()
        c = np.full(2 * BUCKETS, SMOOTH)
        c[t.column("bucket").to_numpy()] += t.column("n").to_numpy()
        for half in (c[:BUCKETS], c[BUCKETS:]):
            half /= half.sum()
        out.append(np.log(c))
    return (out[0] - out[1]).astype(np.float32)


def good_ids(labels: DataFrame, limit: int = SAMPLE) -> tuple[DataFrame, float]:
    """(t_id of at most `limit` good labelled documents, share of good ones among all labelled)."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    per = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("t_id")).agg(
        F.min(good.cast("int")).alias("good"))
    share = per.agg(F.avg("good")).first()[0]
    return (per.filter("good = 1").orderBy(F.xxhash64("t_id"), "t_id").limit(limit).select("t_id"),
            1.0 if share is None else share)


def weigh(docs: DataFrame, ratio: np.ndarray, length: float | None = None) -> DataFrame:
    """(doc_id, n_grams, log_weight): sum of the n-grams' log ratios, or `length` times their mean.

    Documents without words weigh 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)      # 2 * BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                d, g = _grams(raw, off, i, j)
                n = np.bincount(d, minlength=j - i)
                s = np.bincount(d, weights=r[g], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)),
                     pa.array(s if length is None else length * s / np.maximum(n, 1))], names=["doc_id", "n_grams", "log_weight"])

    return docs.mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from 52 hash bits of doc_id: the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(-F.ln(u))


def kth_largest(scores: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, by histograms of ever narrower ranges.

    Each round aggregates at most `bins` rows; nothing is sorted or collected.
    """
    lo, hi, n = scores.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return lo
    rest = k                                                    # rank counted from hi downwards
    while True:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        part = scores.filter((F.col(col) >= lo) & (F.col(col) <= hi))
        b = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int").alias("b")
        rows = part.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if rest <= r.n:
                break
            rest -= r.n
        if r.lo == r.hi or (r.lo == lo and r.hi == hi):
            return r.lo
        lo, hi = r.lo, r.hi


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17,
                        sample: int = SAMPLE, length: float | None = None) -> DataFrame:
    """(doc_id, n_grams, log_weight, score, kept) for every document.

    kept: the ceil(share * n) largest scores; ties at the last place are all
    kept.  share: by default the labels' share of good documents.  length: see
    `weigh`.  Null, empty and wordless texts weigh 0 (neutral); rows with equal
    doc_id share noise, as do all rows with a null one; repeated rows all count.
    Columns other than doc_id and text are not read.
    """
    docs = documents(docs)
    ids, good = good_ids(labels, sample)
    target = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("t_id"), "left_semi")
    scored = cut_lineage(weigh(docs, log_ratio(docs, target), length).withColumn(
        "score", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    k = int(np.ceil((good if share is None else share) * scored.count()))
    least = kth_largest(scored, "score", k)
    return scored.withColumn("kept", F.col("score") >= F.lit(least) if least is not None else F.lit(False))
