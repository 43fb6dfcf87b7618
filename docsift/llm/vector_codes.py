"""Vector codes: each vector as one entry index per part, entries fitted by rounds of exact assignment.

Components become integers, floor(1024 * x); vectors are cut into equal
consecutive parts with a codebook each.  The nearest entry is found in a
geometric near-neighbour access tree (Brin 1995) over the entries: a node holds
split points and, for every (split point, other child) pair, the range of
distances from the point to the child's entries.  A query's distances to the
split points drop every child whose range proves it farther than the best
entry so far.  Bounds are rounded outwards and a child goes only if it is
strictly farther, so entries at equal distance are still compared, by exact
integers, ties to the lower index.

A round is one pass over the vectors: each task adds up its parts by entry, the
shuffle carries at most entries x width numbers per task, and the codebooks
(entries x dimension numbers) are the only thing the driver holds.

Rows whose vector is null or has a null, NaN or infinite component are left
out.  Equal and null `vec_id`s are rows like others; the first codebook takes
null ids last and orders equal ids by their components.  With fewer rows than
entries all rows are the first codebook.  All vectors must have one length, a
multiple of the number of parts, and components below 2**42 in magnitude
(else ValueError).  `error` and `label_error` beyond a long are null.  Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.tables import join_counted
from docsift.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a tree node; nodes of at most LEAF entries are not split; vectors searched at a time.
SPLITS, LEAF, BLOCK = 12, 16, 4096
#: Relative widening of distances: far above the rounding of a square root and a difference.
_OUT, _IN = 1 + 1e-12, 1 - 1e-12


def squared(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of q to rows of e (floats hold integers below 2**53)."""
    if q.dtype == object:
        return ((q[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    return (q * q).sum(axis=1)[:, None] + (e * e).sum(axis=1)[None, :] - 2 * (q @ e.T)


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


class Tree:
    """Near-neighbour access tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)), splits, leaf)

    def _node(self, idx: np.ndarray, splits: int, leaf: int) -> dict:
        if len(idx) <= max(leaf, 1):
            return {"points": idx, "children": []}
        e = self.entries[idx]
        chosen, gap = [0], squared(e, e[:1])[:, 0]
        while len(chosen) < min(splits, len(idx)):            # farthest from all chosen so far
            gap[chosen[-1]] = -1
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, squared(e, e[chosen[-1]:chosen[-1] + 1])[:, 0])
            gap[chosen] = -1
        chosen.sort()
        rest = np.setdiff1d(np.arange(len(idx)), chosen)
        d2 = squared(e, e[chosen])
        near = np.argmin(d2[rest], axis=1)
        children, low, high = [], [], []
        for j in range(len(chosen)):
            members = rest[near == j]
            if len(members):
                d = _root(d2[members])
                children.append((j, self._node(idx[members], splits, leaf)))
                low.append(d.min(axis=0) * _IN)
                high.append(d.max(axis=0) * _OUT)
        return {"points": idx[chosen], "children": children, "low": np.array(low), "high": np.array(high)}

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry index, exact squared distance) of every row of q."""
        index = np.full(len(q), len(self.entries), np.int64)
        best = np.full(len(q), -1, q.dtype)                   # -1: none yet
        self._search(self.root, q, np.arange(len(q)), index, best)
        return index, best

    def _search(self, node: dict, q: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        points = node["points"]
        d2 = squared(q[rows], self.entries[points])
        near = np.argmin(d2, axis=1)                          # points ascend: ties to the lower index
        d, i = d2[np.arange(len(rows)), near], points[near]
        old = best[rows]
        better = (old < 0) | (d < old) | ((d == old) & (i < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], i[better]
        if not node["children"]:
            return
        root = _root(d2)
        # least possible distance to each child: triangle inequality over all split points
        bound = np.stack([np.maximum(root * _IN - high, low - root * _OUT).max(axis=1)
                          for low, high in zip(node["low"], node["high"])], axis=1)
        for own in (True, False):                             # each row's own child first, for a good best
            for c, (j, child) in enumerate(node["children"]):
                ask = (near == j) if own else (near != j)
                ask &= bound[:, c] <= _root(best[rows]) * _OUT
                if ask.any():
                    self._search(child, q, rows[ask], index, best)


def integers(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """`df` without unusable vectors, with `v`: components as integers."""
    x = F.col(vector).cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return df.filter(F.coalesce(usable, F.lit(False))).withColumn("v", F.transform(x, lambda c: F.floor(c * scale)))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _typed(m: np.ndarray, peak: int, width: int) -> np.ndarray:
    """Floats where all squared distances stay exact in them, else Python integers."""
    return m.astype(np.float64 if 4 * width * peak * peak < 1 << 53 else object)


class Codebooks:
    """One list of entries per part."""

    def __init__(self, entries: list[np.ndarray], peak: int):
        self.entries, self.peak = entries, peak               # int64 arrays (entries x width)
        self.parts, (self.size, self.width) = len(entries), entries[0].shape

    def assign(self, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(entry index, squared distance) of all rows of m, part by part."""
        if not hasattr(self, "trees"):
            self.trees = [Tree(_typed(e, self.peak, self.width)) for e in self.entries]
        for p, tree in enumerate(self.trees):
            part = m[:, p * self.width:(p + 1) * self.width]
            found = [tree.nearest(_typed(part[i:i + BLOCK], self.peak, self.width))
                     for i in range(0, len(part), BLOCK)]
            yield np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def moved(self, table: DataFrame) -> "Codebooks":
        """Every entry replaced by the floor of the mean of its parts; unused entries stay."""
        dim, size, width = self.parts * self.width, self.size, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((self.parts, size, width + 1), np.int64 if self.peak < 1 << 31 else object)
            for batch in batches:
                m = _matrix(batch.column("v"), dim)
                for p, (index, _) in enumerate(self.assign(m)):
                    part = m[:, p * width:(p + 1) * width].astype(total.dtype)
                    np.add.at(total[p, :, :width], index, part)
                    np.add.at(total[p, :, width], index, 1)
            used = np.flatnonzero(np.repeat(total[:, :, width].ravel() > 0, width + 1))
            x = total.ravel()[used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array((x >> 32).astype(np.int64)), pa.array((x & 0xFFFFFFFF).astype(np.int64))],
                names=["slot", "high", "low"])

        sums = table.select("v").mapInArrow(run, "slot long, high long, low long").groupBy("slot").agg(
            F.sum("high").alias("high"), F.sum("low").alias("low")).collect()   # at most entries x (dim + parts)
        total = np.zeros(self.parts * size * (width + 1), object)
        for r in sums:
            total[r.slot] = (r.high << 32) + r.low
        total = total.reshape(self.parts, size, width + 1)
        new = [e.copy() for e in self.entries]
        for p in range(self.parts):
            for k in np.flatnonzero(total[p, :, width] > 0):
                new[p][k] = [x // int(total[p, k, width]) for x in total[p, k, :width]]
        return Codebooks(new, self.peak)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def fit(table: DataFrame, vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of an `integers` table (read once a round); None if it has no rows."""
    shape = table.agg(F.min(F.size("v")), F.max(F.size("v")),
                      F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    low, dim, peak = shape
    if low is None:
        return None
    if low != dim or dim % parts or dim == 0:
        raise ValueError(f"vectors of {low} to {dim} components: one length, a multiple of {parts}, is needed")
    if peak >= SCALE << 42:
        raise ValueError("a component of 2**42 or more in magnitude")
    first = table.select("v", F.col(vec_id).alias("_i")).orderBy(F.col("_i").asc_nulls_last(), "v").limit(entries)
    m = np.array([r.v for r in first.collect()], np.int64)    # at most `entries` rows
    books = Codebooks(np.split(m, parts, axis=1), int(peak))
    for _ in range(rounds):
        books = books.moved(table)
    return books


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of an `integers` table."""
    dim = books.parts * books.width
    digits = max(2, len(f"{books.size - 1:x}"))
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{k:0{digits}x}" for k in range(books.size)], dtype=object)
        for batch in batches:
            found = list(books.assign(_matrix(batch.column("v"), dim)))
            code = sum((names[i] for i, _ in found[1:]), names[found[0][0]])
            error = sum(d.astype(object) for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()),
                 pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    return table.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Code, error and the label's summed error of every usable vector."""
    table = cut_lineage(integers(df, vector, scale).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), "v"))
    books = fit(table, "vec_id", parts, entries, rounds)
    if books is None:
        none = F.lit(None)
        return table.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"),
                            none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    coded = cut_lineage(encode(table, books))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy("label").agg(
        F.when(F.count("error") == F.count(F.lit(1)), total).alias("total"), F.count(F.lit(1)).alias("rows"))
    return join_counted(coded, by_label, ["label"], "rows").select(
        "vec_id", "code", "error", F.expr("try_cast(total AS BIGINT)").alias("label_error"),
        F.lit(books.sha256()).alias("codebooks_sha256"))
