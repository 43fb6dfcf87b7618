"""Finding repeated windows of a fixed length: the steps both substring operators share.

A window is `size` consecutive units (bytes or words) of one text.  Every
window holds exactly one *anchor*: the leftmost least hash among its `unit`
k-grams.  The anchor depends on the window's content alone, so equal windows
have equal anchors at equal places, and about 2 / (size - k) of all positions
are anchors.  An anchor's *context* is every window that can hold it: up to
`size - k` units before it and `size` from it on.

1. `scan` emits anchors.  Equal contexts meet first inside the map task: all but
   the least are settled there, so a passage in a third of all texts costs one
   row per map task, not one per text.
2. `settle` finds equal contexts across tasks.
3. `contexts` fetches the text around anchors whose k-gram also stands in a
   different context (the only ones left to compare).
4. The operator compares contexts of one k-gram (suffix array or suffix tree)
   and yields the covered interval of each.
5. `digest` joins intervals to the texts by doc_id and cuts them out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.words import U64, Prefix, Words, _BYTE, chunks, mix, sliding_argmin, text_buffers
from docsift.session import cut_lineage

#: Bytes of text hashed at a time: about a hundred bytes of arrays stand for each.
CHUNK = 1 << 18
#: Stands for a null doc_id between tasks; the least id there is.
NO_ID = -(1 << 63)
ANCHOR = ("doc_id long, pos int, lo int, hi int, gram long, ctx long, settled boolean")
INTERVAL = "doc_id long, start int, end int"
CONTEXT = "gram long, doc_id long, pos int, lo int, hi int, body binary"


@dataclass(frozen=True)
class Scheme:
    """size: units in a window; gram: units in an anchor; words: units are words, else bytes.

    earlier: a window counts as repeated only if a smaller doc_id has it; else if
    it starts anywhere else.  group_rows: k-grams with more contexts than this
    are not compared inside one task but by their windows' hashes.
    """

    size: int
    gram: int
    words: bool
    earlier: bool
    group_rows: int = 20_000


def _units(raw, off, i, j, words: bool):
    """(prefix hash, unit offsets of each text) of a chunk of texts."""
    if words:
        w = Words(raw, off, i, j)
        return Prefix(w.h), w.first, w
    data = raw[off[i]:off[j]]
    return Prefix(_BYTE[data]), off[i:j + 1] - off[i], data


def _anchors(prefix: Prefix, first: np.ndarray, s: Scheme):
    """(text index, position, left, right, gram hash, context hash) of a chunk's anchors."""
    n = len(prefix.s) - 1
    if n < s.size:
        return None
    at = np.arange(n - s.gram + 1)
    grams = prefix.of(at, at + s.gram)
    w = s.size - s.gram + 1
    if n < 1 << 24:
        # hash in the high bits, place in the low ones: the least is the leftmost least hash
        key = (grams & ~U64((1 << 24) - 1)) | at.astype(U64)
        span = 1
        while span * 2 <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < w:
            key = np.minimum(key[:len(key) - (w - span)], key[w - span:])
        least = (key & U64((1 << 24) - 1)).astype(np.int64)
    else:
        least = sliding_argmin(grams & ~U64((1 << 24) - 1), w)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:n - s.size + 1] == text[s.size - 1:]
    mark = np.zeros(n, bool)
    mark[least[inside]] = True
    pos = np.flatnonzero(mark)
    t = text[pos]
    left = np.minimum(s.size - s.gram, pos - first[t])
    right = np.minimum(s.size, first[t + 1] - pos)
    ctx = mix(prefix.of(pos - left, pos + right) + left.astype(U64) * U64(0xA24BAED4963EE407))
    return t, pos - first[t], left, right, grams[pos], ctx


def scan(docs: DataFrame, s: Scheme) -> DataFrame:
    """Anchors of every text; equal contexts of one map task are settled in it.

    settled: the context's whole interval [pos - lo, pos + hi) is covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off, CHUNK):
                prefix, first, _ = _units(raw, off, i, j, s.words)
                got = _anchors(prefix, first, s)
                if got is not None and len(got[0]):
                    t, pos, left, right, gram, ctx = got
                    found.append((ids[i:j][t].astype(np.int64), pos.astype(np.int32), left.astype(np.int32),
                                  right.astype(np.int32), gram.view(np.int64), ctx.view(np.int64)))
        if not found:
            return
        doc, pos, left, right, gram, ctx = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, doc, ctx))
        new = np.r_[True, np.diff(ctx[order]) != 0]
        run_id = np.cumsum(new) - 1
        size = np.bincount(run_id)
        settled = np.empty(len(doc), bool)
        if s.earlier:
            settled[order] = doc[order] > doc[order][new][run_id]
        else:
            # the first of a run stands for it; the others are only reported as settled
            settled[order] = size[run_id] > 1
        lead = np.empty(len(doc), bool)
        lead[order] = new if not s.earlier else ~settled[order]
        cols = [doc, pos, left, right, gram, ctx, settled, lead]
        names = ["doc_id", "pos", "lo", "hi", "gram", "ctx", "settled", "lead"]
        for a in range(0, len(doc), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 100_000]) for c in cols], names=names)

    return docs.mapInArrow(run, ANCHOR + ", lead boolean")


def settle(anchors: DataFrame, s: Scheme) -> tuple[DataFrame, DataFrame]:
    """(intervals settled by equal contexts, anchors left to compare).

    A context has at most one leading doc per map task, so the window's groups
    are bounded by the number of map tasks.
    """
    w = Window.partitionBy("ctx")
    lead = anchors.filter("lead")
    if s.earlier:
        lead = lead.withColumn("least", F.min("doc_id").over(w)).withColumn(
            "settled", F.col("doc_id") > F.col("least"))
        rep = lead.filter("not settled")
    else:
        lead = (lead.withColumn("rank", F.row_number().over(w.orderBy("doc_id", "pos")))
                .withColumn("settled", F.col("settled") | (F.count(F.lit(1)).over(w) > 1)))
        rep = lead.filter("rank = 1")
    covered = (anchors.filter("settled and not lead").select("doc_id", "pos", "lo", "hi")
               .unionByName(lead.filter("settled").select("doc_id", "pos", "lo", "hi"))
               .select("doc_id", F.expr("pos - lo").alias("start"), F.expr("pos + hi").alias("end")))
    return covered, rep.select("doc_id", "pos", "lo", "hi", "gram", "ctx")


def contexts(docs: DataFrame, rep: DataFrame, s: Scheme) -> DataFrame:
    """CONTEXT rows, with `hot`, of the anchors whose k-gram has a second context."""
    grams = (rep.groupBy("gram").agg(F.min("ctx").alias("c0"), F.max("ctx").alias("c1"),
                                     F.count(F.lit(1)).alias("n"))
             .filter("c0 <> c1").select(F.col("gram").alias("g"), (F.col("n") > s.group_rows).alias("hot")))
    wanted = (rep.join(grams, F.col("gram") == F.col("g"))
              .groupBy(F.col("doc_id").alias("d"))
              .agg(F.collect_list(F.struct("pos", "lo", "hi", "gram", "hot")).alias("places")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            raw, off = text_buffers(b.column("text"))
            places = b.column("places")
            flat, po = places.flatten(), np.r_[0, np.cumsum([len(x) for x in places])]
            f = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("pos", "lo", "hi", "gram", "hot")}
            for i, j in chunks(off, CHUNK):
                _, first, u = _units(raw, off, i, j, s.words) if s.words else (None, off[i:j + 1] - off[i],
                                                                               raw[off[i]:off[j]])
                sel = slice(po[i], po[j])
                t = np.repeat(np.arange(j - i), np.diff(po[i:j + 1]))
                pos, lo, hi = f["pos"][sel], f["lo"][sel], f["hi"][sel]
                a, z = first[t] + pos - lo, first[t] + pos + hi
                data = (u.data if s.words else u).tobytes()
                if s.words:
                    a, z = u.start[a], u.end[z - 1]
                body = [data[x:y] for x, y in zip(a.tolist(), z.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f["gram"][sel], pa.int64()), pa.array(ids[i:j][t].astype(np.int64)),
                     pa.array(pos, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                     pa.array(body, pa.binary()), pa.array(f["hot"][sel], pa.bool_())],
                    names=["gram", "doc_id", "pos", "lo", "hi", "body", "hot"])

    joined = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.d)).select("doc_id", "text", "places")
    return joined.mapInArrow(cut, CONTEXT + ", hot boolean")


def body_buffers(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of context bodies."""
    return text_buffers(pa.array(bodies, pa.large_binary()).view(pa.large_string()))


Compare = Callable[[dict, Scheme], tuple[np.ndarray, np.ndarray]]


def compare_groups(ctx: DataFrame, s: Scheme, compare: Compare, rows: int = 20_000) -> DataFrame:
    """INTERVAL rows from comparing the contexts of each k-gram.

    Partitions hold whole k-grams, sorted; a task takes them through `compare`
    about `rows` contexts at a time, so memory is bounded by `rows` plus the
    largest group, which is at most `group_rows`.
    """

    def emit(part: pa.Table) -> pa.RecordBatch:
        c = {n: part.column(n).to_numpy() for n in ("gram", "doc_id", "pos", "lo", "hi")}
        c["body"] = part.column("body").to_pylist()
        lo, hi = compare(c, s)
        on = lo + hi >= s.size
        return pa.RecordBatch.from_arrays(
            [pa.array(c["doc_id"][on], pa.int64()), pa.array((c["pos"] - lo)[on].astype(np.int32)),
             pa.array((c["pos"] + hi)[on].astype(np.int32))], names=["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < rows:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("gram").to_numpy()
            cut = int(np.searchsorted(g, g[-1], "left"))
            if cut:
                yield emit(t.slice(0, cut))
                t = t.slice(cut).combine_chunks()
            held, n = t.to_batches(), t.num_rows
        if n:
            yield emit(pa.Table.from_batches(held))

    parts = int(ctx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (ctx.repartition(parts, "gram").sortWithinPartitions("gram")
            .select("gram", "doc_id", "pos", "lo", "hi", "body").mapInArrow(run, INTERVAL))


def compare_hot(ctx: DataFrame, s: Scheme) -> DataFrame:
    """INTERVAL rows of k-grams with too many contexts for one task.

    The prefix grows to the whole window: one row per window of a context, keyed
    by its hash, counted with map-side aggregation and joined back (a join AQE
    may split), so no task needs a group in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = body_buffers(b.column("body").to_pylist())
            c = {n: b.column(n).to_numpy() for n in ("doc_id", "pos", "lo")}
            for i, j in chunks(off, 1 << 18):
                prefix, first, _ = _units(raw, off, i, j, s.words)
                n = np.maximum(np.diff(first) - s.size + 1, 0)
                t = np.repeat(np.arange(j - i), n)
                k = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
                a = first[t] + k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix.of(a, a + s.size).view(np.int64)), pa.array(c["doc_id"][i:j][t], pa.int64()),
                     pa.array((c["pos"][i:j][t] - c["lo"][i:j][t] + k).astype(np.int32))],
                    names=["h", "doc_id", "start"])

    win = ctx.select("doc_id", "pos", "lo", "body").mapInArrow(run, "h long, doc_id long, start int").distinct()
    seen = win.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    hit = seen.filter("n > 1").select(F.col("h").alias("k"), "least")
    j = win.join(hit, F.col("h") == F.col("k"))
    if s.earlier:
        j = j.filter("doc_id > least")
    return j.select("doc_id", "start", F.expr(f"start + {s.size}").alias("end"))


def intervals(docs: DataFrame, s: Scheme, compare: Compare) -> DataFrame:
    """INTERVAL rows (overlapping) whose union per text is all it shares."""
    anchors = cut_lineage(scan(docs, s))
    covered, rep = settle(anchors, s)
    ctx = cut_lineage(contexts(docs, rep, s))
    rows = 4_000 if s.words else 20_000                   # a context of words is several times as long
    return (covered.unionByName(compare_groups(ctx.filter("not hot"), s, compare, rows))
            .unionByName(compare_hot(ctx.filter("hot"), s)))


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a union of intervals."""
    order = np.argsort(start, kind="stable")
    a, z = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, a[1:] > z[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(a) - 1]
    return list(zip(a[first].tolist(), z[last].tolist()))


_TYPES = {"long": ("long", pa.int64()), "binary": ("binary", pa.binary()),
          "spans": ("array<int>", pa.list_(pa.int32()))}


def coded(docs: DataFrame) -> DataFrame:
    """Null ids as NO_ID, so that ids stay integers in Arrow batches."""
    return docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def digest(docs: DataFrame, found: DataFrame, fn, columns: dict[str, str]) -> DataFrame:
    """One row per document: doc_id and what fn(text bytes, merged runs) returns as `columns`."""
    per = found.groupBy(F.col("doc_id").alias("d")).agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    kinds = [_TYPES[t] for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans = b.column("doc_id"), b.column("spans")
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off, 4 * CHUNK):
                rows = []
                for r in range(i, j):
                    sp = spans[r].values if spans[r].is_valid else ()
                    rows.append(fn(raw[off[r]:off[r + 1]].tobytes(), merged(
                        sp.field("start").to_numpy(), sp.field("end").to_numpy()) if len(sp) else []))
                arrays = [ids.slice(i, j - i)] + [pa.array(list(x), k[1]) for x, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])

    schema = ", ".join(["doc_id long", *(f"{n} {k[0]}" for n, k in zip(columns, kinds))])
    joined = docs.join(per, docs.doc_id.eqNullSafe(per.d), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
