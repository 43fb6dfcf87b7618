"""Exact n-gram Jaccard self-join by universe partitioning and pigeonhole.

Sets x, y with J >= 3/4 differ in at most H = (|x| + |y|) // 7 shingles.  Sets are
banded by size (powers of two); a band's universe is cut by hash into m
segments.  If a set has more than H non-empty segments, at least one equals the
partner's, so it is enough to index as many leading non-empty segment subsets
as that and to meet on equal ones.  Costs decide what is indexed:

* a segment costs one row, so a set stops after H + 1 + slack segments;
* empty segments (which every set shares) cost too many candidates: none are indexed;
* sets with too few non-empty segments also index the one-deletion
  neighbourhoods of all of theirs, worth two differences each;
* subsets held by more than GROUP sets are hot: each meets one hub; a set whose
  slack covers its hot segments needs no more, and the others meet the sets of
  other components in as many of their smallest hot groups as they lack.

Candidates pass a parity sketch (an exact bound) and are verified on the texts.  A pair is lost only by a collision of
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.tables import connected_components, documents, same_columns, whole_rows
from docsift.llm.words import Prefix, U64, Words, chunks, mix, text_buffers
from docsift.session import cut_lineage

SHINGLE, GROUP, BLOCK = 5, 16, 2048
#: Signatures a reducing task holds (24 bytes each), and a mapping task before it emits.
TASK_SIGNATURES, HELD = 4_000_000, 2_000_000


def shingle_sets(raw, offsets, i: int, j: int, k: int = SHINGLE):
    """(text index, element hash) of texts' distinct shingles, sorted by both; sizes."""
    w = Words(raw, offsets, i, j, lower=True)
    g, inside = w.grams(k)
    at = np.flatnonzero(inside)
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    whole = Prefix(w.h).of(w.first[short], w.first[short + 1])
    doc = np.r_[w.doc[at], short]
    e = mix(np.r_[g[at], whole])
    order = np.lexsort((e, doc))
    doc, e = doc[order], e[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (e[1:] != e[:-1])][:len(doc)]
    doc, e = doc[new], e[new]
    return doc, e, np.bincount(doc, minlength=j - i)


def set_hashes(doc: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hash of each set (by text index); empty sets get 0."""
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if len(full):
        start = np.searchsorted(doc, full)
        out[full] = mix(np.add.reduceat(mix(e + U64(77)), start) + n[full].astype(U64))
    return out


def segments(band: np.ndarray) -> np.ndarray:
    """Segments of a band's universe: 0.85 for each element of its least set."""
    return np.maximum(1, np.ceil(0.85 * 2.0 ** band)).astype(np.int64)


def slack(h: np.ndarray) -> np.ndarray:
    """Segments indexed beyond H + 1, to make up for hot ones."""
    return 8 + h // 4


def signatures(doc: np.ndarray, e: np.ndarray, n: np.ndarray, seed: int = 0, only: np.ndarray | None = None):
    """(text index, signature, band, spare) of all texts' index entries.

    spare: the segments a text indexes beyond H + 1; -1 where it has fewer and
    relies on deletions.
    """
    cls = np.zeros(len(n), np.int64)
    cls[n > 0] = np.floor(np.log2(n[n > 0])).astype(np.int64)
    cls = np.where((n > 0) & (2 ** cls > n), cls - 1, cls)
    out = []
    for high in (False, True):
        band = cls - high
        use = (n > 0) & (band >= 0)
        if high:
            use &= 3 * n <= 4 * (2 ** cls - 1)
        if only is not None:
            use &= only
        partner = np.where(high, 2 ** cls - 1, 4 * n // 3)
        h = (n + partner) // 7
        on = use[doc]
        d, x = doc[on], e[on]
        if not len(d):
            continue
        if seed:
            x = mix(x + U64(seed))
            order = np.lexsort((x, d))
            d, x = d[order], x[order]
        m = segments(np.maximum(band, 0))
        seg = ((x >> U64(32)) * m[d].astype(U64)) >> U64(32)     # grows with x: segments are runs
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])])
        y = mix(x + U64(11))
        total = np.add.reduceat(y, first)
        gd, size = d[first], np.diff(np.r_[first, len(d)])
        filled = np.bincount(gd, minlength=len(n))
        rank = np.arange(len(gd)) - np.searchsorted(gd, gd)
        salt = mix((band[gd].astype(U64) << U64(40)) + (U64(seed) << U64(34)) + seg[first] + U64(5))
        need = h + 1 + slack(h)
        keep = rank < need[gd]
        spare = np.where(filled >= h + 1, np.minimum(filled, need) - h - 1, -1)
        out.append((gd[keep], mix(total[keep] + salt[keep]), band[gd[keep]], spare[gd[keep]]))
        # one-deletion neighbourhoods of sets with too few segments
        poor = use & (filled < h + 1)
        if poor.any():
            group = np.repeat(np.arange(len(first)), size)
            sel = poor[d] & (size[group] > 1)
            g = group[sel]
            out.append((d[sel], mix(total[g] - y[sel] + salt[g]), band[d[sel]], spare[d[sel]]))
            worth = np.bincount(gd, weights=np.minimum(size, 2), minlength=len(n))
            weak = np.flatnonzero(poor & (worth < h + 1))
            if len(weak):
                out += _weak(weak, doc, e, n, h, band, seed)
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _weak(weak, doc, e, n, h, band, seed):
    """Entries of sets so crowded into few segments that single deletions do not suffice.

    Small sets index every subset with up to H deletions (two such sets meet on
    their intersection); larger ones are cut by further hash functions.
    """
    out = []
    for t in weak[n[weak] < 16].tolist():    # sums of uint64 wrap on purpose
        own = mix(e[doc == t] + U64(11))
        salt = mix(np.array([(int(band[t]) << 40) + (1 << 39)], U64))[0]
        sums = [np.delete(own, cut).sum()
                for k in range(int(h[t]) + 1) for cut in combinations(range(len(own)), k)]
        sig = mix(np.array(sums, U64) + salt)
        out.append((np.full(len(sig), t), sig, np.full(len(sig), band[t]), np.full(len(sig), -1)))
    large = weak[n[weak] >= 16]
    if len(large) and not seed:
        only = np.zeros(len(n), bool)
        only[large] = True
        out += [signatures(doc, e, n, s, only) for s in range(1, 5)]
    return out


def parities(doc: np.ndarray, e: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: bit c tells whether cell c holds an odd number of elements.

    Cells are a power of two, 64 or more and at least four times the set's size,
    so that few differences share a cell: the bound is near the difference
    itself.  Sketches of two sets differ in at most as many bits as the sets in elements.
    """
    bound, out = np.r_[0, np.cumsum(n)], []
    for a, z in zip(bound[:-1].tolist(), bound[1:].tolist()):
        cells = max(64, 4 << (z - a - 1).bit_length()) if z > a else 64
        odd = np.bincount((e[a:z] & U64(cells - 1)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference from two sketches; the longer is folded."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def classes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch) of every document; set_id 0: no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                doc, e, n = shingle_sets(raw, off, i, j, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)),
                     pa.array(set_hashes(doc, e, n).view(np.int64)), pa.array(parities(doc, e, n), pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id long, sketch binary")


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set_ids, as the documents (a, b) that stand for them, whose sketches allow a link.

    sets: (set_id, rep, n, sketch).  No pair with J >= 3/4 is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n, m = (b.column(c).to_pylist() for c in ("sx", "sy", "nx", "ny"))
            ok = pa.array([7 * least_difference(p, q) <= i + j for p, q, i, j in zip(x, y, n, m)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("x", "y")], names=["x", "y"])

    for side, s in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), F.col("rep").alias(s),
                                       F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")), side)
    return pairs.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(run, "x long, y long").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


SET = np.dtype([("set_id", "<i8"), ("n", "<i4"), ("info", "<i4"), ("entries", "<i4")])


def bucket_keys(spark, parts: int) -> np.ndarray:
    """One key for each of `parts` hash partitions, so that buckets are dealt out evenly."""
    rows = (spark.range(64 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p"))
            .groupBy("p").agg(F.min("id").alias("id")).collect())            # parts rows
    keys = {r.p: r.id for r in rows}
    return np.array([keys.get(p, 64 * parts + p) for p in range(parts)], np.int64)


def index(docs: DataFrame, keys: np.ndarray, k: int = SHINGLE) -> DataFrame:
    """Rows (bucket, sets, sigs): the entries of a map task by bucket.

    sets: set_id, size, band << 16 | spare + 1 and number of entries of each set;
    sigs: the sets' signatures (48 bits each; the bucket stands for more) one
    after another.  Equal sets of a task are indexed once.
    """
    buckets = len(keys)

    def flush(held):
        sid, n, sig, info = (np.concatenate(c) for c in zip(*held))
        low = 16 if buckets <= 1 << 16 else 32
        bucket = (((sig & U64((1 << low) - 1)) * U64(buckets)) >> U64(low)).astype(np.int64)
        order = np.lexsort((info, sid, bucket))
        sid, n, sig, info, bucket = (c[order] for c in (sid, n, sig, info, bucket))
        new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (sid[1:] != sid[:-1]) | (info[1:] != info[:-1])])
        sets = np.empty(len(new), SET)
        sets["set_id"], sets["n"], sets["info"] = sid[new].view(np.int64), n[new], info[new]
        sets["entries"] = np.diff(np.r_[new, len(sid)])
        six = np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
        cut = np.flatnonzero(np.r_[True, np.diff(bucket[new]) != 0])
        rows_s = np.r_[cut, len(new)].tolist()
        rows_e = np.r_[new[cut], len(sid)].tolist()
        return pa.RecordBatch.from_arrays([
            pa.array(keys[bucket[new[cut]]]),
            pa.array([sets[a:z].tobytes() for a, z in zip(rows_s, rows_s[1:])], pa.binary()),
            pa.array([six[a:z].tobytes() for a, z in zip(rows_e, rows_e[1:])], pa.binary())],
            names=["bucket", "sets", "sigs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                doc, e, n = shingle_sets(raw, off, i, j, k)
                sid = set_hashes(doc, e, n)
                fresh = np.zeros(len(n), bool)
                for t, s in enumerate(sid.tolist()):
                    if s and s not in seen:
                        seen.add(s)
                        fresh[t] = True
                t, sig, band, spare = signatures(doc, e, n, 0, fresh)
                if len(t):
                    held.append((sid[t], n[t].astype(np.int64), sig, (band << 16) | (spare + 1)))
                    size += len(t)
                if size >= HELD:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "bucket long, sets binary, sigs binary")


def meet(indexed: DataFrame, parts: int, group: int = GROUP) -> DataFrame:
    """(kind, a, b, n, info) from equal signatures.

    kind 0: candidate pair of set_ids a < b.  kind 1: set b (of size n, with
    band and spare in info) holds the hot signature a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sigs = [], []
        for b in batches:
            for s, g in zip(b.column("sets"), b.column("sigs")):
                sets.append(np.frombuffer(s.as_buffer(), SET))
                six = np.frombuffer(g.as_buffer(), np.uint8).reshape(-1, 6)
                wide = np.zeros((len(six), 8), np.uint8)
                wide[:, :6] = six
                sigs.append(wide.view("<u8").ravel())
        if not sets:
            return
        table, sig = np.concatenate(sets), np.concatenate(sigs)
        sets.clear(), sigs.clear()
        row = np.repeat(np.arange(len(table)), table["entries"])
        order = np.lexsort((table["set_id"][row], sig))
        sig, row = sig[order], row[order]
        sid = table["set_id"][row]
        one = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])]      # a set once per signature
        sig, row, sid = sig[one], row[one], sid[one]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[first, len(sig)])
        n = table["n"][row].astype(np.int64)
        pairs = []

        def keep(x, y):
            ok = 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
            if ok.any():
                pairs.append(np.unique(np.c_[sid[x[ok]], sid[y[ok]]], axis=0))

        for f in np.unique(size[(size > 1) & (size <= group)]).tolist():
            at = first[size == f]
            for x, y in combinations(range(f), 2):
                keep(at + x, at + y)
        hot = np.flatnonzero(size > group)
        member = np.repeat(first[hot], size[hot])
        place = np.arange(len(member)) - np.repeat(np.cumsum(size[hot]) - size[hot], size[hot]) + member
        if len(hot):
            tail = place > member
            keep(member[tail], place[tail])
        if pairs:
            p = np.unique(np.concatenate(pairs), axis=0)
            for a in range(0, len(p), 100_000):
                q = p[a:a + 100_000]
                zero = np.zeros(len(q), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32)), pa.array(q[:, 0].copy()),
                                                  pa.array(q[:, 1].copy()), pa.array(zero), pa.array(zero)], names=names)
        for a in range(0, len(place), 100_000):
            r = place[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(len(r), np.int32)), pa.array(sig[r].view(np.int64)), pa.array(sid[r]),
                pa.array(n[r]), pa.array(table["info"][row[r]].astype(np.int64))], names=names)

    names = ["kind", "a", "b", "n", "info"]
    return (indexed.repartition(parts, "bucket").select("sets", "sigs")
            .mapInArrow(run, "kind int, a long, b long, n long, info long"))


def hot_members(member: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, set_id, rep, n, f, probe) of hot signatures; f: the holders of a signature.

    A set needs any H + 1 of its indexed segments compared.  What its spare and
    ordinary ones leave it picks from its hot ones, those of the smallest groups
    first (probes).
    """
    m = member.select(F.col("a").alias("sig"), F.col("b").alias("set_id"), "n", F.pmod("info", F.lit(65536)).alias("spare"), "info")
    size = m.groupBy("sig").agg(F.count(F.lit(1)).alias("f"))
    m = cut_lineage(m.join(size, "sig"))
    hot = m.groupBy("set_id", "info").agg(F.count(F.lit(1)).alias("hot"))
    rank = F.row_number().over(Window.partitionBy("set_id", "info").orderBy("f", "sig"))      # at most m rows a set
    probes = (m.withColumn("rank", rank).join(hot, ["set_id", "info"])
              .withColumn("probe", F.col("rank") <= F.col("hot") - F.greatest(F.col("spare") - 1, F.lit(0)))
              .select("sig", "set_id", "n", "f", "probe"))
    return cut_lineage(probes.join(sets.select("set_id", "rep"), "set_id"))


def unmet(hot: DataFrame, sets: DataFrame, comp: DataFrame, parts: int, nearest: bool) -> DataFrame:
    """Plausible pairs (a, b) of documents that hot signatures hide, in different components.

    A group's probes meet its sets of other components in block pairs of at
    most 2 * BLOCK sets, whose sketches are compared inside the task; only
    pairs that may be linked come out.  With `nearest`, a task gives only the
    nearest partner of each probing set.
    """
    c = comp.select(F.col("id").alias("rep"), "comp")
    named = cut_lineage(hot.join(c, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
    mixed = (named.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                      F.max("probe").alias("any")).filter("c0 <> c1 and any").select("sig"))
    blocks = F.ceil(F.col("f") / BLOCK).cast("int")
    dealt = (named.join(mixed, "sig", "left_semi").join(sets.select("set_id", "sketch"), "set_id")
             .withColumn("own", F.pmod(F.xxhash64("set_id"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                     "own", "rep", "n", "comp", "probe", "sketch"))

    def group(rows: list[dict], found: dict) -> None:
        width = min(len(r["sketch"]) for r in rows)
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(r["sketch"], U64).reshape(-1, width // 8), axis=0)
                         for r in rows])
        rep, n, cid, own, probe = (np.array([r[c] for r in rows]) for c in ("rep", "n", "comp", "own", "probe"))
        x, y = rows[0]["x"], rows[0]["y"]
        for i in np.flatnonzero(probe).tolist():
            ok = (cid != cid[i]) & (4 * np.minimum(n, n[i]) >= 3 * np.maximum(n, n[i]))
            ok &= (own != own[i]) | (x == y)
            j = np.flatnonzero(ok)
            if len(j):
                d = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = 7 * d <= n[j] + n[i]
                me, others = int(rep[i]), zip(d[near].tolist(), rep[j[near]].tolist())
                if not nearest:
                    found.update(((min(me, r), max(me, r)), None) for _, r in others)
                elif near.any():
                    found[me] = min(min(others), found.get(me, (1 << 62, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, found = [], None, {}

        def emit():
            rows = [(min(a, b), max(a, b)) for a, (_, b) in found.items()] if nearest else list(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)],
                                              names=["a", "b"])

        for b in batches:
            for r in b.to_pylist():
                at = (r["sig"], r["x"], r["y"])
                if at != key:
                    if len(held) > 1:
                        group(held, found)
                    held, key = [], at
                    if len(found) > 100_000:
                        yield emit()
                held.append(r)
        if len(held) > 1:
            group(held, found)
        yield emit()

    return (dealt.repartition(parts, "sig", "x", "y").sortWithinPartitions("sig", "x", "y")
            .mapInArrow(run, "a long, b long").distinct())


def verify(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of document ids whose texts' shingle sets have J >= 3/4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ra, oa), (rb, ob) = text_buffers(b.column("ta")), text_buffers(b.column("tb"))
            for i, j in chunks(oa + ob - oa[0] - ob[0]):
                da, ea, na = shingle_sets(ra, oa, i, j, k)
                db, eb, nb = shingle_sets(rb, ob, i, j, k)
                d, e = np.r_[da, db], np.r_[ea, eb]
                order = np.lexsort((e, d))
                d, e = d[order], e[order]
                both = np.bincount(d[1:][(d[1:] == d[:-1]) & (e[1:] == e[:-1])], minlength=j - i)
                ok = pa.array((na > 0) & (100 * both >= 75 * (na + nb - both)))
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i).filter(ok) for c in ("a", "b")],
                                                 names=["a", "b"])

    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = cut_lineage(texts.join(need, texts.doc_id == need.id).select("id", "text"))
    rows = (pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(own.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"))
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def ngram_components(docs: DataFrame, k: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id): linked texts share the smallest doc_id they reach.

    Words are maximal runs of non-ASCII-space bytes, A-Z lower-cased.  Texts of
    fewer than k words are one shingle; null, empty and blank texts have none and
    are linked with nothing.  Texts with equal sets are linked whatever their
    number (one row each, never pairs).  Rows with equal doc_id keep their own
    n_shingles and share links.  A row with a null doc_id is no member of a
    component (it has no name to give): n_shingles, and a null component_id
    unless its set is that of a named document; `keep_one` links such rows too.
    """
    docs = documents(docs)
    spark = docs.sparkSession
    cls = cut_lineage(classes(docs, k))
    sets = cut_lineage(cls.filter("set_id <> 0").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")))
    total = cls.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // (2 * TASK_SIGNATURES) + 1)
    met = cut_lineage(meet(index(docs, bucket_keys(spark, parts), k), parts, group))
    ids = sets.select("set_id", "rep")
    pairs = cut_lineage(plausible(met.filter("kind = 0").select("a", "b").distinct(), sets))
    links = cut_lineage(verify(pairs, docs, k).distinct())
    comp = cut_lineage(connected_components(None, links))
    # nearest partners first, as long as they mostly are links: that joins a crowd in few rounds
    # and without its pairs; then every plausible pair that is still in two components
    hot, nearest = hot_members(met.filter("kind = 1"), sets), True
    while True:
        pairs = cut_lineage(unmet(hot, sets, comp, parts, nearest))
        if pairs.isEmpty():
            break
        new = cut_lineage(verify(pairs, docs, k).distinct())
        n_new = new.count()
        if n_new:
            links = cut_lineage(links.unionByName(new).distinct())
            comp = cut_lineage(connected_components(None, links))
        if not nearest:
            break
        nearest = 2 * n_new >= pairs.count()
    named_sets = ids.join(comp, F.col("rep") == F.col("id"), "left").select(
        F.col("set_id").alias("s"), F.coalesce("comp", "rep").alias("c"))
    return cls.join(named_sets, F.col("set_id") == F.col("s"), "left").select(
        "doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """`docs` with one document of each component: that of the smallest doc_id, a null one being the least.

    Rows with equal doc_id are documents of their own if their texts differ (the
    lesser hash of both stays if they are linked); repeated rows, equal in both,
    stay or go together.  All columns stay, of any name.
    """
    # a key of id and text stands for the document in the join; ids come back to choose
    rows = whole_rows(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    comp = ngram_components(rows.select(F.col("key").alias("doc_id"), "text"), k).select(
        F.col("doc_id").alias("of"), F.col("component_id").alias("comp")).dropDuplicates(["of"])
    linked = cut_lineage(rows.select("doc_id", "key").distinct().join(comp, F.col("key") == F.col("of")))
    first = linked.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(
        "comp", F.col("first.key").alias("stays"))
    drop = linked.join(first, "comp").filter("key <> stays").select(F.col("key").alias("goes"))
    return same_columns(rows.join(drop, F.col("key") == F.col("goes"), "left_anti"), docs)
