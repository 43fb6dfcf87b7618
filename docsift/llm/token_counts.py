"""Edit-aware token counts: a segment tree of token counts per document.

A text is cut into leaves of about LEAF bytes that end after a space or
newline; the tokenizer cuts there before anything else, so a text's count is
the sum of its leaves'.  The tree is the array of a binary heap: node 1 is the
root, nodes P..2P-1 the leaves.  An edit re-encodes the leaves it touches, and
the next one while its own end is no longer a boundary, and updates the sums on
the path to the root.  Leaves that became one region leave empty ones before
it, so bounds and sums keep their length and the result is the tree of the
edited text, ready for the next edits.  A leaf grows by what is inserted into
it; `build_trees` on the edited text evens the leaves out again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.packing import WordIds
from docsift.llm.tables import documents
from docsift.llm.words import chunks, text_buffers
from docsift.session import cut_lineage

LEAF = 1024
EDITS = "array<struct<start:int,end:int,text:string>>"


def leaf_bounds(text: bytes, leaf: int = LEAF) -> list[int]:
    """Byte bounds of the leaves; each but the last ends after a space or newline."""
    out, at = [0], 0
    while len(text) - at > leaf:
        s, n = text.find(b" ", at + leaf - 1), text.find(b"\n", at + leaf - 1)
        cut = min(x for x in (s, n, len(text)) if x >= 0) + 1
        if cut >= len(text):
            break
        out.append(cut)
        at = cut
    return out + [len(text)]


def build_sums(counts: list[int]) -> list[int]:
    """Heap array of subtree sums over the leaves' counts."""
    p = 1 << max(0, len(counts) - 1).bit_length()
    tree = [0] * p + counts + [0] * (p - len(counts))
    for i in range(p - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def update(tree: list[int], leaf: int, count: int) -> None:
    """Set a leaf's count and the sums above it."""
    i = len(tree) // 2 + leaf
    delta = count - tree[i]
    while i:
        tree[i] += delta
        i //= 2


def _count(words: WordIds, parts: list[bytes]) -> list[int]:
    raw, off = text_buffers(pa.array(parts, pa.large_binary()).view(pa.large_string()))
    out: list[int] = []
    for i, j in chunks(off):
        out += np.diff(words.chunk(raw, off, i, j)[1]).tolist()
    return out


def build_trees(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, version, bounds, sums): version is the hash of the text the tree belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.at(tokenizer)
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                texts = [raw[off[r]:off[r + 1]].tobytes() for r in range(i, j)]
                bounds = [leaf_bounds(t, leaf) for t in texts]
                n = _count(words, [t[x:y] for t, c in zip(texts, bounds) for x, y in zip(c, c[1:])])
                sums, at = [], 0
                for c in bounds:
                    sums.append(build_sums(n[at:at + len(c) - 1]))
                    at += len(c) - 1
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("version").slice(i, j - i),
                     pa.array(bounds, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int64()))],
                    names=["doc_id", "version", "bounds", "sums"])

    return (documents(docs).withColumn("version", F.xxhash64("text")).select("doc_id", "version", "text")
            .mapInArrow(run, "doc_id long, version long, bounds array<int>, sums array<long>"))


def touched(bounds: list[int], text: bytes, edits: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """(first leaf, end leaf, new bytes) of the regions that edits change.

    edits: sorted, not overlapping.  A region grows to the right while its new
    bytes do not end at a boundary.
    """
    out, k, leaves = [], 0, len(bounds) - 1
    while k < len(edits):
        a = min(int(np.searchsorted(bounds, edits[k][0], "right")) - 1, leaves - 1)
        z, parts, at = a + 1, [], bounds[a]
        while True:
            while k < len(edits) and (edits[k][0] < bounds[z] or z == leaves):
                start, end, new = edits[k]
                parts += [text[at:start], new]
                at = end
                k += 1
                while bounds[z] < at:
                    z += 1
            whole = b"".join(parts) + text[at:bounds[z]]
            if z == leaves or not whole or whole.endswith((b" ", b"\n")):
                break
            z += 1
        out.append((a, z, whole))
    return out


def moved(bounds: list[int], regions: list[tuple[int, int, bytes]]) -> list[int]:
    """Bounds after the edits: a region's bytes are its last leaf, the ones before it are empty.

    Like this a place at a region's start, or at the end of the text, belongs to
    the leaf that holds the bytes around it, never to an empty one in its middle.
    """
    sizes = np.diff(bounds)
    for a, z, new in regions:
        sizes[a:z] = 0
        sizes[z - 1] = len(new)
    return [0, *np.cumsum(sizes).tolist()]


def edited(text: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """The text after its edits."""
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return b"".join([*parts, text[at:]])


def apply_edits(docs: DataFrame, trees: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens_before, n_tokens_after, n_edits, n_bytes, n_reencoded, text, version, bounds, sums).

    docs: (doc_id, text, edits: byte ranges of the text and what replaces them,
    sorted, not overlapping; null: none), other columns are not read; trees: of
    the same texts.  The last four columns are the edited text and its tree: the
    documents and the trees of the next edits.  Counts have no end id.  A null
    text is empty, a null doc_id a key like any other.  Rows with equal doc_id
    are counted each by their own text; repeated rows all stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.at(tokenizer)
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                rows, regions = [], []
                trees_, bounds, edits = (b.column(c).slice(i, j - i).to_pylist() for c in ("sums", "bounds", "edits"))
                for r in range(i, j):
                    text = raw[off[r]:off[r + 1]].tobytes()
                    own = [(x["start"], x["end"], x["text"].encode()) for x in edits[r - i] or ()]
                    found = touched(bounds[r - i], text, own)
                    regions += [x[2] for x in found]
                    rows.append((len(own), len(text), found, edited(text, own)))
                counts, out = iter(_count(words, regions)), []
                for tree, cuts, (n, size, found, new_text) in zip(trees_, bounds, rows):
                    before = tree[1]
                    for a, z, _ in found:
                        for k in range(a, z - 1):
                            update(tree, k, 0)
                        update(tree, z - 1, next(counts))
                    out.append((before, tree[1], n, size, sum(len(x[2]) for x in found), new_text,
                                moved(cuts, found), tree))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols[:5]),
                     pa.array(cols[5], pa.binary()).cast(pa.string()), pa.array(cols[6], pa.list_(pa.int32())),
                     pa.array(cols[7], pa.list_(pa.int64()))], names=[*names, "text", "bounds", "sums"])

    names = ["doc_id", "n_tokens_before", "n_tokens_after", "n_edits", "n_bytes", "n_reencoded"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "edits")
    t = trees.dropDuplicates(["doc_id", "version"]).select(
        F.col("doc_id").alias("d"), "version", "bounds", "sums")
    joined = base.withColumn("v", F.xxhash64("text")).join(
        t, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("v") == F.col("version")))
    return joined.select("doc_id", "text", "edits", "bounds", "sums").mapInArrow(
        run, ", ".join([*(f"{c} long" for c in names), "text string", "bounds array<int>", "sums array<long>"])).select(
        *names, "text", F.xxhash64("text").alias("version"), "bounds", "sums")


def cleaning_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): the edits a cleaning pass makes.

    A line that equals an earlier line of its text goes with its newline, and
    every run of five digits or more becomes 0.
    """
    number = re.compile(rb"[0-9]{5,}")

    def edits(text: bytes):
        out, seen, at = [], set(), 0
        for line in text.split(b"\n"):
            end = at + len(line)
            if line in seen and line.strip():
                out.append((at - 1, end, ""))
            else:
                seen.add(line)
                out += [(at + m.start(), at + m.end(), "0") for m in number.finditer(line)]
            at = end + 1
        return [{"start": s, "end": e, "text": t} for s, e, t in out]

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            own = [edits(raw[off[r]:off[r + 1]].tobytes()) for r in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(own, kind)],
                                             names=["doc_id", "text", "edits"])

    return documents(docs).mapInArrow(run, f"doc_id long, text string, edits {EDITS}")


def edit_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token counts before and after `cleaning_edits`, re-encoding touched leaves only."""
    trees = cut_lineage(build_trees(docs, tokenizer))
    return apply_edits(cleaning_edits(docs), trees, tokenizer)
