"""Alignment of two tokenizers over a corpus: which ids stand for the same bytes, and how often.

Every text is encoded by both; byte offsets where tokens of both end cut it
into groups, and each overlap of an A token with a B token is a link.  An array
from A id to the B id of the same bytes, made once from the vocabularies, takes
the common case: a group of one token each that the array maps onto another is
counted in a vector as long as the vocabulary and never shuffled.  Only links
of other groups enter the shuffle of pairs, added up per task first.

Links are then scored by their pair's corpus-wide count.  Pairs of the array
and pairs with at least 1 / HEAVY of all links (at most the vocabulary plus
HEAVY in number) are looked up inside the tasks; all others are joined by
shuffle, where no pair holds more than that share of the links.

Null and empty texts, and texts that either tokenizer does not keep byte by
byte, have no tokens: zeros and an empty `groups_sha256`.  Rows are scored
each, equal or null `doc_id`s included; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.tables import documents
from docsift.llm.words import chunks, text_buffers
from docsift.session import cut_lineage

CHUNK, FLUSH, HEAVY = 1 << 18, 1 << 19, 100_000
#: Bytes of ids a writing task gathers before they go to disk.
ROW_GROUP = 8 << 20
#: Fixed value: how the byte-level vocabulary cuts texts into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Bytes of each id (`data[start[i]:start[i] + size[i]]`) and its decimal digits as a padded row."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        width = len(str(len(tokens)))
        self.digits = np.zeros((len(tokens), width + 1), np.uint8)
        for i in range(len(tokens)):
            s = str(i).encode()
            self.digits[i, :len(s)] = np.frombuffer(s, np.uint8)
        self.n_digits = (self.digits != 0).sum(axis=1)
        self.by_bytes: dict[bytes, int] = {}
        for i, t in enumerate(tokens):
            if t:
                self.by_bytes[t] = i          # a plain piece comes after the single-byte pieces

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.data[at + np.arange(len(at))]


class Pair:
    """Both tokenizers of a Python worker, loaded once."""

    _loaded: dict[tuple[str, str], "Pair"] = {}

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]   # bytes that stand for themselves
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        by_id = {i: t for t, i in ranks.items()}
        self.a = Vocabulary([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self.encode_a = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks,
                                          special_tokens={}).encode_to_numpy
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        tokens = []
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                tokens.append(bytes([int(p[3:5], 16)]))
            else:
                special = self.model.is_control(i) or self.model.is_unknown(i)
                tokens.append(b"" if special else p.replace("▁", " ").encode())
        self.b = Vocabulary(tokens)
        self.same = np.full(len(self.a.size), -1, np.int64)
        for t, i in ranks.items():
            self.same[i] = self.b.by_bytes.get(t, -1)

    @classmethod
    def at(cls, path_a: str, path_b: str) -> "Pair":
        key = (path_a, path_b)
        if key not in cls._loaded:
            cls._loaded[key] = cls(*key)
        return cls._loaded[key]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, tokens per text, ids of B, tokens per text, bytes per text).

        A text that either side does not give back byte by byte has no tokens.
        """
        none = np.zeros(0, np.int32)
        a, b, want = [], [], []
        for t, ids in zip(texts, self.model.encode(texts, num_threads=1) if texts else []):
            x, y, w = none, none, b""
            if t:
                w = (" " + t).encode()
                x = self.encode_a(" " + t, disallowed_special=()).astype(np.int32)
                y = np.array(ids, np.int32)
                if not (self._gives(self.a, x, w) and self._gives(self.b, y, w)):
                    x, y, w = none, none, b""
            a.append(x)
            b.append(y)
            want.append(len(w))
        count = lambda xs: np.array([len(x) for x in xs], np.int64)
        return (np.concatenate([none, *a]), count(a), np.concatenate([none, *b]), count(b),
                np.array(want, np.int64))

    @staticmethod
    def _gives(v: Vocabulary, ids: np.ndarray, want: bytes) -> bool:
        return int(v.size[ids].sum()) == len(want) and v.joined(ids).tobytes() == want


class Aligned:
    """Groups and links of a chunk of texts (all arrays over the chunk's bytes or tokens)."""

    def __init__(self, pair: Pair, texts: list[str]):
        a, self.n_a, b, self.n_b, size = pair.encode(texts)
        total, stop = int(size.sum()), np.cumsum(size)
        end_a, end_b = np.cumsum(pair.a.size[a]), np.cumsum(pair.b.size[b])
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[end_a], in_b[end_b] = True, True
        ends = np.flatnonzero(in_a | in_b)                # one link ends at each
        both = (in_a & in_b)[ends]
        self.link_a = a[(np.cumsum(in_a, dtype=np.int32) - in_a)[ends]].astype(np.int64)
        self.link_b = b[(np.cumsum(in_b, dtype=np.int32) - in_b)[ends]].astype(np.int64)
        alone = both.copy()
        alone[1:] &= both[:-1]                            # one token of each side
        self.fast = alone & (pair.same[self.link_a] == self.link_b)
        self.bound = np.concatenate([[0], np.searchsorted(ends, stop, "right")])
        common = ends[both]
        self.n_groups = np.diff(np.concatenate([[0], np.searchsorted(common, stop, "right")]))
        joint = in_a & in_b
        group = np.cumsum(joint, dtype=np.int32) - joint      # common ends before each byte offset
        self._groups(pair, a, b, group[end_a], group[end_b], len(common))

    def _groups(self, pair: Pair, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray,
                n: int) -> None:
        """`groups_sha256` of each text: ids as digit rows in their written order, separators in place."""
        per_a, per_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        at_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
        width = max(pair.a.digits.shape[1], pair.b.digits.shape[1])
        rows = np.zeros((len(a) + len(b), width), np.uint8)
        size = np.zeros(len(rows), np.int64)
        for v, ids, at, group, sign in ((pair.a, a, at_a, group_a, b"|"), (pair.b, b, at_b, group_b, b";")):
            last = np.ones(len(ids), bool)
            last[:-1] = group[1:] != group[:-1]
            x = np.zeros((len(ids), width), np.uint8)
            x[:, :v.digits.shape[1]] = v.digits[ids]
            x[np.arange(len(ids)), v.n_digits[ids]] = np.where(last, sign[0], ord(","))
            rows[at], size[at] = x, v.n_digits[ids] + 1
        text = rows[rows != 0].tobytes()
        byte = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        self.sha = [hashlib.sha256(text[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(byte[:-1], byte[1:])]


def _lists(values: np.ndarray, bound: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(values, kind))


def _within(keep: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bounds after only the marked elements stay."""
    return np.concatenate([[0], np.cumsum(keep)])[bound]


ALIGNED = ("part int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "fast array<int>, pairs array<long>, times array<long>")
SCORED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "n_best long, count_sum long, pairs array<long>, times array<long>")
_TEXTS, _FAST, _OTHERS = 0, 1, 2


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of `ALIGNED`: one per document (part 0), and each task's sums of links by pair (parts 1 and 2).

    A pair is `a id * 2**32 + b id`; `fast` holds the A ids of links that the
    identity array covers, `pairs` all other links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.at(path_a, path_b)
        vector = np.zeros(len(pair.same), np.int64)
        others: list[np.ndarray] = []

        def sums(part: int, pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            none = lambda kind: pa.nulls(1, kind)
            return _batch([pa.array([part], pa.int32()), *(none(pa.int64()) for _ in range(6)), none(pa.string()),
                           none(pa.list_(pa.int32())), _lists(pairs, [0, len(pairs)], pa.int64()),
                           _lists(times, [0, len(times)], pa.int64())], ALIGNED)

        for batch in batches:
            text = batch.column("text")
            for i, j in chunks(text_buffers(text)[1], CHUNK):
                m, n = Aligned(pair, text.slice(i, j - i).to_pylist()), j - i
                keys, fast = m.link_a << 32 | m.link_b, m.fast
                vector += np.bincount(m.link_a[fast], minlength=len(vector))
                others.append(keys[~fast])
                zero = np.zeros(n + 1, np.int32)
                yield _batch([pa.array(np.full(n, _TEXTS, np.int32)), batch.column("row").slice(i, n),
                              batch.column("doc_id").slice(i, n), pa.array(m.n_a), pa.array(m.n_b),
                              pa.array(m.n_groups), pa.array(np.diff(m.bound)), pa.array(m.sha, pa.string()),
                              _lists(m.link_a[fast], _within(fast, m.bound), pa.int32()),
                              _lists(keys[~fast], _within(~fast, m.bound), pa.int64()),
                              _lists(zero[:0], zero, pa.int64())], ALIGNED)
                if sum(map(len, others)) > FLUSH:
                    yield sums(_OTHERS, *np.unique(np.concatenate(others), return_counts=True))
                    others = []
        a = np.flatnonzero(vector)
        yield sums(_FAST, a << 32 | pair.same[a], vector[a])
        if others:
            yield sums(_OTHERS, *np.unique(np.concatenate(others), return_counts=True))

    return documents(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n links corpus-wide, best: n is the highest of its B id, fast) from an `align` table."""
    link = aligned.filter(F.col("part") > _TEXTS).select(
        (F.col("part") == _FAST).alias("fast"), F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    n = link.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"), F.max("fast").alias("fast"))
    n = cut_lineage(n.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    top = n.groupBy(F.col("b").alias("top_b")).agg(F.max("n").alias("top"))     # at most B's vocabulary
    return n.join(F.broadcast(top), F.col("b") == F.col("top_b")).select(
        "pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"), "fast")


def score(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """`n_best` and `count_sum` of every document; both inputs must be tables (read several times)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    light = F.col("n") * HEAVY < total
    known = counts.filter(F.col("fast") | ~light).select("pair", "n", "best", "fast").toPandas().sort_values("pair")
    pair, n, best = (known[c].to_numpy(np.int64) for c in ("pair", "n", "best"))
    # the array's ids, by A id (at most the vocabulary)
    fast = known[known.fast.astype(bool)]
    size = int((fast.pair.to_numpy(np.int64) >> 32).max(initial=-1)) + 1
    n_of, best_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row in fast.itertuples():
        n_of[row.pair >> 32], best_of[row.pair >> 32] = row.n, row.best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((2, len(batch)), np.int64)

            def add(values: np.ndarray, bound: np.ndarray, k: int) -> None:
                s = np.concatenate([[0], np.cumsum(values)])
                out[k] += s[bound[1:]] - s[bound[:-1]]

            def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
                col = batch.column(name)
                bound = col.offsets.to_numpy().astype(np.int64)
                return col.values.to_numpy()[bound[0]:bound[-1]].astype(np.int64), bound - bound[0]

            ids, bound = lists("fast")
            add(best_of[ids], bound, 0)
            add(n_of[ids], bound, 1)
            keys, bound = lists("pairs")
            at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            found = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            add(np.where(found, best[at], 0) if len(pair) else keys * 0, bound, 0)
            add(np.where(found, n[at], 0) if len(pair) else keys * 0, bound, 1)
            doc = np.repeat(np.arange(len(batch)), np.diff(bound))[~found]
            rest = keys[~found]
            order = np.lexsort((rest, doc))
            doc, rest = doc[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate([first, [len(rest)]]))
            bound = np.searchsorted(doc[first], np.arange(len(batch) + 1))
            yield _batch([*(batch.column(c) for c in _KEPT), pa.array(out[0]), pa.array(out[1]),
                          _lists(rest[first], bound, pa.int64()), _lists(times, bound, pa.int64())], SCORED)

    texts = aligned.filter(F.col("part") == _TEXTS).select(*_KEPT, "fast", "pairs")
    known_part = cut_lineage(texts.mapInArrow(run, SCORED), ROW_GROUP)
    rest = known_part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = rest.join(counts.filter(light & ~F.col("fast")), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return known_part.drop("pairs", "times").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Both steps: one row per document, scored by corpus-wide counts of id pairs."""
    aligned = cut_lineage(align(docs, path_a, path_b), ROW_GROUP)
    return score(aligned, cut_lineage(pair_counts(aligned)))
