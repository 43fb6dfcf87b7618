"""Best-fit packing of tokenised documents into sequences of at most `size` tokens.

Tokenising runs once per document in Arrow batches.  Packing depends on piece
lengths alone, so it works on the histogram of lengths (at most `size` rows,
whatever the input): best-two-fit fills a bin greedily, then replaces its
smallest document by two unpacked ones that fit the widened gap more tightly,
and applies the bin's pattern as often as the counts allow.  Pieces find their
place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.tables import documents
from docsift.llm.words import U64, Prefix, Words, _BYTE, chunks, text_buffers
from docsift.session import cut_lineage

SIZE, END_ID = 4096, 1
#: Parts kept per Python worker (about 150 bytes each), and pieces in one ranking group.
CACHE_WORDS, GROUP_ROWS = 1_000_000, 200_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


_GAP = np.zeros(256, bool)
_GAP[[32, 10]] = True
_LETTER, _MARK, _ODD = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(c) for c in ".,;:!?"]] = True
_ODD[[ord("<"), *range(128, 256)]] = True


class WordIds:
    """Token ids of texts from a table of their parts' ids.

    The tokenizer cuts texts at white space, and between an ASCII letter and a
    mark, before anything else, so a text's ids are its parts' ids one after
    another; it lower-cases, so parts are keyed by the hash of their lower-case
    bytes (parts with `<`, which may be special tokens, or with non-ASCII bytes
    by their own).  A new part is encoded once per Python worker.
    """

    _loaded: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size()
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.reset()

    def reset(self) -> None:
        self.row: dict[int, int] = {}
        self.bound = np.zeros(1, np.int64)       # ids of row r: flat[bound[r]:bound[r + 1]]
        self.flat = np.zeros(0, np.uint32)

    @classmethod
    def at(cls, path: str) -> "WordIds":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        """Add words; those of letters are one pre-token each, so they go through as one text
        and are told apart by the word-end mark of their last token."""
        letters = [w for w in words if w.isalpha()]
        ids = self._encode(" ".join(letters))
        stop = np.flatnonzero(self.ends[ids]) + 1
        if letters and (len(stop) != len(letters) or stop[-1] != len(ids)):
            letters, stop, ids = [], stop[:0], ids[:0]           # not as expected: one by one
        done, begin = set(letters), np.r_[0, stop]
        others = [self._encode(w) for w in words if w not in done]
        at, k, parts = iter(others), 0, []
        for w in words:
            if w in done:
                parts.append(ids[begin[k]:begin[k + 1]])
                k += 1
            else:
                parts.append(next(at))
        base = len(self.bound) - 1
        self.row.update(zip(keys, range(base, base + len(keys))))
        self.bound = np.r_[self.bound, self.bound[-1] + np.cumsum([len(x) for x in parts])]
        self.flat = np.concatenate([self.flat, *parts])

    def chunk(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts i..j-1 one after another, bounds of each text)."""
        w = Words(raw, offsets, i, j, lower=True, between=_GAP)
        data, start, end, doc = w.data, w.start, w.end, w.doc
        odd = np.r_[0, np.cumsum(_ODD[data])]
        odd = odd[end] > odd[start]
        split = end - start > 1
        split[split] = _MARK[data[end[split] - 1]] & _LETTER[data[end[split] - 2]]
        at = np.arange(len(start)) + np.r_[0, np.cumsum(split)[:-1]] if len(start) else np.zeros(0, np.int64)
        n = len(start) + int(split.sum())
        s, e, k, d = (np.empty(n, x.dtype) for x in (start, end, w.h, doc))
        body = end - split
        s[at], e[at], d[at] = start, body, doc
        k[at] = w.bytes.of(start, body)
        if odd.any():
            k[at[odd]] = Prefix(_BYTE[data]).of(start[odd], body[odd]) ^ U64(0x5851F42D4C957F2D)
        m = at[split] + 1
        s[m], e[m], d[m] = body[split], end[split], doc[split]
        k[m] = w.bytes.of(body[split], end[split])
        u, first, inv = np.unique(k, return_index=True, return_inverse=True)
        if len(self.row) + len(u) > CACHE_WORDS:
            self.reset()
        keys = u.tolist()
        rows = np.fromiter((self.row.get(x, -1) for x in keys), np.int64, len(keys))
        new = np.flatnonzero(rows < 0)
        if len(new):
            text = data.tobytes()
            self._learn([keys[x] for x in new.tolist()],
                        [text[s[f]:e[f]].decode() for f in first[new].tolist()])
            rows[new] = np.arange(len(self.bound) - 1 - len(new), len(self.bound) - 1)
        size = (self.bound[rows + 1] - self.bound[rows])[inv]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(self.bound[rows][inv] - stop + size, size) + np.arange(total)]
        return ids, np.r_[0, np.cumsum(np.bincount(d, weights=size, minlength=j - i).astype(np.int64))]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """PIECES rows: documents' ids with `end_id`, cut into `size`-token pieces only if longer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.at(tokenizer)
        for b in batches:
            out = []
            docs, rows = b.column("doc_id").to_pylist(), b.column("row").to_pylist()
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                ids, bound = words.chunk(raw, off, i, j)
                for r, (x, y) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist()), i):
                    own = np.append(ids[x:y], np.uint32(end_id)).astype("<u4")
                    for k in range(0, len(own), size):
                        part = own[k:k + size]
                        out.append((docs[r], rows[r], k // size, k, len(part), zlib.crc32(part.tobytes())))
            if out:
                doc, row, piece, *rest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(piece, pa.int32()),
                     *(pa.array(c, pa.int64()) for c in rest)],
                    names=[x.split()[0] for x in PIECES.split(", ")])

    return documents(docs).withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", "text").mapInArrow(run, PIECES)


def best_two_fit(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: how many})] from counts[length]; every length is used up.

    Greedy: the longest that still fits, again and again.  Then the bin's
    smallest piece gives way to the two unpacked pieces that fill the widened
    gap best, if they fill it better than it did.
    """
    left = counts.astype(np.int64).copy()
    size = len(left) - 1
    fit = np.zeros(size + 1, np.int64)          # longest unpacked length <= i

    def refit():
        fit[:] = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))

    refit()
    out = []
    while fit[size]:
        used: dict[int, int] = {}
        gap = size
        while gap and (n := int(fit[gap])):
            k = int(min(gap // n, left[n] - used.get(n, 0)))
            if k <= 0:                          # used up in this bin: next shorter one
                n = next((int(m) for m in np.flatnonzero(left[:n])[::-1] if used.get(int(m), 0) < left[m]), 0)
                if not n:
                    break
                k = int(min(gap // n, left[n] - used.get(n, 0)))
            used[n] = used.get(n, 0) + k
            gap -= n * k
        small = min(used)
        if gap and sum(used.values()) > 1:
            room = gap + small
            free = left.copy()
            for n, k in used.items():
                free[n] -= k
            a = np.flatnonzero(free[:room])
            if len(a):
                avail = np.maximum.accumulate(np.where(free[:room + 1] > 0, np.arange(room + 1), 0))
                b = avail[room - a]
                twice = (b == a) & (free[a] < 2)
                b = np.where(twice, np.where(a > 0, avail[np.maximum(a - 1, 0)], 0), b)
                total = np.where(b > 0, a + b, 0)
                i = int(np.argmax(total))
                if total[i] > small and total[i] <= room:
                    used[small] -= 1
                    if not used[small]:
                        del used[small]
                    for n in (int(a[i]), int(b[i])):
                        used[n] = used.get(n, 0) + 1
        times = int(min(left[n] // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= times * k
        out.append((times, used))
        refit()
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Rank ranges of each length and where they go: one row per pattern and length.

    Sorted by (length, first rank).  Rows are at most patterns * sqrt(2 * size).
    """
    taken: dict[int, int] = {}
    rows, base = [], 0
    for times, used in patterns:
        at = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, taken.get(n, 0), times, base, at))
            taken[n] = taken.get(n, 0) + times * k
            at += n * k
        base += times
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": t[:, 0], "first": t[:, 1], "times": t[:, 2], "base": t[:, 3], "offset": t[:, 4]}


def place(pieces: DataFrame, size: int = SIZE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`pieces` with (sequence_id, offset); `pieces` must be a table (read twice).

    Ranks: row_number inside (length, salt) groups of about `group_rows` rows,
    plus the groups' offsets, so a length that a third of all pieces have is
    still spread over many tasks.
    """
    hist = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # <= size rows
    counts = np.zeros(size + 1, np.int64)
    for r in hist:
        counts[r.length] = r.n
    table = slots(best_two_fit(counts))
    salts = int(max(1, -(-counts.max(initial=0) // group_rows)))
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    sizes = keyed.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select(
        F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce("before", F.lit(0)).alias("before"))
    ranked = (keyed.withColumn("r", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("row", "piece")))
        .join(before, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
        .withColumn("rank", F.col("r") + F.col("before") - 1).drop("l", "s", "salt", "r", "before", "row"))
    lead = table["length"] * (1 << 40) + table["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(lead, length * (1 << 40) + rank, "right") - 1
            r = rank - table["first"][i]
            seq = table["base"][i] + r % table["times"][i]
            off = table["offset"][i] + (r // table["times"][i]) * length
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in OUT[:-2]), pa.array(seq), pa.array(off)], names=OUT)

    return ranked.select(*OUT[:-2], "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its place in a packed sequence.

    Null and empty texts are the end id alone; a long text is cut, never
    dropped; rows with equal doc_id are packed each.
    """
    return place(cut_lineage(token_pieces(docs, tokenizer, size, end_id)), size)
