"""Token operators: clean text, word statistics, token audits.

Tokenising and per-document counts of words are array expressions inside
the row (no shuffle).  Per-document term counts explode and aggregate with
map-side partial aggregation; corpus totals are one global aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import (
    COHERENCE_MIN_LEN, STOPWORD_SET, clean_text, join_text, tokens_alnum, tokens_coherence, tokens_prefilter,
    tokens_whitespace)
from docsift.session import cut_lineage

TOTAL_TITLE = "__TOTAL__"


def after_view(clean: DataFrame, stopwords=STOPWORD_SET) -> DataFrame:
    """DocIndex, Title_Clean, Abstract_Clean, Title_Abstract_Clean."""
    return (clean.select(F.col("doc_id").alias("DocIndex"),
                         clean_text("title", stopwords).alias("Title_Clean"),
                         clean_text("abstract", stopwords).alias("Abstract_Clean"))
            .withColumn("Title_Abstract_Clean", join_text("Title_Clean", "Abstract_Clean")))


def doc_term_freq(clean: DataFrame, text: str = "title_abstract",
                  stopwords=STOPWORD_SET) -> DataFrame:
    """Long table (doc_id, term, n, first_pos): count of each token per document.

    `posexplode` keeps the token position; the aggregate on (doc_id, term) is
    partial map-side (a document's tokens live in one input partition), so
    the shuffle carries distinct (document, term) pairs, not tokens.
    """
    toks = clean.select("doc_id", F.posexplode(tokens_alnum(text, stopwords)).alias("pos", "term"))
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"),
                                              F.min("pos").cast("long").alias("first_pos"))


def doc_tokens(clean: DataFrame, text: str = "title_abstract", stopwords=STOPWORD_SET) -> DataFrame:
    """(doc_id, tokens): the tokens that `doc_term_freq` counts, as one list a row."""
    return clean.select("doc_id", tokens_alnum(text, stopwords).alias("tokens"))


def doc_texts(clean: DataFrame, text: str = "title_abstract") -> DataFrame:
    """(doc_id, alnum_text): texts for `count_terms`, which counts the tokens of `doc_tokens` in them."""
    return clean.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("alnum_text"))


def coherence_texts(clean: DataFrame, text: str = "abstract") -> DataFrame:
    """(doc_id, coherence_text): lower-cased texts for `count_terms`, which counts the tokens of `coherence_tokens`."""
    return clean.select("doc_id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("coherence_text"))


_DIGITS, _SMALL, _CAPITALS = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))


def _table(kept: bytes, lower: bool) -> bytes:
    """Byte table for `bytes.translate`: kept bytes stay (capitals become small), all others become spaces."""
    out = bytearray(b" " * 256)
    for c in kept:
        out[c] = c
    if lower:
        out[65:91] = _SMALL
    return bytes(out)


#: Text column -> byte table, whether a run is no token.
TOKENIZERS = {
    "alnum_text": (_table(_DIGITS + _SMALL, True),
                   lambda t, stop=frozenset(w.encode() for w in STOPWORD_SET): t in stop or t.isdigit()),
    "coherence_text": (_table(_DIGITS + _SMALL + b"-", False), lambda t: len(t) < COHERENCE_MIN_LEN),
}
#: Bytes of text whose tokens a task holds as one array, and rows of counts it hands on at a time.
CHUNK_BYTES, HELD_TERMS = 32 << 20, 200_000


def text_column(df: DataFrame) -> str | None:
    """The column of `df` that `count_terms` reads, or None."""
    return next((c for c in TOKENIZERS if c in df.columns), None)


def runs(texts: pa.Array, style: str) -> Iterator[list[bytes]]:
    """The runs of each text, in order; those that are no tokens are among them."""
    table = TOKENIZERS[style][0]
    return (t.translate(table).split() for t in texts.cast(pa.binary()).to_pylist())


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of about `most` bytes together, at least one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _words(texts: list[bytes], style: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code, terms) of all runs of the texts in order: index of the text and of the run among the distinct terms."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = b" ".join([*texts, b""]).translate(TOKENIZERS[style][0])    # bytes to bytes, so the places stay
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(starts), pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(spaced)
    coded = lists.flatten().dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy(), coded.dictionary


def count_terms(style: str, key: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`mapInArrow` kernel: rows of a long `key` and a text to (key, term, n), counts of the tokens by key.

    Texts are taken apart some CHUNK_BYTES at a time and their tokens counted as
    numbers; a key and term come again with each chunk that holds them.
    """
    drop = TOKENIZERS[style][1]

    def counted(ks: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, of = np.unique(ks, return_inverse=True)
        text, code, terms = _words(texts, style)
        is_term = np.array([bool(t) and not drop(t) for t in terms.cast(pa.large_binary()).to_pylist()], bool)
        use = is_term[code]
        cells, n = np.unique(of[text[use]] * np.int64(max(len(terms), 1)) + code[use], return_counts=True)
        for i in range(0, len(cells), HELD_TERMS):
            part = cells[i:i + HELD_TERMS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part // len(terms)], pa.int64()), terms.take(pa.array(part % len(terms))).cast(pa.string()),
                 pa.array(n[i:i + HELD_TERMS], pa.int64())], [key, "term", "n"])

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, texts = batch[key].to_numpy(), batch[style].cast(pa.binary())
            for a, b in _chunks(pc.binary_length(texts).to_numpy(zero_copy_only=False), CHUNK_BYTES):
                yield from counted(ks[a:b], texts.slice(a, b - a).to_pylist())

    return kernel


def held_terms(vocab: Iterable[str], key: str = "doc_id") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`mapInArrow` kernel: rows of a `key` and `coherence_text` to (key, term), each token of `vocab` once a row."""
    drop = TOKENIZERS["coherence_text"][1]
    wanted = frozenset(w for w in (v.encode() for v in vocab) if not drop(w))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms = [], []
            for i, words in enumerate(runs(batch["coherence_text"], "coherence_text")):
                there = wanted.intersection(words)
                rows += [i] * len(there)
                terms += there
            for i in range(0, len(rows), HELD_TERMS):
                yield pa.RecordBatch.from_arrays(
                    [batch[key].take(pa.array(rows[i:i + HELD_TERMS], pa.int64())),
                     pa.array(terms[i:i + HELD_TERMS], pa.binary()).cast(pa.string())], [key, "term"])

    return kernel


def top_words(clean: DataFrame, k: int = 10, text: str = "title_abstract",
              stopwords=STOPWORD_SET) -> DataFrame:
    """Top-k words per document, wide: DocIndex, Title, Word_1, Count_1 ... Word_k, Count_k.

    Ranked by count desc, ties by first occurrence (a stable most-common
    ranking); padded with ('', 0).  `row_number() <= k` becomes a
    WindowGroupLimit, so only k rows per document survive the sort; the
    pivot is a grouped aggregate over at most k rows per document.
    """
    tf = doc_term_freq(clean, text, stopwords)
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), F.col("first_pos"))
    top = tf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    aggs = []
    for j in range(1, k + 1):
        aggs += [F.max(F.when(F.col("rank") == j, F.col("term"))).alias(f"Word_{j}"),
                 F.max(F.when(F.col("rank") == j, F.col("n"))).alias(f"Count_{j}")]
    wide = top.groupBy("doc_id").agg(*aggs)
    base = clean.select(F.col("doc_id"), F.col("title").alias("Title"))
    out = base.join(wide, "doc_id", "left")
    cols = []
    for j in range(1, k + 1):
        cols += [F.coalesce(F.col(f"Word_{j}"), F.lit("")).alias(f"Word_{j}"),
                 F.coalesce(F.col(f"Count_{j}"), F.lit(0)).cast("long").alias(f"Count_{j}")]
    return out.select(F.col("doc_id").alias("DocIndex"), "Title", *cols)


def _pct_removed(before, after):
    return F.when(before > 0, F.bround((1 - after / before) * 100, 2)).otherwise(F.lit(0.0))


def word_counts(clean: DataFrame, text: str = "title_abstract", stopwords=STOPWORD_SET,
                with_total: bool = True) -> DataFrame:
    """Words before/after stopword removal per document, plus a `__TOTAL__` row.

    Pct_Removed = round_half_even((1 - after/before) * 100, 2), 0.0 when
    before = 0.  The total row sums the counts and derives its percentage from
    the sums; its DocIndex is NULL.
    """
    # the token array is projected once (an expensive alias referenced twice is not
    # inlined by the optimizer), then both sizes read it
    toks = clean.select(F.col("doc_id").alias("DocIndex"), F.col("title").alias("Title"),
                        tokens_prefilter(text).alias("_pre"))
    per_doc = toks.select(
        "DocIndex", "Title", F.size("_pre").cast("long").alias("Words_Before"),
        F.size(F.filter("_pre", lambda t: ~t.isin(list(stopwords)))).cast("long").alias("Words_After"))
    if not with_total:
        return per_doc.withColumn("Pct_Removed", _pct_removed(F.col("Words_Before"),
                                                              F.col("Words_After")))
    # written once, so that the total adds up two numbers a row instead of tokenising again
    rows = cut_lineage(per_doc)
    total = rows.agg(F.lit(None).cast("long").alias("DocIndex"), F.lit(TOTAL_TITLE).alias("Title"), *(
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("Words_Before", "Words_After")))
    return rows.unionByName(total).withColumn("Pct_Removed", _pct_removed(F.col("Words_Before"), F.col("Words_After")))


def default_subword_count(tokens) -> "F.Column":
    """Stand-in subword count: pieces of at most 4 characters per word, + 2 specials."""
    return F.aggregate(tokens, F.lit(0).cast("long"),
                       lambda acc, t: acc + F.ceil(F.length(t) / 4).cast("long")) + 2


def token_audit(clean: DataFrame, limits=(384, 512),
                tokenizer: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Words and subword tokens of the cleaned title+abstract, with limit flags.

    Output: DocIndex, Title, Words_in_Clean_Input, Tokens_in_Clean_Input,
    Exceeds_<limit> (strict >) for each limit.  `tokenizer` is any vectorised
    callable `pd.Series[str] -> pd.Series[int]` (e.g. a pretrained subword
    tokenizer loaded once per Python worker); it runs as an Arrow-batched
    pandas UDF.  The default needs no model and stays in the JVM.
    """
    tac = join_text(clean_text("title"), clean_text("abstract"))
    pieces = tokens_whitespace("_tac")
    if tokenizer is None:
        ntok = default_subword_count(pieces)
    else:
        ntok = F.pandas_udf(tokenizer, "long")(F.col("_tac"))
    out = (clean.select(F.col("doc_id").alias("DocIndex"), F.col("title").alias("Title"),
                        tac.alias("_tac"))
           .select("DocIndex", "Title", F.size(pieces).cast("long").alias("Words_in_Clean_Input"),
                   ntok.alias("Tokens_in_Clean_Input")))
    for lim in limits:
        out = out.withColumn(f"Exceeds_{lim}", F.col("Tokens_in_Clean_Input") > lim)
    return out


def truncate_tokens(clean: DataFrame, limit: int = 512, text: str = "title_abstract") -> DataFrame:
    """(doc_id, n_tokens, n_kept, text): the first `limit` white-space tokens, as an encoder with that limit reads.

    Opt-in: nothing else in the library cuts texts.
    """
    rows = clean.select("doc_id", tokens_whitespace(text).alias("_t"))
    return rows.select("doc_id", F.size("_t").cast("long").alias("n_tokens"),
                       F.least(F.size("_t"), F.lit(limit)).cast("long").alias("n_kept"),
                       F.array_join(F.slice("_t", 1, limit), " ").alias("text"))


def token_distribution(audit: DataFrame, limits=(384, 512)) -> DataFrame:
    """Corpus distribution of the audit: n, min/median/max tokens and share over each limit."""
    aggs = [F.count(F.lit(1)).alias("n_docs"),
            F.min("Tokens_in_Clean_Input").alias("min_tokens"),
            F.percentile("Tokens_in_Clean_Input", 0.5).alias("median_tokens"),
            F.max("Tokens_in_Clean_Input").alias("max_tokens"),
            F.avg("Words_in_Clean_Input").alias("mean_words")]
    aggs += [F.avg(F.col(f"Exceeds_{lim}").cast("double")).alias(f"share_over_{lim}")
             for lim in limits]
    return audit.agg(*aggs)


def coherence_tokens(df: DataFrame, text: str = "abstract", key: str = "doc_id") -> DataFrame:
    """(doc_id, tokens) with the coherence tokenizer (lower, [a-z0-9-] runs, length > 2)."""
    return df.select(key, tokens_coherence(text).alias("tokens"))
