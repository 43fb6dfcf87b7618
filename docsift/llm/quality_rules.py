"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditions.

Text statistics are computed for every document.  Rules are learned on a
bounded sample of labelled documents (`SAMPLE` rows, a documented bound): grow a
conjunction of thresholds by information gain on two thirds of the sample,
prune it on the rest, keep it if it is precise there, drop what it covers,
repeat.  Flagged words are learned on the growing two thirds only, so the third
that prunes and accepts is independent of all that was learned.  The list becomes one ordered CASE expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.tables import documents, same_columns, whole_rows
from docsift.llm.words import MARKS, Prefix, U64, Words, _BYTE, chunks, mix, text_buffers
from docsift.session import cut_lineage

#: Labelled documents used to learn flagged words and rules, at most.
SAMPLE = 20_000
MAX_FLAGGED, MIN_CONTEXTS, MIN_SHARE = 512, 10, 0.95
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
         "n_exclaim", "n_distinct", "n_flagged"]
_SYMBOL, _UPPER, _EXCLAIM = (np.zeros(256, np.int64) for _ in range(3))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER[65:91] = 1
_EXCLAIM[[33, 63]] = 1

#: Ratios the learner may use, as SQL over the statistics (0 where undefined).
FEATURES = {
    "words": "double(n_words)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0d)",
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0d)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0d)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0d)",
    "upper_share": "coalesce(try_divide(n_upper, word_chars), 0d)",
    "exclaim_per_word": "coalesce(try_divide(n_exclaim, n_words), 0d)",
    "distinct_share": "coalesce(try_divide(n_distinct, n_words), 0d)",
    "flagged": "double(n_flagged)",
    "flagged_share": "coalesce(try_divide(n_flagged, n_words), 0d)",
}


def _per_text(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flag)][off])


def chunk_stats(raw, offsets, i, j, flagged: np.ndarray) -> list[np.ndarray]:
    """The STATS of texts i..j-1."""
    w = Words(raw, offsets, i, j)
    off, data, n = w.off, w.data, j - i
    letter = ~w.space
    chars = _per_text(letter & ((data & 0xC0) != 0x80), off)
    # lines: (text, hash) of those with a word; repeats = all but one of each
    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.r_[off[:-1], cut + 1], kind="stable")
    line_doc = np.sort(np.r_[np.arange(n), np.searchsorted(off, cut, "right") - 1], kind="stable")
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    last = np.r_[line_doc[1:] != line_doc[:-1], True]
    end[last] = off[1:][line_doc[last]]
    full = np.r_[0, np.cumsum(letter)]
    has = full[np.maximum(end, begin)] > full[begin]
    lines = np.bincount(line_doc, minlength=n)
    begin, end, line_doc = begin[has], end[has], line_doc[has]
    key = mix(w.bytes.of(begin, end) + line_doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    one = np.unique(key, return_index=True)[1]
    dup = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[one], minlength=n)
    # words inside 3-word windows that occur twice or more in their text
    g, inside = w.grams(3)
    at = np.flatnonzero(inside)
    salt = w.doc[at].astype(U64) * U64(0x9E3779B97F4A7C15)
    inv, cnt = np.unique(mix(g[at] + salt), return_inverse=True, return_counts=True)[1:]
    rep = np.zeros(len(w.h) + 1, np.int8)
    again = at[cnt[inv] > 1]
    for k in range(3):
        rep[again + k] = 1
    repeat = np.bincount(w.doc[rep[:-1] > 0], minlength=n)
    dist = np.unique(mix(w.h + w.doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(w.doc[dist], minlength=n)
    flags = np.zeros(n, np.int64)
    if len(flagged):
        v = Words(raw, offsets, i, j, lower=True, between=MARKS)
        flags = np.bincount(v.doc[np.isin(v.h, flagged)], minlength=n)
    return [w.n, chars, _per_text(_SYMBOL[data], off), dup, repeat, lines, _per_text(_UPPER[data], off),
            _per_text(_EXCLAIM[data], off), distinct, flags]


def text_stats(docs: DataFrame, flagged: list[int] = ()) -> DataFrame:
    """(doc_id, *STATS) of every document's whole text; null and empty texts have zeros, one line."""
    marked = np.array(sorted(flagged), np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                cols = chunk_stats(raw, off, i, j, marked)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i)] + [pa.array(c.astype(np.int64)) for c in cols],
                    names=["doc_id", *STATS])

    return documents(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in STATS)]))


def stats_of(text: Column, flagged: list[int] = ()) -> Column:
    """struct of the STATS of a text beside its row, which is neither sent to Python nor shuffled."""
    marked = np.array(sorted(flagged), np.int64).view(np.uint64)

    @F.arrow_udf(", ".join(f"{c} long" for c in STATS))
    def stats(col: pa.Array) -> pa.Array:
        raw, off = text_buffers(col)
        parts = [chunk_stats(raw, off, i, j, marked) for i, j in chunks(off)]
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(STATS)
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=STATS)

    return stats.asNondeterministic()(text)              # judged once, not again in each condition


def labelled(labels: DataFrame, limit: int) -> DataFrame:
    """(l_id, bad) of at most `limit` labelled documents, chosen by hash; several labels: bad wins."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id"))
            .agg(F.max(bad.cast("int")).alias("bad")).orderBy(F.xxhash64("l_id"), "l_id").limit(limit))


def fold(key: str) -> Column:
    """0 and 1 grow, 2 prunes."""
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(3))


def flagged_words(docs: DataFrame, sample: DataFrame) -> list[int]:
    """Hashes of at most MAX_FLAGGED words that stand nearly always in bad documents of `sample` (l_id, bad).

    Support is the number of different words before it, so copies of one text
    do not add up.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = b.column("bad").to_numpy()
            raw, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                v = Words(raw, off, i, j, lower=True, between=MARKS)
                t = np.unique(np.c_[v.h, np.r_[U64(0), v.h[:-1]], bad[i:j][v.doc].astype(np.uint64)], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[:, 0].copy().view(np.int64)), pa.array(t[:, 1].copy().view(np.int64)),
                     pa.array(t[:, 2].astype(np.int32))], names=["h", "before", "bad"])

    pairs = (documents(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
             .select("text", "bad").mapInArrow(run, "h long, before long, bad int").distinct())
    rows = (pairs.groupBy("h").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n"))
            .filter((F.col("p") >= MIN_CONTEXTS) & (F.col("p") >= MIN_SHARE * F.col("n")))
            .orderBy(F.desc("p"), "h").limit(MAX_FLAGGED).collect())
    return [r.h for r in rows]


@dataclass
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) that rejects; hits, wrong: on the pruning fold."""

    terms: list[tuple[str, str, float]] = field(default_factory=list)
    hits: int = 0
    wrong: int = 0

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        on = np.ones(len(x), bool)
        for f, op, t in self.terms:
            on &= (x[f].to_numpy() <= t) if op == "<=" else (x[f].to_numpy() > t)
        return on

    def condition(self) -> Column:
        on = F.lit(True)
        for f, op, t in self.terms:
            on = on & ((F.expr(FEATURES[f]) <= F.lit(t)) if op == "<=" else (F.expr(FEATURES[f]) > F.lit(t)))
        return on

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.terms)


def _best_term(x: pd.DataFrame, y: np.ndarray):
    """The term with the largest information gain, or None."""
    p0, n0 = y.sum(), (~y).sum()
    if not p0 or not n0:
        return None
    best, gain0 = None, 1e-9
    base = np.log2(p0 / (p0 + n0))
    for f in x:
        v = x[f].to_numpy()
        order = np.argsort(v, kind="stable")
        s, c = v[order], np.cumsum(y[order])
        at = np.flatnonzero(s[1:] > s[:-1])
        if not len(at):
            continue
        for op in ("<=", ">"):
            p = c[at] if op == "<=" else p0 - c[at]
            t = (at + 1) if op == "<=" else len(v) - at - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > gain0:
                best, gain0 = (f, op, float((s[at[k]] + s[at[k] + 1]) / 2)), gain[k]
    return best


def learn(x: pd.DataFrame, bad: np.ndarray, fold: np.ndarray, max_rules: int = 16, max_terms: int = 4,
          precision: float = 0.9, support: int = 5) -> list[Rule]:
    """Decision list for `bad`; fold: 0 and 1 grow, 2 prunes (cut from a hash of the key).

    A rule is kept for what it does on the pruning fold: at least `support` bad
    rows covered there, `precision` of all that it covers.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        grow, prune = left & (fold < 2), left & (fold == 2)
        rule, on = Rule(), grow.copy()
        while len(rule.terms) < max_terms and (term := _best_term(x[on], bad[on])):
            rule.terms.append(term)
            on = grow & rule.covers(x)
        if not rule.terms:
            break
        worth = []
        for k in range(1, len(rule.terms) + 1):
            c = Rule(rule.terms[:k]).covers(x) & prune
            worth.append((bad[c].sum() - (~bad[c]).sum()) / max(1, c.sum()))
        rule.terms = rule.terms[:int(np.argmax(worth)) + 1]
        held = rule.covers(x) & prune
        rule.hits, rule.wrong = int(bad[held].sum()), int((~bad[held]).sum())
        if rule.hits < support or rule.hits < precision * (rule.hits + rule.wrong):
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression: text of the first rule that rejects, else null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.condition(), F.lit(str(r))).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[int], list[Rule]]:
    """(flagged word hashes, rules).  No usable labels give no rules."""
    chosen = cut_lineage(labelled(labels, sample))
    words = flagged_words(docs, chosen.filter(fold("l_id") < 2))
    x = (text_stats(documents(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"), "left_semi"), words)
         .join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
         .select("bad", fold("doc_id").alias("fold"), "doc_id",
                 *(F.expr(e).alias(f) for f, e in FEATURES.items()))
         .orderBy("doc_id").limit(sample).toPandas())
    return words, learn(x[list(FEATURES)], x["bad"].to_numpy() == 1, x["fold"].to_numpy())


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, *STATS, base_failed, rule, kept) for every document.

    rule: the learned rule that rejects, or null.  Null and empty texts fail the
    base rule; rows with equal doc_id are judged each by their own text, repeated
    rows all stay.  Labels of a null doc_id are not used, documents with one are
    judged like others.  Columns other than doc_id and text are not read.
    """
    words, rules = fit(docs, labels, sample)
    return (text_stats(docs, words).withColumn("base_failed", F.expr(BASE_FAILED))
            .withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows that the base rule or the learned list rejects.

    All columns stay, of any name.  Rows with equal doc_id are judged each by
    their own text; a null doc_id is judged like any other.
    """
    words, rules = fit(docs, labels, sample)
    rows = whole_rows(docs).select("row", stats_of(F.col("text"), words).alias("s")).select("row", "s.*")
    return same_columns(rows.filter(~F.expr(BASE_FAILED) & verdict(rules).isNull()), docs)
