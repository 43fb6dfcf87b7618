"""Benchmark decontamination by broadcast word windows (DataFrame functions only).

The test items' normalised windows are a hash set that is broadcast with the
plan, keyed by the hash of their first words; each training text is cut into
blocks of words that overlap by a window, every place of a block is looked up,
and where the set has it the whole window is joined to the items', whose string
equality is the exact verification of a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.tables import documents, same_columns, whole_rows
from docsift.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, BLOCK = 10, 1000
#: Words hashed to find where a window may begin.
OPENING = 3
#: Openings in the row's hash set, and item windows that are broadcast (of at most WINDOW words each), at most;
#: more are joined by shuffle.
MAX_SET = 100_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words: runs of digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _windows(ws: Column, k: Column | int) -> Column:
    """All windows of k words of an array, joined by a space, in order."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(ws) >= k, F.transform(
        F.sequence(F.lit(1), F.size(ws) - k + 1),
        lambda i: F.array_join(F.slice(ws, i, k), " "))).otherwise(F.array().cast("array<string>"))


def _block(length: int):
    return lambda c: F.struct(c.alias("base"), F.slice("w", c + 1, length).alias("ws"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, k, win): distinct windows of each item; a shorter item is one window."""
    w = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                         words(F.coalesce(F.col("text"), F.lit(""))).alias("w")).filter("size(w) > 0")
    k = F.least(F.lit(window), F.size("w"))
    return w.select("item_id", k.alias("k"), F.explode(_windows(F.col("w"), k)).alias("win")).distinct()


def _opening(ws: Column, i: Column, p: int) -> Column:
    """Hash of the p words from place i (0-based) on; past the end nulls, which only cost a look."""
    return F.xxhash64(*(F.get(ws, i + j) for j in range(p)))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK,
         max_set: int = MAX_SET) -> DataFrame:
    """(doc_id, at, k, win): every place (0-based word) where an item window occurs.

    A window is only written out where the hash of its first OPENING words is
    among the items' (a hash set inside the row, of at most `max_set` longs;
    with more items, a join by shuffle on that hash).  The join on the window's
    string proves the hit; it is a broadcast in the first case.
    """
    spark = docs.sparkSession
    keys = cut_lineage(items.select("k", "win").distinct())
    sizes = sorted(r.k for r in keys.select("k").distinct().collect())              # <= window rows
    found = None
    texts = docs.select("doc_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    # blocks are columns, not expressions: a lambda computes what it refers to for every element
    longest = max(sizes, default=1)
    blocks = texts.select("doc_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - 1, F.lit(block)), _block(block + longest - 1))).alias("b")).select(
        "doc_id", F.col("b.base").alias("base"), F.col("b.ws").alias("ws"))
    for p in sorted({min(k, OPENING) for k in sizes}):
        ks = [k for k in sizes if min(k, OPENING) == p]
        side = keys.filter(F.col("k").isin(ks))
        opening = side.select(_opening(F.split("win", " "), F.lit(0), p).alias("h")).distinct()
        known = [r.h for r in opening.limit(max_set + 1).collect()]
        places = F.sequence(F.lit(0), F.least(F.size("ws"), F.lit(block)) - 1)
        if len(known) <= max_set:
            at = blocks.select("doc_id", "base", "ws", F.explode(F.filter(
                places, lambda i: _opening(F.col("ws"), i, p).isin(known))).alias("i"))
        else:
            at = blocks.select("doc_id", "base", "ws", F.posexplode(F.transform(
                places, lambda i: _opening(F.col("ws"), i, p))).alias("i", "h")).join(opening, "h").drop("h")
        rows = at.select("doc_id", (F.col("base") + F.col("i")).alias("at"), F.explode(F.array(*(
            F.when(F.col("i") + k <= F.size("ws"), F.struct(
                F.lit(k).alias("k"), F.array_join(F.slice("ws", F.col("i") + 1, k), " ").alias("win")))
            for k in ks))).alias("x")).filter("x IS NOT NULL").select("doc_id", "at", F.col("x.k").alias("k"),
                                                                      F.col("x.win").alias("win"))
        part = rows.join(F.broadcast(side) if side.count() <= max_set else side, ["k", "win"]).select(
            "doc_id", "at", "k", "win")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "doc_id long, at int, k int, win string")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted item ids as strings), spans, contaminated.

    spans: sorted distinct word places inside a hit.  Null and empty texts have
    no words; repeated items count once per item_id; rows with equal doc_id
    share their hits.
    """
    docs = documents(docs)
    items = item_windows(benchmark, window)
    found = cut_lineage(hits(docs, items, window))       # read twice; the texts are scanned once
    cover = (found.select("doc_id", F.explode(F.expr("sequence(at, at + k - 1)")).alias("word")).distinct()
             .groupBy(F.col("doc_id").alias("d1")).agg(F.array_sort(F.collect_list("word")).alias("spans")))
    named = (found.select("doc_id", "win").distinct().join(items.select("win", "item_id"), "win")
             .groupBy(F.col("doc_id").alias("d2"))
             .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    per = cover.join(named, F.col("d1").eqNullSafe(F.col("d2"))).select("d1", "spans", "items")
    base = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return base.join(per, F.col("doc_id").eqNullSafe(F.col("d1")), "left").select(
        "doc_id", "n_words", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
        F.col("spans").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  action: str = "document") -> DataFrame:
    """`docs` without contaminated documents, or (action='span') without hit words.

    All columns of `docs` stay, of any name; with 'span' the text between words is
    kept as it is and only hit words go.  Null and empty texts hold nothing.  Rows
    with equal doc_id are judged each by its own text, of equal texts all or none
    go; a null doc_id is a key like any other.
    """
    if action not in ("document", "span"):
        raise ValueError(action)
    # a key of id and text, so rows that only share their id stay apart
    key = F.xxhash64("doc_id", "text")
    rows = whole_rows(docs).withColumn("key", key)
    found = contamination(rows.select(F.col("key").alias("doc_id"), "text"), benchmark, window)
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad"), "spans").dropDuplicates(["bad"])
    on = F.col("key") == F.col("bad")
    if action == "document":
        return same_columns(rows.join(bad, on, "left_anti"), docs)
    # text = gap, word, gap, word, ..., gap
    words_, gaps = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD)
    hit = rows.join(bad, on, "left").withColumn("gaps", F.when(F.col("spans").isNotNull(), gaps))
    left = F.transform(words_, lambda t, i: F.concat(
        F.get(F.col("gaps"), i), F.when(F.array_contains("spans", i), "").otherwise(t)))
    cut = F.concat(F.array_join(left, ""), F.element_at("gaps", -1))
    return same_columns(hit, docs, text=F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut))
