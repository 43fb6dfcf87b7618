"""Topic operators over document labels: ids, class TF-IDF, words, reports, labels.

Conventions: an assignment table has `keys + [doc_id, topic]` (keys is e.g.
`["min_cluster_size"]` for a sweep, or empty); topic -1 is noise and is kept
as a class of its own.  Every table is keyed, row order never matters.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOISE = -1


def _k(keys) -> list[str]:
    return list(keys or [])


def topic_ids(labels: DataFrame, keys=(), label: str = "cluster") -> DataFrame:
    """Renumber clusters into topics by size: 0 = largest, ties by cluster id; noise stays -1.

    Only the per-cluster size table (one row per cluster) is ranked, by range
    partitions, so many clusters are no task's burden; the documents are joined
    back to it.
    """
    from docsift.operators.ranks import rank_within
    keys = _k(keys)
    sizes = (labels.filter(F.col(label) != NOISE).groupBy(*keys, label)
             .agg(F.count(F.lit(1)).alias("_n")))
    ids = rank_within(sizes, keys, [F.col("_n").desc(), F.col(label)], "topic").withColumn(
        "topic", F.col("topic").cast("int")).drop("_n")
    return (labels.join(ids, keys + [label], "left")
            .withColumn("topic", F.coalesce(F.col("topic"), F.lit(NOISE)).cast("int")))


def _held(assign: DataFrame, keys) -> DataFrame:
    """Table (doc_id, sig, held): each document's (keys, topic, mult) rows as one array, numbered by its content.

    Documents with the same topics at all settings share a `sig`, so counts that
    depend on topics alone are taken once per `sig` and dealt out to the settings
    afterwards.  `mult`: how often the row is there (repeated ids).
    """
    from docsift.session import cut_lineage
    per = (assign.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", *keys, "topic")
           .agg(F.count(F.lit(1)).alias("mult")))
    held = cut_lineage(per.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct(*keys, "topic", "mult"))).alias("held")))
    sigs = cut_lineage(held.select("held").distinct().withColumn("sig", F.monotonically_increasing_id()))
    return cut_lineage(held.join(sigs, "held").select("doc_id", "sig", "held"))


def _sig_entries(held: DataFrame, keys) -> DataFrame:
    """(sig, keys, topic, mult) of `_held`."""
    return held.groupBy("sig").agg(F.first("held").alias("held")).select("sig", F.explode("held").alias("h")).select(
        "sig", *(F.col(f"h.{c}").alias(c) for c in [*keys, "topic", "mult"]))


#: Sets of topics up to which their list goes to every task and counts are dealt by term.
FEW_SIGS = 100_000


def _sig_counts(dtf: DataFrame, held: DataFrame) -> DataFrame:
    """(sig, term, n): occurrences of each term in the documents of each `sig` of `_held`."""
    from docsift.operators.tokens import count_terms, text_column
    own = dtf.join(held.select("doc_id", "sig"), "doc_id")
    text = text_column(dtf)
    if text:
        counted = own.select("sig", text).mapInArrow(count_terms(text, "sig"), "sig long, term string, n long")
        return counted.groupBy("sig", "term").agg(F.sum("n").alias("n"))
    if "tokens" in dtf.columns:
        # outer: the optimizer would filter empty lists by tokenising every text a second time
        return own.select("sig", F.explode_outer("tokens").alias("term")).filter(F.col("term").isNotNull()).groupBy(
            "sig", "term").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("sig", "term").agg(F.sum("n").alias("n"))


def _dealer(entries: list[tuple[int, int, int, int]]) -> Callable:
    """`mapInArrow` kernel: rows (sig, term, n) in the order of the term to (term, at, tf, f).

    `entries`: (sig, at, setting, mult), the topics (by number) that a `sig` counts
    for.  tf: a topic's count of the term, f: that of all topics of its setting.
    """
    import numpy as np
    sig, at, setting, mult = (np.array(c, np.int64) for c in zip(*sorted(entries)))
    sigs, start, size = np.unique(sig, return_index=True, return_counts=True)
    n_at, n_settings = int(at.max()) + 1, int(setting.max()) + 1
    setting_of = np.zeros(n_at, np.int64)
    setting_of[at] = setting

    def deal(t: pa.Table) -> pa.RecordBatch:
        coded = t["term"].combine_chunks().dictionary_encode()
        code, own, n = coded.indices.to_numpy().astype(np.int64), np.searchsorted(sigs, t["sig"].to_numpy()), t["n"].to_numpy()
        reps = size[own]
        row = np.repeat(np.arange(len(own)), reps)
        entry = np.arange(len(row)) + np.repeat(start[own] - (np.cumsum(reps) - reps), reps)
        cell = code[row] * n_at + at[entry]
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        tf = np.add.reduceat((n[row] * mult[entry])[order], first)
        term, topic = cell[first] // n_at, cell[first] % n_at
        group = term * n_settings + setting_of[topic]
        f = np.zeros(len(coded.dictionary) * n_settings, np.int64)
        np.add.at(f, group, tf)
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term)), pa.array(topic), pa.array(tf), pa.array(f[group])],
                                          ["term", "at", "tf", "_f"])

    def kernel(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not len(t):
                continue
            # the last term may go on in the next batch
            whole = pc.index(t["term"], t["term"][-1]).as_py()
            rest = t.slice(whole)
            if whole:
                yield deal(t.slice(0, whole))
        if rest is not None and len(rest):
            yield deal(rest)

    return kernel


def _dealt_counts(per: DataFrame, entries: DataFrame, keys) -> DataFrame:
    """(keys, topic, term, tf, _f) from `_sig_counts`; _f: the sum of tf over the topics.

    With few sigs a term's rows are dealt to the settings where they meet, without being sorted by setting.
    """
    if entries.count() > FEW_SIGS:
        tf = per.join(entries, "sig").groupBy("term", *keys, "topic").agg(
            F.sum(F.col("n") * F.col("mult")).cast("long").alias("tf"))
        return tf.select(*keys, "topic", "term", "tf", F.sum("tf").over(Window.partitionBy("term", *keys)).alias("_f"))
    rows = entries.collect()
    tops = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[c] for c in [*keys, "topic"]) for r in rows))}
    settings = {k: i for i, k in enumerate(dict.fromkeys(k[:-1] for k in tops))}
    if not rows:
        return per.join(entries, "sig").select(*keys, "topic", "term", F.col("n").alias("tf"), F.col("n").alias("_f"))
    kernel = _dealer([(r["sig"], tops[k], settings[k[:-1]], r["mult"]) for r in rows for k in [tuple(r[c] for c in [*keys, "topic"])]])
    kinds = ", ".join(f"{c} {dict(entries.dtypes)[c]}" for c in [*keys, "topic"])
    names = per.sparkSession.createDataFrame([(i, *k) for k, i in tops.items()], f"at long, {kinds}")
    dealt = per.select("sig", "term", "n").repartition("term").sortWithinPartitions("term").mapInArrow(
        kernel, "term string, at long, tf long, _f long")
    return dealt.join(F.broadcast(names), "at").select(*keys, "topic", "term", "tf", "_f")


def class_term_counts(assign: DataFrame, dtf: DataFrame, keys=(), held: DataFrame | None = None) -> DataFrame:
    """tf(term, topic): occurrences of each term in the documents of each topic.

    `dtf`: counts (doc_id, term, n), token lists (doc_id, tokens) or texts (as by
    `tokens.doc_texts`): lists and texts meet their document's topics before
    they are taken apart, and no row per (document, term) is shuffled.  `held`:
    `_held` of the same assignments.
    """
    from docsift.session import cut_lineage
    keys = _k(keys)
    held = _held(assign, keys) if held is None else held
    return _dealt_counts(_sig_counts(dtf, held), cut_lineage(_sig_entries(held, keys)), keys).drop("_f")


def ctfidf(assign: DataFrame, dtf: DataFrame, keys=(), held: DataFrame | None = None) -> DataFrame:
    """Class TF-IDF: weight = tf(t, c) * ln(1 + A / f(t)).

    f(t) = frequency of t over all classes, A = mean number of words per class.
    Output: keys, topic, term, tf, weight.  The counts by set of topics are a
    table: A comes from their sums, and the counts of the settings and f from one
    shuffle by term.  `dtf`, `held`: as in `class_term_counts`.
    """
    from docsift.session import cut_lineage
    keys = _k(keys)
    held = _held(assign, keys) if held is None else held
    entries = cut_lineage(_sig_entries(held, keys))
    per = cut_lineage(_sig_counts(dtf, held))
    out = _dealt_counts(per, entries, keys)
    a = (per.groupBy("sig").agg(F.sum("n").alias("n")).join(entries, "sig")
         .groupBy(*keys).agg((F.sum(F.col("n") * F.col("mult")).cast("long") / F.countDistinct("topic")).alias("_A")))
    # `a` has one row per setting (a parameter list): a proven-small broadcast
    if keys:
        out = out.join(F.broadcast(a), keys)
    else:
        out = out.withColumn("_g", F.lit(0)).join(F.broadcast(a.withColumn("_g", F.lit(0))), "_g")
    return out.select(*keys, "topic", "term", "tf",
                      (F.col("tf") * F.log(1 + F.col("_A") / F.col("_f"))).alias("weight"))


def topic_words(ct: DataFrame, n: int = 10, keys=(), score: str = "weight") -> DataFrame:
    """Top-n terms per topic: (keys, topic, rank, term, score), score desc then term asc."""
    keys = _k(keys)
    w = Window.partitionBy(*keys, "topic").orderBy(F.col(score).desc(), F.col("term"))
    return (ct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(*keys, "topic", F.col("rank").cast("int"), "term", F.col(score).alias("score")))


def _word_list(words: DataFrame, keys, upto: int, sep: str, name: str) -> DataFrame:
    """Per topic, the first `upto` words in rank order joined by `sep` (at most `upto` rows per group)."""
    keys = _k(keys)
    return (words.filter(F.col("rank") <= upto).groupBy(*keys, "topic")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                          lambda s: s["term"]), sep).alias(name)))


def topic_freq(assign: DataFrame, keys=()) -> DataFrame:
    keys = _k(keys)
    return assign.groupBy(*keys, "topic").agg(F.count(F.lit(1)).alias("count"))


def topic_count(assign: DataFrame, keys=()) -> DataFrame:
    """Number of non-noise topics per setting."""
    keys = _k(keys)
    return (assign.groupBy(*keys)
            .agg(F.countDistinct(F.when(F.col("topic") != NOISE, F.col("topic"))).alias("n_topics")))


def topic_info(assign: DataFrame, words: DataFrame, keys=()) -> DataFrame:
    """Topic, Count, Name (`<topic>_w1_w2_w3_w4`), Representation (top words, space separated)."""
    keys = _k(keys)
    freq = topic_freq(assign, keys)
    name = _word_list(words, keys, 4, "_", "_nm")
    rep = _word_list(words, keys, 10, " ", "representation")
    return (freq.join(name, keys + ["topic"], "left").join(rep, keys + ["topic"], "left")
            .select(*keys, "topic", "count",
                    F.concat_ws("_", F.col("topic").cast("string"), F.col("_nm")).alias("name"),
                    F.coalesce("representation", F.lit("")).alias("representation")))


def doc_assignments(assign: DataFrame, corpus: DataFrame, keys=()) -> DataFrame:
    keys = _k(keys)
    return assign.join(corpus.select("doc_id", "title"), "doc_id").select(*keys, "doc_id", "title",
                                                                          "topic")


def titles_report(assign: DataFrame, corpus: DataFrame, keys=()) -> DataFrame:
    """Lines of the titles-by-topic report: `Topic N:`, `- title` per doc, a blank line.

    Returned as (topic, part, doc_id, line); sorting by those columns gives the
    file order (topics ascending, documents in key order).  `write_lines`
    writes it with a global range-partitioned sort, so a huge topic is spread
    over many tasks instead of being gathered into one list.
    """
    keys = _k(keys)
    docs = assign.join(corpus.select("doc_id", "title"), "doc_id")
    body = docs.select(*keys, "topic", F.lit(1).alias("part"), "doc_id",
                       F.concat(F.lit("- "), F.col("title")).alias("line"))
    tops = assign.select(*keys, "topic").distinct()
    head = tops.select(*keys, "topic", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("doc_id"),
                       F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(":"))
                       .alias("line"))
    blank = tops.select(*keys, "topic", F.lit(2).alias("part"), F.lit(-1).cast("long").alias("doc_id"),
                        F.lit("").alias("line"))
    return head.unionByName(body).unionByName(blank)


#: Token occurrences of a block of documents that share their topics.
BLOCK_TOKENS = 500_000
#: Bytes of text that count as one token when blocks are dealt, and bytes of packed blocks a writing task holds.
TEXT_BYTES, BLOCK_BYTES = 6, 32 << 20


def representative_docs(ct: DataFrame, dtf: DataFrame, assign: DataFrame, k: int = 3,
                        keys=(), held: DataFrame | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Top-k documents per topic by cosine(doc c-TF-IDF vector, topic c-TF-IDF vector).

    A document's vector is tf(t, d) * idf(t) with the topic model's idf; all
    documents of the topic are scored (no sampling).  Ranked by similarity
    desc, doc_id asc.  Output: keys, topic, rank, doc_id, similarity.

    Documents of the same topics at all settings are dealt into blocks of about
    `block_tokens` tokens, and each block is packed into one row: its terms once,
    and (document, place of the term, count) as arrays.  The model rows of a
    block's terms go to the block, so a document is scored whole in one task and
    no row per (document, term) is shuffled.  `dtf`, `held`: as in `class_term_counts`.
    """
    from docsift.operators.tokens import TOKENIZERS, runs, text_column
    from docsift.session import cut_lineage
    keys = _k(keys)
    held = _held(assign, keys) if held is None else held
    text = text_column(dtf)
    if text:
        lists = dtf.withColumn("_size", F.octet_length(text) / TEXT_BYTES)
    elif "tokens" in dtf.columns:
        lists = dtf.select("doc_id", F.col("tokens").alias("terms"), F.size("tokens").alias("_size"),
                           F.transform("tokens", lambda t: F.lit(1).cast("long")).alias("ns"))
    else:
        lists = dtf.groupBy("doc_id").agg(F.collect_list(F.struct("term", F.col("n").cast("long").alias("n"))).alias("_l")).select(
            "doc_id", F.col("_l.term").alias("terms"), F.size("_l").alias("_size"), F.col("_l.n").alias("ns"))
    docs = lists.join(held.select("doc_id", "sig"), "doc_id")
    blocks = cut_lineage(docs.groupBy("sig").agg(
        F.greatest(F.ceil(F.sum("_size") / block_tokens), F.lit(1)).cast("int").alias("_b")))
    docs = docs.join(blocks, "sig").withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("_b")).cast("int")).drop("_b", "_size")
    id_type = dict(docs.dtypes)["doc_id"]

    def pack(t: pa.Table) -> pa.Table:
        import numpy as np
        if text:
            of = [list(runs(c, text)) for c in t[text].chunks]
            words = [w for lists in of for doc in lists for w in doc]
            sizes = [len(doc) for lists in of for doc in lists]
            n = np.ones(len(words))
            drop = TOKENIZERS[text][1]
        else:
            words = [w for doc in t["terms"].to_pylist() for w in doc or ()]
            sizes = [len(doc or ()) for doc in t["terms"].to_pylist()]
            n = np.array([x for doc in t["ns"].to_pylist() for x in doc or ()], float)
            drop = lambda w: False
        code, terms = pd.factorize(np.array(words, object))
        is_term = np.array([not drop(w) for w in terms], bool)
        ids, doc = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
        use = code >= 0
        use[use] = is_term[code[use]]
        kept = [w for w, ok in zip(terms, is_term) if ok]
        place = (np.cumsum(is_term) - 1)[code[use]]
        # counts of a document's repeated terms add up before they are squared
        cell, back = np.unique(np.repeat(doc, sizes)[use] * np.int64(max(len(kept), 1)) + place, return_inverse=True)
        n = np.bincount(back, weights=n[use], minlength=len(cell)).astype(np.int64)
        row, place = cell // max(len(kept), 1), cell % max(len(kept), 1)
        as_row = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table({"sig": t["sig"].slice(0, 1), "blk": t["blk"].slice(0, 1), "ids": as_row(ids, t["doc_id"].type),
                         "terms": as_row([w.decode() if text else w for w in kept], pa.string()),
                         "row": as_row(row, pa.int32()), "place": as_row(place, pa.int32()), "n": as_row(n, pa.int64())})

    packed = cut_lineage(docs.groupBy("sig", "blk").applyInArrow(
        pack, f"sig long, blk int, ids array<{id_type}>, terms array<string>, row array<int>, place array<int>, n array<long>"),
        BLOCK_BYTES)
    # the model's numbers of every (setting, topic) that a block's documents hold, for the terms they hold
    entries = cut_lineage(_sig_entries(held, keys).withColumn("at", F.monotonically_increasing_id()))
    near = F.broadcast(entries) if entries.count() <= FEW_SIGS else entries
    idf = ct.select(*keys, "topic", "term", "weight", (F.col("weight") / F.col("tf")).alias("idf"))
    need = packed.select("sig", "blk", F.posexplode("terms").alias("at_place", "term"))
    need = need.join(near.drop("mult"), "sig").join(idf, ["term", "topic", *keys]).select(
        F.col("sig").alias("msig"), F.col("blk").alias("mblk"), "at_place", "at", "idf", "weight")

    def score(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        none = pd.DataFrame({"at": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64),
                             "_dot": np.zeros(0), "_dn": np.zeros(0)})
        if not len(block) or not len(model):
            return none
        ids, row, place, n = (np.asarray(block[c].iloc[0]) for c in ("ids", "row", "place", "n"))
        terms = int(block["width"].iloc[0])
        out = []
        for at, part in model.groupby("at"):
            i, w = np.zeros(terms), np.zeros(terms)
            there = np.zeros(terms, bool)
            p = part["at_place"].to_numpy()
            i[p], w[p], there[p] = part["idf"].to_numpy(), part["weight"].to_numpy(), True
            x = n * i[place]
            dot, dn = (np.bincount(row, weights=v, minlength=len(ids)) for v in (x * w[place], x * x))
            seen = np.bincount(row, weights=there[place], minlength=len(ids)) > 0
            out.append(pd.DataFrame({"at": at, "doc_id": ids[seen], "_dot": dot[seen], "_dn": dn[seen]}))
        return pd.concat(out, ignore_index=True) if out else none

    docs = packed.select("sig", "blk", "ids", F.size("terms").alias("width"), "row", "place", "n")
    sums = docs.groupBy("sig", "blk").cogroup(need.groupBy("msig", "mblk")).applyInPandas(
        score, f"at long, doc_id {id_type}, _dot double, _dn double")
    tnorm = ct.groupBy(*keys, "topic").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_tn"))
    per = sums.join(entries.drop("sig"), "at").groupBy(*keys, "topic", "doc_id").agg(
        F.sum(F.col("_dot") * F.col("mult")).alias("_dot"), F.sqrt(F.sum(F.col("_dn") * F.col("mult"))).alias("_dn"))
    per = per.join(tnorm, keys + ["topic"]).withColumn(
        "similarity", F.col("_dot") / (F.col("_dn") * F.col("_tn")))
    # rank on 9 decimals so equal documents tie exactly whatever the summation order
    w = Window.partitionBy(*keys, "topic").orderBy(F.round("similarity", 9).desc(), F.col("doc_id"))
    return (per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*keys, "topic", F.col("rank").cast("int"), "doc_id", "similarity"))


def topic_diff(before: DataFrame, after: DataFrame, n: int = 5, nr_topics: int | None = None,
               keys=()) -> DataFrame:
    """Top-n words before and after a representation update, ' | ' joined, topics 0..nr-1."""
    keys = _k(keys)
    a = _word_list(before, keys, n, " | ", "original")
    b = _word_list(after, keys, n, " | ", "updated")
    out = a.join(b, keys + ["topic"], "full_outer").filter(F.col("topic") != NOISE)
    if nr_topics is not None:
        out = out.filter(F.col("topic") < nr_topics)
    return out.select(*keys, "topic", F.coalesce("original", F.lit("")).alias("original"),
                      F.coalesce("updated", F.lit("")).alias("updated"))


PROMPT_TEMPLATE = """
These texts belong together:
[DOCUMENTS]

Words that set them apart: [KEYWORDS]

Name what they have in common in a few words, as one line that starts with "topic:".
"""


def label_prompt(words: DataFrame, reps: DataFrame, corpus: DataFrame,
                 template: str = PROMPT_TEMPLATE, keys=()) -> DataFrame:
    """Fill [DOCUMENTS] (one `- title` line per representative doc) and [KEYWORDS]."""
    keys = _k(keys)
    kw = _word_list(words, keys, 10, ", ", "_kw")
    docs = (reps.join(corpus.select("doc_id", "title"), "doc_id").groupBy(*keys, "topic")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))),
                                          lambda s: F.concat(F.lit("- "), s["title"])), "\n")
                 .alias("_docs")))
    j = kw.join(docs, keys + ["topic"], "left")
    prompt = F.replace(F.replace(F.lit(template), F.lit("[DOCUMENTS]"), F.coalesce("_docs", F.lit(""))),
                       F.lit("[KEYWORDS]"), F.col("_kw"))
    return j.select(*keys, "topic", prompt.alias("prompt"))


def topic_labels(words: DataFrame, generator: Callable[[pd.Series], pd.Series] | None = None,
                 prompts: DataFrame | None = None, n_words: int = 3, keys=()) -> DataFrame:
    """One label per topic.

    Default (no model needed): the first `n_words` topic words joined by a
    space.  With `generator` (a vectorised `pd.Series[prompt] -> pd.Series[label]`,
    e.g. a text-generation model loaded once per Python worker) the prompts
    are labelled by an Arrow-batched pandas UDF.
    """
    keys = _k(keys)
    if generator is None:
        return _word_list(words, keys, n_words, " ", "label")
    if prompts is None:
        raise ValueError("a generator needs the prompts table")
    gen = F.pandas_udf(generator, "string")
    return prompts.select(*keys, "topic", gen(F.col("prompt")).alias("label"))


def numeric_labels(assign: DataFrame, keys=()) -> DataFrame:
    keys = _k(keys)
    return assign.select(*keys, "topic").distinct().withColumn("label",
                                                               F.col("topic").cast("string"))


def label_changes(old: DataFrame, new: DataFrame, keys=()) -> DataFrame:
    """Topics whose label changed; a topic missing from `new` gets ''."""
    keys = _k(keys)
    j = old.select(*keys, "topic", F.col("label").alias("old_label")).join(
        new.select(*keys, "topic", F.col("label").alias("new_label")), keys + ["topic"], "left")
    j = j.withColumn("new_label", F.coalesce("new_label", F.lit("")))
    return j.filter(F.col("old_label") != F.col("new_label"))


def topics_to_show(assign: DataFrame, n: int = 17, keys=()) -> DataFrame:
    """The n lowest non-noise topic ids."""
    keys = _k(keys)
    t = assign.filter(F.col("topic") != NOISE).select(*keys, "topic").distinct()
    w = Window.partitionBy(*keys).orderBy("topic") if keys else Window.orderBy("topic")
    return t.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def barchart_data(words: DataFrame, n_topics: int = 8, n_words: int = 5, keys=()) -> DataFrame:
    keys = _k(keys)
    return words.filter((F.col("topic") >= 0) & (F.col("topic") < n_topics)
                        & (F.col("rank") <= n_words)).select(*keys, "topic", "rank", "term", "score")


def topic_similarity(ct: DataFrame, keys=(), block_topics: int = 256, chunk_terms: int = 65536,
                     task_entries: int = 200_000) -> DataFrame:
    """Cosine similarity of all topic pairs by c-TF-IDF, long form (topic_a, topic_b, similarity).

    A full matrix, as a heatmap needs: both orders, the diagonal, and 0 for
    topics without a shared term.  The work is cut two ways: topics into blocks
    of about `block_topics`, terms into buckets so that a bucket of a setting
    holds about `task_entries` entries.  A task multiplies one term bucket of one
    block pair (in dense slices of at most `chunk_terms` terms) and emits partial
    products, which are summed by topic pair; no task holds a setting's table and
    no row per shared term is emitted.  All pairs come from the block pairs of
    the topic list.
    """
    import numpy as np
    keys = _k(keys)
    v = ct.select(*keys, "topic", "term", "weight")
    per = v.groupBy(*keys).agg(F.countDistinct("topic").alias("_t"), F.count(F.lit(1)).alias("_e"))
    per = per.select(*keys, F.ceil(F.col("_t") / block_topics).cast("int").alias("_b"),
                     F.ceil(F.col("_e") / task_entries).cast("int").alias("_n"))
    joined = lambda df: df.join(per, keys) if keys else df.crossJoin(F.broadcast(per))  # noqa: E731  one row
    block = F.pmod(F.xxhash64("topic"), F.col("_b")).cast("int")

    def met(df: DataFrame) -> DataFrame:
        """Rows of both blocks of every block pair (bi <= bj)."""
        other = joined(df).withColumn("_blk", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        return (other.withColumn("bi", F.least("_blk", "_o")).withColumn("bj", F.greatest("_blk", "_o"))
                .withColumn("side", (F.col("_blk") > F.col("_o")).cast("int")).drop("_blk", "_o", "_b"))

    entries = met(v).withColumn("_n", F.pmod(F.xxhash64("term"), F.col("_n")).cast("int"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        diag = pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
        b = a if diag else b
        terms = np.intersect1d(a["term"].to_numpy(), b["term"].to_numpy())
        ta, ia = np.unique(a["topic"].to_numpy(), return_inverse=True)
        tb, ib = np.unique(b["topic"].to_numpy(), return_inverse=True)
        d = np.zeros((len(ta), len(tb)))
        at = {t: i for i, t in enumerate(terms)}
        ka, kb = (x["term"].map(at).fillna(-1).to_numpy(np.int64) for x in (a, b))
        wa, wb = a["weight"].to_numpy(), b["weight"].to_numpy()
        for lo in range(0, len(terms), chunk_terms):
            hi = min(lo + chunk_terms, len(terms))
            ma, mb = np.zeros((len(ta), hi - lo)), np.zeros((len(tb), hi - lo))
            for m, i, k, w in ((ma, ia, ka, wa), (mb, ib, kb, wb)):
                use = (k >= lo) & (k < hi)
                np.add.at(m, (i[use], k[use] - lo), w[use])
            d += ma @ mb.T
        i, j = np.nonzero(d)
        out = pd.DataFrame({"topic_a": ta[i], "topic_b": tb[j], "_dot": d[i, j]})
        if not diag:
            out = pd.concat([out, pd.DataFrame({"topic_a": tb[j], "topic_b": ta[i], "_dot": d[i, j]})],
                            ignore_index=True)
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out

    types = dict(ct.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["topic_a int", "topic_b int", "_dot double"])
    dot = entries.groupBy(*keys, "_n", "bi", "bj").applyInPandas(kernel, schema).groupBy(
        *keys, "topic_a", "topic_b").agg(F.sum("_dot").alias("_dot"))
    norm = v.groupBy(*keys, "topic").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_norm"))
    listed = met(norm).drop("_n")
    pair = [*keys, "bi", "bj"]
    a = listed.filter("side = 0").select(*pair, F.col("topic").alias("topic_a"), F.col("_norm").alias("_na"))
    b = listed.filter("side = 1 OR bi = bj").select(*pair, F.col("topic").alias("topic_b"), F.col("_norm").alias("_nb"))
    half = a.join(b, pair).drop("bi", "bj")
    back = a.filter("bi < bj").join(b, pair).select(*keys, F.col("topic_b").alias("topic_a"), F.col("_nb").alias("_na"),
                                                    F.col("topic_a").alias("topic_b"), F.col("_na").alias("_nb"))
    every = half.select(*keys, "topic_a", "_na", "topic_b", "_nb").unionByName(back)
    return every.join(dot, [*keys, "topic_a", "topic_b"], "left").select(
        *keys, "topic_a", "topic_b",
        F.coalesce(F.try_divide("_dot", F.col("_na") * F.col("_nb")), F.lit(0.0)).alias("similarity"))


def heatmap_k(assign: DataFrame, cap: int = 15, keys=()) -> DataFrame:
    """Number of groups for the topic heatmap: max(1, min(cap, n_topics - 1)); NULL if <= 1 topic."""
    keys = _k(keys)
    n = topic_count(assign, keys)
    return n.withColumn("n_groups", F.when(F.col("n_topics") > 1, F.greatest(
        F.lit(1), F.least(F.lit(cap), F.col("n_topics") - 1))).cast("int"))


def document_map(assign: DataFrame, corpus: DataFrame, coords: DataFrame, keys=()) -> DataFrame:
    """doc_id, title, topic, x, y (coords: doc_id, x, y)."""
    keys = _k(keys)
    return (assign.join(corpus.select("doc_id", "title"), "doc_id").join(coords, "doc_id")
            .select(*keys, "doc_id", "title", "topic", "x", "y"))


def datamap_data(assign: DataFrame, corpus: DataFrame, coords: DataFrame, labels: DataFrame,
                 n: int = 17, keys=()) -> DataFrame:
    """Documents of the shown topics with coordinates and topic label."""
    keys = _k(keys)
    show = topics_to_show(assign, n, keys)
    return (document_map(assign.join(show, keys + ["topic"], "left_semi"), corpus, coords, keys)
            .join(labels.select(*keys, "topic", "label"), keys + ["topic"], "left"))


def preview(info: DataFrame, n: int = 10) -> DataFrame:
    return info.orderBy("topic").limit(n)


def topic_hierarchy(sim: DataFrame, n_groups: DataFrame | None = None, keys=()) -> tuple[DataFrame, DataFrame]:
    """Single-linkage hierarchy of the topics of every setting on distance 1 - similarity, cut into groups.

    `sim`: a full matrix as by `topic_similarity`; its diagonal is the topic
    list, so a topic that shares no term with others joins at distance 1, and a
    setting of one topic has one group.  Noise is left out; a setting with noise
    alone has no rows.  All settings share one forest and one hierarchy job.

    Returns merges (keys, node, parent, topic, distance, size): topics are the
    leaves (distance 0), topics that meet at equal distance one node; and groups
    (keys, topic, group): the parts left when all edges heavier than the k-th
    heaviest are cut (at most k groups, k without equal distances; k from
    `n_groups`, else 1), numbered by their least topic.
    """
    from docsift.operators import graph, hierarchy
    from docsift.operators.density import mst_from_edges
    from docsift.operators.ranks import global_rank, rank_within
    from docsift.session import cut_lineage
    keys = _k(keys)
    s = cut_lineage(sim.filter((F.col("topic_a") != NOISE) & (F.col("topic_b") != NOISE)
                               & (F.col("topic_a") <= F.col("topic_b"))))
    topics = s.filter("topic_a = topic_b").select(*keys, F.col("topic_a").alias("topic"))
    settings = cut_lineage(global_rank(topics.select(*keys).distinct(), keys, "g") if keys
                           else topics.limit(1).select(F.lit(0).cast("long").alias("g")))
    add = lambda df: df.join(settings, keys) if keys else df.withColumn("g", F.lit(0).cast("long"))
    leaf = cut_lineage(global_rank(add(topics), ["g", "topic"], "uid"))
    a, b = (leaf.select(*keys, F.col("topic").alias(f"topic_{x}"), F.col("uid").alias(y)) for x, y in ("au", "bv"))
    e = s.filter("topic_a < topic_b").join(a, [*keys, "topic_a"]).join(b, [*keys, "topic_b"]).select(
        "u", "v", F.greatest(F.lit(0.0), 1 - F.col("similarity")).alias("w"))
    forest = cut_lineage(mst_from_edges(e)[0].join(leaf.select(F.col("uid").alias("lo"), "g"), "lo"))
    tree = hierarchy.hierarchy(forest)
    # the k-th heaviest edge of each setting
    want = add(n_groups).select("g", F.coalesce("n_groups", F.lit(1)).alias("k")) if n_groups is not None \
        else settings.select("g", F.lit(1).alias("k"))
    heavy = rank_within(forest, ["g"], [F.col("w").desc()], "r").join(want, "g").filter(F.col("r") == F.col("k") - 1)
    kept = tree.join(heavy.select("g", F.col("w").alias("at")), "g", "left").withColumn(
        "held", F.col("leaf") | (F.col("w") <= F.coalesce("at", F.lit(-1.0))))
    above = kept.select(F.col("node").alias("parent"), F.col("held").alias("up"))
    marked = kept.join(above, "parent", "left").select(
        "node", "parent", (F.col("held") & ~F.coalesce("up", F.lit(False))).alias("marked"))
    top = graph.nearest(marked)
    own = leaf.join(top.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
        "target", F.coalesce("target", "uid"))               # a setting's only topic has no edge
    first = own.groupBy("g", "target").agg(F.min("topic").alias("_first"))
    first = rank_within(first, ["g"], ["_first"], "group")
    groups = own.join(first.select("target", F.col("group").cast("int").alias("group")), "target").select(
        *keys, "topic", "group")
    named = leaf.select(F.col("uid").alias("node"), "topic")
    merges = tree.join(named, "node", "left")
    merges = merges.join(settings, "g") if keys else merges
    return merges.select(*keys, "node", "parent", "topic", F.col("w").alias("distance"), "size"), groups


def rerank_words(ct: DataFrame, doc_terms: DataFrame, doc_vecs: DataFrame, assign: DataFrame,
                 candidates: int = 30, n: int = 10, keys=()) -> DataFrame:
    """Re-rank each topic's c-TF-IDF candidates by cosine(word vector, topic vector).

    word vector = mean vector of the documents holding the word; topic vector =
    mean vector of the topic's documents.  Both are streaming vector-sum
    aggregates (partial map-side), so a word or topic holding a third of all
    documents is still reduced across tasks.  Output like `topic_words`.
    """
    from docsift.functions.vectors import cosine, vsum
    keys = _k(keys)
    cand = topic_words(ct, candidates, keys).select(*keys, "topic", "term")
    vocab = cand.select("term").distinct()
    dv = doc_terms.select("doc_id", "term").distinct().join(vocab, "term", "left_semi") \
        .join(doc_vecs.select("doc_id", "vec"), "doc_id")
    wv = dv.groupBy("term").agg(vsum(F.col("vec")).alias("wv"))
    tv = (assign.select(*keys, "doc_id", "topic").join(doc_vecs.select("doc_id", "vec"), "doc_id")
          .groupBy(*keys, "topic").agg(vsum(F.col("vec")).alias("tv")))
    j = cand.join(wv, "term").join(tv, keys + ["topic"])
    j = j.withColumn("score", cosine(F.col("wv"), F.col("tv")))
    w = Window.partitionBy(*keys, "topic").orderBy(F.col("score").desc(), F.col("term"))
    return (j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(*keys, "topic", F.col("rank").cast("int"), "term", "score"))
