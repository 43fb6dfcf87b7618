import pytest
from pyspark.sql import functions as F

from docsift.operators import coherence as H
from docsift.operators import topics as T


def test_ctfidf_golden(spark):
    assign = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, topic int")
    dtf = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "b", 1), (1, "c", 1)],
                                "doc_id long, term string, n long")
    w = {(r.topic, r.term): r.weight for r in T.ctfidf(assign, dtf).collect()}
    assert w[(0, "a")] == pytest.approx(1.6218604324326575, abs=1e-12)
    assert w[(0, "b")] == pytest.approx(0.8109302162163288, abs=1e-12)
    assert w[(1, "b")] == pytest.approx(0.8109302162163288, abs=1e-12)
    assert w[(1, "c")] == pytest.approx(1.252762968495368, abs=1e-12)


def test_topic_ids_by_size(spark):
    lab = spark.createDataFrame([(i, c) for i, c in enumerate([7, 7, 3, 3, 3, -1, 9])], "doc_id long, cluster int")
    got = {r.cluster: r.topic for r in T.topic_ids(lab).collect()}
    assert got == {3: 0, 7: 1, 9: 2, -1: -1}


def test_coherence_golden(spark):
    docs = ["alpha beta gamma", "alpha beta", "alpha", "delta"]
    toks = spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "alpha", 3.0), (0, 2, "beta", 2.0), (0, 3, "gamma", 1.0)],
                                  "topic int, rank int, term string, score double")
    r = H.npmi_umass(toks, words).first()
    assert r.npmi == pytest.approx(0.3741854163060885, abs=1e-12)
    assert r.umass == pytest.approx(-0.1351550360360548, abs=1e-12)


def test_coherence_pair_everywhere_is_one(spark):
    toks = spark.createDataFrame([(0, ["aaa", "bbb"]), (1, ["aaa", "bbb"])], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "aaa", 1.0), (0, 2, "bbb", 1.0)], "topic int, rank int, term string, score double")
    assert H.npmi_umass(toks, words).first().npmi == 1.0


def test_topic_diff_and_labels(spark):
    w1 = spark.createDataFrame([(0, i + 1, f"w{i}", 1.0) for i in range(6)], "topic int, rank int, term string, score double")
    w2 = spark.createDataFrame([(0, i + 1, f"v{i}", 1.0) for i in range(6)], "topic int, rank int, term string, score double")
    r = T.topic_diff(w1, w2).first()
    assert r.original == "w0 | w1 | w2 | w3 | w4" and r.updated == "v0 | v1 | v2 | v3 | v4"
    assert T.topic_labels(w1).first().label == "w0 w1 w2"
    old = spark.createDataFrame([(0, "a"), (1, "b")], "topic int, label string")
    new = spark.createDataFrame([(0, "a")], "topic int, label string")
    ch = T.label_changes(old, new).collect()
    assert [(c.topic, c.old_label, c.new_label) for c in ch] == [(1, "b", "")]


def test_topic_similarity_blocks_agree(spark):
    from docsift.plans import queries as Q
    _, assign, _, ct, _ = Q._topic_model(spark, "/root/testdata/sf0.001")
    one = {(r.min_cluster_size, r.topic_a, r.topic_b): r.similarity
           for r in T.topic_similarity(ct, Q.KEYS).collect()}
    many = {(r.min_cluster_size, r.topic_a, r.topic_b): r.similarity
            for r in T.topic_similarity(ct, Q.KEYS, block_topics=3).collect()}
    assert one.keys() == many.keys()
    for k, v in one.items():
        assert many[k] == pytest.approx(v, abs=1e-12)
    diag = [v for (s, a, b), v in one.items() if a == b]
    assert all(abs(v - 1) < 1e-9 for v in diag)


def test_topic_similarity_term_chunks_agree(spark):
    from docsift.plans import queries as Q
    _, _, _, ct, _ = Q._topic_model(spark, "/root/testdata/sf0.001")
    one = {(r.min_cluster_size, r.topic_a, r.topic_b): r.similarity
           for r in T.topic_similarity(ct, Q.KEYS).collect()}
    small = {(r.min_cluster_size, r.topic_a, r.topic_b): r.similarity
             for r in T.topic_similarity(ct, Q.KEYS, block_topics=4, chunk_terms=50).collect()}
    assert one.keys() == small.keys()
    for k, v in one.items():
        assert small[k] == pytest.approx(v, abs=1e-12)


def test_token_lists_count_like_term_counts(spark):
    """Lists of tokens give the counts of (doc_id, term, n) rows, for repeated and null ids too, and tokenise once."""
    from docsift.operators import topics as T
    lists = [(1, ["a", "b", "a"]), (2, ["a"]), (2, ["c", "a"]), (3, []), (None, ["a"]), (4, ["d", "b"])]
    toks = spark.createDataFrame(lists, "doc_id long, tokens array<string>")
    long = toks.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n"))
    rows = [(5, 1, 0), (5, 2, 0), (5, 2, 1), (5, 3, -1), (5, 4, 1), (9, 1, 1), (9, 2, 0), (9, 2, 0), (9, 4, 0),
            (5, None, 0)]
    assign = spark.createDataFrame(rows, "m int, doc_id long, topic int")
    n = {}
    for d, terms in lists:
        for t in terms:
            n[d, t] = n.get((d, t), 0) + 1
    want = {}
    for m, d, topic in rows:
        for (e, t), c in n.items():
            if d is not None and d == e:
                want[m, topic, t] = want.get((m, topic, t), 0) + c
    for form in (toks, long):
        got = {(r.m, r.topic, r.term): r.tf for r in T.class_term_counts(assign, form, ["m"]).collect()}
        assert got == want
    plan = T.class_term_counts(assign, toks, ["m"])._jdf.queryExecution().optimizedPlan().toString()
    assert "size(tokens" not in plan


def test_representative_docs_against_plain_python(spark):
    """Scores of blocks of one document each, of one block, and of both forms of the counts are the plain ones."""
    import math
    from docsift.operators import topics as T
    lists = [(i, [f"w{(i * j) % 7}" for j in range(1, 3 + i % 5)]) for i in range(1, 13)] + [(3, ["w1", "w1"]), (20, [])]
    toks = spark.createDataFrame(lists, "doc_id long, tokens array<string>")
    long = toks.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n"))
    rows = [(m, i, i % m) for m in (2, 3) for i in range(1, 13)] + [(2, 3, 0), (2, 20, 1)]
    assign = spark.createDataFrame(rows, "m int, doc_id long, topic int")
    ct = T.ctfidf(assign, long, ["m"])
    w = {(r.m, r.topic, r.term): (r.weight, r.weight / r.tf) for r in ct.collect()}
    n = {}
    for d, terms in lists:
        for t in terms:
            n.setdefault(d, {}).setdefault(t, 0)
            n[d][t] += 1
    want = {}
    for m, topic in {(m, t) for m, _, t in rows}:
        norm = math.sqrt(sum(x[0] ** 2 for key, x in w.items() if key[:2] == (m, topic)))
        sims = []
        for d in {d for k, d, t in rows if (k, t) == (m, topic) and d in n}:
            dot = sum(c * w[m, topic, t][0] * w[m, topic, t][1] for t, c in n[d].items())
            sims.append((-round(dot / math.sqrt(sum((c * w[m, topic, t][1]) ** 2 for t, c in n[d].items())) / norm, 9), d))
        for rank, (s, d) in enumerate(sorted(sims)[:3], 1):
            want[m, topic, rank] = (d, -s)
    for form, size in ((toks, 500_000), (toks, 2), (long, 4)):
        got = T.representative_docs(ct, form, assign, 3, ["m"], block_tokens=size).collect()
        assert {(r.m, r.topic, r.rank): (r.doc_id, round(r.similarity, 9)) for r in got} == want


ODD_TEXTS = [(1, "Alpha alpha2 42 the ALPHA2 Kelvin 007bond x-ray a--b"), (2, "İstanbul naïve 3μm  beta gamma"),
             (3, None), (4, ""), (5, "12 34 the of"), (5, "beta beta"), (6, "it's e-mail --- -ab ab- ſharp 9z"), (None, "lost")]


def _odd(spark):
    return spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")


def _sweep(spark):
    return spark.createDataFrame([(m, d, t) for m in (5, 10) for d, t in ((1, 0), (2, 0), (3, 1), (4, 1), (5, 1 if m == 5 else 0), (6, -1))]
                                 + [(5, 1, 0)], "min_cluster_size int, doc_id long, topic int")


def test_texts_count_like_token_lists(spark):
    from docsift.functions.text import tokens_alnum, tokens_coherence
    from docsift.operators import tokens as C
    docs, assign = _odd(spark), _sweep(spark)
    for texts, lists in ((C.doc_texts(docs, "text"), tokens_alnum("text")),
                         (C.coherence_texts(docs, "text"), tokens_coherence("text"))):
        want = T.ctfidf(assign, docs.select("doc_id", lists.alias("tokens")), ["min_cluster_size"])
        got = T.ctfidf(assign, texts, ["min_cluster_size"])
        rows = [sorted((r.min_cluster_size, r.topic, r.term, r.tf, round(r.weight, 12)) for r in x.collect()) for x in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 10


def test_counts_held_by_a_task_are_handed_on(spark, monkeypatch):
    import pyarrow as pa
    from docsift.operators import tokens as C
    monkeypatch.setattr(C, "HELD_TERMS", 2)
    batch = pa.RecordBatch.from_pydict({"sig": [7, 8, 7], "alnum_text": ["cat dog cat", "cat the 5", "Emu CAT"]})
    out = [r for b in C.count_terms("alnum_text", "sig")(iter([batch, batch])) for r in b.to_pylist()]
    assert len(out) == 8                                  # each batch's counts on their own
    total = {}
    for r in out:
        total[r["sig"], r["term"]] = total.get((r["sig"], r["term"]), 0) + r["n"]
    assert total == {(7, "cat"): 6, (7, "dog"): 2, (7, "emu"): 2, (8, "cat"): 2}


def test_ctfidf_shuffles_counts_by_term_alone(spark):
    from docsift.operators import tokens as C
    ct = T.ctfidf(_sweep(spark), C.doc_texts(_odd(spark), "text"), ["min_cluster_size"])
    plan = ct._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line and "term#" in line]
    assert len(dealt) == 1 and "hashpartitioning(term#" in dealt[0]


def test_ctfidf_of_many_topic_sets_is_the_same(spark, monkeypatch):
    from docsift.operators import tokens as C
    texts = C.doc_texts(_odd(spark), "text")
    few = sorted(map(tuple, T.ctfidf(_sweep(spark), texts, ["min_cluster_size"]).collect()))
    monkeypatch.setattr(T, "FEW_SIGS", 0)
    assert sorted(map(tuple, T.ctfidf(_sweep(spark), texts, ["min_cluster_size"]).collect())) == few


def test_representative_docs_of_texts_and_lists_agree(spark):
    from docsift.functions.text import tokens_alnum
    from docsift.operators import tokens as C
    docs, assign, keys = _odd(spark), _sweep(spark), ["min_cluster_size"]
    texts = C.doc_texts(docs, "text")
    ct = T.ctfidf(assign, texts, keys)
    lists = docs.select("doc_id", tokens_alnum("text").alias("tokens"))
    counts = C.doc_term_freq(docs, "text")
    got = [sorted((r.min_cluster_size, r.topic, r.rank, r.doc_id, round(r.similarity, 9)) for r in T.representative_docs(
        ct, dtf, assign, 3, keys, block_tokens=size).collect())
        for dtf, size in ((texts, 500_000), (texts, 2), (lists, 500_000), (lists, 2), (counts, 500_000))]
    assert all(g == got[0] for g in got) and len(got[0]) == 8


def test_representative_docs_hands_out_model_rows_without_terms(spark):
    from docsift.operators import tokens as C
    texts = C.doc_texts(_odd(spark), "text")
    ct = T.ctfidf(_sweep(spark), texts, ["min_cluster_size"])
    reps = T.representative_docs(ct, texts, _sweep(spark), 3, ["min_cluster_size"])
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    group = next(line for line in plan.splitlines() if "FlatMapCoGroupsInPandas" in line)
    assert "term" not in group.split("score", 1)[1]


def test_words_held_are_the_same_from_texts_and_token_lists(spark, monkeypatch):
    from docsift.functions.text import tokens_coherence
    from docsift.operators import coherence as H
    from docsift.operators import tokens as C
    docs = _odd(spark).unionByName(_odd(spark).limit(1))
    lists = spark.createDataFrame([(m, 0, i, t) for m in (5, 10) for i, t in enumerate(
        ["alpha", "x-ray", "beta", "the", "ab", "---", "naïve", "μm", "9z", "none", "kelvin", "-ab", "sharp"][:m + 3], 1)],
        "min_cluster_size int, topic int, rank int, term string")
    keys = ["min_cluster_size"]
    rows = lambda d: sorted(map(str, H.doc_vocab(d, lists, keys).collect()))
    want = rows(docs.select("doc_id", tokens_coherence("text").alias("tokens")))
    texts = C.coherence_texts(docs, "text")
    plan = H.doc_vocab(texts, lists, keys)._jdf.queryExecution().executedPlan().toString()
    assert rows(texts) == want and len(want) > 10 and "regexp_extract_all" not in plan
    monkeypatch.setattr(H, "FEW_WORDS", 2)
    assert rows(texts) == want


def test_a_tasks_texts_are_counted_in_chunks(monkeypatch):
    import pyarrow as pa
    from docsift.operators import tokens as C
    monkeypatch.setattr(C, "CHUNK_BYTES", 9)
    batch = pa.RecordBatch.from_pydict({"sig": [7, 8, 7, 7], "alnum_text": ["cat dog cat", "", " cat\x00the 5 É", "a very long text of cats"]})
    got = [(r["sig"], r["term"], r["n"]) for b in C.count_terms("alnum_text", "sig")(iter([batch.slice(1), batch])) for r in b.to_pylist()]
    assert sorted(got) == sorted([(7, "cat", 2), (7, "dog", 1), *2 * [(7, "cat", 1), (7, "long", 1), (7, "text", 1), (7, "cats", 1)]])


def test_a_term_is_dealt_whole_across_batches():
    import pyarrow as pa
    entries = [(3, 0, 0, 1), (3, 2, 1, 2), (4, 1, 0, 1), (4, 2, 1, 1)]
    rows = [(3, "a", 1), (3, "b", 5), (4, "b", 7), (4, "c", 2)]
    batches = [pa.RecordBatch.from_pydict({"sig": [s], "term": [t], "n": [n]}) for s, t, n in rows]
    got = sorted(tuple(r.values()) for b in T._dealer(entries)(iter(batches)) for r in b.to_pylist())
    assert got == [("a", 0, 1, 1), ("a", 2, 2, 2), ("b", 0, 5, 12), ("b", 1, 7, 12), ("b", 2, 17, 17), ("c", 1, 2, 2), ("c", 2, 2, 2)]


def test_ctfidf_sorts_counts_once_before_settings(spark):
    from docsift.operators import tokens as C
    plan = T.ctfidf(_sweep(spark), C.doc_texts(_odd(spark), "text"), ["min_cluster_size"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "min_cluster_size" not in plan.split("Sort [", 1)[1].split("]", 1)[0]
