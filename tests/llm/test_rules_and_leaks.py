import re

import pandas as pd
import pytest

from docsift.llm import quality_rules as Q
from docsift.llm.decontam import contamination, decontaminate

from .util import ROWS, corpus

ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short ITEM"), (3, None), (4, "--"),
         (5, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten")]


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination_equals_brute_force(spark):
    rows = corpus(9, 20) + [
        (700, "x one two, THREE four five six seven eight nine ten eleven y", "en", "z"), (701, "a Short-item", "en", "z"),
        (702, "w " * 2500 + "one two three four five six seven eight nine ten " + "v " * 1500, "en", "z"),
        (703, "one two three four five six seven eight nine", "en", "z")]
    df = spark.createDataFrame(rows, ROWS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in contamination(df, bench).collect()}
    for d, t, *_ in rows:
        w, hit, items = words(t), set(), set()
        for i, text in ITEMS:
            x = words(text)
            k = min(10, len(x))
            for s in range(len(x) - k + 1 if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == x[s:s + k]:
                        hit |= set(range(p, p + k))
                        items.add(str(i))
        assert (got[d].n_words, got[d].n_hit, got[d].items) == (len(w), len(hit), sorted(items)), d
    left = {r.doc_id: r.text for r in decontaminate(df, bench).collect()}
    assert set(left) == {d for d, *_ in rows} - {700, 701, 702}
    cut = {r.doc_id: r.text for r in decontaminate(df, bench, action="span").collect()}
    assert cut[700] == "x  ,          y" and cut[701] == "a -" and len(cut) == len(rows)
    with pytest.raises(ValueError):
        decontaminate(df, bench, action="line")


def test_decontamination_of_empty_tables(spark):
    df = spark.createDataFrame(corpus(1, 6), ROWS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in contamination(df, none).collect())
    assert contamination(df.limit(0), none).count() == 0


def stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))


def test_stats_equal_brute_force(spark):
    rows = corpus(4, 25) + [(800, "a b\na b\n\n\n a b\nc#|%", "en", "z"), (801, "é ü x y <&>", "en", "z")]
    got = {r.doc_id: r for r in Q.text_stats(spark.createDataFrame(rows, ROWS)).collect()}
    for d, t, *_ in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(t), t


def test_decision_list_finds_a_planted_conjunction():
    import numpy as np
    rng = np.random.default_rng(1)
    x = pd.DataFrame({"words": rng.uniform(0, 100, 3000), "flagged": rng.uniform(0, 10, 3000)})
    bad = ((x.words > 60) & (x.flagged > 7)).to_numpy()
    rules = Q.learn(x[:2000], bad[:2000], np.arange(2000) % 3)
    told = np.zeros(1000, bool)
    for r in rules:
        told |= r.covers(x[2000:])
    assert (told == bad[2000:]).mean() > 0.98 and Q.learn(x, np.zeros(3000, bool), np.arange(3000) % 3) == []


def test_rules_without_labels_or_documents(spark):
    df = spark.createDataFrame(corpus(2, 6), ROWS)
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = Q.quality_rules(df, labels).collect()
    assert len(got) == df.count() and all(r.kept != r.base_failed for r in got)
    assert Q.quality_rules(df.limit(0), labels.limit(0)).count() == 0


def test_hits_by_shuffle_equal_hits_by_set(spark):
    from docsift.llm import decontam
    rows = corpus(9, 20) + [(700, "x one two, THREE four five six seven eight nine ten eleven y", "", ""),
                            (701, "a Short-item short item", "", ""), (702, None, "", "")]
    docs = decontam.documents(spark.createDataFrame(rows, ROWS))
    items = decontam.item_windows(spark.createDataFrame([*ITEMS, (6, "x"), (7, rows[0][1])], "item_id long, text string"))
    runs = [sorted(map(tuple, decontam.hits(docs, items, block=b, max_set=m).collect()))
            for b, m in ((1000, 100_000), (7, 100_000), (1000, 0))]
    assert runs[0] and runs[0] == runs[1] == runs[2]
