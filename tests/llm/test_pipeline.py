"""The pipeline's stages, each against plain Python on what its predecessor kept, and the whole run."""
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_line_dedup import lev, norm  # noqa: E402
from .test_ngram_join import brute as components  # noqa: E402
from .test_rules_and_leaks import stats, words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _had string, _gone string"
STAGES = dict(corpus_pipeline.STAGES)


def texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    line = lambda k: " ".join(word() for _ in range(k))
    leak, footer = line(12), line(9)
    own = []
    for i in range(60):
        parts = [line(rng.randint(8, 20)) for _ in range(5)]
        if i % 5 == 0:
            parts.insert(2, footer if i % 2 else footer + "!")
        if i % 12 == 0:
            parts.insert(1, "so " + leak + " ends")
        own.append("\n".join(parts))
    bad = ["\n".join("vile " + " ".join(rng.choice(["vile", "awful", "ugly"]) + " " + line(2) for _ in range(4))
                     for _ in range(6)) for _ in range(60)]
    near = [t.replace(" ", "  ", 3) for t in own[:6]] + [own[7], own[7]]
    odd = [None, "", "\n \n", "---", "short text", "again and again " * 60, footer, " ".join(line(40) for _ in range(300))]
    rows = [(3 * i, t) for i, t in enumerate(own + bad + near + odd)]
    rows += [(rows[8][0], line(70)), (None, line(80)), rows[9]]           # an equal id, a null one, a repeated row
    rng.shuffle(rows)
    return [(d, t, "en", "s", None if t is None else len(t), "x", "y") for d, t in rows], bad, leak


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rows, bad, leak = texts()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if r[1] in bad else 1, 0) for r in rows], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, bad, leak


def key(r):
    return r[0] is not None, r[0] or 0, r[1] or ""


def kept_lines(rows):
    """doc_id -> text, by all pairs of lines."""
    at = sorted(((r[0] is not None, r[0] or 0), i, norm(t)) for r in rows for i, t in enumerate((r[1] or "").split("\n")))
    first, up = {}, {}
    for d, i, t in at:
        if t:
            first.setdefault(t, (d, i))
            up[t] = t

    def root(t):
        while up[t] != t:
            t = up[t]
        return t
    every = sorted(up)
    for a in every:
        for b in every:
            if a < b and 17 * max(len(a), len(b)) <= 20 * min(len(a), len(b)) and 20 * lev(a, b) <= 3 * max(len(a), len(b)):
                up[root(a)] = root(b)
    keep = {}
    for t in every:
        keep[root(t)] = min(keep.get(root(t), first[t]), first[t])
    gone = {(d, i) for d, i, t in at if t and keep[root(t)] != (d, i)}
    out = []
    for r in rows:
        d = (r[0] is not None, r[0] or 0)
        kept = r[1] if r[1] is None else "\n".join(t for i, t in enumerate(r[1].split("\n")) if (d, i) not in gone)
        if (kept or "").strip() or not (r[1] or "").strip():
            out.append((r[0], kept))
    return out


def result(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=key)


def test_quality(spark, data):
    d, rows, bad, _ = data
    got = result(STAGES["quality rules"](spark, spark.createDataFrame(rows, DOCS), d))
    base = [(r[0], r[1]) for r in rows if stats(r[1])[0] >= 50 and 2 * stats(r[1])[4] <= stats(r[1])[0]]
    assert got == sorted((r for r in base if r[1] not in bad), key=key)


def test_lines(spark, data):
    d, rows, _, _ = data
    small = [r for r in rows if len(r[1] or "") < 2000 and not (r[1] or "").startswith("vile")
             and [x[0] for x in rows].count(r[0]) == 1]
    got = STAGES["line dedup"](spark, spark.createDataFrame(small, DOCS), d).cache()
    assert result(got) == sorted(kept_lines(small), key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_near_duplicates(spark, data):
    d, rows, _, _ = data
    own = [(i, r[1]) for i, r in enumerate(sorted({(r[0], r[1]) for r in rows}, key=key))]
    back = {i: r for i, r in enumerate(sorted({(r[0], r[1]) for r in rows}, key=key))}
    groups = {}
    for i, (_, comp) in components(own).items():
        groups.setdefault(comp, []).append(back[i])
    got = result(STAGES["n-gram Jaccard join"](spark, spark.createDataFrame(rows, DOCS), d))
    for members in groups.values():
        # of equal ids either may stay
        left = [m for m in members if m in got]
        assert len(left) == 1 and left[0][0] == min(members, key=key)[0]
    assert len(got) == len(groups) + sum((r[0], r[1]) in got for r in rows) - len(set(got))


def test_leaks(spark, data):
    d, rows, _, leak = data
    w = words(leak)
    wins = [w[i:i + 10] for i in range(len(w) - 9)]

    def hit(t):
        x = words(t)
        return any(x[i:i + 10] in wins for i in range(len(x) - 9))
    got = result(STAGES["benchmark decontamination"](spark, spark.createDataFrame(rows, DOCS), d))
    assert 0 < len(got) < len(rows) and got == sorted(((r[0], r[1]) for r in rows if not hit(r[1])), key=key)


def test_run_equals_its_stages_one_by_one(spark, data):
    d, rows, _, _ = data
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    lengths = {}
    for r in docs.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, seqs = {}, {}
    for r in corpus_pipeline.run(spark, d).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == lengths and len(got) > 40
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 4096


def test_stages_of_empty_tables(spark, data):
    d, rows, _, _ = data
    none = spark.createDataFrame([], DOCS)
    assert all(stage(spark, none, d).count() == 0 for stage in STAGES.values())
