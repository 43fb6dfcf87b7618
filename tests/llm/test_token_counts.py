import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docsift.llm import token_counts as T
from docsift.llm.packing import best_two_fit, pack

from .util import ROWS, corpus

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["don't o'er it's 'S x' 'll", "ªº ß ŉ Ǆ á é.日本語。 ab… १२ ʰ", "A.B c-d <|EndOfText|> x<|endoftext|>.",
       "ſ K Å ﬁ J̌ ǰ", "A <|endoftext|> b\x1c c d é ́x\tİstanbul ΑΣ Σ", "... wow!!! a.,b ,, .\n.\n"]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def ids(model, t):
    return model.encode(t or "", add_special_tokens=False).ids


def apply(text, edits):
    out, at = b"", 0
    for s, e, new in edits:
        out += text[at:s] + new.encode()
        at = e
    return (out + text[at:]).decode()


def test_counts_after_edits(spark, model):
    rng = random.Random(2)
    rows = []
    for d, t, *_ in corpus(5) + [(5000 + k, t, "", "") for k, t in enumerate(ODD)]:
        b = (t or "").encode()
        cuts = sorted(rng.randrange(len(b) + 1) for _ in range(2 * rng.randint(0, 4)))
        cuts = [c for c in cuts if c == len(b) or b[c] & 0xC0 != 0x80]
        edits = [(s, e, rng.choice(["", "x", " ", "new word", "\n", "3."])) for s, e in zip(cuts[::2], cuts[1::2])]
        rows.append((d, t, edits))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {T.EDITS}").repartition(3)
    trees = T.build_trees(df, PATH, leaf=64)
    got = {r.doc_id: r for r in T.apply_edits(df, trees, PATH).collect()}
    for d, t, edits in rows:
        r = got[d]
        assert r.n_tokens_before == len(ids(model, t))
        assert r.n_tokens_after == len(ids(model, apply((t or "").encode(), edits))), (t, edits)
        half = len(r.sums) // 2
        assert all(r.sums[i] == r.sums[2 * i] + r.sums[2 * i + 1] for i in range(1, half))
        if not edits:
            assert r.n_reencoded == 0


def random_edits(rng, text):
    b = (text or "").encode()
    cuts = sorted(rng.choice([0, len(b), rng.randrange(len(b) + 1)]) for _ in range(2 * rng.randint(0, 4)))
    cuts = [c for c in cuts if c == len(b) or b[c] & 0xC0 != 0x80]
    return [(s, e, rng.choice(["", "x", " ", "new word", "\n", "3.", " many words more " * 9])) for s, e in zip(cuts[::2], cuts[1::2])]


def test_a_tree_serves_one_edit_pass_after_the_other(spark, model):
    rng = random.Random(8)
    texts = {d: t for d, t, *_ in corpus(6, 30)} | {7000 + k: t for k, t in enumerate(ODD)} | {None: "null id, null version"}
    schema = f"doc_id long, text string, sums string, edits {T.EDITS}"
    frame = lambda now: spark.createDataFrame([(d, t, "clash", random_edits(rng, t)) for d, t in now.items()], schema)
    docs = frame(texts)
    trees = T.build_trees(docs, PATH, leaf=32)
    for _ in range(4):
        edits = {r.doc_id: r.edits for r in docs.collect()}
        out = T.apply_edits(docs, trees, PATH).collect()
        want = {d: apply((t or "").encode(), edits[d]) for d, t in texts.items()}
        assert {r.doc_id: r.text for r in out} == want
        for r in out:
            assert (r.n_tokens_before, r.n_tokens_after) == (len(ids(model, texts[r.doc_id])), len(ids(model, r.text)))
            b = r.text.encode()
            leaves = [b[x:y].decode() for x, y in zip(r.bounds, r.bounds[1:])]
            assert "".join(leaves) == r.text and len(r.sums) // 2 >= len(leaves)
            half = len(r.sums) // 2
            assert r.sums[half:half + len(leaves)] == [len(ids(model, t)) for t in leaves]
        texts = want
        docs = frame(texts)
        trees = spark.createDataFrame([(r.doc_id, r.version, r.bounds, r.sums) for r in out],
                                      "doc_id long, version long, bounds array<int>, sums array<long>")


def test_repeated_rows_equal_ids_and_a_very_long_text(spark, model):
    long_ = "word and 1234567 more\n" * 20_000 + "x" * 50_000
    rows = [(1, "one 12345"), (1, "two words 123456"), (1, "one 12345"), (2, long_)]
    got = T.edit_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(r.text for r in got if r.doc_id == 1) == ["one 0", "one 0", "two words 0"]
    r = next(r for r in got if r.doc_id == 2)
    assert r.text == "word and 0 more\n" + "x" * 50_000 and r.n_tokens_after == len(ids(model, r.text))


def test_cleaning_edits(spark, model):
    text = "a 1234567\nsame line\nb\nsame line\nsame line\n\n99999"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.edit_counts(df, PATH).collect()}
    assert got[1].n_tokens_after == len(ids(model, "a 0\nsame line\nb\n\n0")) and got[1].n_edits == 4
    assert got[2].n_tokens_after == got[3].n_tokens_after == 0


def test_packing_is_a_partition_of_the_ids(spark, model):
    import zlib
    import numpy as np
    rows = corpus(7) + [(9000 + k, t, "", "") for k, t in enumerate(ODD)] + [(9100, "w " * 300, "", "")]
    got = pack(spark.createDataFrame(rows, ROWS).repartition(4), PATH, size=100).collect()
    want = {}
    for d, t, *_ in rows:
        own = ids(model, t) + [1]
        for k in range(0, len(own), 100):
            part = own[k:k + 100]
            want[d, k // 100] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100
    assert len(seqs) <= 1.02 * -(-sum(n for _, n, _ in want.values()) // 100) + 1


def test_best_two_fit():
    import numpy as np
    # greedy fills 10 with 6 + 3 and leaves 1; 3 gives way to 2 + 2
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert best_two_fit(counts)[0] == (1, {6: 1, 2: 2})
    for seed in range(100):
        rng = np.random.default_rng(seed)
        counts = np.bincount(rng.integers(1, 31, rng.integers(1, 60)), minlength=31)
        used = np.zeros(31, int)
        for times, bin_ in best_two_fit(counts):
            assert times > 0 and sum(n * k for n, k in bin_.items()) <= 30
            for n, k in bin_.items():
                used[n] += times * k
        assert (used == counts).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    assert pack(df, PATH).count() == 0 and T.edit_counts(df, PATH).count() == 0


def test_ranks_of_a_hot_length(spark):
    from docsift.llm.packing import place, token_pieces
    df = spark.createDataFrame([(i, "same words here") for i in range(500)], "doc_id long, text string")
    got = place(token_pieces(df, PATH, 64).cache(), 64, group_rows=50).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 500
