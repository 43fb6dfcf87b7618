"""Tokenizer alignment against a token-by-token walk over both encodings."""
import collections
import hashlib

import pytest

from docsift.llm import alignment
from tests.llm.util import ROWS, corpus

P = pytest.importorskip("public_tokenizers")
A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))


def walk(texts):
    """For every text (n_a, n_b, n_groups, n_links, sha, links)."""
    import sentencepiece
    from tokenizers import Tokenizer
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    out = []
    for text in texts:
        if not text:
            out.append((0, 0, 0, 0, "", []))
            continue
        e = ta.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in ((i, tb.id_to_piece(i)) for i in tb.encode(text))]
        if not all(b"".join(t for _, t in x) == (" " + text).encode() for x in (a, b)):
            out.append((0, 0, 0, 0, "", []))
            continue
        groups, links, own_a, own_b, i, j, end_a, end_b = [], [], [], [], 0, 0, len(a[0][1]), len(b[0][1])
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                own_a.append(str(a[i][0]))
                i += 1
                end_a += len(a[i][1]) if i < len(a) else 0
            if step_b:
                own_b.append(str(b[j][0]))
                j += 1
                end_b += len(b[j][1]) if j < len(b) else 0
            if step_a and step_b:
                groups.append(",".join(own_a) + "|" + ",".join(own_b))
                own_a, own_b = [], []
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), sha, links))
    return out


def brute(rows):
    walked = walk([t for _, t in rows])
    count = collections.Counter(x for w in walked for x in w[5])
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((r[0], *w[:4], sum(count[x] == top[x[1]] for x in w[5]), sum(count[x] for x in w[5]), w[4])
                   for r, w in zip(rows, walked)), key=repr)


def aligned(df):
    return sorted((tuple(r) for r in alignment.tokenizer_alignment(df, A, B).collect()), key=repr)


ODD = ["", None, " ", "  two  spaces", "▁mark", "<|endoftext|> and </s> <unk>", "naïve 中文 😀 \t\n\r x\x00y", "a" * 5000,
       "word " * 3000, "repeated row", "repeated row", "é", "\u2028 odd \xa0 space"]


@pytest.mark.parametrize("heavy", [100_000, 3])
def test_equals_walk(spark, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)          # 3: most irregular pairs go through the shuffle
    monkeypatch.setattr(alignment, "FLUSH", 50)
    rows = corpus(n=25) + [(9000 + i, t, "en", "z") for i, t in enumerate(ODD)] + [(7, "same id", "", ""),
                                                                                 (7, "same id twice", "", ""),
                                                                                 (None, "null id", "", "")]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert aligned(df) == brute([(r[0], r[1]) for r in rows])


def test_clashing_columns_and_empty(spark):
    rows = [(1, "one two", 5, "x", 0), (2, None, 6, "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, pairs string, n_a int")
    assert aligned(df) == brute([(r[0], r[1]) for r in rows])
    empty = alignment.tokenizer_alignment(df.limit(0), A, B)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                                       "count_sum", "groups_sha256"]


def test_long_text(spark):
    text = "the quick naïve 中 fox, " * 40_000 + "x" * 100_000
    df = spark.createDataFrame([(1, text, "", "")], ROWS)
    assert aligned(df) == brute([(1, text)])
