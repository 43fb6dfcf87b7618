"""Fixture documents with copies, shared passages, periodic and degenerate texts."""
import random

ROWS = "doc_id long, text string, lang string, extra string"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "é", "ing", "X"]) for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() + rng.choice(["", "", ".", ",\n", "\t "]) for _ in range(k))
    passage, short = text(70), text(55)
    texts = [text(rng.randint(1, 160)) for _ in range(n)]
    for i in range(0, n, 3):
        texts[i] = text(rng.randint(0, 30)) + " " + rng.choice([passage, short]) + " " + text(rng.randint(0, 30))
    base = text(120).split(" ")
    for _ in range(n // 4):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [texts[1]] * 5 + ["", None, " \n ", "a", "For " * 300, "ab " * 130 + passage, "x" * 700, passage]
    rows = [(i * 3 + 1, t, "en", "z") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows
