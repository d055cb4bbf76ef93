import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with copies, near copies, chains, nulls, short, empty and long texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, texts = [], []
    for _ in range(12):
        base = make(rng.randint(40, 160))
        texts.append(base)
        for _ in range(rng.randint(0, 8)):
            base = list(base)
            for _ in range(rng.choice((1, 1, 2, 4, 9))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(base)
    texts += [make(60) for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    n = len(rows)
    extra = [rows[3][1], rows[3][1].upper(), rows[3][1].replace(" ", "\n\t"), "one two", "ONE  two", "one two three", "", "   \n", None, "é", "word " * 20_000, "É", "x" * 50_000]
    return rows + [(n + k, t) for k, t in enumerate(extra)]
