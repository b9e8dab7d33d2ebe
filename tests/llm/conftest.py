import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ba", "de", "fi", "go", "hu", "ja", "ke", "lu")]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, n: int) -> str:
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def corpus():
    """Originals, exact and near copies, a near-copy group whose members mostly do not link with each other, shared passages,
    nulls, empty and short texts, repeated rows, one very long text."""
    rng = random.Random(7)
    base = [text_of(rng, rng.randrange(60, 200)) for _ in range(40)]
    texts = list(base) + base[:5] + [b.upper() for b in base[5:8]]
    texts += [edited(rng, b, 2) for b in base[:10]]
    hub = text_of(rng, 150)
    texts += [hub] + [edited(rng, hub, k) for k in range(1, 9) for _ in range(6)]
    passage = text_of(rng, 70)
    texts += [f"{text_of(rng, 60)} {passage} {text_of(rng, 40)}" for _ in range(8)]
    texts += [None, None, "", " \n\t ", "one", "one", "one two three", "ONE two three", text_of(rng, 20_000)]
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return rows + rows[:2]
