import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Ordinary words and marks, and rows that every operator must bear.
PROSE = "the of and a to in is that for on it as with was at by from this which or an be are not have but they one all we can has more"


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    w = PROSE.split() + [f"word{k}" for k in range(200)]
    return " ".join(r.choice(w) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash with results."""
    base = prose(1, 300)
    rows = [
        (1, base), (2, base), (2, base), (3, base.replace("word7", "word8")), (4, None), (5, ""), (6, "  \n\t \n"), (7, "one"), (8, "one two"),
        (9, "x" * 3000), (10, "ab" * 1500), (11, prose(2, 30_000)), (12, "é\u0301 \U0001f600 " * 200), (13, prose(3, 80) + "\n" + prose(4, 70)), (14, prose(3, 80) + "\n" + prose(5, 70)),
        (15, "Line\n" * 40), (None, base), (None, "alone here"), (16, "<|endoftext|> a <|endoftext|>"), (17, "\\### Assistant: </turn> ok"),
    ]
    full = [(i, t, "en", "s", len(t or ""), 0.5, "c", "f", 3, "k") for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, fingerprint string, n_words int, kept string"
    return spark.createDataFrame(full, names)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
