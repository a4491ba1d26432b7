from __future__ import annotations

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon".split()


def sentence(start: int, count: int) -> str:
    """``count`` words that do not repeat elsewhere."""
    return " ".join(f"{WORDS[(start + i) % len(WORDS)]}{start}x{i}" for i in range(count))


#: (doc_id, text, source): nulls, blanks, repeated rows, near copies, shared passages, a long text.
DOCS = [
    (0, sentence(1, 60), "a"), (1, sentence(1, 60), "a"), (2, sentence(1, 60).replace("x30", "y30"), "b"),
    (3, None, "a"), (4, "", None), (5, " \t\n ", "b"), (6, "One", "b"), (7, "one  TWO\tthree", None),
    (8, f"{sentence(2, 40)}\n{sentence(3, 50)} {sentence(4, 10)}", "a"), (9, f"{sentence(5, 30)} {sentence(3, 50)}", "c"),
    (10, " ".join([sentence(6, 36)] * 2), "c"), (11, "é" * 40 + " " + sentence(7, 3000), "a"),
    (12, sentence(8, 80), "d"), (12, sentence(8, 80), "d"), (None, sentence(9, 50), "a"), (13, "x " * 400, "a"),
    (14, sentence(3, 34), "b"), (15, "\u00a0 \u2003 und \x00 \x1f", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases with extra columns whose names the operators use themselves."""
    rows = [
        (i, t, s, "en", 1, 2.0, "k", None, True) for i, t, s in DOCS
    ]
    kind = "doc_id long, text string, source string, lang string, key int, size double, n string, window string, keep boolean"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
