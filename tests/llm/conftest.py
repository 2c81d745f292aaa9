import pytest

BASE = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"


def prose(seed: int, n: int) -> str:
    """``n`` words that differ between seeds."""
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, blanks, long texts, copies, near copies, shared passages, repeated rows."""
    a, b, passage = prose(1, 120), prose(2, 90), prose(3, 60)
    near = a.split()
    near[60] = "changed"
    return [
        (1, a), (2, a), (3, " ".join(near)), (4, b), (4, b), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "One two"), (10, "one  TWO"),
        (11, prose(4, 30) + " " + passage + " " + prose(5, 20)), (12, passage + "\n" + prose(6, 40)), (13, prose(7, 25) + " " + passage),
        (14, prose(8, 20000)), (15, a.upper()), (16, a.replace(" ", "\n", 3)), (17, "the " * 3000), (18, "é" * 4000 + " 漢字 \U0001f600"), (None, "no id here"),
        (19, prose(1, 119)),
    ]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    """The same with extra columns, whose names clash with what operators make."""
    rows = [(d, t, "x", 1, None, 2.5, "k") for d, t in hard_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, tid int, source string, kept double, island string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
