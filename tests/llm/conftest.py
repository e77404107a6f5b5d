import datetime

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(n, seed=1):
    return " ".join(WORDS[(i * seed + i // 3) % len(WORDS)] for i in range(n)) + "."


EDGE = [
    (1, prose(40), "en", "s"), (2, None, "en", "s"), (3, "", None, "s"), (4, prose(40), "en", None),
    (4, prose(40), "en", None), (None, "no id, 12 't's!", "fr", "s"), (5, " \n  two  spaces\n\n\tend ", "fr", "s"),
    (6, "12345 !!! ???", "en", "s"), (7, "x" * 3000 + " " + prose(3000, 5), "fr", "s"),
    (8, "<|endoftext|>it's <|endoftext|> été 漢字 \U0001f600́", "fr", "s"), (9, "a", "en", "s"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, empty, repeated, very long and odd texts, and
    extra columns whose names clash with those of the operators."""
    rows = [(*r, len(r[1] or ""), 1.5, "x", 7, datetime.date(2020, 1, 1)) for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 "score double, ids string, shard int, component_id date").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
