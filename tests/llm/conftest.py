from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdeghilmnorstu", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(7)
    base = [sentence(rng, n) for n in (3, 4, 5, 6, 40, 120, 300, 30_000)]
    near = base[6].split()
    near[150] = "changed"
    texts = [*base, base[5], base[5], " ".join(near), base[5].upper() + "!", None, "", " \n\t ", "é" * 50, "x" * 100_000, "1 2 3", "don't  <|endoftext|> stop², ok", "a\x00b \U0001f600 ß", "mail a@b.co now, card 4111 1111 1111 1111"]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, base[6], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
