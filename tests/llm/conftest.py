import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, n string"


def words(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "an", "in", "on", "re", "é"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(seed=5, n=60):
    """Documents with copies, near copies, repeats, nulls, empty texts and one long text."""
    rnd = random.Random(seed)
    passage = "\n".join(words(rnd, 12) for _ in range(4))
    texts = [words(rnd, rnd.randint(1, 120)) for _ in range(n)]
    texts += [passage + "\n" + words(rnd, 10), words(rnd, 8) + "\n" + passage, passage, texts[3], texts[3], texts[5] + " tail"]
    long = texts[7].split(" ")
    texts += [" ".join(long[:-1] + ["changed"]), None, "", " \t\n", words(rnd, 4000), "a", "a b", "x\ny", "\n\n\n\n\n", "SAME same", "same SAME", "ab " * 300]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no identifier " * 5, "de", None, 3, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
