import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("the of and alpha beta gamma delta eps zeta eta theta iota kappa la der mu nu xi ómicron 12 x-y".split()) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return words_of


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies and shared passages."""
    base = [words_of(k, 20 + 13 * k) for k in range(12)]
    passage = words_of(99, 60)
    texts = [*base, None, "", " \t\n", "one", base[3], base[3], base[5] + " tail end", "lead " + base[5], passage, words_of(50, 9) + "\n" + passage + "\n" + words_of(51, 9), passage + " " + words_of(52, 70), "x" * 5000, words_of(60, 9000), "é" * 49, "é" * 60, "<|endoftext|> a<|endoftext|>", "it's   odd²  x\x1cy\n\n", "A b C d E", "a B c D e"]
    out = [(k, t, "en", None if k % 7 == 3 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[4], (None, "no id here", "en", "s1", 10)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(1).alias(c) for c in ("h", "b", "size", "score", "token", "key", "pid", "g", "open", "target", "media", "signatures")))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
