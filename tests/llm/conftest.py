import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, size string, found string, predicted string, spans string, _d string, target string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows, signs of many scripts."""
    rng = random.Random(4)
    passage = words(rng, 120)
    long = "\n".join(words(rng, 40) for _ in range(400))
    base = words(rng, 150)
    texts = [None, "", " \t\n", "one", "one two", base, base, base.replace(" ", "  "), base.upper(), base + " end", "x " + base, words(rng, 60) + "\n" + passage + "\n" + words(rng, 60), passage, long, words(rng, 5) + " " + long[:5000], "a" * 5000, "ab " * 900, "žluťoučký kůň — 日本語 テキスト 👩‍👩‍👧 " * 40, "žluťoučký kůň — 日本語 テキスト 👩‍👩‍👧 " * 40 + "!", "\x00\x01\x1c odd \x85 signs   end", "\n\n\n", "|" * 50, base[:300]]
    rows = [(i * 3 - 6, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "ž", None]), None if t is None else len(t), *["clash"] * 8) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[13], (None, base, None, "s1", 1, *["x"] * 8), (None, None, None, None, None, *[None] * 8)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
