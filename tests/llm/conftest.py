import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, row_id long, score double, pattern string, _hash string"


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 3)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(3)
    base = prose(rng, 80)
    words = base.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    far = " ".join([w if k % 4 else "other" for k, w in enumerate(words)])
    texts = {1: base, 2: near, 3: base, 4: far, 5: None, 6: "", 7: " \n\t", 8: "short text", 9: "x" * 30_000, 10: prose(rng, 30_000), 11: "No letters: é ▁ 日本語 \U0001f600", 12: "12 34"}
    rows = [(i, t, None if i % 5 == 0 else "en", None if i == 6 else "src0", len(t) if t else None, 1, 2, 0.5, "p", "h") for i, t in texts.items()]
    rows += [rows[0], (13, base, "en", "src1", 0, 1, 2, 0.5, "p", "h")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
