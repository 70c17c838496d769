import pytest

#: Columns that operators use as names of their own.
CLASHING = {"score": 1.5, "kept": True, "node": 7, "shard": 3, "fingerprint": "x", "ids": "y", "component": 2}


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, a repeated id, a long text, one word, and clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six seven"), (5, "one two three four five six seven"),
            (5, "one two three four five six seven"), (6, "One TWO three four five six seven"), (7, "one two"), (8, "one two"), (9, "two one"),
            (10, long), (11, long + " and more"), (None, "one two three four five six seven"), (None, None), (12, "é" * 50 + " ☃ 日本 " + "x" * 5000),
            (13, "a b c d e"), (14, "<|endoftext|> </s> ▁ \x00")]
    names = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}"
                      for k, v in CLASHING.items())
    return spark.createDataFrame([(*r, "en" if i % 2 else None, *CLASHING.values()) for i, r in enumerate(rows)],
                                 f"doc_id long, text string, lang string, {names}")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
