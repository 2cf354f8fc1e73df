import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# other columns under names that operators use inside
CLASH = ["id", "n", "h", "key", "label", "digest", "tokens", "place", "pieces", "bands", "rep", "spans", "bucket", "__text"]


def odd_rows(seed=1, n=60):
    """Nulls in every column, empty, white and very long texts, ties, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "übel", "niño", "한글", "x1", "don't", "a.b@c.org", "+49 30 123 456 78", "4111 1111 1111 1111", "10.0.0.1"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text)))
    long = " ".join(rng.choice(words) for _ in range(20000))
    rows += [(100, long, "en", "a", None), (101, long, "en", "b", 1), (102, long + " tail", None, None, 2)]
    rows += [(103, None, None, None, None), (104, "", "de", "b", 0), (105, " \t\n", "en", "a", 3), (None, "alpha beta", "en", "a", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[5], (200, rows[5][1], "de", "a", 1), (201, rows[7][1].replace(" ", "\n "), "de", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in CLASH:
        docs = docs.selectExpr("*", f"doc_id AS `{c}`")
    return docs.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return lambda name: str(public_tokenizers.path(name))
