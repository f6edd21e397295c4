import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or add themselves.
CLASHES = ["row", "fp", "key", "h1", "u1", "u2", "doc", "batch", "size", "shard", "score", "n_words", "n_tokens", "id", "root", "a", "b", "drops", "kept"]
WORDS = [a + b + c for a in ("th", "er", "on", "st") for b in ("an", "in", "ou", "") for c in ("ed", "ing", "e", "ly")]


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table of (doc_id, text) pairs or whole rows."""

    def build(rows, partitions=3):
        full = [(*r, "en", "src", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def prose():
    def make(seed, words=60, lines=4):
        rng = random.Random(seed)
        return "\n".join(" ".join(rng.choice(WORDS) for _ in range(max(1, words // lines))) for _ in range(lines))

    return make


@pytest.fixture(scope="session")
def odd_documents(documents_of, prose):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, copies, and columns with clashing names."""
    rows = [
        (1, prose(1), "en", "a", 5), (1, prose(1), "en", "a", 5), (2, prose(1), "en", "a", 5), (2, prose(2), None, None, None),
        (None, prose(3), "de", "b", 1), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t\n ", "fr", "a", 5),
        (6, prose(4, 20000, 40), "en", "a", 9), (7, "x" * 30000, "en", "a", 9), (8, "123 456 ###", "en", "a", 9), (9, "日本語 🙂 Ünï", "ja", "a", 9),
    ]
    df = documents_of(rows)
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"own {i}"))
    return df
