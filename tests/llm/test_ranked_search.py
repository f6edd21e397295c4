"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitledger.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    held = [h for h in held if h[2]]
    n, size = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item in {i for i, _ in items}:
        wanted = {t for i, x in items if i == item for t in terms(x)}
        scored = []
        for d, c, length in held:
            m = 50 + (50 * length * n) // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out |= {(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)}
    return out


def search(docs, items, **options):
    return {tuple(r) for r in ranked_search.search(docs, items, **options).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(600)]
    docs += [(1000 + k, docs[5][1]) for k in range(80)] + [docs[7], docs[7], (None, docs[9][1]), (2000, None), (2001, ""), (2002, "  ,; "), (2003, "Ünï 日本語 W1"), (2004, "w1 " * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(30)]
    items += [(30, docs[5][1]), (31, None), (32, ""), (33, "ünï W1 w1 日本語"), (34, "nowhere"), (None, "w2 w3"), (3, "w9 w10"), (4, items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("own") for c in ("item", "doc", "score", "rank", "n", "part")})
    return docs, items, frame.repartition(5), spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("own"))


@pytest.mark.parametrize("top", [1, 7, 50])
def test_search(tables, top):
    docs, items, df, queries = tables
    assert search(df, queries, top=top) == plain(docs, items, top)


def test_in_small_blocks(tables, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", 500)
    docs, items, df, queries = tables
    assert search(df, queries, top=9, block_pairs=100) == plain(docs, items, 9)


def test_block_limits_accumulators(tables):
    docs, items, _, _ = tables
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, c, _ in held for t in c}))}
    df = Counter(t for _, c, _ in held for t in c)
    size = sum(h[2] for h in held)
    weights = np.array([ranked_search.weight(len(held), df[t]) for t in vocabulary], np.int64)
    flat = [(vocabulary[t], n) for _, c, _ in held for t, n in c.items()]
    block = ranked_search.Block(
        pa.array([d for d, _, _ in held]), np.array([h[2] for h in held]), np.array([len(h[1]) for h in held]), np.array([f[0] for f in flat]), np.array([f[1] for f in flat]), weights, len(held), size
    )
    opened = []
    for item, text in items[:30]:
        wanted = np.array(sorted({vocabulary[t] for t in terms(text) if t in vocabulary}, key=lambda k: df[list(vocabulary)[k]]), np.int64)
        score, found = block.best(wanted, 5, 1)
        want = sorted((e for e in plain(docs, [(item, text)], 5)), key=lambda e: e[1])
        assert score.tolist() == [e[3] for e in want]
        # most documents hold a term, few have an accumulator
        opened.append((int((block.sums > 0).sum()), len({h[0] for h in held if set(terms(text)) & set(h[1])})))
    assert sum(o < m for o, m in opened) > 5


def test_empty(tables):
    docs, items, df, queries = tables
    assert search(df.filter("doc_id < 0"), queries) == set()
    assert search(df, queries.filter("item_id < 0")) == set()
    assert ranked_search.search(df, queries.withColumnRenamed("item_id", "doc_id"), item_id="doc_id").columns == ["item_doc_id", "rank", "doc_doc_id", "score"]
