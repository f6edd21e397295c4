"""Near copies of the pipeline against all pairs."""

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from hitledger.llm import near_copies

VOCABULARY = [f"w{i}" for i in range(3000)]


def jaccard(a, b):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def copies(rng):
    """Texts, copies with one to eight words replaced, a large group, and a passage that many share."""
    texts = []
    for size in (6, 30, 80, 200, 400):
        for _ in range(6):
            words = rng.choices(VOCABULARY, k=size)
            texts.append(" ".join(words))
            for changes in (1, 2, 3, 5, 8):
                other = list(words)
                for at in rng.sample(range(size), min(changes, size)):
                    other[at] = rng.choice(VOCABULARY)
                texts.append(" ".join(other))
    base, passage = rng.choices(VOCABULARY, k=120), rng.choices(VOCABULARY, k=40)
    for _ in range(90):
        other = list(base)
        other[rng.randrange(120)] = rng.choice(VOCABULARY)
        texts.append(" ".join(other))
        texts.append(" ".join(passage + rng.choices(VOCABULARY, k=30)))
    return texts


def test_stage_drops_all_of_a_similarity_of_four_fifths(spark, documents_of):
    texts = copies(random.Random(5))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    middling = 0
    for i in range(len(texts)):
        for j in range(i):
            if (s := jaccard(texts[i], texts[j])) >= 0.8:
                middling += s < 0.95
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert middling > 20
    got = corpus_pipeline.near_duplicates(spark, documents_of(list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(len(texts)) if root[i] == i]


def test_sets(documents_of):
    ten = " ".join(f"w{i}" for i in range(13))  # nine shingles
    assert near_copies.similar(near_copies.shingles(ten), near_copies.shingles(ten + " x"))  # 9 of 10
    assert not near_copies.similar(near_copies.shingles(ten), near_copies.shingles("y x " + ten + " z"))  # 9 of 12
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "b a"), (None, "a b")]
    assert sorted(r.doc_id for r in near_copies.keep_one(documents_of(rows)).collect()) == [1, 3, 5]


def test_sketches_lose_no_link():
    rng = np.random.default_rng(6)
    for size in (5, 60, 700, 6000):
        for _ in range(40):
            a = np.unique(rng.integers(-(1 << 63), 1 << 63, size))
            b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.8, 1)], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, size // 8 + 1)))))
            whole = [near_copies.sketch(s) for s in (a, b)]
            small = [near_copies.laid(w, near_copies.SKETCH_BITS // 8) for w in whole]
            x, y = (np.frombuffer(w, np.uint8) for w in small)
            apart = int(np.bitwise_count(x ^ y).sum())
            assert apart <= len(np.setxor1d(a, b))
            if near_copies.similar(a, b, Fraction(4, 5)):
                assert 9 * apart <= len(a) + len(b)
                assert near_copies.plausible(*whole, len(a), len(b))


def test_whole_sketches_part_what_small_ones_cannot():
    rng = np.random.default_rng(7)
    one, other, shared = (np.unique(rng.integers(-(1 << 63), 1 << 63, n)) for n in (3000, 3000, 3000))
    a, b = np.union1d(one, shared), np.union1d(other, shared)  # a third alike
    small = [np.frombuffer(near_copies.laid(near_copies.sketch(s), 64), np.uint8) for s in (a, b)]
    assert 9 * int(np.bitwise_count(small[0] ^ small[1]).sum()) <= len(a) + len(b)
    assert not near_copies.plausible(near_copies.sketch(a), near_copies.sketch(b), len(a), len(b))
    assert near_copies.sketch(np.empty(0, np.int64)) == bytes(64)


def test_simhash_links_stand_without_the_prefixes(documents_of, monkeypatch):
    """Copies within the radius are found by their fingerprints alone; equal fingerprints of unlike texts are no link."""
    monkeypatch.setattr(near_copies, "_pairs", lambda buckets, least, hubs: buckets.selectExpr("0L AS a", "0L AS b").limit(0))
    rng = random.Random(8)
    words, passage = rng.choices(VOCABULARY, k=600), rng.choices(VOCABULARY, k=40)
    rows = [(1, " ".join(words)), (2, " ".join(words + ["x"])), (3, " ".join(["y"] + words)), (4, " ".join(passage)), (5, " ".join(passage + rng.choices(VOCABULARY, k=600)))]
    assert sorted(r.doc_id for r in near_copies.keep_one(documents_of(rows)).collect()) == [1, 4, 5]
    monkeypatch.setattr(near_copies, "fingerprint_of", lambda hashes: 0)
    assert sorted(r.doc_id for r in near_copies.keep_one(documents_of([rows[0], rows[4]])).collect()) == [1, 5]
