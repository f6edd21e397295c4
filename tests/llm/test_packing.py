"""Packing against the tokenizer library, a search of all combinations, and one sequence after another."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitledger.llm import packing
from hitledger.llm.queries import op12_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("section", [1 << 20, 16])
def test_ids_are_the_library_s(section, monkeypatch):
    monkeypatch.setattr(packing, "SECTION", section)
    specification = open(PATH, encoding="utf-8").read()
    ranks = packing.merge_ranks(specification)
    assert len(ranks) == 50_256
    parts = list("ab'sZ 1 2!?é  \n\n\t\r") + [" ", "　", "\x0b", "\x1c", "\x85", "​", "Ω", "漢", "½", "²", "Ɤ", "ß", "'s", "'LL", "<|endoftext|>", "  ", "\r\n", "🙂"]
    rng = random.Random(3)
    for use in (packing.Encoder(specification, ranks), packing.Encoder(specification, None)):
        for n in (len(parts), 18):
            for _ in range(1500):
                text = "".join(rng.choice(parts[:n]) for _ in range(rng.randint(0, 50)))
                assert use.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_long_runs():
    encode = packing.Encoder(open(PATH, encoding="utf-8").read(), packing.merge_ranks(open(PATH, encoding="utf-8").read())).encode
    for text in ("\n" * 300_000, " \n" * 100_000 + "a", "ab" * 300_000, "word " * 500_000):
        assert encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_fullest_of_all_combinations():
    rng = random.Random(4)
    for _ in range(150):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        sums = {sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n)}
        found = packing.fullest(Counter(items), 40)
        assert sum(k * n for k, n in found) == max(s for s in sums if s <= 40)
        assert all(n <= Counter(items)[k] for k, n in found)
        longest = max(items)
        rest = list(items)
        rest.remove(longest)
        with_longest = {longest + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n)}
        assert sum(k * n for k, n in packing.combination(Counter(items), 40)) == max(s for s in with_longest if s <= 40)


def test_plan_is_one_sequence_after_another():
    rng = random.Random(5)
    counts = Counter(rng.choice([3, 7, 8, 15, 22, 31]) for _ in range(300))
    plan, left, one_by_one = packing.plan(counts, 50), Counter(counts), []
    while left:
        one_by_one.append(packing.combination(left, 50))
        left -= Counter(dict(one_by_one[-1]))
    assert [c for times, c in plan for _ in range(times)] == one_by_one


def gapless(rows, capacity):
    bins = defaultdict(list)
    for offset, sequence, length in rows:
        bins[sequence].append((offset, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_any_rows(spark):
    rng = random.Random(6)
    sizes = [rng.randint(1, 100) for _ in range(900)] + [100] * 500 + [None, 0, -3, 101]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k int, length bigint").withColumns({c: F.lit("own") for c in ("row", "size", "task", "rank", "offset")}).repartition(7)
    rows = packing.pack(df, capacity=100).collect()
    assert sorted(r.k for r in rows) == list(range(len(sizes))) and {r.row for r in rows} == {r.size for r in rows} == {"own"}
    assert {r.length for r in rows if r.sequence_id is None} == {None, 0, -3, 101} == {r.length for r in rows if r.offset is None}
    n = gapless([(r.offset, r.sequence_id, r.length) for r in rows if r.sequence_id is not None], 100)
    least = -(-sum(s for s in sizes if s and 0 < s <= 100) // 100)
    assert least <= n <= least * 1.01 + 1
    assert packing.pack(df.filter("k < 0"), capacity=100).count() == 0
    assert packing.pack(df.filter("length is null"), capacity=100).filter("sequence_id is null").count() == 1


def test_pieces(spark, odd_documents):
    rows = packing.token_pieces(odd_documents, PATH, capacity=64).collect()
    want = Counter((r.doc_id, tuple(LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in odd_documents.collect())
    held = defaultdict(list)
    for r in rows:
        held[r.doc_id].append((r.start, r.piece, r.length, r.ids))
    for doc in {d for d, _ in want}:
        got = Counter()
        for start, piece, length, ids in held[doc]:
            assert len(ids) == 4 * length and (length == 64 or piece == 0) and (start == 0) == (piece == 0)
            got[piece, start, np.frombuffer(ids, "<u4").tobytes()] += 1
        cut = Counter()
        for (d, ids), n in want.items():
            if d == doc:
                first = (len(ids) - 1) % 64 + 1
                for k, a in enumerate([0, *range(first, len(ids), 64)]):
                    cut[k, a, np.array(ids[a : first if a == 0 else a + 64], "<u4").tobytes()] += n
        assert got == cut
    assert packing.token_pieces(odd_documents.filter("doc_id < 0"), PATH).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = op12_packing(spark, folder).collect()
    ids = {r.doc_id: LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    total = 0
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(piece) == 4 * r.length and zlib.crc32(piece) == r.ids_crc32
        total += r.length
    assert total == sum(map(len, ids.values()))
    n = gapless([(r.offset, r.sequence_id, r.length) for r in rows], 1024)
    assert -(-total // 1024) <= n <= -(-total // 1024) + 3
