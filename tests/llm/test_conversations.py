"""Conversation repair against a plain search from the end, and on odd and split conversations."""

import hashlib
import random
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from hitledger.llm import conversations
from hitledger.llm.conversations import Repair, Run, Weights

NEXT = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = text.strip(" \t\n\v\f\r")
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows, w):
    """The least (cost, audit) and its turns, searched from the last row to the first."""
    faults = fault_of(rows)

    @lru_cache(None)
    def best(i, state, inserted=0):
        ways = [(0, "", ())] if i == len(rows) and state in "ep" else []
        if inserted < 2:
            for t in "ua":
                if t in NEXT[state]:
                    c, a, turns = best(i, NEXT[state][t], inserted + 1)
                    ways.append((c + w.insert, "I" + a, (("user:" if t == "u" else "assistant:"), *turns)))
        if i < len(rows):
            c, a, turns = best(i + 1, state)
            ways.append((c + w.delete, "D" + a, turns))
            if faults[i] in ("", "truncated"):
                extra = w.truncated if faults[i] else 0
                role, text = rows[i]
                for edit, t, name, price in (("K", role[:1], role, w.keep), ("R", "u", "user", w.rerole), ("R", "a", "assistant", w.rerole)):
                    if t in NEXT[state]:
                        c, a, turns = best(i + 1, NEXT[state][t])
                        ways.append((c + price + extra, edit + a, (f"{name}:{text}", *turns)))
        return min(ways, key=lambda e: (e[0], e[1])) if ways else (10**9, "", ())

    for i in range(len(rows), 0, -1):  # from the end, so that no search is deep
        for state in NEXT:
            best(i, state)
    return best(0, "e")


def made(rng, most):
    texts = ["One.", "Two!", "Three?", "cut", " ", "", "Four.\n", "Five. "]
    return [(rng.choice(["user", "assistant", "system", "tool", "", "assistant"]), rng.choice(texts) if rng.random() < 0.4 else f"Own {rng.random()}.") for _ in range(rng.randint(0, most))]


@pytest.mark.parametrize("weights", [Weights(), Weights(0, 3, 4, 1, 0), Weights(0, 1, 9, 2, 3), Weights(1, 1, 1, 1, 1), Weights(0, 9, 9, 1, 9)])
def test_parse_is_cheapest(weights):
    rng, repair = random.Random(5), Repair(weights)
    for _ in range(400):
        rows = made(rng, 9)
        run = Run(repair)
        for (role, _), fault in zip(rows, fault_of(rows)):
            run.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit = run.finish()
        assert (cost, audit) == plain(rows, weights)[:2], rows


def expected(rows):
    """Result columns of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    pairs, turns = [(r, t) for _, r, t in rows], [t for t, *_ in rows if t is not None]
    cost, audit, lines = plain(pairs, Weights())
    faults = fault_of(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows, parts=4):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, " " if role is None else role, " " if text is None else text))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("conv", "part", "kind", "n", "first", "h1")}).repartition(parts)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).collect()}
    assert got == {c: expected(r) for c, r in held.items()}
    turns = defaultdict(list)
    for r in conversations.repaired_turns(df).orderBy("place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in held} == {c: v[-1] for c, v in got.items()}


def test_conversations(spark):
    rng, rows = random.Random(6), []
    for conv in range(150):
        turn = 0
        for role, text in made(rng, 8):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((conv, None if rng.random() < 0.05 else turn, role or None, text or None))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "Still."), (900, None, None, None), (901, 5, "user", "x" * 200_000 + ".")]
    check(spark, rows)


def test_one_conversation_over_all_tasks(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(1, k // 2, *row) for k, row in enumerate(r for _ in range(60) for r in made(rng, 8))] + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Ho."), (0, 1, "tool", "Hm.")]
    rows += [(1, 3, "user", "Same.")] * 80
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_without_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", "Ho.")], SCHEMA)
    ids = spark.createDataFrame([(1,), (2,), (None,)], "conv_id bigint")
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(rows, ids).collect()}
    assert got[1][5:7] == (0, "KK") and got[2] == got[None] == (0, 0, 0, 0, 0, 0, "", nothing) and len(got) == 3
    assert conversations.repair(rows.filter("turn < 0")).count() == 0
    assert conversations.damage(rows.filter("turn < 0")).count() == 0
