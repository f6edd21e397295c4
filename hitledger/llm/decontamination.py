"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a text with at most k edits, a share of its length. Cut into k + 1 pieces, at least one
piece then occurs unchanged. All pieces of all items are searched at once with an automaton; around each hit
the item is verified with Myers' bit-parallel edit distance. Texts are compared in lower case with single
spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hitledger.llm.texts import slices

#: Edits as a share of the item's characters.
EDIT_SHARE = 0.08
#: Bytes of benchmark text that are searched in one pass over the documents.
BLOCK_BYTES = 2 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _positions(text: str) -> list[int]:
    """For each character of the normal form the place of the character it comes from."""
    places, gap = [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(places)
            continue
        if gap:
            places.append(i - 1)
            gap = False
        places += [i] * len(c.lower())
    return places


def nearest(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` with at most ``most`` edits, the first if several."""
    if not pattern:
        return (0, 0)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | (1 << i)
    mask, top = (1 << len(pattern)) - 1, len(pattern) - 1
    plus, minus, score, best = mask, 0, len(pattern), None
    if score <= most:
        best = (score, 0)
    for end, c in enumerate(text, 1):
        equal = at.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (mask & ~(across | plus))
        down = plus & across
        score += ((up >> top) & 1) - ((down >> top) & 1)
        up, down = (up << 1) & mask, (down << 1) & mask
        plus = down | (mask & ~(vertical | up))
        minus = up & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class PieceIndex:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple], edit_share: float):
        self.items = [(item_id, normal(text)) for item_id, text in items]
        self.items = [(i, t, int(len(t) * edit_share)) for i, t in self.items if t]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            cuts = [j * len(text) // (edits + 1) for j in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a hit: the stretches of the normal text it can lie in, joined where they overlap."""
        found: dict[int, set[int]] = {}
        if self.items:
            for last, (size, places) in self.automaton.iter(text):
                for n, offset in places:
                    found.setdefault(n, set()).add(last + 1 - size - offset)
        out: dict[int, list[list[int]]] = {}
        for n, starts in found.items():
            _, item, edits = self.items[n]
            joined: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - edits), min(len(text), s + len(item) + edits)
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            out[n] = joined
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, edits, start, end) of the best occurrence of each item that the text has; places in ``text``."""
        whole, found = normal(text), []
        for n, stretches in self.windows(whole).items():
            item_id, item, edits = self.items[n]
            best = None
            for a, b in stretches:
                exact = whole.find(item, a, b)
                hit = (0, exact + len(item)) if exact >= 0 else None
                if hit is None and (near := nearest(item, whole[a:b], edits)):
                    hit = (near[0], a + near[1])
                if hit and (best is None or hit[0] < best[0]):
                    best = hit
            if best:
                low = max(0, best[1] - len(item) - edits)
                back = nearest(item[::-1], whole[low : best[1]][::-1], edits) if best[0] else (0, len(item))
                found.append((item_id, best[0], best[1] - back[1], best[1]))
        if found:
            places = _positions(text)
            found = [(i, d, places[a] if a < len(places) else len(text), places[b - 1] + 1 if b else 0) for i, d, a, b in found]
        return found

    def hit(self, text: str | None) -> bool:
        return bool(self.matches(text))


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size: the query set of one pass. Null and blank items match nothing."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    count = max(1, -(-int(size) // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(count)))
    for n in range(count):
        yield [(r.i, r.t) for r in rows.filter(F.col("block") == n).orderBy("i", "t").collect()]


def find_items(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", edit_share: float = EDIT_SHARE
) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each item that a document holds, at its best place.

    Places are characters of the text. An item with the text of another is found as well; repeated rows of
    ``docs`` give repeated results. Null texts hold nothing; without items the result is empty.
    """
    schema = T.StructType(
        [docs.schema[doc_id], T.StructField(item_id, benchmark.schema[item_id].dataType), T.StructField("edits", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
    arrow = to_arrow_schema(schema)
    narrow, out = docs.select(doc_id, text), None
    for items in _blocks(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(items, edit_share)
            for batch in slices(batches, text):
                rows = [(d, *m) for d, t in zip(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist()) for m in index.matches(t)]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow.types)], names=schema.names)

        found = narrow.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """The documents that hold no item, unchanged."""
    for items in _blocks(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(items, edit_share)
            for batch in slices(batches, text):
                yield batch.filter(pa.array([not index.hit(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
