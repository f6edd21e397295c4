"""Ranked lexical search: the best documents of every query item, term at a time with limited accumulators.

A first pass over the documents keeps the occurrences of the items' terms; their counts give the weights. A
second pass scores blocks of documents. In a block an item's terms come rarest first. While a document not yet
met could still reach the k-th best score, every occurrence opens or feeds an accumulator; from then on none is
opened, and the open ones are fed to the end, so that their scores are exact. Arithmetic is on 64-bit integers.

Nulls and texts without a term have no terms: such documents count nowhere, such items get no rows. Rows that
repeat an item's id are one item with all their terms, rows that repeat a document's id are documents of
their own. Equal scores are ordered by ascending id, nulls last.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.texts import slices, work_path

TOP = 50
#: Pairs of item and term that one search holds; more items are searched in turns, each over all documents.
BLOCK_PAIRS = 200_000
#: Occurrences that a task scores at once.
BLOCK_POSTINGS = 1_500_000
#: Parts of an item's task results that are cut to the best ``TOP`` before the last cut.
PARTS = 64

#: Letters and digits of ASCII, lower-cased, and all bytes beyond ASCII make terms; other bytes part them.
_FOLDED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLDED).split()


def weight(docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holders + 1)))


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Different pairs (item, term) of all items."""
    narrow = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = pa.array([t for f in found for t in f], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows)), flat], names=["item", "term"])

    return narrow.mapInArrow(run, T.StructType([T.StructField("item", narrow.schema["item"].dataType), T.StructField("term", T.BinaryType())])).distinct()


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs): how often each term of ``vocabulary`` occurs, for documents with any term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, ns, kept = [], [], []
            for at, t in enumerate(batch.column("text").to_pylist()):
                words = terms_of(t)
                if words:
                    kept.append(at)
                    ns.append(len(words))
                    counts.append({vocabulary[w]: c for w, c in Counter(words).items() if w in vocabulary})
            offsets = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array([k for c in counts for k in c], pa.int32()))
            tfs = pa.ListArray.from_arrays(offsets, pa.array([v for c in counts for v in c.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(kept, pa.int64())), pa.array(ns, pa.int64()), ids, tfs], names=["doc", "n", "terms", "tfs"])

    fields = [T.StructField("doc", docs.schema["doc"].dataType), T.StructField("n", T.LongType())]
    fields += [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType(fields))


def _counts(postings: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms of all documents, and documents for each term of a vocabulary of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
            docs, words = docs + batch.num_rows, words + (pc.sum(batch.column("n")).as_py() or 0)
        some = np.flatnonzero(held)
        keys, values = np.concatenate(([-1, -2], some)), np.concatenate(([docs, words], held[some]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["term", "n"])

    rows = postings.select("n", "terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    held = np.zeros(size, np.int64)
    for k, n in found.items():
        if k >= 0:
            held[k] = n
    return found.get(-1, 0), found.get(-2, 0), held


class Block:
    """Occurrences of some documents, by term, with their share of the score."""

    def __init__(self, docs: pa.Array, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total_docs: int, total_terms: int):
        self.docs = docs
        self.place = np.empty(len(docs), np.int64)
        self.place[pc.sort_indices(docs, null_placement="at_end").to_numpy()] = np.arange(len(docs))
        if len(n) and 50 * int(n.max()) * total_docs >= 1 << 63:
            length = np.array([50 * int(x) * total_docs // total_terms for x in n], np.int64)
        else:
            length = 50 * n * total_docs // max(1, total_terms)
        m = 100 - 50 + length
        order = np.argsort(terms, kind="stable")
        terms, tfs, self.doc = terms[order], tfs[order], np.repeat(np.arange(len(docs)), sizes)[order]
        self.share = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[self.doc]))
        edges = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.start, self.stop = edges[:-1], edges[1:]
        self.most = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(self.stop > self.start)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.share, self.start[some])
        self.sums = np.zeros(len(docs), np.int64)

    def best(self, terms: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, document) of the best ``top`` documents for ``terms``, given rarest first; none below ``floor``."""
        terms = terms[self.most[terms] > 0]
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0)  # what documents without an accumulator can still get
        sums, open_, peak = self.sums, None, 0
        sums[:] = 0
        for at, t in enumerate(terms):
            part = slice(self.start[t], self.stop[t])
            doc, share = self.doc[part], self.share[part]
            if open_ is None and peak > rest[at]:
                met = np.flatnonzero(sums)
                if len(met) >= top:
                    floor = max(floor, int(np.partition(sums[met], len(met) - top)[len(met) - top]))
            if open_ is None and floor > rest[at]:
                open_ = np.flatnonzero(sums)
            if open_ is None:
                sums[doc] += share
                peak = max(peak, int(sums[doc].max()))
            elif len(open_):
                where = np.minimum(np.searchsorted(doc, open_), len(doc) - 1)
                hit = doc[where] == open_
                sums[open_[hit]] += share[where[hit]]
        found = np.flatnonzero(sums) if open_ is None else open_
        score = sums[found]
        keep = score >= max(1, floor)
        found, score = found[keep], score[keep]
        order = np.lexsort((self.place[found], -score))[:top]
        return score[order], found[order]


def _scored(postings: DataFrame, wanted: list[tuple[object, np.ndarray]], weights: np.ndarray, total_docs: int, total_terms: int, item_type: T.DataType, top: int) -> DataFrame:
    """The best ``top`` documents of each item in each task."""
    names = ["doc", "n", "terms", "tfs"]
    doc_type = postings.schema["doc"].dataType
    arrow_item = T.StructType([T.StructField("item", item_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best: list[list[tuple[int, bool, object]]] = [[] for _ in wanted]

        def settle(held: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            doc, n, terms, tfs = (whole.column(c).combine_chunks() if whole.column(c).num_chunks != 1 else whole.column(c).chunk(0) for c in names)
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            flat = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
            block = Block(doc, n.to_numpy(), sizes, *flat, weights, total_docs, total_terms)
            for (_, item_terms), mine in zip(wanted, best):
                floor = -mine[-1][0] if len(mine) == top else 1
                score, found = block.best(item_terms, top, floor)
                if len(found):
                    mine += [(-s, d is None, d) for s, d in zip(score.tolist(), doc.take(pa.array(found)).to_pylist())]
                    mine.sort(key=lambda e: (e[0], e[1], 0 if e[2] is None else e[2]))
                    del mine[top:]

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= BLOCK_POSTINGS:
                settle(held)
                held, size = [], 0
        if size:
            settle(held)
        rows = [(i, d, -s) for (i, _), mine in zip(wanted, best) for s, _, d in mine]
        columns = [pa.array([r[0] for r in rows], to_arrow_type(item_type)), pa.array([r[1] for r in rows], to_arrow_type(doc_type)), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc", "score"])

    return postings.select(*names).mapInArrow(run, T.StructType([*arrow_item.fields, T.StructField("doc", doc_type), T.StructField("score", T.LongType())]))


def _cut(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy("item", *keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item, rank, doc, score) of the ``top`` best documents of each item with a score above 0, under the ids' own names.

    Items are dealt to as many searches as keep one below about ``block_pairs`` pairs of item and term; each
    search reads all documents, and what it brings to the driver is bounded by that. An item's own terms are
    held by every task. Two ids of one name become ``item_<name>`` and ``doc_<name>``.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("binary").alias("text"))
    root = work_path(spark, "search")
    _item_terms(items, item_id, item_text).write.parquet(f"{root}/pairs")
    pairs = spark.read.parquet(f"{root}/pairs")
    turns = max(1, -(-pairs.count() // block_pairs))
    item_type = items.schema[item_id].dataType
    for turn in range(turns):
        by_item: dict[object, list[bytes]] = {}
        for r in pairs.filter(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn).collect():
            by_item.setdefault(r["item"], []).append(bytes(r["term"]))
        vocabulary = {t: k for k, t in enumerate(sorted({t for ts in by_item.values() for t in ts}))}
        _postings(narrow, vocabulary).write.parquet(f"{root}/postings-{turn}")
        postings = spark.read.parquet(f"{root}/postings-{turn}")
        total_docs, total_terms, held = _counts(postings, len(vocabulary))
        weights = np.array([weight(total_docs, int(h)) for h in held], np.int64)
        rare = np.argsort(held, kind="stable")
        rarity = np.empty(len(held), np.int64)
        rarity[rare] = np.arange(len(held))
        wanted = []
        for item, ts in by_item.items():
            ids = np.array([vocabulary[t] for t in ts], np.int64)
            wanted.append((item, ids[np.argsort(rarity[ids])]))
        found = _scored(postings, wanted, weights, total_docs, total_terms, item_type, top)
        part = F.pmod(F.xxhash64("doc", "score"), F.lit(PARTS)).alias("part")
        fewer = _cut(found.select("*", part), top, "part").drop("part", "rank")
        _cut(fewer, top).write.parquet(f"{root}/found/turn={turn}")
    out = spark.read.parquet(f"{root}/found")
    names = (item_id, doc_id) if item_id != doc_id else (f"item_{item_id}", f"doc_{doc_id}")
    return out.select(F.col("item").alias(names[0]), F.col("rank").cast("int"), F.col("doc").alias(names[1]), "score")
