"""Near copies by SimHash, and by the exact Jaccard similarity of word shingles.

Equal sets are one node. Nodes whose SimHash fingerprints link (see :mod:`hitledger.llm.simhash`) are verified against the
smallest node of their component, on their texts. Fingerprints of near copies may differ in more bits, so prefix
filtering finds what is left between nodes that no link joins yet.

Two sets of a similarity of ``LEAST`` or more share one of the first n - ceil(LEAST n) + 1 of their shingles in
any order that holds for all sets. Shingles that a sample shows to be common come last in it, so that few sets
meet in one of those. The nodes that meet in a shingle are first verified against a hub of theirs; then, so that
no link is missed, against all nodes there that the links so far do not reach.

A pair is only verified on its texts if its sizes allow the similarity and if its sketches do: a sketch has the
parity of the set's hashes in each of its cells, so two sketches differ in no more cells than their sets have
different members. No link is lost by that. A sketch has a power of two of cells, at least twice as many as the
set has members, and half of it laid over the other half is the sketch of half the cells. Buckets carry sketches
laid down to ``SKETCH_BITS``, which are small but full for long texts; the pairs that those let through meet the
whole ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.llm.components import components
from hitledger.llm.simhash import fingerprint_of, near_components, shingle_hashes
from hitledger.llm.texts import by_rows, slices, stored, wide_hash, work_path
from hitledger.sources.sinks import delete_folders

SHINGLE_WORDS = 5
LEAST = Fraction(4, 5)
#: The sample that orders shingles: documents, how many of them hold a common one, and most common ones kept. Links do not depend on it.
SAMPLE_DOCS, COMMON_DOCS, MOST_COMMON = 4000, 4, 200_000
#: Nodes of one shingle that share a hub, about.
HUB_NODES = 64
#: Cells of the parity sketches in buckets, and of the largest whole one. More cells only save texts from being compared.
SKETCH_BITS, MOST_BITS = 512, 1 << 15
#: Pairs that are sent to the texts, and not the texts to the pairs, if there are no more than this many.
FEW_PAIRS = 200_000
NODES = "array<struct<node: bigint, root: bigint, n: bigint, sketch: binary>>"


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, least: Fraction = LEAST) -> bool:
    """Whether the Jaccard similarity of two sets is ``least`` or more; empty sets are equal."""
    if min(len(a), len(b)) * least.denominator < max(len(a), len(b)) * least.numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray, least: Fraction = LEAST) -> np.ndarray:
    """The shingles of a set one of which it shares with each set as similar; ``rank`` orders the sorted ``common`` ones."""
    n = len(found)
    need = -(-n * least.numerator // least.denominator)
    order = np.full(n, -1, np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        order = np.where(common[at] == found, rank[at], -1)
    return found[np.argsort(order, kind="stable")[: n - need + 1 if n else 0]]


def _common(narrow: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample, sorted, and the rank of each by how many documents hold it."""
    share = min(1.0, SAMPLE_DOCS / max(1, narrow.count()))
    picked = narrow.filter(F.pmod(wide_hash(13, F.col("u1")), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words))], names=["k"])

    held = picked.mapInArrow(run, "k bigint").groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    rows = held.orderBy(F.desc("n"), "k").limit(MOST_COMMON).collect()
    keys = np.array([r.k for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], (len(rows) - np.arange(len(rows)))[order]


def sketch(found: np.ndarray) -> bytes:
    """The parity of the number of hashes in each cell; at least two cells for each hash, up to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(SKETCH_BITS, 1 << (2 * len(found) - 1).bit_length())) if len(found) else SKETCH_BITS
    cells = np.bincount((found.view(np.uint64) >> np.uint64(20)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def laid(whole: bytes, size: int) -> bytes:
    """A sketch of the same set with cells for ``size`` bytes, which is no more than it has."""
    return np.bitwise_xor.reduce(np.frombuffer(whole, np.uint8).reshape(-1, size), axis=0).tobytes()


def plausible(a: bytes, b: bytes, n: int, m: int, least: Fraction = LEAST) -> bool:
    """Whether sets of ``n`` and ``m`` members with these whole sketches may be as similar."""
    size = min(len(a), len(b))
    apart = int.from_bytes(laid(a, size)) ^ int.from_bytes(laid(b, size))
    # |A ^ B| = |A| + |B| - 2 |A & B|, and |A & B| >= least / (1 + least) (|A| + |B|)
    return apart.bit_count() * (least.denominator + least.numerator) <= (n + m) * (least.denominator - least.numerator)


class _Bucket:
    """The nodes that share a shingle, in order of their numbers."""

    def __init__(self, held: pa.StructArray):
        nodes, roots, sizes = (held.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "n"))
        sketches = np.frombuffer(b"".join(held.field("sketch").to_pylist()), np.uint64).reshape(len(nodes), -1)
        order = np.argsort(nodes)
        self.nodes, self.roots, self.sizes, self.sketches = nodes[order], roots[order], sizes[order], sketches[order]

    def possible(self, at: int, others: np.ndarray, least: Fraction) -> np.ndarray:
        """Those of ``others`` (places) that sizes and sketches allow to be as similar to the node at ``at``."""
        n, m = self.sizes[at], self.sizes[others]
        others = others[np.minimum(n, m) * least.denominator >= np.maximum(n, m) * least.numerator]
        apart = np.bitwise_count(self.sketches[others] ^ self.sketches[at]).sum(axis=1)
        # |A ^ B| = |A| + |B| - 2 |A & B|, and |A & B| >= least / (1 + least) (|A| + |B|)
        most = (n + self.sizes[others]) * (least.denominator - least.numerator)
        return others[apart * (least.denominator + least.numerator) <= most]


def _pairs(buckets: DataFrame, least: Fraction, hubs: bool) -> DataFrame:
    """(a, b) of different roots that may be as similar: of ``hubs`` each node and its hub, and each hub and the
    smallest node; else all others."""

    def of(bucket: _Bucket) -> Iterator[tuple[np.ndarray, int]]:
        nodes = bucket.nodes
        groups = np.uint64(1 << (len(nodes) // HUB_NODES).bit_length())
        group = (nodes.view(np.uint64) % groups).astype(np.int64)
        tops = np.unique(group, return_index=True)[1]  # the first place of each group
        top = dict(zip(group[tops].tolist(), tops.tolist()))
        own = np.array([top[g] for g in group.tolist()], np.int64)
        for at in range(len(nodes)):
            if hubs:
                mine = np.flatnonzero(own == at) if own[at] == at else np.empty(0, np.int64)
                mine = np.union1d(mine, tops) if at == 0 else mine
            else:
                mine = np.arange(at + 1, len(nodes))
            mine = mine[bucket.roots[mine] != bucket.roots[at]]
            yield nodes[bucket.possible(at, mine, least)], nodes[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column("nodes"):
                for found, at in of(_Bucket(held.values)):
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), at))], names=["a", "b"])

    return buckets.select("nodes").mapInArrow(run, "a bigint, b bigint").distinct()


def _thinned(pairs: DataFrame, texts: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (stored already) that the whole sketches of their nodes leave possible."""
    few = pairs.count() <= FEW_PAIRS
    left = (F.broadcast(pairs) if few else pairs).join(texts.select(F.col("node").alias("a"), F.col("whole").alias("sa"), F.col("n").alias("na")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("whole").alias("sb"), F.col("n").alias("nb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")))
            yield batch.select(["a", "b"]).filter(pa.array([plausible(sa, sb, na, nb, least) for sa, sb, na, nb in rows], pa.bool_()))

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """The pairs (stored already) whose texts are as similar; ``texts`` has one row (node, packed text, set size) for each node of them."""
    few = pairs.count() <= FEW_PAIRS
    left = (F.broadcast(pairs) if few else pairs).join(texts.select(F.col("node").alias("a"), F.col("packed").alias("ta"), F.col("n").alias("na")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("tb"), F.col("n").alias("nb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # pairs of one hub come one after another
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "ta"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, held = b[i], shingles(unpack(batch.column("tb")[i].as_py()).decode(), words)
                keep.append(similar(shingles(unpack(batch.column("ta")[i].as_py()).decode(), words), held, least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def roots_of(narrow: DataFrame, words: int = SHINGLE_WORDS, least: Fraction = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rows (id, u1, u2, node) of ``narrow`` (id, text, u1, u2), and (node, root) of all nodes with a link."""
    common, rank = _common(narrow, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in slices(batches, "text"):
            nodes, keys, sizes, packed, wholes, marks = [], [], [], [], [], []
            for t in batch.column("text").to_pylist():
                found = shingles(t, words)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                keys.append(prefix(found, common, rank, least))
                sizes.append(len(found))
                packed.append(pack((t or "").encode()))
                wholes.append(sketch(found))
                marks.append(fingerprint_of(found.view(np.uint64)))
            made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            made += [pa.array(wholes, pa.binary()), pa.array([laid(w, SKETCH_BITS // 8) for w in wholes], pa.binary())]
            made.append(pa.array(np.array(marks, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "u1", "u2")), *made], names=["id", "u1", "u2", "node", "keys", "n", "packed", "whole", "sketch", "fp"])

    id_type = narrow.schema["id"].dataType.simpleString()
    spark, folder = narrow.sparkSession, work_path(narrow.sparkSession, "near-copies")

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df, f"{folder}/{name}")

    marked = kept(narrow.mapInArrow(run, f"id {id_type}, u1 bigint, u2 bigint, node bigint, keys array<bigint>, n bigint, packed binary, whole binary, sketch binary, fp bigint"), "marked")
    rows = kept(marked.select("id", "u1", "u2", "node"), "rows")
    # equal sets have equal keys, so a node that comes twice in a bucket is one
    entries = marked.select("node", F.explode("keys").alias("key"))
    # buckets of the same nodes are one: near copies share most of their keys
    buckets = entries.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes")).filter(F.size("nodes") > 1)
    buckets = kept(buckets.groupBy(F.xxhash64("nodes").alias("h1"), F.xxhash64(F.lit(2), "nodes").alias("h2")).agg(F.first("nodes").alias("nodes")), "buckets")
    members = buckets.select("h1", "h2", F.explode("nodes").alias("node"))
    held = members.select("node").distinct().hint("merge")  # the rows meet by node for the next step anyway
    texts = kept(marked.select("node", "n", "packed", "whole", "sketch", "fp").join(held, "node", "left_semi").dropDuplicates(["node"]), "texts")
    delete_folders(spark, [f"{folder}/marked"])  # what is needed of it stands in tables of its own

    def gathered(roots: DataFrame) -> DataFrame:
        """Buckets whose nodes have several ``roots``, with sizes and sketches."""
        known = members.join(by_rows(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = known.groupBy("h1", "h2").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h1", "h2")
        left = known.join(mixed, ["h1", "h2"], "left_semi").join(texts.select("node", "n", "sketch"), "node")
        grouped = left.groupBy("h1", "h2").agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("nodes"))
        return grouped.select(F.col("nodes").cast(NODES).alias("nodes"))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        links = kept(_verified(kept(_thinned(pairs, texts, least), f"{name}-thinned"), texts, words, least), f"{name}-links")
        delete_folders(spark, [f"{folder}/{name}-thinned"])
        return links

    marks = texts.select("node", "fp")
    alike = marks.join(near_components(marks, "node").select("fp", "component_id"), "fp").filter("node <> component_id")
    links = linked(kept(alike.select(F.col("node").alias("a"), F.col("component_id").alias("b")), "alike"), "alike")
    found = components(links)
    hubs = kept(_pairs(gathered(found), least, True), "hubs")
    more = linked(hubs, "hubs")
    links = links.union(more)
    found = found if more.isEmpty() else components(links)
    others = kept(_pairs(gathered(found), least, False).join(hubs, ["a", "b"], "left_anti"), "others")
    last = linked(others, "others")
    return rows, found if last.isEmpty() else components(links.union(last))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, least: Fraction = LEAST) -> DataFrame:
    """One row of each group that links of similarity ``least`` or more join, with the smallest id (nulls last, then by a hash of the text).

    A text of fewer than ``words`` words is one shingle; texts without a word, null ones too, are equal.
    """
    key: list[Column] = [wide_hash(11, F.col(doc_id).cast("string"), F.col(text)).alias("u1"), wide_hash(12, F.col(doc_id).cast("string"), F.col(text)).alias("u2")]
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *key)
    rows, roots = roots_of(narrow, words, least)
    marked = rows.join(roots, "node", "left").select("id", "u1", "u2", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "u1", "u2")).alias("first")
    best = marked.groupBy("root").agg(first).select("first.u1", "first.u2")
    packed = docs.select(F.struct("*").alias("row"), *key)
    kept = packed.join(best, ["u1", "u2"], "left_semi").dropDuplicates(["u1", "u2"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
