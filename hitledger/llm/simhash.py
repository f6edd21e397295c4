"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints are collapsed to the different ones first. Their 64 bits are cut into segments; two fingerprints
with at most ``most_bits`` different bits differ by at most most_bits // segments in one of them. Each
fingerprint looks up the Hamming ball of that radius around each of its segments; a hit is verified on all 64
bits in the join condition, so that only links come out of the join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.components import components
from hitledger.llm.texts import LOWER, UPPER, cut, slices, stored, wide_hash, work_path
from hitledger.sources.sinks import delete_folders

SHINGLE_WORDS = 4
MOST_BITS = 4
SEED = 42
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> list[int]:
    """The hash of each shingle of ``width`` words, or of all words if they are fewer; none without a word."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - width + 1].tolist()
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, end[width - 1 :].tolist())]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text's word shingles, as an unsigned number; zero without a word."""
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(hashes: Sequence[int]) -> int:
    """The 64-bit fingerprint of 64-bit hashes, as an unsigned number; zero without any."""
    if not len(hashes):
        return 0
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[at : at + (1 << 16)], dtype=">u8").view(np.uint8)).reshape(-1, 64)
        set_ += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """The rows with their fingerprint as a signed long in column ``name``, which must be a new one."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = np.array([fingerprint(t) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def segments_for(distinct: int) -> int:
    """Three segments of 21 or 22 bits up to 2^24 fingerprints, then two of 32: buckets stay small."""
    return 3 if distinct <= 1 << 24 else 2


def _masks(low: int, width: int, radius: int) -> list[tuple[int, int]]:
    """Bits to flip in a segment, and the highest of them: 0 to ``radius`` bits."""
    found = [(0, 0)]
    for n in range(1, radius + 1):
        for bits in combinations(range(low, low + width), n):
            found.append((sum(1 << b for b in bits), 1 << bits[-1]))
    return [(m - (1 << 64) if m >= 1 << 63 else m, t - (1 << 64) if t >= 1 << 63 else t) for m, t in found]


def links(nodes: DataFrame, most_bits: int = MOST_BITS, segments: int = 3) -> DataFrame:
    """(a, b) of all different fingerprints ``fp`` of ``nodes`` that differ in 1 to ``most_bits`` bits.

    A pair comes once for each segment it is found in. Of two fingerprints only the one whose highest flipped
    bit is 0 looks the other one up.
    """
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    probes, table = None, None
    for s, (low, high) in enumerate(zip(cuts, cuts[1:])):
        mask = ((1 << (high - low)) - 1) << low
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        flips = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(t).cast("bigint").alias("t")) for m, t in _masks(low, high - low, most_bits // segments)])
        key = F.col("fp").bitwiseAND(F.lit(mask).cast("bigint"))
        at = F.lit(s).cast("tinyint").alias("s")
        probe = nodes.select(F.col("fp").alias("a"), F.explode(F.filter(flips, lambda f: (f["m"] == 0) | (F.col("fp").bitwiseAND(f["t"]) == 0))).alias("f"))
        probe = probe.select("a", at, F.col("a").bitwiseXOR(F.col("f.m")).bitwiseAND(F.lit(mask).cast("bigint")).alias("key"), (F.col("f.m") == 0).alias("same"))
        entry = nodes.select(F.col("fp").alias("b"), at, key.alias("key"))
        probes = probe if probes is None else probes.union(probe)
        table = entry if table is None else table.union(entry)
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits) & (~F.col("same") | (F.col("a") < F.col("b")))
    # Spark sizes rows by the bytes of files and not by what the explode makes of them: never broadcast
    p, t = probes.alias("p"), table.hint("merge").alias("t")
    return p.join(t, (F.col("p.s") == F.col("t.s")) & (F.col("p.key") == F.col("t.key")) & near).select("a", "b")


def near_components(marked: DataFrame, doc_id: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """(fp, component_id) of the fingerprints of ``marked`` (doc_id, fp): the smallest id that links reach."""
    spark, folder = marked.sparkSession, work_path(marked.sparkSession, "near-components")
    nodes = stored(marked.groupBy("fp").agg(F.min(doc_id).alias("least")), f"{folder}/nodes")
    found = components(links(nodes, most_bits, segments_for(nodes.count())))
    rooted = nodes.join(found.hint("merge"), nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, f"{folder}/rooted")
    delete_folders(spark, [f"{folder}/nodes"])
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(best.hint("merge"), "root").select("fp", "component_id", "root")


def cluster(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Texts without a word, null ones too, have fingerprint zero and are linked like others. Rows of one id are
    documents of their own. Null ids get a component but never name one; if it has no other, its id is null.
    """
    marked = cut(fingerprints(docs.select(doc_id, text), text, "fp").select(doc_id, "fp"))
    found = near_components(marked, doc_id, most_bits).select("fp", "component_id")
    return marked.join(found.hint("merge"), "fp").select(doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row of each component, with the smallest id (nulls last, then by a hash of the text)."""
    key = [wide_hash(11, F.col(doc_id).cast("string"), F.col(text)).alias("u1"), wide_hash(12, F.col(doc_id).cast("string"), F.col(text)).alias("u2")]
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *key)
    marked = cut(fingerprints(narrow, "text", "fp").select("id", "u1", "u2", "fp"))
    roots = near_components(marked, "id", most_bits).select("fp", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "u1", "u2")).alias("first")
    best = marked.join(roots.hint("merge"), "fp").groupBy("root").agg(first).select("first.u1", "first.u2")
    packed = docs.select(F.struct("*").alias("row"), *key)
    kept = packed.join(best, ["u1", "u2"], "left_semi").dropDuplicates(["u1", "u2"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
