"""Packing into few sequences of a fixed capacity by minimum bin slack.

Each sequence in turn takes the longest piece left. A subset-sum table over the lengths that are left, kept as
bitsets, gives the fullest combination that fits beside it; of equally full ones the one with the longest pieces.
The combination is taken out and the next sequence begins. Only the number of pieces of each length matters, so a combination is used as often as the
numbers allow at once, which is what one sequence after another would do. Pieces then find their place by their
rank among those of their length.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.texts import slices, work_path

CAPACITY = 1024
#: Characters of a long text that are encoded at once.
SECTION = 1 << 20

#: Fixed value: how byte-level tokenizers split texts before they merge.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are letters, digits, white space or none of these to every library, without long white space.
_PLAIN = re.compile(r"(?:[!-~\u00a1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]++|[ \t\n\r\u00a0]{1,500}(?![ \t\n\r\u00a0]))*+")
#: Tokens never reach from a visible character into white space after it.
_BREAK = re.compile(r"(?<=[!-~])[ \t\n\r]")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, the others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(rest)}


def merge_ranks(specification: str) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if merging by rank of the result equals the library's merging by list; else None.

    That holds where the library encodes every token of the vocabulary as itself: two neighbours that make a
    token are then the two of its own merge, or a merge of lower rank would have come first.
    """
    from tokenizers import Tokenizer

    spec = json.loads(specification)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    usual = model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges") and spec["normalizer"] is None
    if not usual or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    added, byte = {t["content"] for t in spec["added_tokens"]}, _byte_of()
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    encode = Tokenizer.from_str(specification).model.tokenize
    if not all(set(t) <= byte.keys() and [x.id for x in encode(t)] == [i] for t, i in vocab.items()):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """Token ids of whole texts as the ``tokenizers`` library gives them.

    Where :func:`merge_ranks` allows it, texts of plain characters are merged by rank, several times faster;
    all others, and those with an added token's text, are left to the library.
    """

    def __init__(self, specification: str, ranks: dict[bytes, int] | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine's cores already
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(specification)
        self.added = [t["content"] for t in json.loads(specification)["added_tokens"]]
        self.fast = ranks and tiktoken.Encoding("merges", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) > SECTION:
            return [i for part in sections(text) for i in self._encode(part)]
        return self._encode(text)

    def _encode(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return self.fast.encode_ordinary(text)
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


def sections(text: str, most: int = SECTION) -> Iterator[str]:
    """Parts of a long text of about ``most`` characters, parted before white space only."""
    start = 0
    while len(text) - start > most:
        cut = _BREAK.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def token_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of each document and ``end``, cut to ``capacity``.

    ``tokenizer`` is the path of a byte-level tokenizer of the ``tokenizers`` library, read on the driver. Only
    longer documents are cut, so that all pieces but the first are full. Null texts are empty. ``ids`` are
    32-bit little-endian numbers.
    """
    with open(tokenizer, encoding="utf-8") as file:
        specification = file.read()
    narrow = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    ranks = merge_ranks(specification)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(specification, ranks).encode
        for batch in slices(batches, "text"):
            rows, piece, start, length, ids = [], [], [], [], []
            for at, text_ in enumerate(batch.column("text")):
                found = np.array([*encode(text_.as_py() or ""), end], "<u4")
                total = len(found)
                first = (total - 1) % capacity + 1
                edges = [0, *range(first, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(at), piece.append(k), start.append(a), length.append(b - a), ids.append(found[a:b].tobytes())
            columns = [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "piece", "start", "length", "ids"])

    fields = [T.StructField("doc", narrow.schema["doc"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType())]
    return narrow.mapInArrow(run, T.StructType([*fields, T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])).withColumnRenamed("doc", doc_id)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination (length, copies) of the lengths that ``counts`` has, longest first."""
    lengths = sorted(k for k, n in counts.items() if n)
    every = (1 << (capacity + 1)) - 1
    tables = [1]  # bit s: sum s can be made of the lengths so far
    for length in lengths:
        table, left, step = tables[-1], min(counts[length], capacity // length), 1
        while left and table != every:
            take = min(step, left)
            table |= table << (length * take) & every
            left, step = left - take, step * 2
        tables.append(table)
    room, out = tables[-1].bit_length() - 1, []
    for at in range(len(lengths) - 1, -1, -1):
        length = lengths[at]
        copies = min(counts[length], room // length)
        while not tables[at] >> (room - copies * length) & 1:
            copies -= 1
        if copies:
            out.append((length, copies))
            room -= copies * length
    return out


def combination(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination with the longest length in it."""
    longest = max(k for k, n in counts.items() if n)
    rest = {**counts, longest: counts[longest] - 1}
    found = dict(fullest({k: n for k, n in rest.items() if k <= capacity - longest}, capacity - longest))
    found[longest] = found.get(longest, 0) + 1
    return sorted(found.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, combination) that use up ``counts``: minimum bin slack, like sequences at once."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        found = combination(left, capacity)
        times = min(left[length] // copies for length, copies in found)
        out.append((times, found))
        for length, copies in found:
            left[length] -= copies * times
            if not left[length]:
                del left[length]
    return out


def _places(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted: where the pieces of a length go, by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, combination in found:
        offset = 0
        for length, copies in combination:
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(rows: DataFrame, size: str = "length", *, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; no sequence holds more than ``capacity`` and none has a gap.

    The driver sees one number for each length, ``capacity`` of them at most. Ranks come from numbers for each
    task and length, so a length that most pieces have is spread like any other. Rows of a null size, of one
    below 1 or above ``capacity`` get nulls. Columns of those names in ``rows`` are replaced.
    """
    spark = rows.sparkSession
    inner = T.StructType([f for f in rows.schema.fields if f.name not in ("sequence_id", "offset")])
    packed = rows.select(F.struct(*(F.col(f"`{f.name}`") for f in inner.fields)).alias("row"), F.col(size).cast("bigint").alias("size"))
    packed = packed.withColumn("size", F.when(F.col("size").between(1, capacity), F.col("size")).otherwise(0))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(sizes, minlength=capacity + 1)
            columns = [batch.column("row"), batch.column("size"), pa.array(np.full(len(sizes), task, np.int64)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "size", "task", "rank"])

    numbers = [T.StructField(c, T.LongType()) for c in ("size", "task", "rank")]
    to = work_path(spark, "packing")
    packed.mapInArrow(number, T.StructType([T.StructField("row", inner), *numbers])).write.parquet(to)
    numbered = spark.read.parquet(to)

    counts = numbered.groupBy("size", "task").agg(F.count("*").alias("n"))
    lengths = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect() if r["size"]}
    where = _places(plan(lengths, capacity))
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("size", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = numbered.join(base, ["size", "task"]).select("row", "size", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (where[:, 0] << 42) | where[:, 1]
        for batch in batches:
            sizes, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (sizes << 42) | rank, side="right") - 1
            found = where[np.maximum(at, 0)] if len(where) else np.ones((len(sizes), 5), np.int64)
            nth = rank - found[:, 1]
            sequence, offset = found[:, 2] + nth // found[:, 3], found[:, 4] + nth % found[:, 3] * sizes
            none = sizes == 0
            row = batch.column("row")
            columns = [*row.flatten(), pa.array(sequence, mask=none), pa.array(offset, mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=[*inner.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType([*inner.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
