"""Helpers shared by the text operators: table access, hashes, bounded Arrow batches, work folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: the ASCII white space.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that one step inside a task handles at once.
BATCH_BYTES = 4 << 20
#: Rows of two numbers that a join broadcasts at most.
FEW_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary folder only where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="llm-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, purpose: str) -> str:
    return f"{work_root(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from the shared folder, without its lineage."""
    spark = df.sparkSession
    root = work_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` from a table of files at ``path``, without its lineage.

    Unlike :func:`cut` the rows are made once, small files are read several to a task, and the caller can delete the table.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_rows(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join, of at most ``rows`` short rows: broadcast if they are few, else merged.

    Spark itself goes by the bytes of files, which say little of rows that compress well or are exploded.
    """
    return F.broadcast(side) if rows <= FEW_ROWS else side.hint("merge")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def wide_hash(salt: int, *columns: Column) -> Column:
    """A 64-bit hash; different salts give independent ones. Nulls and empty texts differ."""
    return F.xxhash64(F.lit(salt), *columns, *(c.isNull() for c in columns))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have about ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts one after another, and where each text ends; nulls are empty."""
    chunks = [b"" if t is None else t for t in pa.array(texts).cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([len(c) for c in chunks], dtype=np.int64)
