"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents, first document), bucketed by hash and sorted in its buckets.
Every new batch is merge-anti-joined, bucket by bucket and without a shuffle, with all runs. What is left, lines
never seen before, is the batch's own run; the counts of lines that some run knows follow beside it, unless the
line is settled. ``fanout`` runs of a level, with the counts beside them, are merged into one run of the next
level; a merged line that reached ``min_docs`` documents moves to a settled run, and nothing more is counted for it
unless first documents are asked for.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger.llm.texts import ASCII_SPACE, LOWER, UPPER, cut, wide_hash, work_path
from hitledger.sources.sinks import delete_folders

MIN_DOCS = 10
FANOUT = 4
#: Batches of a small table, and rows from which on one more comes with each doubling.
LEAST_BATCHES, BATCH_ROWS = 6, 100_000
#: Turns, by a hash of the content, in which documents may keep a line; the same at every size, whatever the batches.
TURNS = 4
#: Rows for one bucket of the runs, and how many buckets there are at least and at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 8, 10_000
HASH = ["h1", "h2"]
DOC = ["u1", "u2"]
RUN = "h1 bigint, h2 bigint, n bigint, first struct<turn: bigint, doc: string>"


def line_keys(text: Column, min_chars: int = 1) -> Column:
    """The different keys of a text's lines, in order of first sight."""
    keys = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER),
    )
    return F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))


def batches_for(rows: int) -> int:
    """Batches for a table of ``rows``: each reads the runs before it, so they grow with the logarithm of the table."""
    return LEAST_BATCHES + (rows // BATCH_ROWS).bit_length()


def buckets_for(rows: int) -> int:
    """Buckets of a run; from ``MOST_BUCKETS`` on they grow in size and sort on disk."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))


class LineRuns:
    """The store of runs below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int = LEAST_BUCKETS, firsts: bool = False):
        self.spark, self.path, self.min_docs, self.fanout, self.buckets = spark, path, min_docs, fanout, buckets
        #: Whether first documents matter: a later batch may hold an earlier one of a settled line.
        self.firsts = firsts
        self.levels: list[list[str]] = [[]]
        #: By level, counts of lines that an earlier run knows.
        self.counts: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._prefix = f"line_runs_{uuid.uuid4().hex[:12]}"
        self._places: dict[str, str] = {}

    def write(self, rows: DataFrame, kind: str, *parts: str) -> str:
        """The name of a new table of ``rows``, which lie in the runs' buckets already."""
        name = f"{self._prefix}_{len(self._places)}"
        self._places[name] = f"{self.path}/{kind}-{len(self._places)}"
        writer = rows.sortWithinPartitions(*parts, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        writer = writer.partitionBy(*parts) if parts else writer
        writer.option("path", self._places[name]).saveAsTable(name)
        return name

    def in_buckets(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *HASH)

    def discard(self, names: list[str]) -> None:
        """Free the space of tables that nothing reads any more."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_folders(self.spark, [self._places[name] for name in names])

    def close(self) -> None:
        """Free all that lies below ``path``."""
        self.discard(list(self._places))
        delete_folders(self.spark, [self.path])

    def runs(self) -> list[str]:
        """All runs; each line ever seen is in at least one."""
        return [name for level in self.levels for name in level] + self.settled

    def _without(self, rows: DataFrame, names: list[str]) -> DataFrame:
        for name in names:
            rows = rows.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
        return rows

    def add(self, batch: DataFrame) -> None:
        """One batch of run rows in the runs' buckets, each hash once. Batches come in the order of their numbers."""
        batch = batch.select("h1", "h2", "n", "first")
        before = self.runs()
        new = self.write(self._without(batch, before), "run-0")
        if before:
            self.counts[0].append(self.write(self._without(batch, [new] if self.firsts else [new, *self.settled]), "counts-0"))
        self.levels[0].append(new)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one run of the next; settle what reached the count."""
        if len(self.levels) == level + 1:
            self.levels.append([])
            self.counts.append([])
        old = self.levels[level] + self.counts[level]
        whole = self.write(self._merged(old, True), "merged")
        self.levels[level + 1].append(self.write(self.spark.table(whole).filter(F.col("n") < self.min_docs), f"run-{level + 1}"))
        self.settled.append(self.write(self.spark.table(whole).filter(F.col("n") >= self.min_docs), "settled"))
        self.levels[level], self.counts[level] = [], []
        self.discard([*old, whole])

    def _merged(self, names: list[str], in_buckets: bool = False) -> DataFrame:
        # by their files: Spark groups a union of bucketed tables without a shuffle though their buckets lie apart
        rows = self.spark.read.schema(RUN).parquet(*(self._places[name] for name in names))
        rows = self.in_buckets(rows) if in_buckets else rows
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def frequent(self) -> DataFrame:
        """Run rows of the lines in at least ``min_docs`` documents; ``n`` stops growing once a line is settled."""
        names = self.runs() + [name for level in self.counts for name in level]
        if not names:
            return self.spark.createDataFrame([], RUN)
        return self._merged(names).filter(F.col("n") >= self.min_docs)


def _described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows as they are, packed, with what identifies them."""
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("string").alias("doc"), F.col(text).alias("text")).select(
        "row",
        "doc",
        "text",
        wide_hash(1, F.col("doc"), F.col("text")).alias("u1"),
        wide_hash(2, F.col("doc"), F.col("text")).alias("u2"),
    )


def _hashed(rows: DataFrame) -> DataFrame:
    """Each row's different line keys as hashes, in order of first sight; rows without one are left out."""
    found = F.transform(line_keys(F.col("text")), lambda k: F.struct(F.xxhash64(F.lit(1), k).alias("h1"), F.xxhash64(F.lit(2), k).alias("h2")))
    return rows.select("doc", *DOC, found.alias("lines")).filter(F.size("lines") > 0)


KEPT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
)


@F.pandas_udf(KEPT)
def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """The texts without the lines whose key is the n-th different key of its text, for n in ``drops``."""
    strip, out = ASCII_SPACE.encode(), []
    for text, drop in zip(texts, drops):
        lines = (text or "").split("\n")
        if drop is None:
            out.append((text, len(lines), 0))
            continue
        keys = [line.encode().strip(strip).lower() for line in lines]
        order = list(dict.fromkeys(k for k in keys if k))
        gone = {order[i] for i in drop}
        kept = [line for line, k in zip(lines, keys) if k not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def drop_common_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    keep_first: bool = False,
    batches: int | None = None,
    fanout: int = FANOUT,
    counts: bool = False,
) -> DataFrame:
    """Drop the lines whose key is in at least ``min_docs`` documents.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case; empty keys never count.
    With ``keep_first`` the first document of a line keeps it: documents have one of ``TURNS`` turns by a hash of
    their content, and within one the order of their ids (as text). ``batches`` (None: by the size of the table)
    decide how the runs are built, never what is dropped. Every row is a document, so repeated rows count each; equal rows lose the same lines. A null text is one empty line and stays null.
    Column names are kept, extra columns too; an empty table gives an empty table. With ``counts`` two columns,
    ``n_lines`` and ``n_dropped``, follow; input columns of these names are then replaced.
    """
    spark = docs.sparkSession
    folder = work_path(spark, "line-runs")
    _hashed(_described(docs.select(doc_id, text), doc_id, text).drop("row")).write.parquet(f"{folder}/lines")
    hashed = spark.read.parquet(f"{folder}/lines")
    count = hashed.count()
    batches = batches or batches_for(count)
    hashed = hashed.select("*", F.pmod("u1", F.lit(batches)).alias("batch"), F.struct(F.pmod("u1", F.lit(TURNS)).alias("turn"), "doc").alias("place"))
    lines = hashed.select("place", "batch", *DOC, F.posexplode("lines").alias("at", "line")).select("place", "batch", *DOC, "at", "line.h1", "line.h2")

    runs = LineRuns(spark, folder, min_docs, fanout, buckets_for(count), keep_first)
    first = F.col("place") if keep_first else F.lit(None).cast("struct<turn: bigint, doc: string>")
    incoming = lines.groupBy("batch", *HASH).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    arrived = runs.write(runs.in_buckets(incoming), "arrived", "batch")
    for number in range(batches):
        runs.add(spark.table(arrived).filter(F.col("batch") == number))
    runs.discard([arrived])
    # a table of files: Spark knows its size and broadcasts it only if it is small
    runs.frequent().write.parquet(f"{folder}/frequent")
    frequent = spark.read.parquet(f"{folder}/frequent")

    hit = lines.join(frequent.select(*HASH, "first"), HASH)
    if keep_first:
        hit = hit.filter(~F.col("place").eqNullSafe(F.col("first")))
    drops = cut(hit.groupBy(*DOC).agg(F.collect_set("at").alias("drops")))
    runs.close()
    rows = _described(docs, doc_id, text)
    done = rows.join(drops, DOC, "left").select("row", _without("text", "drops").alias("kept"))
    added = ["n_lines", "n_dropped"] if counts else []
    old = [F.col("kept.text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return done.select(*old, *(F.col(f"kept.{c}") for c in added))
