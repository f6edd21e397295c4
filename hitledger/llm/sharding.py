"""Sharding by extendible hashing, with DataFrame functions only.

A row's address is 60 bits of a hash of its key, then 60 bits of a hash of the whole row for keys that are
heavy by themselves. A bucket is a prefix of the address. The directory is made ``LEVEL_BITS`` bits at a time:
bytes are counted for the deepest buckets of the level, summed upwards, and each row goes to the shortest
prefix whose bucket fits; only buckets that are still too large at the deepest prefix go on to the next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitledger.llm.texts import cut

SHARD_BYTES = 1 << 20
LEVEL_BITS = 15
_HASH_BITS = 60


def _address(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def _bits(number: Column, width: Column) -> Column:
    """The lowest ``width`` binary digits; '' for none."""
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(number), width, F.lit("0")))


def _level(rows: DataFrame, level: int) -> DataFrame:
    """The rows with the level's next bits as ``leaf``."""
    per = _HASH_BITS // LEVEL_BITS
    word = F.col("a1" if level < per else "a2")
    shift = _HASH_BITS - LEVEL_BITS * (level % per + 1)
    return rows.withColumn("leaf", F.shiftright(word, shift).bitwiseAND((1 << LEVEL_BITS) - 1).cast("int"))


def _depths(rows: DataFrame, shard_bytes: int, least: int) -> DataFrame:
    """(base, leaf, depth): how many of the level's bits the leaf's bucket takes; null if it is too large at all."""
    leaves = rows.groupBy("base", "leaf").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    up = leaves.select("*", F.explode(F.sequence(F.lit(least), F.lit(LEVEL_BITS))).alias("d"))
    up = up.withColumn("p", F.expr(f"shiftright(leaf, {LEVEL_BITS} - d)"))
    bucket = Window.partitionBy("base", "d", "p")  # at most 2^LEVEL_BITS leaves
    up = up.withColumn("fits", (F.sum("size").over(bucket) <= shard_bytes) | (F.sum("n").over(bucket) == 1))
    return up.groupBy("base", "leaf").agg(F.min(F.when(F.col("fits"), F.col("d"))).alias("depth"))


def assign(docs: DataFrame, *, key: str = "doc_id", size: Column | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows with ``shard`` (the bucket's bits, '' if one holds all) and ``shard_bytes`` (the bucket's sum).

    ``size`` is the bytes of a row, by default those of ``text``; null counts as 0. No shard exceeds the limit
    but for one that is a single row. Rows with one key share a shard if the key's rows fit, else they are
    dealt out by a hash of the row; equal rows that are too many are numbered and cut into shards ``...#n``.
    Null keys are one key. Other columns stay, those of the two new names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("shard", "shard_bytes")]
    weight = F.coalesce(size if size is not None else F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = docs.select(
        F.struct(*columns).alias("row"),
        weight.alias("size"),
        _address(F.coalesce(F.col(key).cast("string"), F.lit("\0"))).alias("a1"),
        _address(F.to_json(F.struct(*columns))).alias("a2"),
        F.lit("").alias("base"),
    )
    rows, done, levels = cut(rows), [], 2 * _HASH_BITS // LEVEL_BITS
    for level in range(levels):
        rows = _level(rows, level)
        depths = cut(_depths(rows, shard_bytes, 0 if level == 0 else 1))
        bits = _bits(F.expr(f"shiftright(leaf, {LEVEL_BITS} - depth)"), F.col("depth"))
        done.append(rows.join(depths.filter("depth is not null"), ["base", "leaf"]).withColumn("shard", F.concat("base", bits)))
        large = depths.filter("depth is null").select("base", "leaf")
        if large.isEmpty():
            break
        deeper = F.concat("base", _bits(F.col("leaf"), F.lit(LEVEL_BITS)))
        rows = cut(rows.join(large, ["base", "leaf"]).withColumn("base", deeper).drop("leaf"))
    else:
        done.append(_numbered(rows, shard_bytes))
    found = done[0].select("row", "size", "shard")
    for part in done[1:]:
        found = found.union(part.select("row", "size", "shard"))
    found = cut(found)
    totals = found.groupBy("shard").agg(F.sum("size").alias("shard_bytes"))
    return found.join(totals, "shard").select(*(F.col("row").getField(c).alias(c) for c in columns), "shard", "shard_bytes")


def _numbered(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Equal rows in shards of as many as fit: numbered inside each task, the tasks' counts added up."""
    rows = cut(rows.withColumn("task", F.spark_partition_id()))
    here = Window.partitionBy("base", "task").orderBy(F.lit(1))
    counts = rows.groupBy("base", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("base").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("base", "task", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = rows.withColumn("nth", F.row_number().over(here) - 1).join(offsets, ["base", "task"])
    per = F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / F.greatest(F.col("size"), F.lit(1))))
    return numbered.withColumn("shard", F.concat("base", F.lit("#"), F.floor((F.col("nth") + F.col("offset")) / per).cast("string")))


def directory(assigned: DataFrame, size: Column | None = None) -> DataFrame:
    """One row for each shard: depth, bytes and rows."""
    return assigned.groupBy("shard", "shard_bytes").agg(F.count("*").alias("n_rows")).withColumn("depth", F.length("shard"))


def write_shards(assigned: DataFrame, path: str, tasks: int) -> None:
    """One folder for each shard, each written by one task."""
    assigned.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition(tasks, "shard").write.partitionBy("shard").parquet(path)
