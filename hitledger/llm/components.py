"""Connected components of a graph given by its edges, as joins and aggregations in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.llm.texts import by_rows, stored, work_path
from hitledger.sources.sinks import delete_folders


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Rounds of large-star and small-star: every node links its larger, then its smaller neighbours to the
    smallest one. Only minima are aggregated, no neighbour list is gathered. Ends when no node has two smaller
    neighbours, or a smaller and a larger one. A round's tables go when the next round has its own.
    """
    spark, folder = edges.sparkSession, work_path(edges.sparkSession, "components")
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs, turn = stored(pairs, f"{folder}/pairs-0"), 0
    while True:
        ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        smaller = F.col("e.b") < F.col("e.a")
        counts = [F.count(F.when(smaller, 1)).alias("smaller"), F.count(F.when(~smaller, 1)).alias("larger")]
        least = ends.groupBy(F.col("e.a").alias("node")).agg(F.least("node", F.min("e.b")).alias("root"), *counts)
        least = stored(least, f"{folder}/least-{turn}")
        nodes, unfinished = least.agg(F.count("*"), F.max(F.expr("smaller > 1 or smaller = 1 and larger > 0"))).first()
        if not unfinished:
            delete_folders(spark, [f"{folder}/pairs-{turn}"])
            return least.select("node", "root")
        # an edge is one of its smaller node's large star
        large = pairs.join(by_rows(least.select(F.col("node").alias("b"), "root"), nodes), "b").select("a", F.col("root").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(by_rows(lowest, nodes), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        pairs = stored(small.select("e.*").filter("a <> b").distinct(), f"{folder}/pairs-{turn + 1}")
        delete_folders(spark, [f"{folder}/pairs-{turn}", f"{folder}/least-{turn}"])
        turn += 1
