"""Response-time statistics with exact ranks.

A rank is found by narrowing, without sorting all values anywhere: count per logarithmic cell, pick
the cell that holds the rank, split that cell evenly, pick again, then look at the single values
left. Each step is an ordinary aggregation whose result per group is small and bounded (some
thousand cells), so no task ever holds a group's values; equal values are one row with a count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.predicates import Scope

_CELLS_PER_E = 1_000
_SPLIT = 4_096

# Ranks as (numerator, denominator) so that integer arithmetic is exact where needed.
RANKS = {"p50": (50, 100), "p95": (95, 100), "p99": (99, 100)}


def overall_offset(n: Column, name: str) -> Column:
    """0-based rank of a percentile over the whole table: floor((n - 1) * p)."""
    num, den = RANKS[name]
    return F.floor((n - 1) * F.lit(num / den))


def client_offset(n: Column, name: str) -> Column:
    """0-based rank of a percentile for one client: n * p, cut to a whole number."""
    num, den = RANKS[name]
    return F.floor(n * num / den)


def _locate(cells: DataFrame, group: list[str], cell: str, wanted: Column) -> DataFrame:
    """Cell holding the wanted 0-based rank in each group, and the rank inside that cell."""
    running = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.withColumn("_upto", F.sum("_n").over(running))
    here = (wanted >= F.col("_upto") - F.col("_n")) & (wanted < F.col("_upto"))
    return counted.filter(here).withColumn("_rank", wanted - (F.col("_upto") - F.col("_n")))


def exact_percentiles(df: DataFrame, value: str, offset, by: Sequence[str] = ()) -> DataFrame:
    """Columns p50, p95, p99 of the positive doubles in ``value``, one row per group of ``by``.

    ``offset`` maps (row count, percentile name) to the 0-based rank.
    """
    group = list(by) or ["_all"]
    rows = df.select(*by, F.col(value).alias("_v"))
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    else:
        # Many groups: fold equal values first, so a dominating value is one row per task.
        rows = rows.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_k"))
    weight = F.sum("_k") if by else F.count(F.lit(1))
    figures = [weight.alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    rows = rows.withColumn("_c1", F.floor(F.ln("_v") * _CELLS_PER_E))
    cells = rows.groupBy(*group, "_c1").agg(*figures)
    whole = Window.partitionBy(*group)
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), offset(F.col("_total"), p).alias("o")) for p in RANKS)))
    ranked = cells.withColumn("_total", F.sum("_n").over(whole)).select("*", ranks.alias("_r"))
    ranked = ranked.select(*cells.columns, F.col("_r.p").alias("_p"), F.col("_r.o").alias("_o"))
    first = _locate(ranked, [*group, "_p"], "_c1", F.col("_o")).select(*group, "_c1", "_p", "_lo", "_hi", "_rank")

    # Without groups the located cells are three rows, one per percentile.
    small = F.broadcast if not by else (lambda located: located)
    inside = rows.join(small(first), [*group, "_c1"])
    width = F.col("_hi") - F.col("_lo")
    share = F.when(width > 0, (F.col("_v") - F.col("_lo")) / width * _SPLIT).otherwise(0.0)
    inside = inside.withColumn("_c2", F.floor(share)).drop("_lo", "_hi")
    key = [*group, "_p"]
    parts = inside.groupBy(*key, "_c2", F.col("_rank").alias("_o")).agg(weight.alias("_n"))
    second = _locate(parts, key, "_c2", F.col("_o")).select(*key, "_c2", F.col("_rank").alias("_o"))

    values = inside.drop("_rank").join(small(second), [*key, "_c2"]).groupBy(*key, "_o", "_v").agg(weight.alias("_n"))
    found = _locate(values, key, "_v", F.col("_o"))
    picked = [F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(p) for p in RANKS]
    return found.groupBy(*group).agg(*picked).drop("_all")


def approx_percentiles(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Sketch-based alternative: one pass, bounded relative rank error of 1 / accuracy."""
    picked = [F.approx_percentile(value, num / den, accuracy).alias(p) for p, (num, den) in RANKS.items()]
    return df.groupBy(*by).agg(*picked)


def _range_measures() -> list[Column]:
    names = {"min": F.min, "max": F.max, "avg": F.avg}
    return [F.coalesce(f("response_time_ms"), F.lit(0.0)).alias(n) for n, f in names.items()]


def response_time_stats(df: DataFrame, scope: Scope, *, approximate: bool = False) -> DataFrame:
    """Min, max, mean and percentiles over measured requests; zeros when there are none."""
    rows = scope.apply(df).filter(F.col("response_time_ms") > 0)
    base = rows.agg(*_range_measures())
    if approximate:
        ranks = approx_percentiles(rows, "response_time_ms")
    else:
        ranks = exact_percentiles(rows, "response_time_ms", overall_offset)
    both = base.unionByName(ranks, allowMissingColumns=True)
    return both.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("min", "max", "avg", *RANKS)))


# Upper bounds in ms of the response-time classes; the last class is open.
_CLASSES = [("fast", 0, 100), ("moderate", 100, 1_000), ("slow", 1_000, 2_000), ("very_slow", 2_000, None)]
_GOALS = (100, 500, 1_000)


def latency_buckets(df: DataFrame, scope: Scope, *, from_timeline: bool = False) -> DataFrame:
    """Requests per speed class and share of requests under each goal.

    Classes apply to single measured requests, with the unmeasured (0 ms) counted apart; or with
    ``from_timeline`` to the mean of each timeline bucket weighted by its requests, zeros included.
    """
    if from_timeline:
        from hitledger.operators.timelines import timeline

        points = timeline(df, scope).select(F.col("avg_response_time").alias("_t"), F.col("requests").alias("_w"))
    else:
        points = scope.apply(df).select(F.col("response_time_ms").alias("_t"), F.lit(1).cast("bigint").alias("_w"))

    def weight(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("_w")).otherwise(0)), F.lit(0))

    t = F.col("_t")
    measured = F.lit(True) if from_timeline else t > 0
    classes = [
        weight(measured & ((t >= low) & (t < high) if high else t >= low)).alias(f"{name}_requests") for name, low, high in _CLASSES
    ]
    under = [weight(measured & (t < goal)).alias(f"_under_{goal}") for goal in _GOALS]
    counts = points.agg(*classes, *under, weight(measured).alias("total_requests"), weight(~measured).alias("unmeasured_requests"))
    goals = {f"goal_{g}_percent": m.percent(F.col(f"_under_{g}"), F.col("total_requests")) for g in _GOALS}
    return counts.withColumns(goals).drop(*(f"_under_{g}" for g in _GOALS))
