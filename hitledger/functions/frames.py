"""Plan-shaping helper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns behind a generator.

    Filters (the null checks of join keys included) are pushed through plain projections by copying
    the expressions they refer to; they stay above a generator, so each column is computed once per
    row whatever is done with it later. They are made in a projection below the generator, whose code shares
    common parts and is compiled; a generator evaluates its own expressions one by one where its method is too large.
    """
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", made.alias("_made")).select(*df.columns, F.inline(F.array("_made")))
