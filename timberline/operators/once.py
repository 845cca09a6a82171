"""Keeping expensive work single.

Catalyst copies an expression into every filter it pushes below a projection,
and prunes each branch of a plan on its own. Both are right for cheap columns;
for a regex over every log line they multiply the main cost. These two helpers
say where work must stay single.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **expressions: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A one-element ``explode`` yields an attribute of its own: filters and
    projections above read it and do not repeat the expression.
    """
    packed = F.struct(*[e.alias(n) for n, e in expressions.items()])
    out = df.select("*", F.explode(F.array(packed)).alias("_once"))
    return out.select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in expressions])


def all_of(*columns: str | Column) -> Column:
    """A condition that is always true and reads all the columns.

    Put into a branch that needs only some of them, it keeps that branch equal
    to its sibling, so both read one shuffle (ReusedExchange).
    """
    return F.xxhash64(*columns) % 2 < 2
