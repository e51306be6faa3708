"""Attach one-row aggregates to another DataFrame as scalar subqueries.

Each column of the one-row frame becomes an uncorrelated scalar subquery: Spark runs it once
(subqueries over the same aggregate are merged into one job) and uses the value as a literal,
so no join, cross join or keyless window is planned and no single task sees the big side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def attach_scalars(df: DataFrame, one_row: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or one_row.columns
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in cols])


def combine_rows(*one_rows: DataFrame) -> DataFrame:
    """Several one-row frames side by side (the first one's row, the others as scalars)."""
    out = one_rows[0]
    for other in one_rows[1:]:
        out = attach_scalars(out, other)
    return out
