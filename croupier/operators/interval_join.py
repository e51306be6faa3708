"""Range (interval) joins: an equi key plus an interval condition.

Spark plans ``key equality AND lo <= point < hi`` as a sort-merge join on the key with a
residual condition, so the blow-up is bounded by the rows sharing a key. Callers pass the
right side de-duplicated per (key, point) so a heavy key contributes at most one row per
distinct point (for daily activity: per day, not per event).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_semi_join(left: DataFrame, right: DataFrame, key: str, lo: F.Column, hi: F.Column, point: str) -> DataFrame:
    """Rows of ``left`` having some ``right`` row with the same key and ``lo <= point < hi``.

    ``lo``/``hi`` are expressions over ``left`` columns; ``point`` is a column of ``right``.
    """
    r = right.select(F.col(key).alias("__k"), F.col(point).alias("__p")).distinct()
    cond = (F.col(key) == F.col("__k")) & (F.col("__p") >= lo) & (F.col("__p") < hi)
    return left.join(r, cond, "left_semi")
