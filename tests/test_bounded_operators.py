"""Quantiles with heavy ties stay bounded; row numbers follow file order over many partitions."""

import numpy as np
from pyspark.sql import functions as F

from croupier.operators import quantiles
from croupier.operators.row_index import with_row_index


def test_six_valued_column_collects_pairs_only(spark, monkeypatch):
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") % 6).cast("double").alias("v"), (F.col("id") * 7919 % 200_003).cast("double").alias("w"))
    values, many = np.arange(200_000) % 6.0, np.arange(200_000) * 7919 % 200_003
    monkeypatch.setattr(quantiles, "MAX_DISTINCT", 50)
    got = quantiles.exact_quantile_row(df, {"a": ("v", 0.85), "b": ("v", 0.5), "c": ("w", 0.123), "d": ("w", 1.0)}, accuracy=200)
    assert got == {"a": np.quantile(values, 0.85), "b": np.quantile(values, 0.5), "c": np.quantile(many, 0.123), "d": np.quantile(many, 1.0)}


def test_row_index_is_contiguous_in_order(spark):
    df = spark.range(0, 1000, 1, 7)
    assert [r.row_index for r in with_row_index(df).orderBy("id").collect()] == list(range(1000))


def test_row_index_does_not_shuffle_the_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        indexed = with_row_index(spark.read.parquet(path))
        assert "SortMergeJoin" not in indexed._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.row_index for r in indexed.collect()) == list(range(1000))
    finally:
        spark.conf.set(key, before)
