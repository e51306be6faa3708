"""Custom operators against brute force on small fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from croupier.operators.interval_join import interval_semi_join
from croupier.operators.quantiles import exact_quantile_row, exact_quantiles


def test_exact_quantiles_match_linear_interpolation(spark):
    rng = random.Random(7)
    values = [rng.choice([rng.random() * 100, float(rng.randint(0, 5))]) for _ in range(3000)] + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    probs = [0.0, 0.1, 0.55, 0.6, 0.8, 0.9, 0.955, 1.0]
    got = exact_quantiles(df, "x", probs, accuracy=50)  # a coarse sketch forces the bracket path
    clean = np.array([v for v in values if v is not None])
    want = np.percentile(clean, [p * 100 for p in probs], method="linear")
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_exact_quantile_row_multiple_columns_and_empty(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(11)], "a double, b double")
    got = exact_quantile_row(df, {"m": ("a", 0.5), "q": ("a", 0.75), "e": ("b", 0.5)})
    assert got == {"m": 5.0, "q": 7.5, "e": None}


def test_interval_semi_join_matches_brute_force(spark):
    rng = random.Random(3)
    left = [(f"p{i}", rng.randint(0, 50)) for i in range(60)]
    right = [(f"p{rng.randint(0, 70)}", rng.randint(0, 120)) for _ in range(600)]
    ldf = spark.createDataFrame(left, "player_id string, start int")
    rdf = spark.createDataFrame(right, "player_id string, day int")
    got = {r["player_id"] for r in interval_semi_join(ldf, rdf, "player_id", F.col("start") + 30, F.col("start") + 37, "day").collect()}
    want = {p for p, s in left if any(q == p and s + 30 <= d < s + 37 for q, d in right)}
    assert got == want
