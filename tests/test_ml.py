"""Model governance and series jobs: ordered temporal windows, metric definitions against brute
force, forecast/anomaly output contracts and determinism."""

import math

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from croupier.ml import forecasts, models, series


def test_temporal_windows_are_ordered_and_leak_free():
    for horizon, w in models.TEMPORAL_WINDOWS.items():
        train, val, test = w["train"], w["validation"], w["test"]
        assert max(train) < min(val) <= max(val) < min(test)
        assert max(test) + horizon <= 0  # test outcomes end before the scoring cutoff
    c = models.cutoffs_for("2000-03-31", 30)
    assert c["test"] == ["2000-02-25"] and len(c["train"]) == 2


def test_classification_metrics_match_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 137
    y = rng.integers(0, 2, n)
    p = np.round(rng.random(n), 2)  # rounded: many ties
    rows = [(f"p{i:03d}", float(y[i]), Vectors.dense([1 - p[i], p[i]])) for i in range(n)]
    df = spark.createDataFrame(rows, ["player_id", "label", "probability"])
    got = models.classification_metrics(df)
    k = math.ceil(n * 0.1)
    order = sorted(range(n), key=lambda i: (-p[i], f"p{i:03d}"))[:k]
    lift = (y[order].mean()) / y.mean()
    pred = p >= 0.5
    assert abs(got["lift_top_10pct"] - lift) < 1e-12
    assert abs(got["precision"] - (y[pred].sum() / pred.sum())) < 1e-12
    assert abs(got["recall"] - (y[pred].sum() / y.sum())) < 1e-12
    assert abs(got["positive_rate"] - y.mean()) < 1e-12
    assert 0.0 <= got["roc_auc"] <= 1.0


def test_forecast_and_anomalies_contracts(wh):
    daily = series.daily_series(wh).cache()
    bt = forecasts.forecast_backtest(wh, daily).cache()
    counts = {r["split"]: r["n"] for r in bt.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["future"] == 30 * len(series.TARGETS) and counts["validation"] > 0 and counts["test"] > 0
    assert bt.filter((F.col("predicted_value") < 0) | (F.col("lower_bound") < 0) | (F.col("upper_bound") < 0)).count() == 0
    last = daily.agg(F.max("date")).first()[0]
    assert bt.filter(F.col("split") == "future").agg(F.min("forecast_date")).first()[0] > last
    a1 = series.anomalies(wh, daily).collect()
    a2 = series.anomalies(wh, daily).collect()
    assert sorted(map(tuple, a1)) == sorted(map(tuple, a2))
    per_metric = {}
    for r in a1:
        per_metric[r["metric"]] = per_metric.get(r["metric"], 0) + 1
        assert r["anomaly_score"] > 0 and r["severity"] in ("High", "Medium")
    n = daily.count()
    assert all(v <= math.ceil(n * series.FLAGGED_SHARE) for v in per_metric.values())


def test_anomaly_flags_injected_outlier(spark):
    import datetime as dt

    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rng = np.random.default_rng(5)
    rows = []
    for i, d in enumerate(days):
        values = {m: 100 + float(rng.normal(0, 2)) for m in series.ANOMALY_METRICS}
        if i == 77:
            values["ggr"] = 400.0  # one extreme day
        rows.append((d, *values.values()))
    daily = spark.createDataFrame(rows, "date date, " + ", ".join(f"{m} double" for m in series.ANOMALY_METRICS))
    out = [r for r in series.anomalies(None, daily).collect() if r["metric"] == "ggr"]
    top = max(out, key=lambda r: r["anomaly_score"])
    assert top["detected_date"] == days[77] and top["severity"] == "High"


def test_forecast_follows_a_weekly_pattern(spark):
    import datetime as dt

    rows = []
    for i in range(400):
        d = dt.date(2000, 1, 1) + dt.timedelta(days=i)
        rows.append((d, *[100.0 + 30 * d.weekday()] * len(series.TARGETS)))
    daily = spark.createDataFrame(rows, "date date, " + ", ".join(f"{m} double" for m in series.TARGETS))
    future = forecasts.forecast_backtest(None, daily).filter("split = 'future' AND metric = 'ggr'").collect()
    assert len(future) == 30
    assert max(abs(r["predicted_value"] - (100 + 30 * r["forecast_date"].weekday())) for r in future) < 10


def test_missing_category_becomes_the_mode(spark, tmp_path):
    from pyspark.ml import Pipeline

    def rows(*countries):
        return spark.createDataFrame([(x,) for x in countries], "country string").select(
            "country", *[F.lit("same").alias(c) for c in models.CATEGORICAL_FEATURES if c != "country"],
            *[F.lit(1.0).alias(f"n_{c}") for c in models.NUMERIC_FEATURES])

    Pipeline(stages=models.preprocess_stages()).fit(rows("DE", "FR", "FR", None)).write().save(str(tmp_path / "m"))
    fitted = models.load_model(str(tmp_path / "m"))
    seen = [tuple(r.features.toArray()) for r in fitted.transform(rows("FR", None, "DE", "unseen")).select("features").collect()]
    assert seen[1] == seen[0] and len(set(seen)) == 3
