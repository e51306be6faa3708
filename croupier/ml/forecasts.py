"""Forecasts of many daily series at once (N12-N14): boosted trees per (market, target).

A series is the daily values of one target in one market. Features and splits are window columns
(``series.forecast_features``). Two grouped maps do the rest, one group per series, so Spark runs
all series side by side and the driver sees none of them: ``fit`` returns a row per series with two models
(training days; training and validation days) and the 10 % and 90 % quantiles of the validation
residuals, ``apply`` returns backtest rows and the 30-day recursion, whose state is the series' last 28
values. A group is one row per calendar day, so it does not grow with the number of events.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import dec
from croupier.ml import series
from croupier.ml.boosting import Trees, boost

FEATURES = ["dow", "month", *series.HISTORY]
KEYS = ["market", "metric"]
ALL_MARKETS = "All"
MODEL_VERSION = "boosted-v1"
_NODES = "base double, roots array<int>, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"
MODELS = ("market string, metric string, low double, high double, "
          + ", ".join(f"{which}_{c}" for which in ("first", "again") for c in _NODES.split(", ")))
ROWS = ("market string, metric string, forecast_date date, actual_value double, predicted_value double, lower_bound double, upper_bound double, "
        "split string")


def market_series(wh) -> DataFrame:
    """Date, market and the six targets of every market and calendar day, 0 filled; from the facts' own columns."""
    deposit = (F.col("transaction_type") == "Deposit") & (F.col("transaction_status") == "Approved")
    none = F.lit(None).cast("decimal(18,2)")
    events = (
        wh.v_sessions_enriched.select(F.col("session_date").alias("date"), "country", F.col("casino_ggr").alias("c"), none.alias("s"), none.alias("d"))
        .unionByName(wh.v_sports_bets_enriched.select(F.col("bet_day").alias("date"), "country", none.alias("c"), F.col("sportsbook_ggr").alias("s"), none.alias("d")))
        .groupBy("date", "country").agg(F.sum("c").alias("casino"), F.sum("s").alias("sports")))
    paid = wh.v_transactions_enriched.filter(deposit).groupBy(F.col("transaction_day").alias("date"), "country").agg(
        F.sum("amount").alias("deposits"), F.countDistinct("player_id").alias("ftd"))
    days = wh.dim_date.agg(F.min("calendar_date").alias("lo"), F.max("calendar_date").alias("hi"))
    span = days.select(F.sequence("lo", "hi").alias("days")).first()  # one row
    markets = wh.dim_player.select("country").filter("country IS NOT NULL").distinct()
    grid = markets.select("country", F.explode(F.lit(span["days"] if span and span["days"] else []).cast("array<date>")).alias("date"))
    ggr = F.coalesce("casino", dec("0")) + F.coalesce("sports", dec("0"))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return grid.join(events, ["date", "country"], "left").join(paid, ["date", "country"], "left").select(
        "date", F.col("country").alias("market"), ggr.cast("double").alias("ggr"), (ggr * dec(series.NGR_FORECAST_SHARE)).cast("double").alias("ngr"),
        z("deposits").alias("deposits"), z("ftd").alias("ftd"), z("casino").alias("casino_ggr"), z("sports").alias("sportsbook_ggr"))


def features(daily: DataFrame) -> DataFrame:
    """Rows of every (market, target) with features and split; days without a full history have split 'history'."""
    if "market" not in daily.columns:
        daily = daily.withColumn("market", F.lit(ALL_MARKETS))
    rows = series.forecast_features(daily, keys=("market", "metric"), complete=False)
    return rows.select(*KEYS, "date", "actual", "split", F.weekday("date").cast("double").alias("dow"), F.month("date").cast("double").alias("month"),
                       *series.HISTORY)


def _row(trees: Trees) -> list:
    return [trees.base, *(v.tolist() for v in (trees.roots, trees.feature, trees.threshold, trees.left, trees.right, trees.value))]


def _trees(model: pd.Series, which: str) -> Trees:
    value = lambda c: model[f"{which}_{c}"]
    return Trees(float(value("base")), *(np.asarray(value(c)) for c in ("roots", "feature", "threshold", "left", "right", "value")))


def fit_series(rows: pd.DataFrame) -> pd.DataFrame:
    """One series: both models and the residual quantiles; nothing without training and validation days."""
    rows = rows.sort_values("date")
    part = {s: rows[rows.split == s] for s in ("train", "validation")}
    names = [c.strip().split(" ")[0] for c in MODELS.split(", ")]
    if not all(len(p) for p in part.values()):
        return pd.DataFrame(columns=names)
    x = {s: p[FEATURES].to_numpy(float) for s, p in part.items()}
    y = {s: p["actual"].to_numpy(float) for s, p in part.items()}
    first = boost(x["train"], y["train"])
    low, high = np.quantile(y["validation"] - np.maximum(first.predict(x["validation"]), 0), [0.10, 0.90])
    again = boost(np.concatenate([x["train"], x["validation"]]), np.concatenate([y["train"], y["validation"]]))
    key = rows.iloc[0]
    return pd.DataFrame([[key.market, key.metric, low, high, *_row(first), *_row(again)]], columns=names)


def recursion(model: Trees, history: list[float], last: dt.date, days: int) -> list[tuple[dt.date, float]]:
    """Each day's forecast becomes the next day's history."""
    out, values = [], list(history)
    for k in range(1, days + 1):
        day = last + dt.timedelta(days=k)
        x = [day.weekday(), day.month, *(values[-j] for j in series.LAGS), *(sum(values[-j:]) / j for j in series.WINDOWS)]
        values.append(max(0.0, float(model.predict(np.array([x], float))[0])))
        out.append((day, values[-1]))
    return out


def _apply(days: int):
    def apply_series(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        columns = ["market", "metric", "forecast_date", "actual_value", "predicted_value", "lower_bound", "upper_bound", "split"]
        if not len(rows) or not len(model):
            return pd.DataFrame(columns=columns)
        rows, model = rows.sort_values("date"), model.iloc[0]
        back = rows[rows.split.isin(["validation", "test"])]
        expected = np.maximum(_trees(model, "first").predict(back[FEATURES].to_numpy(float)), 0)
        out = list(zip(back.date, back.actual, expected, back.split))
        out += [(day, None, value, "future") for day, value in
                recursion(_trees(model, "again"), rows.actual.tolist()[-max(series.WINDOWS):], rows.date.iloc[-1], days)]
        return pd.DataFrame([(model.market, model.metric, day, actual, value, max(value + model.low, 0.0), max(value + model.high, 0.0), split)
                             for day, actual, value, split in out], columns=columns)

    return apply_series


def fit(daily: DataFrame) -> DataFrame:
    """One row of models per series."""
    return features(daily).groupBy(*KEYS).applyInPandas(fit_series, MODELS)


def apply(daily: DataFrame, fitted: DataFrame, days: int = series.HORIZON_DAYS) -> DataFrame:
    """Validation and test predictions of the first model and ``days`` future days of the refitted one, with band."""
    rows = features(daily).groupBy(*KEYS).cogroup(fitted.groupBy(*KEYS)).applyInPandas(_apply(days), ROWS)
    return rows.withColumn("model_version", F.lit(MODEL_VERSION))


def forecast_backtest(wh, daily: DataFrame | None = None) -> DataFrame:
    """The backtest and forecast rows over all markets together."""
    daily = daily if daily is not None else series.daily_series(wh)
    return apply(daily, fit(daily)).drop("market")


def market_backtest(wh) -> DataFrame:
    """The same per market, all markets and targets in one job."""
    daily = market_series(wh)
    return apply(daily, fit(daily))


def train(daily: DataFrame, path: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Save the forecasters (N21); returns them as read back and the backtest they give."""
    spark = daily.sparkSession
    fit(daily).withColumn("scoring_cutoff", F.lit(cutoff)).write.mode("overwrite").parquet(path)
    saved = load(spark, path)
    return saved, apply(daily, saved.drop("scoring_cutoff")).drop("market")


def load(spark, path: str) -> DataFrame:
    """Saved forecasters, one row per series."""
    return spark.read.schema(MODELS + ", scoring_cutoff string").parquet(path)
