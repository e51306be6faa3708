"""Train, score and save: the model tables of a warehouse.

``train`` writes everything under one folder, each step reading what the one before wrote:

  training_rows     snapshots of every horizon and the players to score, from one pass over each fact
  models/<name>     saved pipelines of the trained horizons
  model_list        one row per horizon: trained or closed form, folder, cut-off, parameters
  scored_players    the current snapshot with the scores of every horizon
  predictions       the same scores, one row per (run, model, horizon, player)
  model_scores, next_best_actions, model_metrics, forecast_backtest, revenue_forecast, ml_anomalies, forecasters,
  run_report

A horizon whose snapshots cannot train a model keeps its closed-form score. ``score`` applies the saved
pipelines to any warehouse; on the warehouse they were trained on it gives the same rows.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from croupier.functions.exprs import SCORE, clip
from croupier.ml import forecasts, models, series
from croupier.ml.snapshots import Spec, snapshots
from croupier.plans.scores import LTV_TYPE, assembled, next_best_actions_table, rule_scores
from croupier.session import released_shuffles

KINDS = {"churn": models.CHURN_HORIZONS, "ltv": models.LTV_HORIZONS}
NAMES = [(kind, h) for kind, hs in KINDS.items() for h in hs]
#: Tables that a reader of the warehouse finds beside the marts.
TABLES = ("model_scores", "next_best_actions", "model_metrics", "forecast_backtest", "revenue_forecast", "ml_anomalies")
MODEL_LIST = "model_name string, kind string, horizon_days int, status string, path string, scoring_cutoff string, model_version string, params string"
FACTS = ("fact_casino_session", "fact_sports_bet", "fact_transaction")
THREADS = 6  # models fitted at a time; each is Spark jobs of its own
# Boosting runs hundreds of short jobs over the same rows: few, cached partitions, one wave of tasks a job
# as long as that leaves no partition with more than MOST_ROWS_A_TASK.
ROWS_A_TASK, MOST_ROWS_A_TASK = 100_000, 500_000
# Boosting passes over binned rows and their predictions some 350 times; rows that do not stay in memory are read from disk
# each time. Bytes of such a row, its share of the storage memory, and snapshots in both fits for one of the horizon.
BYTES_A_ROW, STORAGE_SHARE, FITTED = 500, 0.6, 1.25


def column(kind: str, horizon: int) -> str:
    return f"churn_probability_{horizon}d" if kind == "churn" else f"remaining_ltv_{horizon}d"


def partitions(rows: int, cores: int) -> int:
    """Partitions of the rows of one model."""
    return max(1, min(rows // ROWS_A_TASK, max(cores, -(-rows // MOST_ROWS_A_TASK))))


def _cores(spark: SparkSession) -> int:
    """Tasks the session runs at a time; 1 on a client without a SparkContext."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001  (no SparkContext on this client: sized by rows alone)
        return 1


def _storage(spark: SparkSession) -> int | None:
    """Bytes the session keeps cached rows in; None on a client without a SparkContext."""
    try:
        return sum(e.totalOnHeapStorageMemory() for e in spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos())
    except Exception:  # noqa: BLE001  (no SparkContext on this client)
        return None


def at_a_time(rows: int, storage: int | None) -> float:
    """How many models of as many snapshot rows can be fitted at a time with all their rows in memory; less than 1: not even
    the two fits of one."""
    return THREADS if storage is None or not rows else min(THREADS, storage * STORAGE_SHARE / (rows * FITTED * BYTES_A_ROW))


def _saved(df: DataFrame, path: str, *by: str) -> DataFrame:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def scored(current: DataFrame, pipelines: dict) -> DataFrame:
    """Closed-form scores, replaced by those of every pipeline given as {(kind, horizon): pipeline}."""
    rows = rule_scores(current)
    for (kind, horizon), model in pipelines.items():
        name = column(kind, horizon)
        value = (clip(F.col("value"), F.lit(0.0), F.lit(1.0)).cast(SCORE) if kind == "churn" else F.col("value").cast(LTV_TYPE)).alias(name)
        kept = [c for c in rows.columns if c != name]
        rows = models.predicted(model, kind, models._numeric(rows)).select(*kept, value)
    return rows


def score(wh, folder: str, cutoff: str | None = None) -> DataFrame:
    """``model_scores`` of a warehouse from the pipelines saved in ``folder``."""
    listed = wh.spark.read.parquet(f"{folder}/model_list").collect()
    pipelines = {(r.kind, r.horizon_days): models.load_model(f"{folder}/{r.path}") for r in listed if r.status == "trained"}
    cutoff = cutoff or listed[0].scoring_cutoff
    current = snapshots(wh, [Spec(cutoff, 1, "current")]).drop("horizon", "split", "cutoff")
    return assembled(_stable(scored(current, pipelines)), cutoff, models.MODEL_VERSION if pipelines else "closed-form-v1")


def _stable(df: DataFrame) -> DataFrame:
    """Cut-offs of the next best action are quantiles of these scores, so they are computed once."""
    from croupier.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _series_tables(wh, folder: str, cutoff: str) -> dict[str, DataFrame]:
    """The tables that need no player model: forecasters, backtest, forecast and anomalies."""
    daily = _saved(series.daily_series(wh), f"{folder}/daily_series")
    forecasters, backtest = forecasts.train(daily, f"{folder}/forecasters", cutoff)
    backtest = _saved(backtest, f"{folder}/forecast_backtest")
    return {"forecasters": forecasters, "forecast_backtest": backtest,
            "revenue_forecast": _saved(series.revenue_forecast(backtest), f"{folder}/revenue_forecast"),
            "ml_anomalies": _saved(series.anomalies(wh, daily), f"{folder}/ml_anomalies")}


def train(wh, folder: str, cutoff: str, run_id: str, params: dict | None = None, names: list[tuple[str, int]] | None = None) -> dict[str, DataFrame]:
    """Train all horizons as of ``cutoff`` and write the tables above; returns the written tables by name.

    With ``names`` only those models are trained and listed; the other scores keep their closed form."""
    names = NAMES if names is None else names
    spark: SparkSession = wh.spark
    folder = folder.rstrip("/")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    horizons = tuple(h for h in models.TEMPORAL_WINDOWS if h in {d for _, d in names})
    facts = wh.training_facts
    with released_shuffles(spark), ThreadPoolExecutor(len(FACTS)) as pool:
        list(pool.map(lambda name: getattr(facts, name), FACTS))  # written side by side
        rows = _saved(models.temporal_dataset(facts, cutoff, horizons, current=True), f"{folder}/training_rows", "horizon", "split")
    current = rows.filter("split = 'current'").drop("horizon", "split", "cutoff")

    counts = {r["horizon"]: r["count"] for r in rows.filter("split <> 'current'").groupBy("horizon").count().collect()}  # one number a horizon
    room = at_a_time(max(counts.values(), default=0), _storage(spark))
    turn = threading.BoundedSemaphore(max(1, int(room)))
    held = {} if room >= 1 else {"beside": False}

    def one(name: tuple[str, int]):
        kind, horizon = name
        data = rows.filter((F.col("horizon") == horizon) & (F.col("split") != "current"))
        with turn:
            data = data.coalesce(partitions(counts.get(horizon, 0), _cores(spark))).persist()
            model, measured = models.fit(data, kind, horizon, params, **held)
            data.unpersist()
        if model is not None:
            saves.append(pool.submit(lambda: model.write().overwrite().save(f"{folder}/models/{kind}_{horizon}d")))
        return model, measured

    # boosting waits between its short jobs; the daily series and what is built on it fill the gaps.
    # Tables that need nothing of each other are written side by side
    with ThreadPoolExecutor(THREADS + 3) as pool:
        saves, tables = [], {}
        by_day = pool.submit(_series_tables, facts, folder, cutoff)
        fitted = dict(zip(names, pool.map(one, names)))
        pipelines = {n: m for n, (m, _) in fitted.items() if m is not None}
        version = models.MODEL_VERSION if pipelines else "closed-form-v1"
        listed = [(f"{k}_{h}d", k, h, "trained" if (k, h) in pipelines else "closed form", f"models/{k}_{h}d" if (k, h) in pipelines else None, cutoff, version,
                   json.dumps({**models.GBT_PARAMS, **(params or {})})) for k, h in names]
        players = _saved(scored(current, pipelines), f"{folder}/scored_players")
        stacked = ", ".join(f"'{k}', {h}, cast({column(k, h)} as double)" for k, h in NAMES)
        beside = {
            "model_list": pool.submit(_saved, spark.createDataFrame(listed, MODEL_LIST).coalesce(1), f"{folder}/model_list"),
            "predictions": pool.submit(_saved, players.selectExpr(f"'{run_id}' as run_id", "player_id", f"stack({len(NAMES)}, {stacked}) as (model, horizon_days, value)"),
                                       f"{folder}/predictions")}
        tables["model_scores"] = _saved(assembled(players, cutoff, version).withColumn("import_run_id", F.lit(run_id)), f"{folder}/model_scores")
        shown = wh.with_tables(model_scores=tables["model_scores"].drop("import_run_id"))
        beside["next_best_actions"] = pool.submit(_saved, next_best_actions_table(shown), f"{folder}/next_best_actions")

        tables.update(by_day.result())
        measured = spark.createDataFrame([(*r, models.MODEL_VERSION, now) for _, (_, ms) in fitted.items() for r in ms], models.METRIC_SCHEMA)
        ahead = series.forecast_metrics(tables["forecast_backtest"]).select("*", F.lit(forecasts.MODEL_VERSION).alias("model_version"), F.lit(now).alias("measured_at"))
        beside["model_metrics"] = pool.submit(_saved, measured.unionByName(ahead), f"{folder}/model_metrics")
        tables["run_report"] = _saved(series.run_report(tables["model_scores"], tables["ml_anomalies"]), f"{folder}/run_report")
        tables.update({name: table.result() for name, table in beside.items()})
        for save in saves:
            save.result()
    return tables
