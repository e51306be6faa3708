"""Churn classifiers and remaining-LTV regressors on temporal snapshots.

Training data are player snapshots at several cutoffs before the scoring cutoff (train /
validation / test, latest window untouched until metrics are recorded), all taken in one pass over
the facts and fitted with MLlib pipelines: median imputation + scaling for numbers, mode imputation, index
and one-hot for categories (unknown categories kept in their own bucket), gradient-boosted trees.
"""

from __future__ import annotations

import datetime as dt
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.operators.quantiles import exact_quantile_row
from croupier.ml.snapshots import Spec, snapshots

# ---- fixed values ------------------------------------------------------------------
NUMERIC_FEATURES = [
    "tenure_days", "session_count", "active_days", "recency_days", "total_bets", "historical_ggr", "avg_duration",
    "max_duration", "distinct_games", "bet_count", "deposit_count", "deposit_amount", "withdrawal_count",
    "withdrawal_amount", "decline_rate", "payment_methods", "sports_bets", "sports_stake", "sports_ggr",
]
CATEGORICAL_FEATURES = ["country", "channel", "device", "vip_level", "kyc_status"]
# Observation windows per horizon as day offsets before the scoring cutoff; the test window's
# outcome period ends before the scoring cutoff.
TEMPORAL_WINDOWS = {
    7: {"train": [-96, -81], "validation": [-65], "test": [-35]},
    14: {"train": [-111, -96], "validation": [-65], "test": [-35]},
    30: {"train": [-126, -96], "validation": [-65], "test": [-35]},
    90: {"train": [-171, -158], "validation": [-126], "test": [-96]},
    180: {"train": [-202, -197], "validation": [-192], "test": [-180]},
}
CHURN_HORIZONS, LTV_HORIZONS = (7, 14, 30), (30, 90, 180)
GBT_PARAMS = {"maxIter": 70, "stepSize": 0.085, "maxDepth": 5, "seed": 2026}
LEAST_ROWS = 25
MODEL_VERSION = "mllib-temporal-v1"
# ------------------------------------------------------------------------------------


def cutoffs_for(scoring_cutoff: str, horizon: int) -> dict[str, list[str]]:
    base = dt.date.fromisoformat(scoring_cutoff)
    return {split: [(base + dt.timedelta(days=o)).isoformat() for o in offs] for split, offs in TEMPORAL_WINDOWS[horizon].items()}


def specs_for(scoring_cutoff: str, horizons=tuple(TEMPORAL_WINDOWS)) -> list[Spec]:
    return [Spec(c, h, split) for h in horizons for split, cs in cutoffs_for(scoring_cutoff, h).items() for c in cs]


def temporal_dataset(wh, scoring_cutoff: str, horizons=tuple(TEMPORAL_WINDOWS), current: bool = False) -> DataFrame:
    """Stacked snapshots with their horizon, split and outcome, all horizons in one pass over each
    fact; with ``current`` also the players to be scored (horizon 1, split 'current')."""
    return snapshots(wh, specs_for(scoring_cutoff, horizons) + [Spec(scoring_cutoff, 1, "current")] * current)


def _numeric(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col(c).cast("double").alias(f"n_{c}") for c in NUMERIC_FEATURES])


def preprocess_stages() -> list:
    """Median impute + standardise numbers; index (unknown kept), mode impute + one-hot categories."""
    num_in = [f"n_{c}" for c in NUMERIC_FEATURES]
    imputed = [f"i_{c}" for c in NUMERIC_FEATURES]
    stages = [Imputer(strategy="median", inputCols=num_in, outputCols=imputed),
              VectorAssembler(inputCols=imputed, outputCol="num_vec", handleInvalid="keep"),
              StandardScaler(inputCol="num_vec", outputCol="num_scaled", withMean=True, withStd=True)]
    idx = [f"x_{c}" for c in CATEGORICAL_FEATURES]
    # the index orders labels by frequency, so 0 is the mode of the fitted data
    filled = ", ".join(f"IF({c} IS NULL, 0D, k_{c}) AS x_{c}" for c in CATEGORICAL_FEATURES)
    stages += [StringIndexer(inputCols=CATEGORICAL_FEATURES, outputCols=[f"k_{c}" for c in CATEGORICAL_FEATURES], handleInvalid="keep"),
               SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
               OneHotEncoder(inputCols=idx, outputCols=[f"o_{c}" for c in CATEGORICAL_FEATURES], handleInvalid="keep"),
               VectorAssembler(inputCols=["num_scaled", *[f"o_{c}" for c in CATEGORICAL_FEATURES]], outputCol="features")]
    return stages


def _balanced(df: DataFrame) -> DataFrame:
    """Class-balanced weights n / (2 n_class), computed in one aggregate."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    n, pos = float(c["n"]), float(c["pos"] or 0)
    neg = n - pos
    wp, wn = (n / (2 * pos) if pos else 1.0), (n / (2 * neg) if neg else 1.0)
    return df.withColumn("weight", F.when(F.col("label") == 1, F.lit(wp)).otherwise(F.lit(wn)))


def classification_metrics(scored: DataFrame) -> dict[str, float]:
    """ROC-AUC, precision/recall at .5, lift of the top decile, positive rate.

    The top decile is the ceil(n/10) highest probabilities (ties by player id): the cut-off
    score is an exact order statistic and only the tie rows at the cut-off are ordered."""
    p = scored.select("player_id", "label", vector_to_array("probability")[1].alias("p")).cache()
    c = p.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"),
              F.sum(((F.col("p") >= 0.5) & (F.col("label") == 1)).cast("long")).alias("tp"),
              F.sum((F.col("p") >= 0.5).cast("long")).alias("pp"), F.countDistinct("label").alias("classes")).first()
    n, pos, tp, pp = int(c["n"]), int(c["pos"] or 0), int(c["tp"] or 0), int(c["pp"] or 0)
    auc = (BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName="areaUnderROC").evaluate(p)
           if c["classes"] > 1 else 0.5)
    k = max(1, math.ceil(n * 0.10))
    cut = exact_quantile_row(p, {"s": ("p", (n - k) / (n - 1) if n > 1 else 0.0)})["s"]
    above = p.filter(F.col("p") > cut).agg(F.count(F.lit(1)).alias("m"), F.sum("label").alias("y")).first()
    rest = k - int(above["m"])
    ties_pos = (p.filter(F.col("p") == cut).orderBy("player_id").limit(max(rest, 0)).agg(F.sum("label")).first()[0] or 0) if rest > 0 else 0
    top_rate = (int(above["y"] or 0) + int(ties_pos)) / k
    base = pos / n if n else 0.0
    p.unpersist()
    return {"roc_auc": float(auc), "precision": tp / pp if pp else 0.0, "recall": tp / pos if pos else 0.0,
            "lift_top_10pct": top_rate / base if base else 0.0, "positive_rate": base}


def regression_metrics(pred: DataFrame) -> dict[str, float]:
    """MAE and WAPE (denominator at least 1)."""
    r = pred.agg(F.avg(F.abs(F.col("label") - F.col("pred"))).alias("mae"), F.sum(F.abs(F.col("label") - F.col("pred"))).alias("ae"),
                 F.sum(F.abs("label")).alias("a")).first()
    return {"mae": float(r["mae"] or 0.0), "wape": float(r["ae"] or 0.0) / max(float(r["a"] or 0.0), 1.0)}


def metric_rows(spark, model: str, horizon, split: str, values: dict, measured_at: dt.datetime) -> DataFrame:
    """Long metric rows rounded to five places."""
    rows = [(model, horizon, split, k, round(float(v), 5), MODEL_VERSION, measured_at) for k, v in values.items()]
    return spark.createDataFrame(rows, METRIC_SCHEMA)


METRIC_SCHEMA = ("model_name string, horizon_days int, split string, metric_name string, metric_value double, model_version string, "
                 "measured_at timestamp")


def _labelled(data: DataFrame, kind: str) -> DataFrame:
    """Churn: no activity in the outcome window. LTV: the window's GGR, not below zero."""
    label = (F.col("future_activity") == 0).cast("double") if kind == "churn" else F.greatest(F.col("future_ggr").cast("double"), F.lit(0.0))
    return _numeric(data).withColumn("label", label)


def _weighted(data: DataFrame, kind: str) -> DataFrame:
    return _balanced(data) if kind == "churn" else data


def _fitted(rows: DataFrame, kind: str, params: dict) -> PipelineModel:
    """Preprocessing and boosted trees on ``rows``. Boosting scans its input several times before it keeps a
    binned copy, so the feature vectors are computed once and held for that time."""
    rows = _weighted(rows, kind)
    prepared = Pipeline(stages=preprocess_stages()).fit(rows)
    weight = {"weightCol": "weight"} if kind == "churn" else {}
    last = (GBTClassifier(featuresCol="features", labelCol="label", **weight, **params) if kind == "churn"
            else GBTRegressor(featuresCol="features", labelCol="label", lossType="absolute", **params))
    features = prepared.transform(rows).select("features", "label", *weight.values()).persist()
    try:
        return PipelineModel(prepared.stages + [last.fit(features)])
    finally:
        features.unpersist()


def predicted(model: PipelineModel, kind: str, rows: DataFrame) -> DataFrame:
    """``rows`` (with their n_ columns) and ``value``: churn probability, or remaining LTV not below zero."""
    out = model.transform(rows)
    value = vector_to_array("probability")[1] if kind == "churn" else F.greatest(F.col("prediction"), F.lit(0.0))
    return out.withColumn("value", value)


def trainable(data: DataFrame, kind: str) -> bool:
    """Whether every split has rows, training more than a leaf's worth, and, for churn, both outcomes."""
    n = {r["split"]: r for r in data.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("future_activity") == 0).cast("int")).alias("gone")).collect()}
    if any(s not in n for s in ("train", "validation", "test")) or n["train"]["n"] < LEAST_ROWS:
        return False
    return kind != "churn" or 0 < n["train"]["gone"] < n["train"]["n"]


def fit(data: DataFrame, kind: str, horizon: int, params: dict | None = None, beside: bool = True) -> tuple[PipelineModel | None, list[tuple]]:
    """Fit on train, measure on validation and test, refit on train and validation.

    ``data`` holds the snapshots of one horizon. Returns the refitted pipeline and (model, horizon, split,
    metric, value) rows; no pipeline where the data cannot train one. Without ``beside`` the refit waits for the
    first fit, so only the rows of one of them are held.
    """
    if not trainable(data, kind):
        return None, []
    data = _labelled(data, kind)
    params = {**GBT_PARAMS, **(params or {})}

    def measured(first: PipelineModel, split: str) -> list[tuple]:
        seen = data.filter(F.col("split") == split)
        if kind == "churn":
            values = classification_metrics(first.transform(seen))
        else:
            values = regression_metrics(predicted(first, kind, seen).withColumnRenamed("value", "pred"))
        return [(f"{kind}_{horizon}d", horizon, split, k, round(float(v), 5)) for k, v in values.items()]

    # boosting waits between its short jobs: the refit needs nothing of the first fit and runs beside it
    refit = lambda: _fitted(data.filter("split IN ('train', 'validation')"), kind, params)
    with ThreadPoolExecutor(3) as pool:
        again = pool.submit(refit) if beside else None
        first = _fitted(data.filter("split = 'train'"), kind, params)
        rows = [row for split in pool.map(lambda s: measured(first, s), ("validation", "test")) for row in split]
        return again.result() if again else refit(), rows


def load_model(path: str) -> PipelineModel:
    """A persisted pipeline (preprocessing + model)."""
    return PipelineModel.load(path)
