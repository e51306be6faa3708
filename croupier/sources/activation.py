"""Turning a checked import into the active warehouse, and its registry.

Order: build, quality gate, trained models and scores, gate with scores, the manifest of all tables, and only
then the pointer moves (``publish``). A failed activation leaves the previous warehouse active,
removes its own half-written folder and is logged. Every issue of a run is kept in a table of its own next to the run's row.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, SCORE
from croupier.plans.scores import LTV_TYPE
from croupier.sources import csv_import as ci
from croupier.sources import publish
from croupier.sources.driver_tables import RawTables

# warehouse input -> (dataset, columns)
CORE = {
    "players": ("players", ("player_id", "registration_date", "country", "channel", "device", "vip_level", "kyc_status", "age_group")),
    "sessions": ("casino_sessions", ("session_id", "player_id", "game_id", "session_start", "duration_minutes", "total_bet_amount",
                                     "total_payout_amount", "casino_ggr", "bet_count")),
    "sports_bets": ("sportsbook_bets", ("bet_id", "player_id", "bet_date", "sport", "is_live", "odds", "stake", "payout", "sportsbook_ggr",
                                        "event_name")),
    "transactions": ("transactions", ("transaction_id", "player_id", "transaction_date", "transaction_type", "amount", "transaction_status",
                                      "payment_method", "processing_fee")),
}
EXTRA = ("bonuses", "campaigns", "kyc_risk_events")
GAME_COLUMNS = ["game_name", "game_family", "theoretical_rtp", "provider"]
EVENT_TIMES = {"casino_sessions": "session_start", "sportsbook_bets": "bet_date", "transactions": "transaction_date"}
RUN_SCHEMA = ("run_id string, created_at timestamp, status string, files_json string, rows_loaded bigint, quality_score bigint, "
              "error_count bigint, warning_count bigint, error_message string")
NULL_SCORES = ("predicted_ltv_90d", "churn_probability", "churn_probability_7d", "churn_probability_14d", "churn_probability_30d",
               "observed_value", "remaining_ltv_30d", "remaining_ltv_90d", "remaining_ltv_180d", "predicted_total_ltv_30d",
               "predicted_total_ltv_90d", "predicted_total_ltv_180d", "fraud_risk", "rg_risk")


def training_gate(frames: dict[str, DataFrame], first_train_cutoff: str, scoring_cutoff: str) -> bool:
    """Whether the events reach back to the first training cutoff and up to the scoring cutoff."""
    days = [frames[d].select(F.to_date(t).alias("d")) for d, t in EVENT_TIMES.items() if d in frames and t in frames[d].columns]
    if not days:
        return False
    span = reduce(DataFrame.unionByName, days).agg(
        (F.min("d") <= F.lit(first_train_cutoff).cast("date")).alias("early"), (F.max("d") >= F.lit(scoring_cutoff).cast("date")).alias("late")).first()
    return bool(span.early and span.late)


def fallback_scores(players: DataFrame, scored_at: dt.datetime) -> DataFrame:
    """One row per player without scores, with the action 'Missing data'; columns and types of ``model_scores``."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kinds = {x: SCORE if x.startswith("churn") or x.endswith("_risk") else LTV_TYPE for x in NULL_SCORES}
    return players.select("player_id", *[null(k, x) for x, k in kinds.items()], F.lit("Missing data").alias("recommended_action"),
                          null(SCORE, "model_confidence"), null("string", "reason"), null(LTV_TYPE, "estimated_value_at_stake"),
                          null("timestamp_ntz", "last_session"), F.lit(0).cast("bigint").alias("session_count"), null(MONEY, "lifetime_ggr"),
                          F.lit("unavailable").alias("model_version"), F.lit(scored_at).cast("timestamp_ntz").alias("scored_at"))


def raw_tables_from_import(frames: dict[str, DataFrame]) -> RawTables:
    """The warehouse's input tables; a dataset that was not imported is an empty table."""
    spark = next(iter(frames.values())).sparkSession
    tables = {}
    for target, (dataset, columns) in CORE.items():
        f = frames.get(dataset)
        if f is None:
            f = spark.createDataFrame([], ", ".join(f"{x} string" for x in columns))
        tables[target] = f.select(*[F.col(x) if x in f.columns else F.lit(None).cast("string").alias(x) for x in columns])
    if "games" in frames:
        tables["games"] = ci.first_rows(frames["games"], "game_id", GAME_COLUMNS)
    elif "casino_sessions" in frames:
        tables["games"] = ci.derive_games(frames["casino_sessions"])
    else:
        tables["games"] = spark.createDataFrame([], "game_id string, game_name string, game_family string, theoretical_rtp double, provider string")
    return RawTables(**tables)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _build(spark: SparkSession, frames: dict[str, DataFrame], target: str, run_id: str, now: dt.datetime,
           first_train_cutoff: str, scoring_cutoff: str, params: dict | None) -> dict[str, DataFrame]:
    """Write every table of the version under ``target``, with both gates; returns them as read back."""
    from croupier.ml import training
    from croupier.plans.quality import enforce, quality_checks
    from croupier.plans.warehouse import Warehouse

    wh = Warehouse.from_raw(spark, raw_tables_from_import(frames))
    built = wh.write(target)
    tables = dict(built._tables)

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{target}/{name}")
        tables[name] = spark.read.schema(df.schema).parquet(f"{target}/{name}")
        return tables[name]

    for name in EXTRA:
        if name in frames:
            write(f"raw_{name}", frames[name].drop(ci.ROW))
    built.raw = wh.raw
    enforce(quality_checks(built))
    built.scoring_cutoff = scoring_cutoff
    trained = training_gate(frames, first_train_cutoff, scoring_cutoff)
    if trained:
        made = training.train(built, target, scoring_cutoff, run_id, params)
        tables |= {name: made[name] for name in training.TABLES}
    else:
        write("model_scores", fallback_scores(built.dim_player, now).withColumn("import_run_id", F.lit(run_id)))
    built._tables["model_scores"] = tables["model_scores"].drop("import_run_id")
    enforce(quality_checks(built, include_ml=True))
    write("mart_player_360", built.mart_player_360)
    meta = [("model_status", "available" if trained else "unavailable"), ("import_run_id", run_id)]
    write("app_metadata", spark.createDataFrame(meta, "key string, value string"))
    return tables


def activate(spark: SparkSession, frames: dict[str, DataFrame], issues: DataFrame, filenames: list[str], root: str,
             first_train_cutoff: str, scoring_cutoff: str, params: dict | None = None) -> tuple[str, str]:
    """Build, check, train and publish an import as a new version; returns (run id, folder).

    ``params`` are passed to the boosted trees (see ``models.GBT_PARAMS``).
    """
    summary = ci.quality_summary(frames, issues)
    if not summary["ready"]:
        raise ValueError("Import cannot be activated until every blocking quality error is resolved.")
    run_id, now = uuid.uuid4().hex[:12], dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    target = f"{root.rstrip('/')}/warehouse_{run_id}"
    status, error = "FAILED", None
    try:
        tables = _build(spark, frames, target, run_id, now, first_train_cutoff, scoring_cutoff, params)
        publish.write_manifest(spark, target, run_id, tables)
        publish.point_to(spark, root.rstrip("/"), run_id, target, now)
        status = "SUCCESS"
    except Exception as exc:
        error = str(exc)
        delete_folder(spark, target)
        raise
    finally:
        row = (run_id, now, status, json.dumps(filenames), summary["rows"], summary["score"], summary["errors"], summary["warnings"], error)
        spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(f"{root}/import_runs")
        issues.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{root}/import_issues")
    return run_id, target


def import_history(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """Latest runs first."""
    return (spark.read.parquet(f"{root}/import_runs").select("run_id", "created_at", "status", "rows_loaded", "quality_score",
                                                             "error_count", "warning_count").orderBy(F.desc("created_at")).limit(limit))


def active_warehouse(spark: SparkSession, root: str) -> str | None:
    found = publish.active(spark, root)
    return found[1] if found else None


def open_active(spark: SparkSession, root: str):
    """The active version as a warehouse: every table its manifest lists, of one version."""
    from croupier.plans.warehouse import Warehouse

    path = active_warehouse(spark, root)
    if path is None:
        return None
    tables = publish.open_tables(spark, path)
    return Warehouse(spark, tables={k: v.drop("import_run_id") for k, v in tables.items()})
