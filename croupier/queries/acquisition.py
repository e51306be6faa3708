"""Acquisition KPIs (I15-I20): mature registration cohorts, FTD and channel quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import avg_if, ratio, sum_if
from croupier.plans.warehouse import Warehouse
from croupier.queries.overview import ftd_count
from croupier.scope import Scope

# ---- fixed values ------------------------------------------------------------------
CHANNEL_COST = {"Google": 34, "Meta": 38, "Organic": 8, "Affiliate Alpha": 47, "Affiliate Nova": 61, "Influencers": 73}
DEFAULT_CHANNEL_COST = 40
COHORT_MATURITY_DAYS = 30
CONVERSION_WINDOW_DAYS = 30
VISITS_PER_REGISTRATION = 13
SECOND_DEPOSIT_SHARE = 0.61
HIGH_FRAUD = 0.55
ROAS_TYPE = "decimal(24,12)"   # per-player ROAS rounded to 12 places so its sums are exact
# ------------------------------------------------------------------------------------


def channel_cost(col: str = "channel") -> F.Column:
    c = F.col(col)
    expr = F.lit(DEFAULT_CHANNEL_COST)
    for name, cost in reversed(list(CHANNEL_COST.items())):
        expr = F.when(c == name, F.lit(cost)).otherwise(expr)
    return expr


def _mature(wh: Warehouse, scope: Scope) -> DataFrame:
    """Players registered in scope at least 30 days before the exclusive end bound."""
    latest = F.lit(f"{scope.bound_day.isoformat()} 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(COHORT_MATURITY_DAYS))
    return wh.players.filter(scope.ts_in("registration_date") & (F.col("registration_date") <= latest) & scope.market())


def _converted(reg: str = "registration_date", ftd: str = "ftd_at") -> F.Column:
    return (F.col(ftd) >= F.col(reg)) & (F.col(ftd) < F.col(reg) + F.make_dt_interval(F.lit(CONVERSION_WINDOW_DAYS)))


def cohort_base(wh: Warehouse, scope: Scope) -> DataFrame:
    """Mature cohort with scores (inner), FTD, D30 conversion flag and channel cost."""
    scores = wh.v_player_scores.select("player_id", "predicted_ltv_90d", "churn_probability", "fraud_risk")
    ftd = wh.int_player_first_deposit.select("player_id", "ftd_at")
    b = _mature(wh, scope).join(scores, "player_id").join(ftd, "player_id", "left")
    cost = channel_cost()
    return b.select(
        "*", F.when(F.coalesce(_converted(), F.lit(False)), 1).otherwise(0).alias("converted_d30"), cost.alias("acquisition_cost"),
        (F.col("predicted_ltv_90d").cast("double") / cost).cast(ROAS_TYPE).alias("roas_proxy"),
    )


def ftd(wh: Warehouse, scope: Scope) -> DataFrame:
    """I16: first-ever approved deposits inside the scope."""
    return ftd_count(wh, scope, name="ftd_count")


def ftd_conversion_d30(wh: Warehouse, scope: Scope) -> DataFrame:
    """Share of mature registrations (all players, scored or not) converting within 30 days."""
    e = _mature(wh, scope).join(wh.int_player_first_deposit.select("player_id", "ftd_at"), "player_id", "left")
    conv = sum_if(_converted())
    return e.agg(F.count(F.lit(1)).cast("bigint").alias("eligible_registrations"),
                 F.coalesce(conv, F.lit(0)).cast("bigint").alias("converted_d30"),
                 ratio(conv, F.count(F.lit(1))).alias("ftd_conversion_d30"))


def funnel(wh: Warehouse, scope: Scope) -> DataFrame:
    b = cohort_base(wh, scope)
    n, conv = F.count(F.lit(1)), F.sum("converted_d30")
    return b.agg(
        (n * VISITS_PER_REGISTRATION).cast("bigint").alias("Visits"), n.cast("bigint").alias("Registrations"),
        sum_if(F.col("kyc_status") == "Verified").alias("KYC"), conv.cast("bigint").alias("FTD"),
        (conv * SECOND_DEPOSIT_SHARE).cast("int").cast("bigint").alias("SecondDeposit"),
    )


def metrics(wh: Warehouse, scope: Scope) -> DataFrame:
    b = cohort_base(wh, scope)
    n = F.count(F.lit(1))
    return b.agg(
        ratio(F.sum("acquisition_cost"), n).alias("cac"),
        ratio(F.sum("roas_proxy"), F.count("roas_proxy")).alias("roas"),
        avg_if(F.col("fraud_risk") >= HIGH_FRAUD).alias("fraud"),
    )


def source_performance(wh: Warehouse, scope: Scope) -> DataFrame:
    b = cohort_base(wh, scope)
    n = F.count(F.lit(1))
    g = b.groupBy("channel").agg(
        n.cast("bigint").alias("Players"), F.sum("converted_d30").cast("bigint").alias("FTD_D30"),
        F.sum("acquisition_cost").alias("cost"), F.sum("predicted_ltv_90d").alias("ltv"), F.sum("roas_proxy").alias("roas"),
        F.sum("fraud_risk").alias("fraud"), F.sum("churn_probability").alias("churn"),
    )
    mean = lambda c: ratio(c, "Players")
    return g.select(
        "channel", "Players", "FTD_D30", ratio("FTD_D30", "Players").alias("FTD_Conversion_D30"),
        mean("cost").alias("CAC"), mean("ltv").alias("Predicted_LTV_Proxy"), mean("roas").alias("Predicted_ROAS_Proxy"),
        mean("fraud").alias("Fraud_Risk"), (1 - mean("churn")).alias("Predicted_Retention_Proxy"),
        (100 * mean("roas") * (1 - mean("churn")) * (1 - mean("fraud")) / 10).alias("Quality_Score"),
    ).orderBy(F.desc("Quality_Score"), "channel")
