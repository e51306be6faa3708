"""CRM automation KPIs (I38-I40); the active predicate is casino sessions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import dec, out
from croupier.plans.warehouse import Warehouse
from croupier.queries.overview import active_scored_casino
from croupier.scope import Scope

SAFE = 0.55
CAMPAIGN_ACTIONS = ("Send retention campaign", "Offer governed bonus", "Recommend preferred game")
CAMPAIGN_VALUE_SHARE = "0.08"


def _safe() -> F.Column:
    return (F.col("fraud_risk") < SAFE) & (F.col("rg_risk") < SAFE)


def metrics(wh: Warehouse, scope: Scope) -> DataFrame:
    v = active_scored_casino(wh, scope)
    safe = _safe()
    value = F.when(safe & F.col("recommended_action").isin(*CAMPAIGN_ACTIONS), F.col("predicted_ltv_90d") * dec(CAMPAIGN_VALUE_SHARE))
    return v.agg(
        F.coalesce(F.sum(safe.cast("int")), F.lit(0)).cast("bigint").alias("targetable"),
        F.coalesce(F.sum((~safe).cast("int")), F.lit(0)).cast("bigint").alias("suppressed"),
        out(F.coalesce(F.sum(F.coalesce(value, dec("0"))), dec("0")), "revenue"),
    )


def next_best_action_queue(wh: Warehouse, scope: Scope, limit: int = 10) -> DataFrame:
    v = active_scored_casino(wh, scope).filter(_safe() & (F.col("recommended_action") != "Do nothing"))
    return (v.select("player_id", "recommended_action", out("predicted_ltv_90d", "predicted_ltv_90d"),
                     out("model_confidence", "model_confidence"))
            .orderBy(F.desc("predicted_ltv_90d"), F.desc("model_confidence"), "player_id").limit(limit))


def segments(wh: Warehouse, scope: Scope) -> DataFrame:
    """Five overlapping segments in one pass over the scored players, unpivoted with ``stack``.

    'Dormant 30D' ignores the active predicate (all scored players in the market).
    """
    v = wh.v_player_scores.filter(scope.market())
    act = (wh.fact_casino_session.filter(scope.date_in("session_date")).select("player_id", "game_id")
           .join(wh.dim_game.select("game_id"), "game_id", "left_semi").select("player_id").distinct()
           .withColumn("__active", F.lit(True)))
    v = v.join(act, "player_id", "left")
    a = F.coalesce(F.col("__active"), F.lit(False))
    p, ltv = F.col("churn_probability"), F.col("predicted_ltv_90d")
    dormant_before = F.lit(f"{(scope.bound_day).isoformat()}").cast("date") - F.expr("INTERVAL 30 DAYS")
    wide = v.agg(
        F.count(F.when(a & (p > 0.65) & (ltv > 500), 1)).alias("s1"),
        F.count(F.when(a & scope.ts_in("registration_at"), 1)).alias("s2"),
        F.count(F.when(a & (ltv > 1200) & (F.col("vip_level") != "Platinum"), 1)).alias("s3"),
        F.count(F.when(F.col("last_session") < dormant_before.cast("timestamp_ntz"), 1)).alias("s4"),
        F.count(F.when(a & F.col("fraud_risk").between(0.25, 0.55), 1)).alias("s5"),
    )
    return wide.selectExpr(
        "stack(5, 'High-value churn risk', s1, 'New players', s2, 'Emerging VIP', s3, 'Dormant 30D', s4, 'Bonus sensitive', s5)"
        " as (Segment, Players)").select("Segment", F.col("Players").cast("bigint"))
