"""Risk & compliance KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import max2, out
from croupier.plans.warehouse import Warehouse
from croupier.queries.overview import active_scored
from croupier.scope import Scope

REVIEW_FLOOR, HIGH, CRITICAL = 0.40, 0.55, 0.75
STATUSES = ["Open", "In review", "Pending info"]


def case_queue(wh: Warehouse, scope: Scope, limit: int = 120) -> DataFrame:
    """Top cases by max(fraud, RG) risk; status from the last id digit modulo 3."""
    f, r = F.col("fraud_risk"), F.col("rg_risk")
    risk = max2(f, r)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]),
                          (F.substring("player_id", -1, 1).cast("int") % 3 + 1).cast("int"))
    v = active_scored(wh, scope).filter((f >= REVIEW_FLOOR) | (r >= REVIEW_FLOOR))
    return v.select(
        "player_id",
        F.when(r >= f, "Player protection").otherwise("Fraud / AML").alias("trigger"),
        F.when(risk >= CRITICAL, "Critical").when(risk >= HIGH, "High").otherwise("Medium").alias("severity"),
        out("model_confidence", "model_confidence"), "recommended_action", status.alias("status"),
        out("fraud_risk", "fraud_risk"), out("rg_risk", "rg_risk"), out("predicted_ltv_90d", "predicted_ltv_90d"),
        out(risk, "risk_score"),
    ).orderBy(F.desc("risk_score"), "player_id").limit(limit)


def metrics(wh: Warehouse, scope: Scope) -> DataFrame:
    f, r = F.col("fraud_risk"), F.col("rg_risk")
    return active_scored(wh, scope).agg(
        F.count(F.lit(1)).cast("bigint").alias("accounts"),
        F.sum(((f >= HIGH) | (r >= HIGH)).cast("int")).cast("bigint").alias("cases"),
        out(F.sum(F.when(f >= HIGH, max2(F.col("lifetime_ggr"), F.lit(0))).otherwise(F.lit(0))), "exposure"),
        F.sum((r >= HIGH).cast("int")).cast("bigint").alias("rg"),
        F.sum((f >= HIGH).cast("int")).cast("bigint").alias("fraud"),
    )


def protection_actions(wh: Warehouse, scope: Scope) -> DataFrame:
    """Four overlapping action counts from one pass, unpivoted with ``stack``."""
    f, r = F.col("fraud_risk"), F.col("rg_risk")
    wide = active_scored(wh, scope).agg(
        F.count(F.when((f >= HIGH) | (r >= HIGH), 1)).alias("a"), F.count(F.when(r >= HIGH, 1)).alias("b"),
        F.count(F.when(r >= REVIEW_FLOOR, 1)).alias("c"), F.count(F.when(f >= HIGH, 1)).alias("d"))
    return wide.selectExpr(
        "stack(4, 'Manual review', a, 'Cooling-off reminder', b, 'Marketing suppression', c, 'Source-of-funds request', d)"
        " as (action, Cases)").select("action", F.col("Cases").cast("bigint"))


def risk_trend(wh: Warehouse, scope: Scope) -> DataFrame:
    """Mean fraud, RG and churn score x100 by the players' last activity day (one aggregate + stack)."""
    v = wh.v_player_scores.filter(scope.ts_in("last_session") & scope.market())
    day = v.groupBy(F.to_date("last_session").alias("date")).agg(
        F.sum("fraud_risk").alias("f"), F.sum("rg_risk").alias("r"), F.sum("churn_probability").alias("c"),
        F.count(F.lit(1)).alias("n"))
    mean100 = lambda c: (F.col(c).cast("double") / F.col("n") * 100)
    return day.select("date", mean100("f").alias("f"), mean100("r").alias("r"), mean100("c").alias("c")).selectExpr(
        "date", "stack(3, 'Fraud', f, 'Responsible gaming', r, 'Churn', c) as (Risk, Score)").orderBy("date", "Risk")
