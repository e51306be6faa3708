"""Executive overview KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, dec, out
from croupier.operators.scalars import combine_rows
from croupier.plans.warehouse import Warehouse
from croupier.scope import Scope


def gaming_totals(wh: Warehouse, scope: Scope) -> DataFrame:
    m = wh.mart_executive_daily.filter(scope.date_and_market("metric_date"))
    zero = dec("0").cast(MONEY)
    return m.agg(
        out(F.coalesce(F.sum("total_ggr"), zero), "ggr"),
        out(F.coalesce(F.sum("estimated_ngr"), zero), "ngr"),
        out(F.coalesce(F.sum("total_wagers"), zero), "wagers"),
        out(F.coalesce(F.sum(F.col("casino_payouts") + F.col("sports_payout")), zero), "payouts"),
    )


def active_players(wh: Warehouse, scope: Scope) -> DataFrame:
    """Distinct players active on either product in scope (one row, ``players``)."""
    a = wh.int_player_activity_daily.filter(scope.date_in("activity_date")).select("player_id")
    if not scope.all_markets:
        a = a.join(wh.dim_player.filter(scope.market()).select("player_id"), "player_id")
    else:
        a = a.join(wh.dim_player.select("player_id"), "player_id")
    return a.agg(F.countDistinct("player_id").cast("bigint").alias("players"))


def approved_deposits(wh: Warehouse, scope: Scope) -> DataFrame:
    t = wh.v_transactions_enriched.filter(scope.date_and_market("transaction_day"))
    ok = (F.col("transaction_status") == "Approved") & (F.col("transaction_type") == "Deposit")
    zero = dec("0").cast(MONEY)
    return t.agg(out(F.coalesce(F.sum(F.when(ok, F.col("amount")).otherwise(zero)), zero), "deposits"))


def ftd_count(wh: Warehouse, scope: Scope, name: str = "ftd") -> DataFrame:
    """Players whose first-ever approved deposit falls in scope (I16/O3)."""
    f = wh.int_player_first_deposit.filter(scope.date_in("ftd_date"))
    p = wh.dim_player.filter(scope.market()).select("player_id")
    return f.join(p, "player_id").agg(F.count(F.lit(1)).cast("bigint").alias(name))


def performance_summary(wh: Warehouse, scope: Scope) -> DataFrame:
    """One row of GGR, NGR, wagers, payouts, active players, deposits and FTD."""
    return (
        combine_rows(gaming_totals(wh, scope), active_players(wh, scope), approved_deposits(wh, scope), ftd_count(wh, scope))
    )


def daily_ggr_trend(wh: Warehouse, scope: Scope, value_name: str = "ggr") -> DataFrame:
    """I2 (and I33 with ``value_name='GGR'``): observed total GGR per day."""
    return (
        wh.mart_executive_daily.filter(scope.date_and_market("metric_date"))
        .groupBy(F.col("metric_date").alias("date")).agg(out(F.sum("total_ggr"), value_name))
        .orderBy("date")
    )


def market_share(wh: Warehouse, scope: Scope) -> DataFrame:
    """The market's share of GGR over the mart's last 30 days (1.0 for all markets).

    The window start is a scalar subquery over the mart; the two sums come from one pass.
    """
    m = wh.mart_executive_daily
    since = m.agg(F.date_sub(F.max("metric_date"), 29).alias("since")).scalar()
    recent = m.filter(F.col("metric_date") >= since)
    agg = recent.agg(
        F.sum("total_ggr").cast("double").alias("total_recent"),
        F.sum(F.when(F.col("country") == F.lit(scope.country), F.col("total_ggr"))).cast("double").alias("market_recent"),
    )
    if scope.all_markets:
        return agg.select(F.lit(1.0).alias("market_share"))
    total = F.coalesce(F.col("total_recent"), F.lit(0.0))
    market = F.coalesce(F.col("market_recent"), F.lit(0.0))
    share = F.when(total != 0, F.greatest(market / total, F.lit(0.0))).otherwise(F.lit(0.0))
    return agg.select(share.alias("market_share"))


def active_scored(wh: Warehouse, scope: Scope) -> DataFrame:
    """Scored players in the market with casino or sportsbook activity in scope (EXISTS)."""
    v = wh.v_player_scores.filter(scope.market())
    act = wh.int_player_activity_daily.filter(scope.date_in("activity_date")).select("player_id")
    return v.join(act, "player_id", "left_semi")


def active_scored_casino(wh: Warehouse, scope: Scope) -> DataFrame:
    """I8: scored players in the market with a casino session (of a known game) in scope."""
    v = wh.v_player_scores.filter(scope.market())
    s = (wh.fact_casino_session.filter(scope.date_in("session_date")).select("player_id", "game_id")
         .join(wh.dim_game.select("game_id"), "game_id", "left_semi").select("player_id"))
    return v.join(s, "player_id", "left_semi")


def risk_bands(wh: Warehouse, scope: Scope) -> DataFrame:
    """Churn bands of active players with LTV proxy and mean confidence."""
    p = F.col("churn_probability")
    band = F.when(p < 0.40, "Stable").when(p < 0.70, "Watch").otherwise("High risk")
    return active_scored(wh, scope).groupBy(band.alias("segment")).agg(
        F.count(F.lit(1)).cast("bigint").alias("players"),
        out(F.sum("predicted_ltv_90d"), "ltv_proxy"),
        (F.sum("model_confidence").cast("double") / F.count("model_confidence")).alias("confidence"),
    )


def risk_summary(wh: Warehouse, scope: Scope) -> DataFrame:
    """Scored active players, churn rate, high churn, value at risk, LTV, payment risk."""
    p = F.col("churn_probability")
    zero = dec("0")
    return active_scored(wh, scope).agg(
        F.count(F.lit(1)).cast("bigint").alias("scored"),
        (F.sum(p).cast("double") / F.count(p)).alias("churn_rate"),
        F.sum((p >= 0.70).cast("int")).cast("bigint").alias("high_churn"),
        out(F.sum(F.when(p >= 0.70, F.col("predicted_ltv_90d")).otherwise(zero)), "value_at_risk"),
        out(F.sum("predicted_ltv_90d"), "future_ltv"),
        (F.sum("model_confidence").cast("double") / F.count("model_confidence")).alias("confidence"),
        F.sum((F.col("fraud_risk") >= 0.55).cast("int")).cast("bigint").alias("payment_risk"),
    )


def revenue_forecast(forecast: DataFrame) -> DataFrame:
    """I4: future GGR forecast with its band."""
    return forecast.select(
        F.col("forecast_date").alias("date"), F.col("predicted_revenue").alias("forecast"),
        F.col("lower_bound").alias("lower"), F.col("upper_bound").alias("upper"),
    ).orderBy("date")
