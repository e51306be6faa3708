"""Sportsbook KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, dec, out, ratio
from croupier.operators.scalars import attach_scalars
from croupier.plans.warehouse import Warehouse
from croupier.scope import Scope


def _bets(wh: Warehouse, scope: Scope) -> DataFrame:
    return wh.v_sports_bets_enriched.filter(scope.date_and_market("bet_day"))


def bet_composition(wh: Warehouse, scope: Scope) -> DataFrame:
    return _bets(wh, scope).groupBy("is_live").agg(out(F.sum("stake"), "stake")).select(
        F.when(F.col("is_live") == 1, "Live").otherwise("Pre-match").alias("Type"), "stake")


def daily_handle_by_sport(wh: Warehouse, scope: Scope) -> DataFrame:
    return (_bets(wh, scope).groupBy(F.col("bet_day").alias("date"), "sport")
            .agg(out(F.sum("stake"), "Exposure"), out(F.sum("sportsbook_ggr"), "GGR")).orderBy("date", "sport"))


def daily_mean_threshold(wh: Warehouse, scope: Scope) -> DataFrame:
    """Mean of the daily handle (0 when there are no bets)."""
    d = _bets(wh, scope).groupBy("bet_day").agg(F.sum("stake").alias("x"))
    return d.agg((F.sum("x").cast("double") / F.count("x")).alias("avg_daily_handle")).select(
        F.coalesce("avg_daily_handle", F.lit(0.0)).alias("avg_daily_handle"))


def event_liability(wh: Warehouse, scope: Scope) -> DataFrame:
    """Per-event exposure with a flag against the mean exposure of all events.

    The mean over all events is a scalar subquery on the per-event aggregate.
    """
    e = _bets(wh, scope).groupBy("event_name", "sport").agg(
        F.sum("stake").alias("exp"), F.sum("sportsbook_ggr").alias("ggr"), F.count(F.lit(1)).alias("Bets"))
    mean = e.agg((F.sum("exp").cast("double") / F.count("exp")).alias("avg_exp"))
    x = F.col("exp").cast("double")
    status = F.when(x > F.col("avg_exp") * 1.5, "HIGH").when(x > F.col("avg_exp"), "MEDIUM").otherwise("LOW")
    return (attach_scalars(e, mean)
            .select("event_name", "sport", out("exp", "Exposure"), out("ggr", "GGR"), F.col("Bets").cast("bigint"), status.alias("Status"))
            .orderBy(F.desc("Exposure"), "event_name", "sport"))


def metrics(wh: Warehouse, scope: Scope) -> DataFrame:
    zero = dec("0").cast(MONEY)
    g = F.col("sportsbook_ggr")
    return _bets(wh, scope).agg(
        out(F.coalesce(F.sum("stake"), zero), "handle"), out(F.coalesce(F.sum("payout"), zero), "payout"),
        out(F.coalesce(F.sum(g), zero), "ggr"), F.coalesce(F.sum("is_live"), F.lit(0)).cast("bigint").alias("live"),
        out(F.coalesce(F.sum(F.when(g < 0, -g).otherwise(zero)), zero), "exposure"),
    )


def sport_performance(wh: Warehouse, scope: Scope) -> DataFrame:
    return _bets(wh, scope).groupBy("sport").agg(
        out(F.sum("sportsbook_ggr"), "GGR"), out(F.sum("stake"), "Handle"), F.count(F.lit(1)).cast("bigint").alias("Bets"),
        ratio(F.sum("sportsbook_ggr"), F.sum("stake")).alias("Hold"),
    ).orderBy("GGR", "sport")


def top_event(wh: Warehouse, scope: Scope) -> DataFrame:
    """Event with the largest handle (ties broken by name)."""
    return (_bets(wh, scope).groupBy("event_name").agg(out(F.sum("stake"), "exposure"))
            .orderBy(F.desc("exposure"), "event_name").limit(1))
