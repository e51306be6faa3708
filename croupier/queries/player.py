"""Player intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, dec, out, sum_if
from croupier.operators.interval_join import interval_semi_join
from croupier.operators.quantiles import exact_quantile_row
from croupier.plans.warehouse import Warehouse
from croupier.scope import Scope

ACTIVATION_MATURITY_DAYS = 37
RETURN_WINDOW = (30, 37)
HIGH_CHURN, HIGH_RG = 0.70, 0.55


def favorite_games(wh: Warehouse, top: int = 5, player_id: str | None = None) -> DataFrame:
    """I9, re-aimed: each player's top games by lifetime sessions (ties by name)."""
    s = wh.v_sessions_enriched
    if player_id is not None:
        s = s.filter(F.col("player_id") == player_id)
    g = s.groupBy("player_id", "game_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("sessions"), F.sum("total_bet_amount").alias("b"), F.sum("casino_ggr").alias("g"))
    w = Window.partitionBy("player_id").orderBy(F.desc("sessions"), "game_name")
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .select("player_id", F.col("rank").cast("bigint").alias("rank"), "game_name", "sessions", out("b", "bets"), out("g", "ggr")))


def _period_counts(wh: Warehouse, scope: Scope) -> DataFrame:
    """Per player: casino sessions and sports bets in the scope and in the previous period,
    from one filtered pass over each fact."""
    prev, wh = scope.previous(), wh.by_player
    both = (F.col("d") >= prev.lo_date) & (F.col("d") < scope.hi_date)
    cur = (F.col("d") >= scope.lo_date)
    s = (wh.v_sessions_enriched.select("player_id", F.col("session_date").alias("d")).filter(both)
         .groupBy("player_id").agg(F.count(F.when(cur, 1)).alias("cs"), F.count(F.when(~cur, 1)).alias("ps")))
    b = (wh.v_sports_bets_enriched.select("player_id", F.col("bet_day").alias("d")).filter(both)
         .groupBy("player_id").agg(F.count(F.when(cur, 1)).alias("cb"), F.count(F.when(~cur, 1)).alias("pb")))
    return s.join(b, "player_id", "full_outer").na.fill(0, ["cs", "ps", "cb", "pb"])


def _lifetime(wh: Warehouse) -> DataFrame:
    """Lifetime GGR and last activity per player over both products."""
    wh = wh.by_player
    return (wh.sessions.select("player_id", F.col("casino_ggr").alias("g"), F.col("session_start").alias("t"))
            .unionByName(wh.sports_bets.select("player_id", F.col("sportsbook_ggr").alias("g"), F.col("bet_date").alias("t")))
            .groupBy("player_id").agg(F.sum("g").alias("lifetime_ggr"), F.max("t").alias("last_activity")))


def kpi_summary(wh: Warehouse, scope: Scope) -> DataFrame:
    """Six portfolio KPIs for the current and previous period in one pass."""
    v = wh.v_player_scores.filter(scope.market()).select("player_id", "churn_probability", "remaining_ltv_90d", "rg_risk")
    base = (v.join(_period_counts(wh, scope), "player_id", "left").join(_lifetime(wh).drop("last_activity"), "player_id", "left")
            .na.fill(0, ["cs", "ps", "cb", "pb"]))
    act = (F.col("cs") + F.col("cb")) > 0
    prev_act = (F.col("ps") + F.col("pb")) > 0
    zero = dec("0")
    return base.agg(
        sum_if(act).alias("active_players"), sum_if(prev_act).alias("previous_active_players"),
        out(F.sum(F.coalesce(F.col("lifetime_ggr"), zero.cast(MONEY))), "lifetime_ggr"),
        out(F.sum(F.when(act, F.col("remaining_ltv_90d")).otherwise(zero)), "remaining_ltv_90d"),
        F.sum(F.when(act & (F.col("churn_probability") >= HIGH_CHURN), 1).otherwise(0)).cast("bigint").alias("high_churn_risk"),
        F.sum(F.when((F.col("cs") > 0) & (F.col("rg_risk") >= HIGH_RG), 1).otherwise(0)).cast("bigint").alias("rg_interventions"),
    )


SCORE_COLUMNS = [
    "predicted_ltv_90d", "churn_probability", "churn_probability_7d", "churn_probability_14d", "churn_probability_30d",
    "observed_value", "remaining_ltv_30d", "remaining_ltv_90d", "remaining_ltv_180d", "predicted_total_ltv_30d",
    "predicted_total_ltv_90d", "predicted_total_ltv_180d", "fraud_risk", "rg_risk", "model_confidence",
]


def _period_gaming(wh: Warehouse, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Per player: casino and sportsbook behaviour in the scope."""
    facts = wh.by_player
    c = (facts.v_sessions_enriched.filter(scope.date_in("session_date")).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("duration_minutes").alias("minutes"),
        F.sum("total_bet_amount").alias("casino_bets"), F.sum("casino_ggr").alias("casino_ggr")))
    s = (facts.v_sports_bets_enriched.filter(scope.date_in("bet_day")).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("sports_bets"), F.sum("stake").alias("sports_handle"), F.sum("sportsbook_ggr").alias("sports_ggr")))
    return c, s


def period_behaviour(wh: Warehouse, scope: Scope) -> DataFrame:
    """The play columns of ``player_base`` alone: sessions, bets and GGR of each scored player in the market."""
    zero = dec("0").cast(MONEY)
    c, s = _period_gaming(wh, scope)
    j = wh.v_player_scores.filter(scope.market()).select("player_id").join(c, "player_id", "left").join(s, "player_id", "left")
    return j.select("player_id", *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x) for x in ("sessions", "sports_bets")],
                    *[out(F.coalesce(F.col(x), zero), x) for x in ("casino_ggr", "sports_ggr")])


def player_base(wh: Warehouse, scope: Scope) -> DataFrame:
    """One row per scored player in the market with period behaviour and all scores."""
    zero = dec("0").cast(MONEY)
    c, s = _period_gaming(wh, scope)
    ok = F.col("transaction_status") == "Approved"
    dep, wd = ok & (F.col("transaction_type") == "Deposit"), ok & (F.col("transaction_type") == "Withdrawal")
    t = (wh.by_player.v_transactions_enriched.filter(scope.date_in("transaction_day")).groupBy("player_id").agg(
        sum_if(dep).alias("deposit_count"), F.sum(F.when(dep, F.col("amount")).otherwise(zero)).alias("deposits"),
        F.sum(F.when(wd, F.col("amount")).otherwise(zero)).alias("withdrawals")))
    fav = favorite_games(wh.by_player, top=1).select("player_id", F.col("game_name").alias("fav"))
    v = wh.v_player_scores.filter(scope.market()).drop("lifetime_ggr")
    j = (v.join(c, "player_id", "left").join(s, "player_id", "left").join(t, "player_id", "left")
         .join(_lifetime(wh), "player_id", "left").join(fav, "player_id", "left"))
    n0 = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x)
    m0 = lambda x: out(F.coalesce(F.col(x), zero), x)
    return j.select(
        "player_id", "country", "channel", "device", "vip_level", "kyc_status", "registration_date",
        *[out(x, x) for x in SCORE_COLUMNS], "recommended_action",
        out(F.coalesce(F.col("lifetime_ggr"), zero), "lifetime_ggr"), "last_activity", F.col("ftd_at").alias("ftd_date"),
        n0("sessions"), F.coalesce(F.col("minutes"), F.lit(0.0)).alias("minutes"), m0("casino_bets"), m0("casino_ggr"),
        n0("sports_bets"), m0("sports_handle"), m0("sports_ggr"), n0("deposit_count"), m0("deposits"), m0("withdrawals"),
        F.coalesce(F.col("fav"), F.lit("No casino activity")).alias("favorite_game"),
    )


def player_timeline(wh: Warehouse, player_id: str | None = None) -> DataFrame:
    """I12, re-aimed: per player and day, approved deposits/withdrawals, GGR by product, events."""
    zero = dec("0").cast(MONEY)
    ok = F.col("transaction_status") == "Approved"
    s, b, t = wh.sessions, wh.sports_bets, wh.transactions
    if player_id is not None:
        s, b, t = (x.filter(F.col("player_id") == player_id) for x in (s, b, t))
    rows = (
        s.select("player_id", F.col("session_date").alias("event_date"), zero.alias("dep"), zero.alias("wd"),
                 F.col("casino_ggr").alias("cg"), zero.alias("sg"))
        .unionByName(b.select("player_id", F.col("bet_day").alias("event_date"), zero.alias("dep"), zero.alias("wd"),
                              zero.alias("cg"), F.col("sportsbook_ggr").alias("sg")))
        .unionByName(t.select("player_id", F.col("transaction_day").alias("event_date"),
                              F.when(ok & (F.col("transaction_type") == "Deposit"), F.col("amount")).otherwise(zero).alias("dep"),
                              F.when(ok & (F.col("transaction_type") == "Withdrawal"), F.col("amount")).otherwise(zero).alias("wd"),
                              zero.alias("cg"), zero.alias("sg")))
    )
    return rows.groupBy("player_id", "event_date").agg(
        out(F.sum("dep"), "deposits"), out(F.sum("wd"), "withdrawals"), out(F.sum("cg"), "casino_ggr"),
        out(F.sum("sg"), "sports_ggr"), F.count(F.lit(1)).cast("bigint").alias("events"))


def retention_d30(wh: Warehouse, scope: Scope) -> DataFrame:
    """Players activated in scope (mature: activation <= bound - 37 days) who came back
    on days 30-36 after activation. Activity is de-duplicated per (player, day) before the
    interval join, so a heavy player contributes at most one row per day."""
    activity = wh.int_player_activity_daily.select("player_id", "activity_date")
    first = wh.int_player_first_activity.select("player_id", F.col("first_activity_date").alias("activation_date"))
    latest = F.date_sub(scope.hi_date, ACTIVATION_MATURITY_DAYS)
    eligible = (first.filter(scope.date_in("activation_date") & (F.col("activation_date") <= latest))
                .join(wh.dim_player.filter(scope.market()).select("player_id"), "player_id"))
    retained = interval_semi_join(
        eligible, activity, "player_id",
        F.date_add("activation_date", RETURN_WINDOW[0]), F.date_add("activation_date", RETURN_WINDOW[1]), "activity_date")
    r = retained.select("player_id", F.lit(1).alias("kept"))
    e = eligible.join(r, "player_id", "left")
    return e.agg(F.count(F.lit(1)).cast("bigint").alias("eligible_players"),
                 F.count("kept").cast("bigint").alias("retained_players"),
                 F.try_divide(F.count("kept").cast("double"), F.count(F.lit(1)).cast("double")).alias("retention_d30"))


def vip_threshold(base: DataFrame, p: float = 0.90) -> float | None:
    """p90 of predicted 180-day total LTV among active non-Platinum players."""
    pool = base.filter(((F.col("sessions") + F.col("sports_bets")) > 0) & (F.col("vip_level") != "Platinum"))
    return exact_quantile_row(pool, {"t": ("predicted_total_ltv_180d", p)})["t"]


def vip_candidates(wh: Warehouse, scope: Scope, threshold: float | None = None) -> DataFrame:
    """Active non-Platinum players at or above the LTV threshold (J7 when not given)."""
    base = player_base(wh, scope)
    if threshold is None:
        threshold = vip_threshold(base)
    pool = base.filter(((F.col("sessions") + F.col("sports_bets")) > 0) & (F.col("vip_level") != "Platinum")
                       & (F.col("predicted_total_ltv_180d") >= F.lit(threshold)))
    return pool.agg(F.count(F.lit(1)).cast("bigint").alias("vip_candidates"))
