"""Derived metrics the dashboard pages compute on top of the queries (J1-J23), as DataFrame
columns and small aggregates instead of pandas post-processing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from croupier.operators.quantiles import exact_quantile_row
from croupier.operators.scalars import attach_scalars
from croupier.plans.warehouse import Warehouse
from croupier.queries import overview, player
from croupier.scope import Scope

# ---- fixed values ------------------------------------------------------------------
SEGMENTS = ["VIP active", "VIP at risk", "New FTD", "Growing players", "Became inactive",
            "Potential bonus abuse", "RG risk", "High future value"]
EXPORT_COLUMNS = ["player_id", "country", "vip_level", "rfm_segment", "segment_tags", "lifetime_ggr", "predicted_ltv_90d",
                  "churn_probability", "recommended_action", "model_confidence"]
PORTFOLIO_COLUMNS = ["player_id", "country", "vip_level", "rfm_segment", "segment_tags", "lifetime_ggr", "predicted_ltv_90d",
                     "churn_probability", "fraud_risk", "rg_risk", "recommended_action"]
MISSING_RECENCY = 999
OBJECTIVE_UPLIFT, PLAYER_OBJECTIVE_UPLIFT, HOLD_OBJECTIVE = 1.05, 1.03, 0.07
SCATTER_SEED, PORTFOLIO_ROWS = 7, 250
EXACT = "decimal(24,6)"  # doubles of 6-place scores/money round-trip exactly, so their sums are exact
# ------------------------------------------------------------------------------------


def _flag(name: str) -> str:
    return "is_" + name.lower().replace(" ", "_")


def prepare_players(wh: Warehouse, scope: Scope) -> DataFrame:
    """Player base joined to its previous period, RFM label, eight segment flags, tags and
    CRM eligibility. Cut-offs are exact quantiles over the market's players."""
    cur = player.player_base(wh, scope)
    prev = player.period_behaviour(wh, scope.previous()).select(
        "player_id", *[F.col(c).alias(f"previous_{c}") for c in ("sessions", "sports_bets", "casino_ggr", "sports_ggr")])
    p = cur.join(prev, "player_id", "left").na.fill(0, ["previous_sessions", "previous_sports_bets"]).na.fill(
        0.0, ["previous_casino_ggr", "previous_sports_ggr"])
    rec = F.greatest(F.coalesce(F.datediff(F.lit(scope.end).cast("date"), F.to_date("last_activity")), F.lit(MISSING_RECENCY)), F.lit(0))
    p = p.select(
        "*", (F.col("casino_ggr") + F.col("sports_ggr")).alias("period_ggr"),
        (F.col("previous_casino_ggr") + F.col("previous_sports_ggr")).alias("previous_ggr"),
        (F.col("sessions") + F.col("sports_bets")).alias("activity"),
        (F.col("previous_sessions") + F.col("previous_sports_bets")).alias("previous_activity"), rec.alias("recency_days"))
    from croupier.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(wh.spark)
    p = p.checkpoint(eager=True)  # feeds four quantile passes and the output
    q = exact_quantile_row(
        p.select(F.when(F.col("period_ggr") > 0, F.col("period_ggr")).alias("pos_ggr"),
                 F.when(F.col("activity") > 0, F.col("activity")).alias("pos_act"), "deposit_count", "predicted_total_ltv_180d"),
        {"monetary": ("pos_ggr", 0.70), "frequency": ("pos_act", 0.70), "deposits": ("deposit_count", 0.85),
         "future": ("predicted_total_ltv_180d", 0.90)})
    mon = max(q["monetary"] or 0.0, 1.0)
    freq = max(q["frequency"] or 0.0, 1.0)
    dep = max(q["deposits"] or 0.0, 2.0)
    fut = q["future"]
    r, a = F.col("recency_days"), F.col("activity")
    rfm = (F.when(r > 60, "Dormant").when((r <= 7) & (a >= freq) & (F.col("period_ggr") >= mon), "Champion")
           .when((r <= 14) & (a >= freq), "Loyal").when((r <= 30) & (a > 0), "Active").otherwise("At risk"))
    gold = F.col("vip_level").isin("Gold", "Platinum")
    flags = {
        "VIP active": gold & (a > 0),
        "VIP at risk": gold & (F.col("churn_probability") >= 0.70),
        "New FTD": scope.ts_in("ftd_date"),
        "Growing players": (F.col("period_ggr") > F.col("previous_ggr") * 1.25) & (F.col("previous_ggr") > 0),
        "Became inactive": (a == 0) & (F.col("previous_activity") > 0),
        "Potential bonus abuse": (F.col("deposit_count") >= dep) & (F.col("fraud_risk") >= 0.35) & (F.col("fraud_risk") < 0.55),
        "RG risk": F.col("rg_risk") >= 0.55,
        "High future value": (F.col("predicted_total_ltv_180d") >= F.lit(fut)) if fut is not None else F.lit(False),
    }
    cols = [F.coalesce(c, F.lit(False)).alias(_flag(n)) for n, c in flags.items()]
    tags = F.array_compact(F.array(*[F.when(F.col(_flag(n)), F.lit(n)) for n in SEGMENTS]))
    out = p.select("*", rfm.alias("rfm_segment"), *cols)
    return out.select(
        "*", F.when(F.size(tags) > 0, F.concat_ws(", ", tags)).otherwise(F.lit("Standard")).alias("segment_tags"),
        ((F.col("fraud_risk") < 0.55) & (F.col("rg_risk") < 0.55) & (F.col("kyc_status") == "Verified")).alias("crm_eligible"))


def segment_sizes(players: DataFrame) -> DataFrame:
    """Players and predicted 180-day value at stake per (overlapping) segment."""
    aggs = []
    for n in SEGMENTS:
        aggs += [F.count(F.when(F.col(_flag(n)), 1)).alias(f"n_{_flag(n)}"),
                 F.sum(F.when(F.col(_flag(n)), F.col("predicted_total_ltv_180d").cast(EXACT)).otherwise(F.lit(0).cast(EXACT))).alias(f"v_{_flag(n)}")]
    wide = players.agg(*aggs)
    stack = "stack({}, {}) as (segment, players, value_at_stake)".format(
        len(SEGMENTS), ", ".join(f"'{n}', n_{_flag(n)}, v_{_flag(n)}" for n in SEGMENTS))
    return wide.selectExpr(stack).select("segment", F.col("players").cast("bigint"), F.col("value_at_stake").cast("double"))


def in_segment(players: DataFrame, segment: str | None) -> DataFrame:
    return players if not segment or segment == "All players" else players.filter(F.col(_flag(segment)))


def crm_export(players: DataFrame, segment: str | None = None, crm_safe: bool = True) -> DataFrame:
    """The CRM-safe activation list (ten columns)."""
    f = in_segment(players, segment)
    return (f.filter(F.col("crm_eligible")) if crm_safe else f).select(*EXPORT_COLUMNS)


def write_crm_export(players: DataFrame, path: str, segment: str | None = None) -> None:
    crm_export(players, segment).write.mode("overwrite").option("header", True).csv(path)


def portfolio(players: DataFrame, segment: str | None = None) -> DataFrame:
    """Top 250 by RG risk, churn, LTV (ties by player id)."""
    return (in_segment(players, segment).select(*PORTFOLIO_COLUMNS)
            .orderBy(F.desc("rg_risk"), F.desc("churn_probability"), F.desc("predicted_ltv_90d"), "player_id").limit(PORTFOLIO_ROWS))


def scatter_sample(players: DataFrame, segment: str | None = None, points: int | None = None) -> DataFrame:
    """The players of a chart, bubble = max(GGR, 0) + 1. ``points`` draws so many of them in a
    deterministic hash order (SHA-256 of seed and id); without it all are returned."""
    f = in_segment(players, segment)
    key = F.sha2(F.concat(F.lit(f"{SCATTER_SEED}:"), F.col("player_id")), 256)
    drawn = f if points is None else f.orderBy(key, "player_id").limit(points)
    return drawn.select("player_id", "vip_level", "churn_probability", "predicted_total_ltv_180d",
                        (F.greatest(F.col("lifetime_ggr"), F.lit(0.0)) + 1).alias("bubble_size"))


def peer_comparison(players: DataFrame, segment: str | None = None) -> DataFrame:
    """J11 (re-aimed for every player): player value / segment average on four measures."""
    f = in_segment(players, segment)
    measures = ["lifetime_ggr", "predicted_total_ltv_180d", "churn_probability", "rg_risk"]
    means = f.agg(*[(F.sum(F.col(m).cast(EXACT)).cast("double") / F.count(m)).alias(f"avg_{m}") for m in measures])
    g = attach_scalars(f.select("player_id", *measures), means)
    cols = [F.try_divide(F.col(m), F.col(f"avg_{m}")).alias(f"{m}_vs_segment") for m in measures]
    return g.select("player_id", *measures, *cols)


def behaviour(players: DataFrame, scope: Scope) -> DataFrame:
    """Sessions per 30 days, mean session minutes, net cash flow and RG indicators."""
    days = max(scope.days, 1)
    freq = F.col("sessions") / days * 30
    mean_min = F.col("minutes") / F.greatest(F.col("sessions"), F.lit(1))
    return players.select(
        "player_id", freq.alias("sessions_per_30d"), mean_min.alias("avg_session_minutes"),
        (F.col("deposits") - F.col("withdrawals")).alias("net_cash_flow"),
        (F.col("rg_risk") >= 0.55).alias("rg_review"), (freq >= 20).alias("high_session_frequency"),
        (mean_min >= 75).alias("long_average_sessions"), (F.col("rg_risk") >= 0.55).alias("marketing_suppression"))


def objectives(wh: Warehouse, scope: Scope) -> DataFrame:
    """KPI objectives (previous period +5 %, players +3 %, hold 7 %), progress clamped
    to [0, 1] and blended hold, current vs previous."""
    cur = overview.performance_summary(wh, scope)
    prev = overview.performance_summary(wh, scope.previous()).select(*[F.col(c).alias(f"p_{c}") for c in ("ggr", "ngr", "wagers", "players", "deposits", "ftd")])
    j = attach_scalars(cur, prev)
    def target(c, up):  # noqa: E306
        pc = F.coalesce(F.col(f"p_{c}").cast("double"), F.lit(0.0))
        return F.when(pc > 0, pc * up).otherwise(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)))
    hold = F.when(F.col("wagers") != 0, F.col("ggr") / F.col("wagers")).otherwise(F.lit(0.0))
    prev_hold = F.when(F.col("p_wagers") != 0, F.col("p_ggr") / F.col("p_wagers")).otherwise(F.lit(0.0))
    rows = []
    for c, up in (("ggr", OBJECTIVE_UPLIFT), ("ngr", OBJECTIVE_UPLIFT), ("players", PLAYER_OBJECTIVE_UPLIFT),
                  ("deposits", OBJECTIVE_UPLIFT), ("ftd", OBJECTIVE_UPLIFT)):
        t = target(c, up)
        rows.append(j.select(F.lit(c).alias("kpi"), F.col(c).cast("double").alias("current"), F.col(f"p_{c}").cast("double").alias("previous"),
                             t.alias("objective"), F.least(F.greatest(F.col(c).cast("double") / t, F.lit(0.0)), F.lit(1.0)).alias("progress")))
    rows.append(j.select(F.lit("hold").alias("kpi"), hold.alias("current"), prev_hold.alias("previous"), F.lit(HOLD_OBJECTIVE).alias("objective"),
                         F.least(F.greatest(hold / HOLD_OBJECTIVE, F.lit(0.0)), F.lit(1.0)).alias("progress")))
    out = reduce(DataFrame.unionByName, rows)
    from croupier.queries.freshness import period_delta
    return out.withColumn("delta", period_delta("current", "previous"))


def forecast_outlook(wh: Warehouse, scope: Scope, forecast: DataFrame) -> DataFrame:
    """Market-scaled 7/30-day forecast sums, run-rate objective (GGR/days x 30 x 1.05) and gap."""
    share = overview.market_share(wh, scope)
    first = forecast.agg(F.min("forecast_date").alias("first_day"))
    f = attach_scalars(attach_scalars(forecast, first), share)
    k = F.datediff("forecast_date", "first_day")  # one forecast row per day: the k-th day is first + k
    sums = f.agg(F.sum(F.when(k < 7, F.col("predicted_revenue") * F.col("market_share"))).alias("forecast_7"),
                 F.sum(F.when(k < 30, F.col("predicted_revenue") * F.col("market_share"))).alias("forecast_30"))
    cur = overview.performance_summary(wh, scope).select(F.greatest(F.col("ggr") / max(scope.days, 1) * 30 * OBJECTIVE_UPLIFT, F.lit(0.0)).alias("run_rate_target_30"))
    return attach_scalars(sums, cur).withColumn("forecast_gap", F.col("forecast_30") - F.col("run_rate_target_30"))


def weekly_forecast(forecast: DataFrame) -> DataFrame:
    """Forecast summed by Monday-start week with asymmetric error bars."""
    g = forecast.groupBy(F.to_date(F.date_trunc("week", "forecast_date")).alias("week")).agg(
        F.sum("predicted_revenue").alias("forecast"), F.sum("lower_bound").alias("lower"), F.sum("upper_bound").alias("upper"))
    return g.select("week", "forecast", "lower", "upper", (F.col("forecast") - F.col("lower")).alias("low_error"),
                    (F.col("upper") - F.col("forecast")).alias("high_error")).orderBy("week")


def ml_scorecard(metrics: DataFrame, anomalies: DataFrame, nba: DataFrame) -> DataFrame:
    """Churn AUC/lift on test, 1 - WAPE of the GGR forecast, anomaly count, players with an action."""
    t = metrics.filter(F.col("split") == "test")
    pick = lambda model, metric: F.max(F.when((F.col("model_name") == model) & (F.col("metric_name") == metric), F.col("metric_value")))
    m = t.agg(pick("churn_30d", "roc_auc").alias("churn_roc_auc_30d"), pick("churn_30d", "lift_top_10pct").alias("churn_lift_top_10pct"),
              (1 - pick("forecast_ggr", "wape")).alias("forecast_accuracy"))
    a = anomalies.agg(F.count(F.lit(1)).alias("anomalies"))
    n = nba.agg(F.count(F.when(F.col("recommended_action") != "Do nothing", 1)).alias("players_with_action"))
    return attach_scalars(attach_scalars(m, a), n)


def timeline_recent(wh: Warehouse, days: int = 50) -> DataFrame:
    """Each player's last 50 timeline days with total GGR."""
    t = player.player_timeline(wh).withColumn("total_ggr", F.col("casino_ggr") + F.col("sports_ggr"))
    w = Window.partitionBy("player_id").orderBy(F.desc("event_date"))
    return t.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= days).drop("rk")
