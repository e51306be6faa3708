"""Player snapshot (N1), rule scores (N17), closed-form churn/LTV scores (N20), next best
action (N16) and the ``model_scores`` table (N18).

The closed-form scores follow the published baseline formulas without their random and
latent terms, so every score-based KPI is reproducible by SQL. A trained MLlib model
(``croupier.ml``) can replace the churn/LTV columns without touching any KPI.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, SCORE, avg_if, clip, dec
from croupier.operators.quantiles import exact_quantile_row

# ---- fixed values ------------------------------------------------------------------
MODEL_VERSION = "closed-form-v1"
DEFAULT_CUTOFF = "2000-03-31"
ELIGIBLE_TENURE_DAYS = 14
RECENCY_CAP = 220
MISSING_RECENCY = 999
CHURN_INTERCEPT, CHURN_RECENCY_SCALE, CHURN_FREQUENCY_WEIGHT = -2.0, 18.0, 0.35
RECENCY_SHIFT = {7: 23, 14: 16, 30: 0}
CHURN_BOUNDS = (0.01, 0.99)
LTV_SCALE, LTV_BOUNDS = 75.0, (10.0, 15000.0)
LTV_HORIZON_FACTOR = {30: 1.0 / 3.0, 90: 1.0, 180: 2.0}
FRAUD_DECLINE_WEIGHT = 1.4
RG_DURATION_WEIGHT, RG_DURATION_SCALE, RG_DEPOSIT_WEIGHT, RG_DEPOSIT_LIMIT = 0.45, 240.0, 0.35, 1500
RG_DURATION_PER_MINUTE, RG_DEPOSIT_STEP = "0.001875", "0.35"   # 0.45 / 240 per minute of the longest session
ACTIONS = [
    "Limit communications · RG review",
    "Manual fraud review",
    "Send retention campaign",
    "Recommend preferred game",
    "Offer governed bonus",
]
REASONS = [
    "Responsible Gaming safeguard",
    "Payment anomaly",
    "High churn × future value",
    "Value retention opportunity",
    "High future value",
]
NO_ACTION, NO_REASON = "Do nothing", "No material intervention signal"
NBA_QUANTILES = {
    "churn_high": ("churn_probability_30d", 0.80),
    "churn_medium": ("churn_probability_14d", 0.55),
    "value_medium": ("remaining_ltv_90d", 0.60),
    "value_high": ("remaining_ltv_90d", 0.75),
    "future_high": ("remaining_ltv_180d", 0.90),
}
CONFIDENCE_BASE, CONFIDENCE_SLOPE, CONFIDENCE_BOUNDS = "0.62", "0.45", ("0.62", "0.94")
RISK_THRESHOLD = 0.55
LTV_TYPE = "decimal(18,6)"
# ------------------------------------------------------------------------------------


def cutoff_ts(cutoff: str) -> F.Column:
    return F.lit(f"{cutoff} 23:59:59").cast("timestamp_ntz")


def snapshot(wh, cutoff: str, horizon: int = 1) -> DataFrame:
    """One row per eligible player with every feature as of ``cutoff`` 23:59:59 and the
    activity/GGR observed in the following ``horizon`` days."""
    cut, cut_day = cutoff_ts(cutoff), F.lit(cutoff).cast("date")
    end = cut + F.make_dt_interval(F.lit(horizon))
    end_day = F.date_add(cut_day, horizon)
    facts = getattr(wh, "by_player", wh)
    zero = dec("0").cast(MONEY)

    def events(rows: DataFrame, kind: str, t: str, day: str, *columns) -> DataFrame:
        """Rows of one fact up to the end of the horizon, ``old`` up to the cut-off."""
        old = (F.col(day) <= cut_day) & (F.col(t) <= cut)
        new = (F.col(day) >= cut_day) & (F.col(t) > cut) & (F.col(t) <= end)
        return rows.filter(F.col(day) <= end_day).filter(old | new).select(
            "player_id", F.lit(kind).alias("kind"), old.alias("old"), F.col(t).alias("t"), *columns)

    s = events(facts.sessions, "s", "session_start", "session_date", F.col("session_date").alias("day"), F.col("casino_ggr").alias("ggr"),
               F.col("total_bet_amount").alias("put"), "duration_minutes", "game_id", "bet_count")
    t = events(facts.transactions, "t", "transaction_date", "transaction_day", "transaction_type", "transaction_status", "payment_method", "amount")
    b = events(facts.sports_bets, "b", "bet_date", "bet_day", F.col("sportsbook_ggr").alias("ggr"), F.col("stake").alias("put"))
    happened = s.unionByName(t.filter("old"), allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    of = lambda kind, c: F.when(F.col("old") & (F.col("kind") == kind), c)
    approved = F.col("transaction_status") == "Approved"
    dep, wd = approved & (F.col("transaction_type") == "Deposit"), approved & (F.col("transaction_type") == "Withdrawal")
    kinds = lambda kind, c: F.size(F.collect_set(of(kind, F.col(c))))  # noqa: E731  (days, games or methods of one player)
    # one aggregation by player over all facts: one shuffle, no join of its parts, distinct values as sets
    # instead of a copy of every row per distinct count
    per = happened.groupBy("player_id").agg(
        F.count(of("s", F.lit(1))).alias("session_count"), kinds("s", "day").alias("active_days"),
        F.max(of("s", F.col("t"))).alias("last_session"), F.sum(of("s", F.col("put"))).alias("total_bets"),
        F.sum(of("s", F.col("ggr"))).alias("casino_hist_ggr"), F.avg(of("s", F.col("duration_minutes"))).alias("avg_duration"),
        F.max(of("s", F.col("duration_minutes"))).alias("max_duration"), kinds("s", "game_id").alias("distinct_games"),
        F.sum(of("s", F.col("bet_count"))).alias("bet_count"),
        F.count(of("t", F.when(dep, 1))).alias("deposit_count"), F.sum(of("t", F.when(dep, F.col("amount")))).alias("deposit_amount"),
        F.count(of("t", F.when(wd, 1))).alias("withdrawal_count"), F.sum(of("t", F.when(wd, F.col("amount")))).alias("withdrawal_amount"),
        avg_if(of("t", F.col("transaction_status") == "Declined")).alias("decline_rate"), kinds("t", "payment_method").alias("payment_methods"),
        F.count(of("b", F.lit(1))).alias("sports_bets"), F.sum(of("b", F.col("put"))).alias("sports_stake"),
        F.sum(of("b", F.col("ggr"))).alias("sports_hist_ggr"), F.max(of("b", F.col("t"))).alias("last_bet"),
        F.count(F.when(~F.col("old"), 1)).alias("future_activity"), F.sum(F.when(~F.col("old"), F.col("ggr"))).alias("future_ggr"))
    p = wh.dim_player.filter(F.col("registration_at") <= cut - F.make_dt_interval(F.lit(ELIGIBLE_TENURE_DAYS)))
    j = p.join(per, "player_id")  # a player without a row has no activity and is left out below
    rec_s = F.coalesce(F.datediff(cut_day, F.to_date("last_session")), F.lit(MISSING_RECENCY))
    rec_b = F.coalesce(F.datediff(cut_day, F.to_date("last_bet")), F.lit(MISSING_RECENCY))
    c0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    m0 = lambda c: F.coalesce(F.col(c), zero)
    last_activity = (F.when(F.col("last_bet").isNull() | (F.col("last_session") >= F.col("last_bet")), F.col("last_session"))
                     .otherwise(F.col("last_bet")))
    return j.filter(c0("session_count") + c0("sports_bets") + c0("deposit_count") > 0).select(
        "player_id", "country", "channel", "device", "vip_level", "kyc_status",
        F.datediff(cut_day, F.col("registration_date")).alias("tenure_days"),
        c0("session_count").cast("bigint").alias("session_count"), c0("active_days").cast("bigint").alias("active_days"),
        F.least(rec_s, rec_b).alias("recency_days"), m0("total_bets").alias("total_bets"),
        (m0("casino_hist_ggr") + m0("sports_hist_ggr")).cast(MONEY).alias("historical_ggr"),
        F.coalesce(F.col("avg_duration"), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.col("max_duration"), F.lit(0.0)).alias("max_duration"),
        c0("distinct_games").cast("bigint").alias("distinct_games"), c0("bet_count").cast("bigint").alias("bet_count"),
        c0("deposit_count").cast("bigint").alias("deposit_count"), m0("deposit_amount").alias("deposit_amount"),
        c0("withdrawal_count").cast("bigint").alias("withdrawal_count"), m0("withdrawal_amount").alias("withdrawal_amount"),
        F.coalesce(F.col("decline_rate"), F.lit(0.0)).alias("decline_rate"),
        c0("payment_methods").cast("bigint").alias("payment_methods"),
        c0("sports_bets").cast("bigint").alias("sports_bets"), m0("sports_stake").alias("sports_stake"),
        m0("sports_hist_ggr").alias("sports_ggr"), c0("future_activity").cast("bigint").alias("future_activity"),
        m0("future_ggr").alias("future_ggr"), last_activity.alias("last_activity"),
        F.lit(cutoff).cast("date").alias("snapshot_date"),
    )


def _churn(recency: F.Column, sessions: F.Column) -> F.Column:
    z = F.lit(CHURN_INTERCEPT) + recency / CHURN_RECENCY_SCALE - F.log(1 + sessions.cast("double")) * CHURN_FREQUENCY_WEIGHT
    return clip(1 / (1 + F.exp(-z)), F.lit(CHURN_BOUNDS[0]), F.lit(CHURN_BOUNDS[1])).cast(SCORE)


def rule_scores(snap: DataFrame) -> DataFrame:
    """Closed-form churn (7/14/30 d), remaining LTV (30/90/180 d), fraud and RG risk."""
    r = F.least(F.col("recency_days"), F.lit(RECENCY_CAP)).cast("double")
    ltv = clip(F.log(1 + F.greatest(F.col("historical_ggr").cast("double"), F.lit(0.0))) * LTV_SCALE,
               F.lit(LTV_BOUNDS[0]), F.lit(LTV_BOUNDS[1]))
    cols = [F.col("*")]
    for h, shift in RECENCY_SHIFT.items():
        cols.append(_churn(F.greatest(r - shift, F.lit(0.0)), F.col("session_count")).alias(f"churn_probability_{h}d"))
    for h, factor in LTV_HORIZON_FACTOR.items():
        cols.append((ltv * factor if factor != 1.0 else ltv).cast(LTV_TYPE).alias(f"remaining_ltv_{h}d"))
    cols.append(clip(F.col("decline_rate") * FRAUD_DECLINE_WEIGHT, F.lit(0.0), F.lit(1.0)).cast(SCORE).alias("fraud_risk"))
    # exact decimal arithmetic: duration x (0.45 / 240) = duration x 0.001875, then half-up to 6 places
    rg = (F.col("max_duration").cast("decimal(18,2)") * dec(RG_DURATION_PER_MINUTE)
          + F.when(F.col("deposit_amount") > RG_DEPOSIT_LIMIT, dec(RG_DEPOSIT_STEP)).otherwise(dec("0")))
    cols.append(F.round(clip(rg, dec("0"), dec("1")), 6).cast(SCORE).alias("rg_risk"))
    return snap.select(*cols)


def next_best_action(scored: DataFrame, cut: dict[str, float] | None = None) -> DataFrame:
    """Five ordered rules (first match wins) with quantile cut-offs over all scored players."""
    cut = cut or exact_quantile_row(scored, NBA_QUANTILES)
    lit = lambda k: F.lit(cut[k]).cast("double")
    c30, c14 = F.col("churn_probability_30d").cast("double"), F.col("churn_probability_14d").cast("double")
    v90, v180 = F.col("remaining_ltv_90d").cast("double"), F.col("remaining_ltv_180d").cast("double")
    conds = [
        F.col("rg_risk") >= RISK_THRESHOLD,
        F.col("fraud_risk") >= RISK_THRESHOLD,
        (c30 >= lit("churn_high")) & (v90 >= lit("value_medium")),
        (v180 >= lit("future_high")) & (c30 < lit("churn_high")),
        (v90 >= lit("value_high")) & (c14 >= lit("churn_medium")),
    ]
    action, reason = F.lit(NO_ACTION), F.lit(NO_REASON)
    for cond, a, r in reversed(list(zip(conds, ACTIONS, REASONS))):
        action = F.when(F.coalesce(cond, F.lit(False)), F.lit(a)).otherwise(action)
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(r)).otherwise(reason)
    # exact decimal arithmetic on the 6-place score, then half-up to 6 places
    p30 = F.col("churn_probability_30d")
    conf = F.round(clip(dec(CONFIDENCE_BASE) + F.abs(p30 - dec("0.5")) * dec(CONFIDENCE_SLOPE),
                        dec(CONFIDENCE_BOUNDS[0]), dec(CONFIDENCE_BOUNDS[1])), 6)
    return scored.select(
        "*", action.alias("recommended_action"), reason.alias("reason"), conf.cast(SCORE).alias("action_confidence"),
        (F.col("remaining_ltv_90d") * F.col("churn_probability_30d")).alias("estimated_value_at_stake"),
    )


def assembled(scored: DataFrame, cutoff: str, version: str = MODEL_VERSION) -> DataFrame:
    """The ``model_scores`` columns of scored snapshot rows, next best action included."""
    return next_best_action(scored).select(
        "player_id",
        F.col("remaining_ltv_90d").alias("predicted_ltv_90d"), F.col("churn_probability_30d").alias("churn_probability"),
        "fraud_risk", "rg_risk", "churn_probability_7d", "churn_probability_14d", "churn_probability_30d",
        F.col("historical_ggr").alias("observed_value"),
        "remaining_ltv_30d", "remaining_ltv_90d", "remaining_ltv_180d",
        *[(F.col("historical_ggr") + F.col(f"remaining_ltv_{h}d")).alias(f"predicted_total_ltv_{h}d") for h in (30, 90, 180)],
        "recommended_action", F.col("action_confidence").alias("model_confidence"), "reason", "estimated_value_at_stake",
        F.col("last_activity").alias("last_session"), "session_count", F.col("historical_ggr").alias("lifetime_ggr"),
        F.lit(version).alias("model_version"), cutoff_ts(cutoff).alias("scored_at"),
    )


def model_scores(wh) -> DataFrame:
    """``model_scores`` from the closed form: one row per scored player (N18). Trained models write the
    same table, see ``croupier.ml.training``."""
    cutoff = getattr(wh, "scoring_cutoff", None) or DEFAULT_CUTOFF
    return assembled(_stable(wh, rule_scores(snapshot(wh, cutoff, 1))), cutoff)


def _stable(wh, df: DataFrame) -> DataFrame:
    """Cut lineage once: the scored snapshot feeds five quantile scans and every score KPI.

    ``checkpoint`` writes to the session's shared checkpoint folder (reliable, survives
    executor loss), unlike ``localCheckpoint``.
    """
    from croupier.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(wh.spark)
    return df.checkpoint(eager=True)


def next_best_actions_table(wh) -> DataFrame:
    """``next_best_actions`` table (N16 output)."""
    return wh.model_scores.select(
        "player_id", "recommended_action", "reason", F.col("model_confidence").alias("action_confidence"),
        "estimated_value_at_stake", "model_version", "scored_at")
