"""Evidence jobs behind the governed answers (M1-M12), one DataFrame each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import dec, out, ratio, sum_if
from croupier.operators.scalars import attach_scalars
from croupier.plans import rules
from croupier.queries.acquisition import channel_cost
from croupier.scope import Scope

NGR_PROVISION = "0.16"  # 6.5 % bonus + 9.5 % tax provisions, floor applied once on the total


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _rel(cur, prev) -> F.Column:
    return F.when(prev != 0, (cur - prev) / F.abs(prev)).otherwise(F.lit(0.0))


def ngr_change(wh, scope: Scope) -> DataFrame:
    """M1: casino GGR, sportsbook GGR and fees for both periods (one scan), NGR movement and the
    driver with the largest absolute change."""
    prev = scope.previous()
    rows = wh.mart_executive_daily.filter((F.col("metric_date") >= prev.lo_date) & (F.col("metric_date") < scope.hi_date) & scope.market())
    cur = F.col("metric_date") >= scope.lo_date
    z = dec("0")
    t = rows.agg(*[F.coalesce(F.sum(F.when(c if is_cur else ~c, F.col(col))), z).alias(f"{col}_{'c' if is_cur else 'p'}")
                   for col in ("casino_ggr", "sports_ggr", "payment_fees", "total_ggr") for is_cur, c in ((True, cur), (False, cur))])
    drivers = t.selectExpr(
        "stack(3, 'Casino GGR', casino_ggr_c, casino_ggr_p, 'Sportsbook GGR', sports_ggr_c, sports_ggr_p, "
        "'Payment fees', payment_fees_c, payment_fees_p) as (Driver, Current, Previous)")
    c, p = _d("Current"), _d("Previous")
    drivers = drivers.select("Driver", c.alias("Current"), p.alias("Previous"), (c - p).alias("Absolute_change"), _rel(c, p).alias("Relative_change"))
    ngr = lambda g, f: _d(g) - _d(f) - F.greatest(_d(g), F.lit(0.0)) * float(NGR_PROVISION)
    summary = t.select(ngr("total_ggr_c", "payment_fees_c").alias("ngr"), ngr("total_ggr_p", "payment_fees_p").alias("prior_ngr"))
    summary = summary.select("ngr", "prior_ngr", (F.col("ngr") - F.col("prior_ngr")).alias("ngr_change"),
                             _rel(F.col("ngr"), F.col("prior_ngr")).alias("ngr_relative_change"))
    top = drivers.orderBy(F.abs("Absolute_change").desc(), "Driver").limit(1).select(F.col("Driver").alias("largest_driver"))
    return attach_scalars(attach_scalars(drivers, summary), top)


def weakest_games(wh, scope: Scope, limit: int = 5) -> DataFrame:
    """M2: five weakest games by margin then GGR (bets > 0)."""
    g = (wh.mart_game_performance_daily.filter(scope.date_and_market("metric_date")).groupBy("game_name", "provider")
         .agg(F.sum("ggr").alias("ggr"), F.sum("bets").alias("bets"), F.sum("payouts").alias("payouts"),
              F.sum(F.col("bets") * F.col("theoretical_rtp")).alias("wt"))
         .filter(F.col("bets") > 0))
    actual, theo = ratio("payouts", "bets"), ratio("wt", "bets")
    return (g.select(F.col("game_name").alias("Game"), F.col("provider").alias("Provider"), out("ggr", "GGR"), out("bets", "Bets"),
                     ratio("ggr", "bets").alias("Margin"), actual.alias("Actual_RTP"), theo.alias("Theoretical_RTP"),
                     (actual - theo).alias("RTP_variance"))
            .orderBy("Margin", "GGR", "Game", "Provider").limit(limit))


def acquisition_budget(wh, scope: Scope) -> DataFrame:
    """M3: per channel CAC, remaining LTV, ROAS as a ratio of averages, churn."""
    p = wh.players.filter(scope.ts_in("registration_date") & scope.market()).select("player_id", "channel")
    v = wh.v_player_scores.select("player_id", "remaining_ltv_90d", "churn_probability_30d")
    g = p.join(v, "player_id").groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum(channel_cost()).alias("cost"), F.sum("remaining_ltv_90d").alias("ltv"),
        F.sum("churn_probability_30d").alias("churn"))
    cac, ltv = ratio("cost", "n"), ratio("ltv", "n")
    return g.select(F.col("channel").alias("Channel"), F.col("n").cast("bigint").alias("Players"), cac.alias("Estimated_CAC"),
                    ltv.alias("Predicted_remaining_LTV_90D"), F.try_divide(ltv, cac).alias("Predicted_ROAS"),
                    ratio("churn", "n").alias("Churn_risk")).orderBy(F.desc("Predicted_ROAS"), "Channel")


def churn_value_at_risk(wh, scope: Scope) -> DataFrame:
    """M4: value at risk by 30-day churn band for active players at or above 45 %."""
    act = wh.int_player_activity_daily.filter(scope.date_in("activity_date")).select("player_id")
    v = wh.v_player_scores.filter(scope.market() & (F.col("churn_probability_30d") >= 0.45)).join(act, "player_id", "left_semi")
    p = F.col("churn_probability_30d")
    band = F.when(p >= 0.75, "Critical ≥75%").when(p >= 0.60, "High 60–75%").otherwise("Watch 45–60%")
    return v.groupBy(band.alias("Risk_band")).agg(
        F.count(F.lit(1)).cast("bigint").alias("Players"), out(F.sum("remaining_ltv_90d"), "Future_value"),
        out(F.sum(F.col("remaining_ltv_90d") * p), "Value_at_risk"), (F.sum(p).cast("double") / F.count(p)).alias("Avg_risk"),
    ).orderBy(F.desc("Avg_risk"))


def alias(col: str = "player_id") -> F.Column:
    """M6: irreversible display alias, 'Player ' + first 8 hex digits of SHA-256, upper case."""
    return F.concat(F.lit("Player "), F.upper(F.substring(F.sha2(F.col(col).cast("string"), 256), 1, 8)))


def vip_attention(wh, scope: Scope, limit: int = 10) -> DataFrame:
    """M5: top Gold/Platinum active players by max(churn, fraud, RG) risk, with aliases."""
    act = wh.int_player_activity_daily.filter(scope.date_in("activity_date")).select("player_id")
    v = (wh.v_player_scores.filter(F.col("vip_level").isin("Gold", "Platinum") & scope.market()).join(act, "player_id", "left_semi"))
    c, f, r = F.col("churn_probability_30d"), F.col("fraud_risk"), F.col("rg_risk")
    risk = F.when(c.isNull() | f.isNull() | r.isNull(), F.lit(None)).otherwise(F.greatest(c, f, r))
    top = v.withColumn("risk", risk).orderBy(F.col("risk").desc_nulls_last(), F.desc("remaining_ltv_90d"), "player_id").limit(limit)
    return top.select(alias().alias("Player"), "vip_level", out("remaining_ltv_90d", "remaining_ltv_90d"),
                      out("churn_probability_30d", "churn_probability_30d"), out("fraud_risk", "fraud_risk"), out("rg_risk", "rg_risk"),
                      "recommended_action",
                      ((c >= 0.6) | (f >= 0.55) | (r >= 0.55)).alias("urgent"))


def withdrawal_failures(wh, scope: Scope) -> DataFrame:
    """M7: withdrawal failure rate by method, current vs previous (full outer, 0 filled)."""
    def one(s: Scope, tag: str) -> DataFrame:
        t = wh.v_transactions_enriched.filter(scope.market() & s.date_in("transaction_day") & (F.col("transaction_type") == "Withdrawal"))
        return t.groupBy(F.col("payment_method").alias("Payment_method")).agg(
            F.count(F.lit(1)).cast("double").alias(f"Attempts_{tag}"), sum_if(F.col("transaction_status") == "Declined").cast("double").alias(f"Failed_{tag}"),
            ratio(sum_if(F.col("transaction_status") == "Declined"), F.count(F.lit(1))).alias(f"Failure_rate_{tag}"))
    e = one(scope, "current").join(one(scope.previous(), "previous"), "Payment_method", "full_outer").na.fill(0.0)
    return e.withColumn("Failure_change", F.col("Failure_rate_current") - F.col("Failure_rate_previous")).orderBy(
        F.desc("Failure_change"), "Payment_method")


def priority_actions(wh, scope: Scope, n: int = 5) -> DataFrame:
    """M8: the first five alerts in the register order."""
    return rules.alerts(wh, scope).limit(n).select(
        F.col("priority").alias("Priority"), F.col("recommendation").alias("Action"), F.col("team").alias("Owner"),
        F.col("financial_impact").alias("Impact"), F.col("confidence").alias("Confidence"), F.col("title").alias("Signal"))


def casino_summary(wh, scope: Scope) -> DataFrame:
    """M9: per game plus the bets-weighted portfolio RTP (= total payouts / total bets)."""
    g = wh.mart_game_performance_daily.filter(scope.date_and_market("metric_date")).groupBy("game_name").agg(
        F.sum("ggr").alias("ggr"), F.sum("bets").alias("bets"), F.sum("sessions").alias("sessions"), F.sum("payouts").alias("payouts"))
    tot = g.agg(ratio(F.sum("payouts"), F.sum("bets")).alias("Portfolio_RTP"))
    return attach_scalars(g, tot).select(
        F.col("game_name").alias("Game"), out("ggr", "GGR"), out("bets", "Bets"), F.col("sessions").cast("bigint").alias("Sessions"),
        ratio("payouts", "bets").alias("RTP"), ratio("ggr", "bets").alias("Margin"), "Portfolio_RTP").orderBy(F.desc("GGR"), "Game")


def sportsbook_summary(wh, scope: Scope) -> DataFrame:
    """Per sport handle, GGR, hold and bets with the total hold."""
    g = wh.v_sports_bets_enriched.filter(scope.date_and_market("bet_day")).groupBy("sport").agg(
        F.sum("stake").alias("h"), F.sum("sportsbook_ggr").alias("g"), F.count(F.lit(1)).alias("n"))
    tot = g.agg(ratio(F.sum("g"), F.sum("h")).alias("Total_hold"))
    return attach_scalars(g, tot).select(F.col("sport").alias("Sport"), out("h", "Handle"), out("g", "GGR"), ratio("g", "h").alias("Hold"),
                                   F.col("n").cast("bigint").alias("Bets"), "Total_hold").orderBy(F.desc("Handle"), "Sport")


def payments_summary(wh, scope: Scope) -> DataFrame:
    """Per method volume, approval, approved deposits/withdrawals and weighted approval."""
    ok = F.col("transaction_status") == "Approved"
    z = dec("0")
    g = wh.v_transactions_enriched.filter(scope.date_and_market("transaction_day")).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v"), F.count(F.when(ok, 1)).alias("ok"),
        F.sum(F.when(ok & (F.col("transaction_type") == "Deposit"), F.col("amount")).otherwise(z)).alias("dep"),
        F.sum(F.when(ok & (F.col("transaction_type") == "Withdrawal"), F.col("amount")).otherwise(z)).alias("wd"))
    tot = g.agg(ratio(F.sum("ok"), F.sum("n")).alias("Weighted_approval"))
    return attach_scalars(g, tot).select(
        F.col("payment_method").alias("Payment_method"), F.col("n").cast("bigint").alias("Transactions"), out("v", "Volume"),
        ratio("ok", "n").alias("Approval_rate"), out("dep", "Deposits"), out("wd", "Withdrawals"), "Weighted_approval",
    ).orderBy(F.desc("Volume"), "Payment_method")


def data_coverage(wh, scope: Scope) -> DataFrame:
    """Row coverage of the four domains in scope."""
    parts = [
        wh.players.filter(scope.market()).agg(F.countDistinct("player_id").alias("Rows")).select(F.lit("Players").alias("Dataset"), "Rows"),
        wh.v_sessions_enriched.filter(scope.date_and_market("session_date")).agg(F.count(F.lit(1)).alias("Rows")).select(F.lit("Casino sessions").alias("Dataset"), "Rows"),
        wh.v_sports_bets_enriched.filter(scope.date_and_market("bet_day")).agg(F.count(F.lit(1)).alias("Rows")).select(F.lit("Sportsbook bets").alias("Dataset"), "Rows"),
        wh.v_transactions_enriched.filter(scope.date_and_market("transaction_day")).agg(F.count(F.lit(1)).alias("Rows")).select(F.lit("Transactions").alias("Dataset"), "Rows"),
    ]
    d = reduce(DataFrame.unionByName, parts)
    return d.select("Dataset", F.col("Rows").cast("bigint"), (F.col("Rows") == 0).alias("missing"))
