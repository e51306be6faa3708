"""KPI reference definitions computed from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, dec, max2, out, ratio, sum_if
from croupier.operators.scalars import attach_scalars
from croupier.plans.warehouse import Warehouse
from croupier.queries import acquisition, player
from croupier.queries.overview import ftd_count
from croupier.scope import Scope


def ggr_ngr_margin(wh: Warehouse, scope: Scope) -> DataFrame:
    """O1: GGR, margin and estimated NGR with the positive-GGR floor applied once on the total."""
    s = wh.v_sessions_enriched.filter(scope.date_and_market("session_date")).agg(
        F.sum("total_bet_amount").alias("w"), F.sum("total_payout_amount").alias("p"))
    b = wh.v_sports_bets_enriched.filter(scope.date_and_market("bet_day")).agg(F.sum("stake").alias("w"), F.sum("payout").alias("p"))
    totals = s.unionByName(b).agg(F.sum("w").alias("wagers"), F.sum("p").alias("payouts"))
    fees = (wh.v_transactions_enriched.filter(scope.date_and_market("transaction_day") & (F.col("transaction_status") == "Approved"))
            .agg(F.coalesce(F.sum("processing_fee"), dec("0").cast(MONEY)).alias("fees")))
    ggr = F.col("wagers") - F.col("payouts")
    pos = max2(ggr, dec("0"))
    return attach_scalars(totals, fees).select(
        out("wagers", "wagers"), out("payouts", "payouts"), out(ggr, "ggr"), ratio(ggr, "wagers").alias("ggr_margin"),
        out(ggr - F.col("fees") - pos * dec("0.065") - pos * dec("0.095"), "estimated_ngr_mvp"))


def active_players(wh: Warehouse, scope: Scope) -> DataFrame:
    """O2: distinct players with a session or a bet in scope (union, then distinct count)."""
    s = wh.v_sessions_enriched.filter(scope.date_and_market("session_date")).select("player_id")
    b = wh.v_sports_bets_enriched.filter(scope.date_and_market("bet_day")).select("player_id")
    return s.union(b).distinct().agg(F.count(F.lit(1)).cast("bigint").alias("active_players"))


def ftd(wh: Warehouse, scope: Scope) -> DataFrame:
    """O3."""
    return ftd_count(wh, scope, name="ftd_count")


def ftd_conversion_d30(wh: Warehouse, scope: Scope) -> DataFrame:
    """As I17 but ``converted_d30`` stays NULL when nobody converted."""
    e = acquisition._mature(wh, scope).join(wh.int_player_first_deposit.select("player_id", "ftd_at"), "player_id", "left")
    conv = sum_if(acquisition._converted())
    return e.agg(F.count(F.lit(1)).cast("bigint").alias("eligible_registrations"), conv.alias("converted_d30"),
                 ratio(conv, F.count(F.lit(1))).alias("ftd_conversion_d30"))


def average_deposit(wh: Warehouse, scope: Scope) -> DataFrame:
    """O5."""
    t = wh.v_transactions_enriched.filter(scope.date_and_market("transaction_day") & (F.col("transaction_type") == "Deposit")
                                          & (F.col("transaction_status") == "Approved"))
    return t.agg(ratio(F.sum("amount"), F.count(F.lit(1))).alias("average_deposit"))


def retention_d30(wh: Warehouse, scope: Scope) -> DataFrame:
    """O6 (same definition as I13)."""
    return player.retention_d30(wh, scope)


def rtp_by_game(wh: Warehouse, scope: Scope) -> DataFrame:
    """Actual RTP, bets-weighted theoretical RTP and signed variance per game from events."""
    g = wh.v_sessions_enriched.filter(scope.date_and_market("session_date")).groupBy("game_name").agg(
        F.sum("total_bet_amount").alias("b"), F.sum("total_payout_amount").alias("p"),
        F.sum(F.col("total_bet_amount") * F.col("theoretical_rtp")).alias("wt"))
    actual, weighted = ratio("p", "b"), ratio("wt", "b")
    return g.select("game_name", out("b", "bets"), out("p", "payouts"), actual.alias("actual_rtp"),
                    weighted.alias("weighted_theoretical_rtp"), (actual - weighted).alias("rtp_variance"))


def latest_scores(wh: Warehouse, scope: Scope) -> DataFrame:
    """Current scores of players in the market."""
    return wh.v_player_scores.filter(scope.market()).select(
        "player_id", out("predicted_ltv_90d", "predicted_ltv_90d"), out("churn_probability", "churn_probability"),
        out("fraud_risk", "fraud_risk"), out("rg_risk", "rg_risk"), out("model_confidence", "model_confidence"),
        "model_version", "scored_at")
