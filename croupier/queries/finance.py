"""Finance KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, avg_if, dec, max2, monday_week, out, ratio
from croupier.operators.scalars import attach_scalars
from croupier.plans.warehouse import Warehouse
from croupier.queries.overview import daily_ggr_trend
from croupier.scope import Scope

def _approved() -> F.Column:
    return F.col("transaction_status") == "Approved"


def _tx(wh: Warehouse, scope: Scope) -> DataFrame:
    return wh.v_transactions_enriched.filter(scope.date_and_market("transaction_day"))


def daily_approval_rate(wh: Warehouse, scope: Scope) -> DataFrame:
    return (_tx(wh, scope).groupBy(F.col("transaction_day").alias("date"))
            .agg(avg_if(_approved()).alias("approval_rate"), F.count(F.lit(1)).cast("bigint").alias("transactions")).orderBy("date"))


def daily_ggr(wh: Warehouse, scope: Scope) -> DataFrame:
    return daily_ggr_trend(wh, scope, value_name="GGR")


def gaming_summary(wh: Warehouse, scope: Scope) -> DataFrame:
    """Casino + sportsbook bets and payouts (two aggregates, then summed)."""
    s = wh.v_sessions_enriched.filter(scope.date_and_market("session_date")).agg(
        F.sum("total_bet_amount").alias("bets"), F.sum("total_payout_amount").alias("payout"))
    b = wh.v_sports_bets_enriched.filter(scope.date_and_market("bet_day")).agg(
        F.sum("stake").alias("bets"), F.sum("payout").alias("payout"))
    zero = dec("0").cast(MONEY)
    return s.unionByName(b).agg(out(F.coalesce(F.sum("bets"), zero), "bets"), out(F.coalesce(F.sum("payout"), zero), "payout"))


def payment_methods(wh: Warehouse, scope: Scope) -> DataFrame:
    return _tx(wh, scope).groupBy("payment_method").agg(
        out(F.sum("amount"), "Volume"), F.count(F.lit(1)).cast("bigint").alias("Transactions"),
        avg_if(_approved()).alias("Approved"), avg_if(F.col("transaction_status") == "Declined").alias("Declined"),
        out(F.sum("processing_fee"), "Fees"), ratio(F.sum("processing_fee"), F.sum("amount")).alias("Avg_fee"),
    ).orderBy(F.desc("Volume"), "payment_method")


def transactions_summary(wh: Warehouse, scope: Scope) -> DataFrame:
    zero = dec("0").cast(MONEY)
    t = F.col("transaction_type")
    return _tx(wh, scope).agg(
        out(F.coalesce(F.sum(F.when(_approved() & (t == "Deposit"), F.col("amount")).otherwise(zero)), zero), "deposits"),
        out(F.coalesce(F.sum(F.when(_approved() & (t == "Withdrawal"), F.col("amount")).otherwise(zero)), zero), "withdrawals"),
        out(F.coalesce(F.sum(F.when(_approved(), F.col("processing_fee")).otherwise(zero)), zero), "fees"),
        avg_if(_approved()).alias("approval"),
    )


def weekly_deposits_withdrawals(wh: Warehouse, scope: Scope) -> DataFrame:
    return (_tx(wh, scope).filter(_approved()).groupBy(monday_week("transaction_day").alias("week"), "transaction_type")
            .agg(out(F.sum("amount"), "amount")).orderBy("week", "transaction_type"))


def waterfall(wh: Warehouse, scope: Scope) -> DataFrame:
    """Bets, payouts, GGR, bonus, fees, tax, NGR for the period and the previous one.

    NGR here floors GGR once on the period total (not per day): provisions of 6.5 % and 9.5 %.
    """
    def one(sc: Scope, period: str) -> DataFrame:
        g = gaming_summary(wh, sc)
        f = transactions_summary(wh, sc).select("fees")
        ggr = F.col("bets") - F.col("payout")
        pos = F.greatest(ggr, F.lit(0.0))
        return attach_scalars(g, f).select(
            F.lit(period).alias("period"), "bets", "payout", ggr.alias("ggr"), (-pos * 0.065).alias("bonus"),
            (-F.col("fees")).alias("fees"), (-pos * 0.095).alias("tax"), (ggr - F.col("fees") - pos * 0.065 - pos * 0.095).alias("ngr"))
    wide = one(scope, "current").unionByName(one(scope.previous(), "previous"))
    steps = ["bets", "payout", "ggr", "bonus", "fees", "tax", "ngr"]
    stack = "stack(7, " + ", ".join(f"'{s}', `{s}`" for s in steps) + ") as (step, value)"
    return wide.selectExpr("period", stack)
