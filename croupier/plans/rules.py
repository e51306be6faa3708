"""Decision rules (K1-K19): ten auditable alert rules evaluated for every market in one job.

Each rule is a grouped DataFrame keyed by ``country``; current and previous periods come
from one filtered scan with conditional sums. The all-markets view is the union of the
per-market alerts (every market is evaluated separately, as a single-market view would).
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from croupier.functions.exprs import dec, max2
from croupier.queries.acquisition import channel_cost
from croupier.scope import Scope
from croupier.sources import publish

# ---- fixed values ------------------------------------------------------------------
RULE_CATALOG = {
    "GGR_DROP": ("Unusual GGR decline", "Observed GGR", "Revenue & Finance", "GGR decreases by at least 10% versus the equivalent prior period."),
    "RTP_ANOMALY": ("Abnormal RTP variance", "Observed RTP", "Casino Operations", "A sufficiently active game's actual RTP differs from theoretical RTP by at least 2 percentage points."),
    "CAMPAIGN_LOSS": ("Unprofitable acquisition campaign", "Predicted ROAS Proxy 90D", "Growth", "A channel's predicted LTV Proxy divided by demo acquisition cost falls below 1.5x."),
    "SUPPLIER_DROP": ("Underperforming provider", "Observed provider GGR", "Casino Operations", "Provider GGR falls by at least 15% versus the equivalent prior period."),
    "WITHDRAWAL_SPIKE": ("Withdrawal increase", "Observed withdrawals", "Payments", "Approved withdrawals increase by at least 20% versus the equivalent prior period."),
    "CONVERSION_DROP": ("Conversion decline", "Observed period FTD rate", "Growth", "Period FTD / registrations decreases by at least 15% relative to the prior period."),
    "SPORTS_EXPOSURE": ("Excessive sportsbook exposure", "Observed event handle share", "Sportsbook Trading", "One event represents at least 35% of settled handle."),
    "REVENUE_CONCENTRATION": ("Excessive revenue concentration", "Observed player GGR share", "VIP & CRM", "The top ten players generate at least 25% of positive player GGR."),
    "FRAUD_SIGNAL": ("Potentially fraudulent behavior", "Predicted fraud risk", "Risk & Compliance", "Active players have a fraud-risk score of at least 55%."),
    "RG_SIGNAL": ("Sensitive Responsible Gaming behavior", "Predicted RG risk", "Player Protection", "Active players have an RG-risk score of at least 55%."),
}
STATUS_ORDER = ("New", "Reviewed", "Resolved")
SEVERITY_RANK = {"Critical": 0, "High": 1, "Medium": 2}
RECOVERY_SHARE = {"Critical": 0.45, "High": 0.32, "Medium": 0.20}
OTHER_RECOVERY_SHARE = 0.12
RULE_TEXT = {
    "GGR_DROP": ("Observed GGR gap", "Lower wager volume, weaker hold, or a mix shift toward lower-margin products.",
                 "Decompose the gap by product, market and top contributors; assign owners to the largest negative drivers.", "Medium"),
    "WITHDRAWAL_SPIKE": ("Excess cash outflow; not revenue loss", "Higher player wins, VIP cash-out activity, or a change in payment behavior.",
                         "Review withdrawal concentration, payment methods and liquidity coverage before changing controls.", "Low"),
    "RTP_ANOMALY": ("Wager value affected by RTP variance", None,
                    "Validate settlements, game configuration and sample significance with the provider before escalation.", "Medium"),
    "SUPPLIER_DROP": ("Observed provider GGR gap", None,
                      "Compare game-level volume and RTP, then open a provider review for the largest verified driver.", "Medium"),
    "CAMPAIGN_LOSS": ("Predicted value shortfall versus demo cost", None,
                      "Validate actual media spend and cohort maturity, then pause or redesign the weakest placements.", "Medium"),
    "CONVERSION_DROP": ("Estimated missing first-deposit value", "Registration mix, KYC friction or payment acceptance may be reducing first-deposit completion.",
                        "Break down the funnel by source, KYC status and payment method; repair the largest verified drop-off.", "Medium"),
    "SPORTS_EXPOSURE": ("Concentrated settled handle above threshold", None,
                        "Review limits, bettor concentration and market liabilities with Trading; do not treat settled handle as open liability.", "Low"),
    "REVENUE_CONCENTRATION": ("Revenue concentration above threshold", "A small high-value cohort contributes a disproportionate share of positive observed GGR.",
                              "Create a monitored VIP continuity plan while preserving RG and affordability controls.", "Medium"),
    "FRAUD_SIGNAL": ("Predicted LTV Proxy weighted by fraud risk", "Transaction and behavioral features place these accounts above the manual-review threshold.",
                     "Route cases to Risk for evidence review; suppress CRM actions until cleared.", "High"),
    "RG_SIGNAL": ("Player-safety impact is intentionally not monetized", "Session intensity, deposits or behavioral features place these players above the RG review threshold.",
                  "Prioritize human player-protection review and apply local policy; suppress commercial targeting.", "High"),
}
# ------------------------------------------------------------------------------------

ALERT_COLUMNS = ["market", "rule_id", "severity", "current_metric", "usual_metric", "financial_impact", "probable_cause", "confidence"]


def _d(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def change_ratio(cur, usual) -> F.Column:
    """(current - usual) / |usual|, 0 when usual is 0 or missing."""
    c, u = F.coalesce(_d(cur), F.lit(0.0)), F.coalesce(_d(usual), F.lit(0.0))
    return F.when(u != 0, (c - u) / F.abs(u)).otherwise(F.lit(0.0))


def severity(mag, high: float, critical: float) -> F.Column:
    return F.when(mag >= critical, "Critical").when(mag >= high, "High").otherwise("Medium")


def _alert(df: DataFrame, rule: str, trigger, sev, cur, usual, impact, conf, cause=None) -> DataFrame:
    cause = cause if cause is not None else F.lit(RULE_TEXT[rule][1])
    return df.filter(F.coalesce(trigger, F.lit(False))).select(
        F.col("country").alias("market"), F.lit(rule).alias("rule_id"), sev.alias("severity"),
        _d(cur).alias("current_metric"), _d(usual).alias("usual_metric"), _d(impact).alias("financial_impact"),
        cause.alias("probable_cause"), F.lit(conf).cast("double").alias("confidence") if not isinstance(conf, F.Column) else conf.cast("double").alias("confidence"))


def _two_periods(df: DataFrame, day_col: str, scope: Scope) -> tuple[DataFrame, F.Column]:
    prev = scope.previous()
    rows = df.filter((F.col(day_col) >= prev.lo_date) & (F.col(day_col) < scope.hi_date))
    return rows, F.col(day_col) >= scope.lo_date


def revenue_and_payments(wh, scope: Scope) -> DataFrame:
    """K1 GGR_DROP and K2 WITHDRAWAL_SPIKE from one scan of the executive mart."""
    rows, cur = _two_periods(wh.mart_executive_daily, "metric_date", scope)
    z = dec("0")
    g = rows.groupBy("country").agg(
        F.coalesce(F.sum(F.when(cur, F.col("total_ggr"))), z).alias("ggr"), F.coalesce(F.sum(F.when(~cur, F.col("total_ggr"))), z).alias("ggr0"),
        F.coalesce(F.sum(F.when(cur, F.col("withdrawals"))), z).alias("wd"), F.coalesce(F.sum(F.when(~cur, F.col("withdrawals"))), z).alias("wd0"))
    gc, wc = change_ratio("ggr", "ggr0"), change_ratio("wd", "wd0")
    return _alert(g, "GGR_DROP", gc <= -0.10, severity(-gc, 0.18, 0.30), gc, "ggr0",
                  F.greatest(_d("ggr0") - _d("ggr"), F.lit(0.0)), 0.94).unionByName(
        _alert(g, "WITHDRAWAL_SPIKE", wc >= 0.20, severity(wc, 0.35, 0.60), wc, "wd0",
               F.greatest(_d("wd") - _d("wd0"), F.lit(0.0)), 0.96))


def rtp_anomaly(wh, scope: Scope) -> DataFrame:
    """K3: per market, the game (bets >= 10,000) with the largest |actual - theoretical| RTP."""
    g = (wh.mart_game_performance_daily.filter(scope.date_in("metric_date"))
         .groupBy("country", "game_name", "provider").agg(
             F.sum("bets").alias("bets"), F.sum("payouts").alias("payouts"),
             F.sum(F.col("bets") * F.col("theoretical_rtp")).alias("wt"))
         .filter(F.col("bets") >= 10000))
    actual = F.try_divide(_d("payouts"), _d("bets"))
    expected = F.try_divide(_d("wt"), _d("bets"))
    g = g.select("*", actual.alias("actual_rtp"), expected.alias("expected_rtp"))
    var = F.abs(F.coalesce("actual_rtp", F.lit(0.0)) - F.coalesce("expected_rtp", F.lit(0.0)))
    w = Window.partitionBy("country").orderBy(F.abs(F.col("actual_rtp") - F.col("expected_rtp")).desc_nulls_last(), "game_name", "provider")
    top = g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1).withColumn("variance", var)
    cause = F.concat(F.col("game_name"), F.lit(" ("), F.col("provider"),
                     F.lit(") has the largest statistically material variance in the filtered scope."))
    return _alert(top, "RTP_ANOMALY", F.col("variance") >= 0.02, severity(F.col("variance"), 0.035, 0.05),
                  "actual_rtp", "expected_rtp", F.col("variance") * _d("bets"), 0.91, cause)


def supplier_drop(wh, scope: Scope) -> DataFrame:
    """K4: provider present in both periods with the worst GGR change (prior 0 ignored)."""
    rows, cur = _two_periods(wh.mart_game_performance_daily, "metric_date", scope)
    g = rows.groupBy("country", "provider").agg(
        F.sum(F.when(cur, F.col("ggr"))).alias("ggr"), F.sum(F.when(~cur, F.col("ggr"))).alias("ggr0"),
        F.count(F.when(cur, 1)).alias("n"), F.count(F.when(~cur, 1)).alias("n0"))
    g = g.filter((F.col("n") > 0) & (F.col("n0") > 0) & (F.col("ggr0") != 0))
    g = g.withColumn("change", (_d("ggr") - _d("ggr0")) / F.abs(_d("ggr0")))
    w = Window.partitionBy("country").orderBy("change", "provider")
    top = g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1)
    cause = F.concat(F.col("provider"), F.lit(" lost the most momentum, potentially from traffic mix, game availability or payout variance."))
    return _alert(top, "SUPPLIER_DROP", F.col("change") <= -0.15, severity(-F.col("change"), 0.25, 0.40), "change", "ggr0",
                  F.greatest(_d("ggr0") - _d("ggr"), F.lit(0.0)), 0.88, cause)


def campaign_loss(wh, scope: Scope) -> DataFrame:
    """K5: per market, the channel with the lowest predicted ROAS among players registered in scope."""
    p = wh.players.filter(scope.ts_in("registration_date")).select("player_id", "country", "channel")
    v = wh.v_player_scores.select("player_id", "predicted_ltv_90d")
    g = p.join(v, "player_id").groupBy("country", "channel").agg(
        F.sum(channel_cost()).alias("cost"), F.sum("predicted_ltv_90d").alias("value"))
    g = g.withColumn("roas", F.try_divide(_d("value"), _d("cost")))
    w = Window.partitionBy("country").orderBy(F.col("roas").asc_nulls_first(), "channel")
    top = g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1)
    roas = F.coalesce(F.col("roas"), F.lit(99.0))
    cause = F.concat(F.col("channel"), F.lit(" combines the weakest predicted LTV Proxy with its estimated channel acquisition cost."))
    return _alert(top, "CAMPAIGN_LOSS", roas < 1.5, F.when(F.coalesce(F.col("roas"), F.lit(0.0)) < 1, "Critical").otherwise("High"),
                  F.coalesce(F.col("roas"), F.lit(0.0)), F.lit(1.5), F.greatest(_d("cost") - _d("value"), F.lit(0.0)), 0.78, cause)


def conversion_drop(wh, scope: Scope) -> DataFrame:
    """K6: FTD / registrations falls by >= 15 %; impact = missing FTD x mean approved deposit."""
    rows, cur = _two_periods(wh.mart_acquisition_daily, "metric_date", scope)
    g = rows.groupBy("country").agg(
        F.sum(F.when(cur, F.col("ftd"))).alias("ftd"), F.sum(F.when(cur, F.col("registrations"))).alias("regs"),
        F.sum(F.when(~cur, F.col("ftd"))).alias("ftd0"), F.sum(F.when(~cur, F.col("registrations"))).alias("regs0"))
    conv, conv0 = F.try_divide(_d("ftd"), _d("regs")), F.try_divide(_d("ftd0"), _d("regs0"))
    g = g.select("*", conv.alias("conv"), conv0.alias("conv0"))
    dep = (wh.v_transactions_enriched.filter(scope.date_in("transaction_day") & (F.col("transaction_type") == "Deposit")
                                             & (F.col("transaction_status") == "Approved"))
           .groupBy("country").agg((F.sum("amount").cast("double") / F.count(F.lit(1))).alias("avg_dep")))
    g = g.join(dep, "country", "left")
    decline = -change_ratio("conv", "conv0")
    missing = F.greatest(F.coalesce(_d("regs"), F.lit(0.0)) * F.coalesce("conv0", F.lit(0.0)) - F.coalesce(_d("ftd"), F.lit(0.0)), F.lit(0.0))
    return _alert(g, "CONVERSION_DROP", decline >= 0.15, severity(decline, 0.25, 0.40), F.coalesce("conv", F.lit(0.0)),
                  F.coalesce("conv0", F.lit(0.0)), missing * F.coalesce("avg_dep", F.lit(0.0)), 0.90)


def sports_exposure(wh, scope: Scope) -> DataFrame:
    """K7: the event with the largest handle holds >= 35 % of the market's handle."""
    e = (wh.v_sports_bets_enriched.filter(scope.date_in("bet_day"))
         .groupBy("country", "event_name").agg(F.sum("stake").alias("handle")))
    totals = e.groupBy("country").agg(F.sum("handle").alias("total"))  # one row per market
    w = Window.partitionBy("country").orderBy(F.desc("handle"), "event_name")
    top = (e.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1)  # WindowGroupLimit: top 1 per market
           .join(totals, "country").withColumn("share", F.try_divide(_d("handle"), _d("total"))))
    share = F.coalesce(F.col("share"), F.lit(0.0))
    cause = F.concat(F.col("event_name"), F.lit(" concentrates an unusually large portion of handle in the selected scope."))
    return _alert(top, "SPORTS_EXPOSURE", share >= 0.35, severity(share, 0.45, 0.60), share, F.lit(0.35),
                  _d("handle") * F.greatest(share - 0.35, F.lit(0.0)), 0.97, cause)


def revenue_concentration(wh, scope: Scope) -> DataFrame:
    """K8: top-10 players' share of positive player GGR per market.

    The top ten come from ``row_number() <= 10`` per market, which Spark plans with a
    partial WindowGroupLimit before the shuffle, so no market is sorted whole in one task.
    """
    g = (wh.v_sessions_enriched.filter(scope.date_in("session_date")).select("player_id", "country", F.col("casino_ggr").alias("g"))
         .unionByName(wh.v_sports_bets_enriched.filter(scope.date_in("bet_day")).select("player_id", "country", F.col("sportsbook_ggr").alias("g")))
         .groupBy("country", "player_id").agg(F.sum("g").alias("ggr")))
    pos = max2(F.col("ggr"), dec("0"))
    w = Window.partitionBy("country").orderBy(F.desc("ggr"), "player_id")
    top = (g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= 10)
           .groupBy("country").agg(F.sum(pos).alias("top_ggr")))
    total = g.groupBy("country").agg(F.sum(pos).alias("total_ggr"))
    c = top.join(total, "country").withColumn("share", F.try_divide(_d("top_ggr"), _d("total_ggr")))
    share = F.coalesce(F.col("share"), F.lit(0.0))
    return _alert(c, "REVENUE_CONCENTRATION", share >= 0.25, severity(share, 0.35, 0.50), share, F.lit(0.25),
                  _d("top_ggr") * F.greatest(share - 0.25, F.lit(0.0)), 0.95)


def player_risk(wh, scope: Scope) -> DataFrame:
    """K9 FRAUD_SIGNAL and K10 RG_SIGNAL over players active on either product in scope."""
    act = wh.int_player_activity_daily.filter(scope.date_in("activity_date")).select("player_id")
    v = wh.v_player_scores.join(act, "player_id", "left_semi")
    f, r = F.col("fraud_risk") >= 0.55, F.col("rg_risk") >= 0.55
    g = v.groupBy("country").agg(
        F.count(F.lit(1)).alias("active"), F.count(F.when(f, 1)).alias("fraud_cases"), F.count(F.when(r, 1)).alias("rg_cases"),
        F.coalesce(F.sum(F.when(f, F.col("predicted_ltv_90d") * F.col("fraud_risk"))), dec("0")).alias("fraud_impact"),
        (F.sum(F.when(f, F.col("model_confidence"))).cast("double") / F.count(F.when(f, 1))).alias("fraud_conf"),
        (F.sum(F.when(r, F.col("model_confidence"))).cast("double") / F.count(F.when(r, 1))).alias("rg_conf"))
    active = F.greatest(F.col("active"), F.lit(1)).cast("double")
    fr, rr = F.col("fraud_cases") / active, F.col("rg_cases") / active
    return _alert(g, "FRAUD_SIGNAL", F.col("fraud_cases") > 0, severity(fr, 0.08, 0.15), "fraud_cases", F.lit(0.55),
                  "fraud_impact", F.coalesce("fraud_conf", F.lit(0.70))).unionByName(
        _alert(g, "RG_SIGNAL", F.col("rg_cases") > 0, severity(rr, 0.08, 0.15), "rg_cases", F.lit(0.55),
               F.lit(0.0), F.coalesce("rg_conf", F.lit(0.70))))


RULES = (revenue_and_payments, rtp_anomaly, supplier_drop, campaign_loss, conversion_drop, sports_exposure,
         revenue_concentration, player_risk)


def alerts(wh, scope: Scope) -> DataFrame:
    """All alerts for the scope (every market when the scope is all markets), ordered."""
    raw = reduce(DataFrame.unionByName, [rule(wh, scope) for rule in RULES])
    if not scope.all_markets:
        raw = raw.filter(F.col("market") == scope.country)
    cat = wh.spark.createDataFrame(
        [(k, v[0], v[1], v[2], RULE_TEXT[k][0], RULE_TEXT[k][1], RULE_TEXT[k][2], RULE_TEXT[k][3]) for k, v in RULE_CATALOG.items()],
        "rule_id string, title string, kpi string, team string, impact_note string, default_cause string, recommendation string, effort string")
    sev = F.col("severity")
    detected = scope.end_day.strftime("%d %b %Y")
    start = scope.start_day.strftime("%d %b %Y")
    share = F.lit(OTHER_RECOVERY_SHARE)
    for name, value in reversed(list(RECOVERY_SHARE.items())):
        share = F.when(sev == name, F.lit(value)).otherwise(share)
    rank = F.when(sev == "Critical", 0).when(sev == "High", 1).when(sev == "Medium", 2).otherwise(3)
    return (raw.join(F.broadcast(cat), "rule_id")  # ten-row rule catalog
            .select(
                "rule_id", "title", "severity", "kpi", "current_metric", "usual_metric", "financial_impact", "impact_note",
                F.coalesce("probable_cause", "default_cause").alias("probable_cause"), "recommendation", "team", "effort",
                F.when(sev == "Critical", "P0").when(sev == "High", "P1").otherwise("P2").alias("priority"),
                "confidence", F.lit(detected).alias("detected_at"), "market", F.lit(start).alias("period_start"),
                F.concat_ws(":", "rule_id", "market", F.lit(start), F.lit(detected)).alias("workflow_id"),
                (F.greatest(F.col("financial_impact"), F.lit(0.0)) * share).alias("revenue_potential"),
                rank.alias("severity_rank"))
            .orderBy("severity_rank", F.desc("financial_impact"), "market", "rule_id"))


def top_alerts(alerts_df: DataFrame, teams: list[str] | None = None, limit: int = 6) -> DataFrame:
    """The worst market per rule (severity, then impact), optionally for some teams, top ``limit``."""
    a = alerts_df if teams is None else alerts_df.filter(F.col("team").isin(*teams))
    w = Window.partitionBy("rule_id").orderBy("severity_rank", F.desc("financial_impact"), "market")
    return (a.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1).drop("rk")
            .orderBy("severity_rank", F.desc("financial_impact"), "rule_id").limit(limit))


CHANGE_COLUMNS = ("workflow_id", "status", "result", "changed_at", "change_id")


def latest_statuses(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The newest change of every workflow, of ``changes`` and of the statuses ``known`` before.

    The change with the greatest (changed_at, change_id) wins, in whatever order changes arrive, so a
    redelivered or late change leaves the result as it is.
    """
    rows = changes.select(*CHANGE_COLUMNS)
    if known is not None:
        rows = rows.unionByName(known.select(*CHANGE_COLUMNS))
    newest = rows.groupBy("workflow_id").agg(F.max(F.struct("changed_at", "change_id", "status", "result")).alias("newest"))
    return newest.select("workflow_id", "newest.status", "newest.result", "newest.changed_at", "newest.change_id")


def save_changes(spark, root: str, changes: DataFrame) -> DataFrame:
    """Merge status changes into the register's table under ``root`` and publish it as a new version."""
    before = publish.active(spark, root)
    known = publish.open_tables(spark, before[1])["statuses"] if before else None
    version = uuid.uuid4().hex[:12]
    path = f"{root.rstrip('/')}/register_{version}"
    merged = latest_statuses(changes, known)
    merged.write.parquet(f"{path}/statuses")
    publish.write_manifest(spark, path, version, {"statuses": spark.read.schema(merged.schema).parquet(f"{path}/statuses")})
    publish.point_to(spark, root.rstrip("/"), version, path, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    return publish.open_tables(spark, path)["statuses"]


def alert_register(alerts_df: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Alerts with their workflow status (default New) and result."""
    if statuses is None:
        return alerts_df.withColumns({"status": F.lit(STATUS_ORDER[0]), "result": F.lit("")})
    a = alerts_df.join(statuses.select("workflow_id", "status", "result"), "workflow_id", "left")
    return a.withColumns({"status": F.coalesce("status", F.lit(STATUS_ORDER[0])), "result": F.coalesce("result", F.lit(""))})


def register_kpis(register: DataFrame) -> DataFrame:
    """What is not resolved (alerts, critical ones, impact, potential), and how many were reviewed."""
    active = F.col("status") != "Resolved"
    total = lambda c: F.round(F.coalesce(F.sum(F.when(active, F.col(c))), F.lit(0.0)), 6)
    return register.agg(
        F.count(F.when(active, 1)).alias("active_alerts"),
        F.count(F.when(active & (F.col("severity") == "Critical"), 1)).alias("critical_alerts"),
        total("financial_impact").alias("financial_impact"), total("revenue_potential").alias("revenue_potential"),
        F.count(F.when(F.col("status").isin("Reviewed", "Resolved"), 1)).alias("reviewed"))


def recovery_by_team(alerts_df: DataFrame) -> DataFrame:
    """K17."""
    return (alerts_df.groupBy("team").agg(F.round(F.sum("revenue_potential"), 6).alias("revenue_potential"))
            .orderBy(F.desc("revenue_potential"), "team"))


def rule_governance(alerts_df: DataFrame) -> DataFrame:
    """Every rule in the catalog, Triggered or Within threshold."""
    spark = alerts_df.sparkSession
    cat = spark.createDataFrame([(k, v[0], v[2], v[3]) for k, v in RULE_CATALOG.items()],
                                "rule_id string, title string, team string, definition string")
    hit = alerts_df.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"))
    return (cat.join(hit, "rule_id", "left").select(
        "rule_id", "title", "team", "definition", F.coalesce("alerts", F.lit(0)).cast("bigint").alias("alerts"),
        F.when(F.col("alerts") > 0, "Triggered").otherwise("Within threshold").alias("state")).orderBy("rule_id"))


def alert_queue(register: DataFrame, severities=None, statuses=None, teams=None) -> DataFrame:
    """Register filtered by severity, status and team."""
    r = register
    for col, values in (("severity", severities), ("status", statuses), ("team", teams)):
        if values:
            r = r.filter(F.col(col).isin(*values))
    return r
