"""Registered semantic-layer requests (L) with oracle SQL written from the catalog definitions."""

from __future__ import annotations

from croupier.catalog import MARKET, S_HALF, S_MAIN, register
from croupier.oracle import q, scores_ctes
from croupier.plans import semantic as sem

SC = scores_ctes("2000-03-31")

# Oracle-side catalog: table, DATE filter column, dimension SQL, metric SQL.
SQL_DATASETS = {
    "executive": ("mart_executive_daily", "metric_date",
                  {"country": "country", "day": "metric_date", "month": "strftime(metric_date, '%Y-%m')",
                   "week": "strftime(metric_date, '%Y-W%W')"},
                  {"ggr": "CAST(SUM(total_ggr) AS DOUBLE)", "estimated_ngr": "CAST(SUM(estimated_ngr) AS DOUBLE)",
                   "deposits": "CAST(SUM(deposits) AS DOUBLE)", "withdrawals": "CAST(SUM(withdrawals) AS DOUBLE)",
                   "wagers": "CAST(SUM(total_wagers) AS DOUBLE)",
                   "margin": "CAST(SUM(total_ggr) AS DOUBLE) / NULLIF(CAST(SUM(total_wagers) AS DOUBLE), 0)"}),
    "casino": ("mart_game_performance_daily", "metric_date",
               {"country": "country", "game": "game_name", "provider": "provider", "game_family": "game_family",
                "month": "strftime(metric_date, '%Y-%m')"},
               {"ggr": "CAST(SUM(ggr) AS DOUBLE)", "bets": "CAST(SUM(bets) AS DOUBLE)", "sessions": "CAST(SUM(sessions) AS BIGINT)",
                "players": "CAST(SUM(active_players) AS BIGINT)",
                "rtp": "CAST(SUM(payouts) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0)",
                "margin": "CAST(SUM(ggr) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0)"}),
    "sportsbook": ("v_sports_bets_enriched", "bet_date",
                   {"country": "country", "sport": "sport", "event": "event_name", "vip_level": "vip_level",
                    "day": "CAST(bet_date AS DATE)", "month": "strftime(bet_date, '%Y-%m')"},
                   {"ggr": "CAST(SUM(sportsbook_ggr) AS DOUBLE)", "handle": "CAST(SUM(stake) AS DOUBLE)", "payout": "CAST(SUM(payout) AS DOUBLE)",
                    "bets": "COUNT(*)", "hold": "CAST(SUM(sportsbook_ggr) AS DOUBLE) / NULLIF(CAST(SUM(stake) AS DOUBLE), 0)"}),
    "payments": ("v_transactions_enriched", "transaction_date",
                 {"country": "country", "payment_method": "payment_method", "status": "transaction_status",
                  "transaction_type": "transaction_type", "channel": "channel"},
                 {"volume": "CAST(SUM(amount) AS DOUBLE)", "transactions": "COUNT(*)",
                  "approval_rate": "AVG(CASE WHEN transaction_status = 'Approved' THEN 1.0 ELSE 0.0 END::DOUBLE)",
                  "fees": "CAST(SUM(processing_fee) AS DOUBLE)",
                  "deposits": "CAST(SUM(CASE WHEN transaction_type = 'Deposit' AND transaction_status = 'Approved' THEN amount ELSE 0 END) AS DOUBLE)"}),
    "acquisition": ("mart_acquisition_daily", "metric_date", {"country": "country", "channel": "channel", "day": "metric_date"},
                    {"registrations": "CAST(SUM(registrations) AS BIGINT)", "ftd": "CAST(SUM(ftd) AS BIGINT)", "kyc": "CAST(SUM(kyc_verified) AS BIGINT)",
                     "conversion": "CAST(SUM(ftd) AS DOUBLE) / NULLIF(CAST(SUM(registrations) AS DOUBLE), 0)"}),
    "players": ("v_player_scores", None, {"country": "country", "vip_level": "vip_level", "channel": "channel", "age_group": "age_group"},
                {"players": "COUNT(DISTINCT player_id)", "lifetime_ggr": "CAST(SUM(lifetime_ggr) AS DOUBLE)",
                 "ltv": "CAST(SUM(predicted_ltv_90d) AS DOUBLE)", "churn": "CAST(SUM(churn_probability) AS DOUBLE) / COUNT(churn_probability)",
                 "fraud": "CAST(SUM(fraud_risk) AS DOUBLE) / COUNT(fraud_risk)", "rg": "CAST(SUM(rg_risk) AS DOUBLE) / COUNT(rg_risk)"}),
    "player_activity": ("v_player_activity_enriched", "activity_date",
                        {"country": "country", "week": "strftime(activity_date, '%Y-W%W')", "month": "strftime(activity_date, '%Y-%m')"},
                        {"active_players": "COUNT(DISTINCT player_id)"}),
}


def plan_sql(plan: sem.QueryPlan, s) -> str:
    table, date_field, dims, mets = SQL_DATASETS[plan.dataset]
    sel = [f'{dims[d]} AS "{sem.dimension_label(d)}"' for d in plan.dimensions] + [f'{mets[m]} AS "{m}"' for m in plan.metrics]
    where = ["TRUE"]
    if date_field:
        where.append(f"CAST({date_field} AS DATE) >= DATE '{s.start}' AND CAST({date_field} AS DATE) < DATE '{s.bound_day.isoformat()}'")
    if not s.all_markets:
        where.append(f"country = '{s.country}'")
    for dim, value in plan.filters:
        where.append(f"{dims[dim]} = '{value}'")
    group = f" GROUP BY {', '.join(str(i + 1) for i in range(len(plan.dimensions)))}" if plan.dimensions else ""
    nulls = "NULLS FIRST" if plan.order_direction == "ASC" else "NULLS LAST"
    ties = "".join(f', "{sem.dimension_label(d)}"' for d in plan.dimensions)
    return (f"SELECT {', '.join(sel)} FROM {table} WHERE {' AND '.join(where)}{group} "
            f'ORDER BY "{plan.order_metric}" {plan.order_direction} {nulls}{ties}' + (f" LIMIT {plan.limit}" if plan.limit is not None else ""))


PLANS = {
    "executive_by_country": (sem.QueryPlan("executive", ("country",), ("ggr", "estimated_ngr", "margin"), "ggr", "DESC", 10), S_MAIN),
    "executive_by_week": (sem.QueryPlan("executive", ("week",), ("ggr", "wagers"), "ggr", "DESC", 100), S_MAIN),
    "executive_by_day_market": (sem.QueryPlan("executive", ("day",), ("deposits", "withdrawals"), "deposits", "ASC", 100),
                                S_MAIN.with_country(MARKET)),
    "casino_by_game_provider": (sem.QueryPlan("casino", ("game", "provider"), ("ggr", "rtp", "players"), "ggr", "DESC", 10), S_MAIN),
    "casino_by_month_filtered": (sem.QueryPlan("casino", ("month",), ("bets", "margin"), "bets", "DESC", 100, "table",
                                               (("provider", "Evolution"),)), S_MAIN),
    "sportsbook_by_sport_vip": (sem.QueryPlan("sportsbook", ("sport", "vip_level"), ("handle", "hold", "bets"), "handle", "DESC", 100), S_HALF),
    "sportsbook_top_events": (sem.QueryPlan("sportsbook", ("event",), ("handle",), "handle", "DESC", 10), S_MAIN),
    "payments_by_method_status": (sem.QueryPlan("payments", ("payment_method", "status"), ("volume", "approval_rate", "fees"), "volume", "DESC", 100), S_MAIN),
    "acquisition_by_channel": (sem.QueryPlan("acquisition", ("channel",), ("registrations", "ftd", "conversion"), "ftd", "DESC", 100), S_MAIN),
    "players_by_vip": (sem.QueryPlan("players", ("vip_level",), ("players", "ltv", "churn"), "players", "DESC", 100), S_MAIN),
    "players_risk_by_country": (sem.QueryPlan("players", ("country",), ("fraud", "rg", "churn"), "fraud", "DESC", 100), S_MAIN),
    "activity_by_week": (sem.QueryPlan("player_activity", ("week",), ("active_players",), "active_players", "DESC", 100), S_MAIN),
    "activity_total_market": (sem.QueryPlan("player_activity", (), ("active_players",), "active_players", "DESC", 1),
                              S_MAIN.with_country(MARKET)),
}

for name, (plan, s) in PLANS.items():
    register(f"semantic_{name}", lambda wh, plan=plan, s=s: sem.compile_plan(wh, plan, s),
             q(plan_sql(plan, s), SC) if plan.dataset == "players" else q(plan_sql(plan, s)))


def kpi_sql(dataset: str, metric: str, s, previous: bool = True) -> str:
    label = sem.DATASETS[dataset].metrics[metric].label
    cur = plan_sql(sem.QueryPlan(dataset, (), (metric,), metric, "DESC", 1), s)
    prev = plan_sql(sem.QueryPlan(dataset, (), (metric,), metric, "DESC", 1), s.previous()) if previous else "SELECT NULL::DOUBLE"
    return f"SELECT '{label}' AS label, ({cur}) AS current_value, ({prev}) AS previous_value"


for ds, m in (("executive", "ggr"), ("executive", "estimated_ngr"), ("player_activity", "active_players"), ("payments", "approval_rate"),
              ("acquisition", "conversion")):
    register(f"semantic_kpi_{ds}_{m}", lambda wh, ds=ds, m=m: sem.kpi(wh, ds, m, S_MAIN), q(kpi_sql(ds, m, S_MAIN)))

register("semantic_distinct_providers", lambda wh: sem.distinct_values(wh, "casino", "provider"), q("""
SELECT DISTINCT CAST(provider AS VARCHAR) AS value FROM mart_game_performance_daily WHERE provider IS NOT NULL"""))
register("semantic_distinct_events", lambda wh: sem.distinct_values(wh, "sportsbook", "event"), q("""
SELECT DISTINCT CAST(event_name AS VARCHAR) AS value FROM v_sports_bets_enriched WHERE event_name IS NOT NULL"""))


# ---- templates (L13): one oracle SELECT per widget, one Spark scan per dataset -----------------
def widget_sql(i: int, w: sem.Widget, s) -> str:
    head = f"SELECT CAST({i} AS INT) AS widget, '{w.title}' AS title"
    if w.type == "kpi":
        one = kpi_sql(w.dataset, w.measures[0], s, w.comparison == "previous_period" and SQL_DATASETS[w.dataset][1] is not None)
        return (f"{head}, CAST(1 AS INT) AS place, CAST(NULL AS VARCHAR) AS label, '{w.measures[0]}' AS measure, CAST(current_value AS DOUBLE) AS value, "
                f"CAST(previous_value AS DOUBLE) AS previous_value FROM ({one})")
    rows = plan_sql(sem.QueryPlan(w.dataset, (w.dimension,), w.measures, w.measures[0]), s)
    label, listed = sem.dimension_label(w.dimension), ", ".join(f"'{m}'" for m in w.measures)
    ranked = (f'SELECT *, COALESCE(CAST("{label}" AS VARCHAR), \'\') AS named, dense_rank() OVER (ORDER BY "{w.measures[0]}" DESC NULLS LAST, '
              f'COALESCE(CAST("{label}" AS VARCHAR), \'\')) AS spot FROM ({rows})')
    values = ", ".join(f'CAST("{m}" AS DOUBLE)' for m in w.measures)
    return (f"{head}, CAST(spot AS INT), named, unnest([{listed}]), unnest([{values}]), CAST(NULL AS DOUBLE) FROM ({ranked})"
            + (f" WHERE spot <= {w.top_n}" if w.top_n else ""))


for _key, (_, _widgets) in sem.TEMPLATES.items():
    _sql = " UNION ALL ".join(f"({widget_sql(i, w, S_MAIN)})" for i, w in enumerate(_widgets))
    register(f"template_{_key}", lambda wh, k=_key: sem.template_rows(wh, k, S_MAIN),
             q(_sql, SC) if any(w.dataset == "players" for w in _widgets) else q(_sql))
register("template_revenue_market_half", lambda wh: sem.template_rows(wh, "revenue", S_HALF.with_country(MARKET)),
         q(" UNION ALL ".join(f"({widget_sql(i, w, S_HALF.with_country(MARKET))})" for i, w in enumerate(sem.TEMPLATES["revenue"][1]))))
