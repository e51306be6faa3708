"""Registered page-level derived metrics (J) with oracle SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from croupier.catalog import MARKET, S_MAIN, d_in, mk, register, t_in
from croupier.catalog_scores import player_base_cte
from croupier.oracle import q, scores_ctes
from croupier.queries import casino, finance, pages

SC = scores_ctes("2000-03-31")
FLAGS = [pages._flag(n) for n in pages.SEGMENTS]


def players_sql(s) -> str:
    """CTEs ``pp`` (players with previous period and derived columns) and ``seg`` (flags, tags)."""
    cur, prev = player_base_cte(s, "cur"), player_base_cte(s.previous(), "prv")
    flags = {
        "VIP active": "vip_level IN ('Gold', 'Platinum') AND activity > 0",
        "VIP at risk": "vip_level IN ('Gold', 'Platinum') AND churn_probability >= 0.70",
        "New FTD": t_in("ftd_date", s),
        "Growing players": "period_ggr > previous_ggr * 1.25 AND previous_ggr > 0",
        "Became inactive": "activity = 0 AND previous_activity > 0",
        "Potential bonus abuse": "deposit_count >= dep AND fraud_risk >= 0.35 AND fraud_risk < 0.55",
        "RG risk": "rg_risk >= 0.55",
        "High future value": "predicted_total_ltv_180d >= fut",
    }
    flag_cols = ", ".join(f"COALESCE({c}, FALSE) AS {pages._flag(n)}" for n, c in flags.items())
    tags = ", ".join(f"CASE WHEN {pages._flag(n)} THEN '{n}' END" for n in pages.SEGMENTS)
    return cur + "," + prev + f""",
pp AS (
  SELECT c.*, COALESCE(pv.sessions, 0) AS previous_sessions, COALESCE(pv.sports_bets, 0) AS previous_sports_bets,
         COALESCE(pv.casino_ggr, 0.0) AS previous_casino_ggr, COALESCE(pv.sports_ggr, 0.0) AS previous_sports_ggr,
         c.casino_ggr + c.sports_ggr AS period_ggr, COALESCE(pv.casino_ggr, 0.0) + COALESCE(pv.sports_ggr, 0.0) AS previous_ggr,
         c.sessions + c.sports_bets AS activity, COALESCE(pv.sessions, 0) + COALESCE(pv.sports_bets, 0) AS previous_activity,
         CAST(GREATEST(COALESCE(date_diff('day', CAST(c.last_activity AS DATE), DATE '{s.end}'), 999), 0) AS INTEGER) AS recency_days
  FROM cur_player_base c LEFT JOIN prv_player_base pv USING (player_id)),
cut AS (
  SELECT GREATEST(COALESCE(quantile_cont(period_ggr, 0.70) FILTER (WHERE period_ggr > 0), 0.0), 1.0) AS mon,
         GREATEST(COALESCE(quantile_cont(activity, 0.70) FILTER (WHERE activity > 0), 0.0), 1.0) AS freq,
         GREATEST(COALESCE(quantile_cont(deposit_count, 0.85), 0.0), 2.0) AS dep,
         quantile_cont(predicted_total_ltv_180d, 0.90) AS fut FROM pp),
seg0 AS (
  SELECT pp.*, CASE WHEN recency_days > 60 THEN 'Dormant'
                    WHEN recency_days <= 7 AND activity >= freq AND period_ggr >= mon THEN 'Champion'
                    WHEN recency_days <= 14 AND activity >= freq THEN 'Loyal'
                    WHEN recency_days <= 30 AND activity > 0 THEN 'Active' ELSE 'At risk' END AS rfm_segment,
         {flag_cols}
  FROM pp, cut),
seg AS (
  SELECT *, CASE WHEN concat_ws(', ', {tags}) = '' THEN 'Standard' ELSE concat_ws(', ', {tags}) END AS segment_tags,
         (fraud_risk < 0.55 AND rg_risk < 0.55 AND kyc_status = 'Verified') AS crm_eligible
  FROM seg0)"""


PREP_COLS = ["player_id", "rfm_segment", "recency_days", "period_ggr", "previous_ggr", "activity", "previous_activity",
             "segment_tags", "crm_eligible"] + FLAGS

for tag, s in (("", S_MAIN), ("_market", S_MAIN.with_country(MARKET))):
    register(f"pages_prepare_players{tag}", lambda wh, s=s: pages.prepare_players(wh, s).select(*PREP_COLS),
             q(f"SELECT {', '.join(PREP_COLS)} FROM seg", SC + "," + players_sql(s)))
    seg_rows = " UNION ALL ".join(
        f"SELECT '{n}' AS segment, COUNT(*) FILTER (WHERE {pages._flag(n)}) AS players, "
        f"CAST(COALESCE(SUM(CASE WHEN {pages._flag(n)} THEN CAST(predicted_total_ltv_180d AS DECIMAL(24,6)) ELSE 0 END), 0) AS DOUBLE) AS value_at_stake FROM seg"
        for n in pages.SEGMENTS)
    register(f"pages_segment_sizes{tag}", lambda wh, s=s: pages.segment_sizes(pages.prepare_players(wh, s)),
             q(seg_rows, SC + "," + players_sql(s)))
    register(f"pages_crm_export{tag}", lambda wh, s=s: pages.crm_export(pages.prepare_players(wh, s)),
             q(f"SELECT {', '.join(pages.EXPORT_COLUMNS)} FROM seg WHERE crm_eligible", SC + "," + players_sql(s)))
    register(f"pages_portfolio{tag}", lambda wh, s=s: pages.portfolio(pages.prepare_players(wh, s)),
             q(f"SELECT {', '.join(pages.PORTFOLIO_COLUMNS)} FROM seg ORDER BY rg_risk DESC, churn_probability DESC, "
               f"predicted_ltv_90d DESC, player_id LIMIT 250", SC + "," + players_sql(s)))
    register(f"pages_behaviour{tag}", lambda wh, s=s: pages.behaviour(pages.prepare_players(wh, s), s), q(f"""
SELECT player_id, sessions / {max(s.days, 1)} * 30 AS sessions_per_30d, minutes / GREATEST(sessions, 1) AS avg_session_minutes,
       deposits - withdrawals AS net_cash_flow, rg_risk >= 0.55 AS rg_review, sessions / {max(s.days, 1)} * 30 >= 20 AS high_session_frequency,
       minutes / GREATEST(sessions, 1) >= 75 AS long_average_sessions, rg_risk >= 0.55 AS marketing_suppression FROM seg""",
                                                                                                      SC + "," + players_sql(s)))
    register(f"pages_scatter_sample{tag}", lambda wh, s=s: pages.scatter_sample(pages.prepare_players(wh, s)), q(f"""
SELECT player_id, vip_level, churn_probability, predicted_total_ltv_180d, GREATEST(lifetime_ggr, 0.0) + 1 AS bubble_size FROM seg""", SC + "," + players_sql(s)))
    register(f"pages_scatter_draw{tag}", lambda wh, s=s: pages.scatter_sample(pages.prepare_players(wh, s), points=100), q(f"""
SELECT player_id, vip_level, churn_probability, predicted_total_ltv_180d, GREATEST(lifetime_ggr, 0.0) + 1 AS bubble_size FROM seg
ORDER BY sha256('{pages.SCATTER_SEED}:' || player_id), player_id LIMIT 100""", SC + "," + players_sql(s)))

register("pages_peer_comparison_vip_active", lambda wh: pages.peer_comparison(pages.prepare_players(wh, S_MAIN), "VIP active"), q("""
SELECT player_id, lifetime_ggr, predicted_total_ltv_180d, churn_probability, rg_risk,
  lifetime_ggr / NULLIF(CAST(SUM(CAST(lifetime_ggr AS DECIMAL(24,6))) OVER () AS DOUBLE) / COUNT(lifetime_ggr) OVER (), 0) AS lifetime_ggr_vs_segment,
  predicted_total_ltv_180d / NULLIF(CAST(SUM(CAST(predicted_total_ltv_180d AS DECIMAL(24,6))) OVER () AS DOUBLE) / COUNT(predicted_total_ltv_180d) OVER (), 0) AS predicted_total_ltv_180d_vs_segment,
  churn_probability / NULLIF(CAST(SUM(CAST(churn_probability AS DECIMAL(24,6))) OVER () AS DOUBLE) / COUNT(churn_probability) OVER (), 0) AS churn_probability_vs_segment,
  rg_risk / NULLIF(CAST(SUM(CAST(rg_risk AS DECIMAL(24,6))) OVER () AS DOUBLE) / COUNT(rg_risk) OVER (), 0) AS rg_risk_vs_segment
FROM seg WHERE is_vip_active""", SC + "," + players_sql(S_MAIN)))

def _objectives_sql(s) -> str:
    from croupier.catalog_entries import perf_sql

    def row(k, up):
        obj = f"CASE WHEN COALESCE(CAST(p.{k} AS DOUBLE), 0.0) > 0 THEN CAST(p.{k} AS DOUBLE) * {up} ELSE GREATEST(COALESCE(CAST(c.{k} AS DOUBLE), 0.0), 1.0) END"
        return (f"SELECT '{k}' AS kpi, CAST(c.{k} AS DOUBLE) AS current, CAST(p.{k} AS DOUBLE) AS previous, {obj} AS objective, "
                f"LEAST(GREATEST(CAST(c.{k} AS DOUBLE) / ({obj}), 0.0), 1.0) AS progress FROM c, p")
    rows = [row(k, up) for k, up in (("ggr", 1.05), ("ngr", 1.05), ("players", 1.03), ("deposits", 1.05), ("ftd", 1.05))]
    rows.append("SELECT 'hold', CASE WHEN c.wagers <> 0 THEN c.ggr / c.wagers ELSE 0.0 END, CASE WHEN p.wagers <> 0 THEN p.ggr / p.wagers ELSE 0.0 END, "
                "0.07, LEAST(GREATEST((CASE WHEN c.wagers <> 0 THEN c.ggr / c.wagers ELSE 0.0 END) / 0.07, 0.0), 1.0) FROM c, p")
    return (f"WITH c AS ({perf_sql(s)}), p AS ({perf_sql(s.previous())}), o AS ({' UNION ALL '.join(rows)}) "
            "SELECT *, CASE WHEN current IS NULL OR previous IS NULL OR abs(previous) < 1e-12 THEN NULL "
            "ELSE (current - previous) / abs(previous) END AS delta FROM o")


register("pages_objectives", lambda wh: pages.objectives(wh, S_MAIN), q(_objectives_sql(S_MAIN)))
register("pages_timeline_recent", lambda wh: pages.timeline_recent(wh), q("""
SELECT player_id, event_date, deposits, withdrawals, casino_ggr, sports_ggr, events, total_ggr FROM (
  SELECT *, casino_ggr + sports_ggr AS total_ggr, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY event_date DESC) AS rk FROM (
    SELECT player_id, event_date, CAST(SUM(deposits) AS DOUBLE) AS deposits, CAST(SUM(withdrawals) AS DOUBLE) AS withdrawals,
           CAST(SUM(casino_ggr) AS DOUBLE) AS casino_ggr, CAST(SUM(sports_ggr) AS DOUBLE) AS sports_ggr, CAST(SUM(events) AS BIGINT) AS events FROM (
      SELECT player_id, CAST(session_start AS DATE) AS event_date, 0 AS deposits, 0 AS withdrawals, SUM(casino_ggr) AS casino_ggr, 0 AS sports_ggr, COUNT(*) AS events
      FROM fact_casino_session GROUP BY 1, 2
      UNION ALL SELECT player_id, CAST(bet_date AS DATE), 0, 0, 0, SUM(sportsbook_ggr), COUNT(*) FROM fact_sports_bet GROUP BY 1, 2
      UNION ALL SELECT player_id, CAST(transaction_date AS DATE),
         SUM(CASE WHEN transaction_status = 'Approved' AND transaction_type = 'Deposit' THEN amount ELSE 0 END),
         SUM(CASE WHEN transaction_status = 'Approved' AND transaction_type = 'Withdrawal' THEN amount ELSE 0 END), 0, 0, COUNT(*)
      FROM fact_transaction GROUP BY 1, 2) GROUP BY player_id, event_date)) WHERE rk <= 50"""))

# ---------------------------------------------------------------- casino / finance page metrics
for tag, s in (("", S_MAIN), ("_market", S_MAIN.with_country(MARKET))):
    hours = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN hour = {h} THEN sessions END), 0) AS BIGINT) AS h{h:02d}" for h in range(24))
    register(f"casino_heatmap_matrix{tag}", lambda wh, s=s: casino.heatmap_matrix(wh, s), q(f"""
WITH hm AS (SELECT dayofweek(session_start) AS dw, CAST(hour(session_start) AS INTEGER) AS hour, COUNT(*) AS sessions
            FROM v_sessions_enriched WHERE {t_in('session_start', s)}{mk(s)} GROUP BY 1, 2),
days AS (SELECT * FROM (VALUES (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'), (6, 'Sat'), (0, 'Sun')) AS d(dw, day))
SELECT days.day, {hours} FROM days LEFT JOIN hm USING (dw) GROUP BY days.day"""))
    gp = f"""WITH g AS (SELECT game_name, SUM(bets) AS b, SUM(payouts) AS p, SUM(bets * theoretical_rtp) AS wt
  FROM mart_game_performance_daily WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY game_name),
g2 AS (SELECT game_name, CAST(p AS DOUBLE) / NULLIF(CAST(b AS DOUBLE), 0) - CAST(wt AS DOUBLE) / NULLIF(CAST(b AS DOUBLE), 0) AS rtp_variance FROM g)"""
    register(f"casino_largest_variance_game{tag}", lambda wh, s=s: casino.largest_variance_game(wh, s), q(gp + """
SELECT game_name, rtp_variance, CASE WHEN rtp_variance > 0.005 THEN 'Paying above theoretical' WHEN rtp_variance < -0.005
  THEN 'Paying below theoretical' ELSE 'In line with theoretical' END AS meaning
FROM g2 WHERE rtp_variance IS NOT NULL ORDER BY abs(rtp_variance) DESC, game_name LIMIT 1"""))
    register(f"casino_cards{tag}", lambda wh, s=s: casino.cards(wh, s), q(f"""
SELECT *, ggr / NULLIF(bets, 0) AS margin, payout / NULLIF(bets, 0) AS rtp FROM (
  SELECT CAST(COALESCE(SUM(bets), 0) AS DOUBLE) AS bets, CAST(COALESCE(SUM(payouts), 0) AS DOUBLE) AS payout,
         CAST(COALESCE(SUM(ggr), 0) AS DOUBLE) AS ggr, COUNT(DISTINCT game_id) AS games
  FROM mart_game_performance_daily WHERE {d_in('metric_date', s)}{mk(s)})"""))

def _waterfall_sql(s) -> str:
    def one(sc, period):
        return f"""SELECT '{period}' AS period, bets, payout, fees FROM
  (SELECT CAST(COALESCE(SUM(b), 0) AS DOUBLE) AS bets, CAST(COALESCE(SUM(p), 0) AS DOUBLE) AS payout FROM (
     SELECT SUM(total_bet_amount) AS b, SUM(total_payout_amount) AS p FROM v_sessions_enriched WHERE {t_in('session_start', sc)}{mk(sc)}
     UNION ALL SELECT SUM(stake), SUM(payout) FROM v_sports_bets_enriched WHERE {t_in('bet_date', sc)}{mk(sc)})),
  (SELECT CAST(COALESCE(SUM(CASE WHEN transaction_status = 'Approved' THEN processing_fee ELSE 0 END), 0) AS DOUBLE) AS fees
     FROM v_transactions_enriched WHERE {t_in('transaction_date', sc)}{mk(sc)})"""
    w = f"WITH w0 AS ({one(s, 'current')} UNION ALL {one(s.previous(), 'previous')}), w AS (SELECT *, bets - payout AS ggr, GREATEST(bets - payout, 0.0) AS pos FROM w0) "
    steps = [("bets", "bets"), ("payout", "payout"), ("ggr", "ggr"), ("bonus", "-pos * 0.065"), ("fees", "-fees"), ("tax", "-pos * 0.095"),
             ("ngr", "ggr - fees - pos * 0.065 - pos * 0.095")]
    return w + " UNION ALL ".join(f"SELECT period, '{k}' AS step, {e} AS value FROM w" for k, e in steps)


register("finance_waterfall", lambda wh: finance.waterfall(wh, S_MAIN), q(_waterfall_sql(S_MAIN)))
