"""Registered queries with their oracle SQL (filled into ``croupier.catalog``)."""

from __future__ import annotations

from croupier.catalog import MARKET, S_1995, S_DAY, S_HALF, S_MAIN, d_in, mk, mk_only, q, register, t_in
from croupier.queries import casino, finance, overview, sportsbook

M = S_MAIN
MN = S_MAIN.with_country(MARKET)

# ------------------------------------------------------------------ overview
for tag, s in (("", M), ("_market", MN), ("_day", S_DAY)):
    register(f"overview_daily_ggr_trend{tag}", lambda wh, s=s: overview.daily_ggr_trend(wh, s), q(f"""
SELECT metric_date AS date, CAST(SUM(total_ggr) AS DOUBLE) AS ggr FROM mart_executive_daily
WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY metric_date"""))

def perf_sql(s) -> str:
    """I1 as one SELECT over the warehouse CTEs."""
    return f"""
SELECT gaming.*, active.players, payments.deposits, ftd.ftd FROM
 (SELECT CAST(COALESCE(SUM(total_ggr), 0) AS DOUBLE) AS ggr, CAST(COALESCE(SUM(estimated_ngr), 0) AS DOUBLE) AS ngr,
         CAST(COALESCE(SUM(total_wagers), 0) AS DOUBLE) AS wagers, CAST(COALESCE(SUM(casino_payouts + sports_payout), 0) AS DOUBLE) AS payouts
  FROM mart_executive_daily WHERE {d_in('metric_date', s)}{mk(s)}) gaming,
 (SELECT COUNT(DISTINCT a.player_id) AS players FROM int_player_activity_daily a JOIN dim_player p USING (player_id)
  WHERE {d_in('a.activity_date', s)}{mk(s, 'p.country')}) active,
 (SELECT CAST(COALESCE(SUM(CASE WHEN transaction_status = 'Approved' AND transaction_type = 'Deposit' THEN amount ELSE 0 END), 0) AS DOUBLE) AS deposits
  FROM v_transactions_enriched WHERE {t_in('transaction_date', s)}{mk(s)}) payments,
 (SELECT COUNT(*) AS ftd FROM (SELECT player_id, MIN(transaction_date) AS ftd_date FROM fact_transaction
    WHERE transaction_type = 'Deposit' AND transaction_status = 'Approved' GROUP BY player_id) f JOIN players p USING (player_id)
  WHERE {t_in('f.ftd_date', s)}{mk(s, 'p.country')}) ftd"""


for tag, s in (("", M), ("_market", MN), ("_day", S_DAY)):
    register(f"overview_performance_summary{tag}", lambda wh, s=s: overview.performance_summary(wh, s), q(perf_sql(s)))

for tag, s in (("", M), ("_market", MN)):
    share = "1.0" if s.all_markets else (
        "CASE WHEN COALESCE(t, 0) <> 0 THEN GREATEST(COALESCE(m, 0) / t, 0) ELSE 0.0 END")
    register(f"overview_market_share{tag}", lambda wh, s=s: overview.market_share(wh, s), q(f"""
SELECT CAST({share} AS DOUBLE) AS market_share FROM (
  SELECT CAST(SUM(total_ggr) AS DOUBLE) AS t,
         CAST(SUM(CASE WHEN country = '{s.country}' THEN total_ggr END) AS DOUBLE) AS m
  FROM mart_executive_daily WHERE metric_date >= (SELECT MAX(metric_date) - INTERVAL 29 DAY FROM mart_executive_daily))"""))

# ------------------------------------------------------------------ casino
for tag, s in (("", M), ("_market", MN)):
    register(f"casino_daily_ggr_by_game{tag}", lambda wh, s=s: casino.daily_ggr_by_game(wh, s), q(f"""
SELECT metric_date AS date, game_name, CAST(SUM(ggr) AS DOUBLE) AS casino_ggr FROM mart_game_performance_daily
WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY metric_date, game_name"""))

    register(f"casino_game_performance{tag}", lambda wh, s=s: casino.game_performance(wh, s), q(f"""
SELECT game_name, CAST(MAX(theoretical_rtp) AS DOUBLE) AS theoretical_rtp, CAST(SUM(ggr) AS DOUBLE) AS "GGR",
       CAST(SUM(sessions) AS BIGINT) AS "Sessions", CAST(SUM(bets) AS DOUBLE) AS "Bets", CAST(SUM(payouts) AS DOUBLE) AS "Payout",
       CAST(SUM(payouts) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS actual_rtp,
       CAST(SUM(payouts) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0)
         - CAST(SUM(bets * theoretical_rtp) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS rtp_variance,
       CAST(SUM(ggr) AS DOUBLE) / NULLIF(CAST(SUM(sessions) AS DOUBLE), 0) AS ggr_per_session,
       CAST(SUM(ggr) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS ggr_margin
FROM mart_game_performance_daily WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY game_name"""))

    register(f"casino_metrics{tag}", lambda wh, s=s: casino.metrics(wh, s), q(f"""
SELECT CAST(COALESCE(SUM(bets), 0) AS DOUBLE) AS bets, CAST(COALESCE(SUM(payouts), 0) AS DOUBLE) AS payout,
       CAST(COALESCE(SUM(ggr), 0) AS DOUBLE) AS ggr, COUNT(DISTINCT game_id) AS games
FROM mart_game_performance_daily WHERE {d_in('metric_date', s)}{mk(s)}"""))

    register(f"casino_sessions_heatmap{tag}", lambda wh, s=s: casino.sessions_heatmap(wh, s), q(f"""
SELECT CASE dayofweek(session_start) WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu'
            WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' ELSE 'Sun' END AS day,
       CAST(hour(session_start) AS INTEGER) AS hour, COUNT(*) AS sessions
FROM v_sessions_enriched WHERE {t_in('session_start', s)}{mk(s)} GROUP BY 1, 2"""))

# ------------------------------------------------------------------ sportsbook
for tag, s in (("", M), ("_half", S_HALF), ("_market", MN)):
    w = f"{t_in('bet_date', s)}{mk(s)}"
    register(f"sportsbook_bet_composition{tag}", lambda wh, s=s: sportsbook.bet_composition(wh, s), q(f"""
SELECT CASE is_live WHEN 1 THEN 'Live' ELSE 'Pre-match' END AS "Type", CAST(SUM(stake) AS DOUBLE) AS stake
FROM v_sports_bets_enriched WHERE {w} GROUP BY is_live"""))
    register(f"sportsbook_daily_handle_by_sport{tag}", lambda wh, s=s: sportsbook.daily_handle_by_sport(wh, s), q(f"""
SELECT CAST(bet_date AS DATE) AS date, sport, CAST(SUM(stake) AS DOUBLE) AS "Exposure", CAST(SUM(sportsbook_ggr) AS DOUBLE) AS "GGR"
FROM v_sports_bets_enriched WHERE {w} GROUP BY CAST(bet_date AS DATE), sport"""))
    register(f"sportsbook_daily_mean_threshold{tag}", lambda wh, s=s: sportsbook.daily_mean_threshold(wh, s), q(f"""
SELECT COALESCE(CAST(SUM(x) AS DOUBLE) / COUNT(x), 0.0) AS avg_daily_handle FROM (
  SELECT CAST(bet_date AS DATE) AS d, SUM(stake) AS x FROM v_sports_bets_enriched WHERE {w} GROUP BY CAST(bet_date AS DATE))"""))
    register(f"sportsbook_event_liability{tag}", lambda wh, s=s: sportsbook.event_liability(wh, s), q(f"""
SELECT event_name, sport, CAST(exp AS DOUBLE) AS "Exposure", CAST(ggr AS DOUBLE) AS "GGR", bets AS "Bets",
       CASE WHEN CAST(exp AS DOUBLE) > avg_exp * 1.5 THEN 'HIGH' WHEN CAST(exp AS DOUBLE) > avg_exp THEN 'MEDIUM' ELSE 'LOW' END AS "Status"
FROM (SELECT event_name, sport, SUM(stake) AS exp, SUM(sportsbook_ggr) AS ggr, COUNT(*) AS bets
      FROM v_sports_bets_enriched WHERE {w} GROUP BY event_name, sport) e
CROSS JOIN (SELECT CAST(SUM(exp) AS DOUBLE) / COUNT(exp) AS avg_exp FROM (
      SELECT SUM(stake) AS exp FROM v_sports_bets_enriched WHERE {w} GROUP BY event_name, sport)) qq"""))
    register(f"sportsbook_metrics{tag}", lambda wh, s=s: sportsbook.metrics(wh, s), q(f"""
SELECT CAST(COALESCE(SUM(stake), 0) AS DOUBLE) AS handle, CAST(COALESCE(SUM(payout), 0) AS DOUBLE) AS payout,
       CAST(COALESCE(SUM(sportsbook_ggr), 0) AS DOUBLE) AS ggr, CAST(COALESCE(SUM(is_live), 0) AS BIGINT) AS live,
       CAST(COALESCE(SUM(CASE WHEN sportsbook_ggr < 0 THEN -sportsbook_ggr ELSE 0 END), 0) AS DOUBLE) AS exposure
FROM v_sports_bets_enriched WHERE {w}"""))
    register(f"sportsbook_sport_performance{tag}", lambda wh, s=s: sportsbook.sport_performance(wh, s), q(f"""
SELECT sport, CAST(SUM(sportsbook_ggr) AS DOUBLE) AS "GGR", CAST(SUM(stake) AS DOUBLE) AS "Handle", COUNT(*) AS "Bets",
       CAST(SUM(sportsbook_ggr) AS DOUBLE) / NULLIF(CAST(SUM(stake) AS DOUBLE), 0) AS "Hold"
FROM v_sports_bets_enriched WHERE {w} GROUP BY sport"""))
    register(f"sportsbook_top_event{tag}", lambda wh, s=s: sportsbook.top_event(wh, s), q(f"""
SELECT event_name, CAST(SUM(stake) AS DOUBLE) AS exposure FROM v_sports_bets_enriched WHERE {w}
GROUP BY event_name ORDER BY SUM(stake) DESC, event_name LIMIT 1"""))

# ------------------------------------------------------------------ finance
for tag, s in (("", M), ("_market", MN), ("_1995", S_1995)):
    w = f"{t_in('transaction_date', s)}{mk(s)}"
    register(f"finance_daily_approval_rate{tag}", lambda wh, s=s: finance.daily_approval_rate(wh, s), q(f"""
SELECT CAST(transaction_date AS DATE) AS date, AVG(CASE WHEN transaction_status = 'Approved' THEN 1.0 ELSE 0.0 END::DOUBLE) AS approval_rate,
       COUNT(*) AS transactions
FROM v_transactions_enriched WHERE {w} GROUP BY CAST(transaction_date AS DATE)"""))
    register(f"finance_payment_methods{tag}", lambda wh, s=s: finance.payment_methods(wh, s), q(f"""
SELECT payment_method, CAST(SUM(amount) AS DOUBLE) AS "Volume", COUNT(*) AS "Transactions",
       AVG(CASE WHEN transaction_status = 'Approved' THEN 1.0 ELSE 0.0 END::DOUBLE) AS "Approved",
       AVG(CASE WHEN transaction_status = 'Declined' THEN 1.0 ELSE 0.0 END::DOUBLE) AS "Declined",
       CAST(SUM(processing_fee) AS DOUBLE) AS "Fees",
       CAST(SUM(processing_fee) AS DOUBLE) / NULLIF(CAST(SUM(amount) AS DOUBLE), 0) AS "Avg_fee"
FROM v_transactions_enriched WHERE {w} GROUP BY payment_method"""))
    register(f"finance_transactions_summary{tag}", lambda wh, s=s: finance.transactions_summary(wh, s), q(f"""
SELECT CAST(COALESCE(SUM(CASE WHEN transaction_status = 'Approved' AND transaction_type = 'Deposit' THEN amount ELSE 0 END), 0) AS DOUBLE) AS deposits,
       CAST(COALESCE(SUM(CASE WHEN transaction_status = 'Approved' AND transaction_type = 'Withdrawal' THEN amount ELSE 0 END), 0) AS DOUBLE) AS withdrawals,
       CAST(COALESCE(SUM(CASE WHEN transaction_status = 'Approved' THEN processing_fee ELSE 0 END), 0) AS DOUBLE) AS fees,
       AVG(CASE WHEN transaction_status = 'Approved' THEN 1.0 ELSE 0.0 END::DOUBLE) AS approval
FROM v_transactions_enriched WHERE {w}"""))
    register(f"finance_weekly_deposits_withdrawals{tag}", lambda wh, s=s: finance.weekly_deposits_withdrawals(wh, s), q(f"""
SELECT CAST(transaction_date AS DATE) - CAST((dayofweek(transaction_date) + 6) % 7 AS INTEGER) AS week, transaction_type,
       CAST(SUM(amount) AS DOUBLE) AS amount
FROM v_transactions_enriched WHERE transaction_status = 'Approved' AND {w} GROUP BY 1, 2"""))

for tag, s in (("", M), ("_market", MN)):
    register(f"finance_daily_ggr{tag}", lambda wh, s=s: finance.daily_ggr(wh, s), q(f"""
SELECT metric_date AS date, CAST(SUM(total_ggr) AS DOUBLE) AS "GGR" FROM mart_executive_daily
WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY metric_date"""))
    register(f"finance_gaming_summary{tag}", lambda wh, s=s: finance.gaming_summary(wh, s), q(f"""
SELECT CAST(COALESCE(SUM(bets), 0) AS DOUBLE) AS bets, CAST(COALESCE(SUM(payout), 0) AS DOUBLE) AS payout FROM (
  SELECT SUM(total_bet_amount) AS bets, SUM(total_payout_amount) AS payout FROM v_sessions_enriched WHERE {t_in('session_start', s)}{mk(s)}
  UNION ALL
  SELECT SUM(stake), SUM(payout) FROM v_sports_bets_enriched WHERE {t_in('bet_date', s)}{mk(s)})"""))
