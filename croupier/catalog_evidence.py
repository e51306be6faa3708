"""Registered evidence jobs (M) with oracle SQL."""

from __future__ import annotations

from croupier.catalog import MARKET, S_HALF, S_MAIN, d_in, mk, mk_only, register, t_in
from croupier.oracle import q, scores_ctes
from croupier.plans import evidence as ev

SC = scores_ctes("2000-03-31")
M, MN = S_MAIN, S_MAIN.with_country(MARKET)


def act(s, alias="v"):
    return (f"EXISTS (SELECT 1 FROM int_player_activity_daily a WHERE a.player_id = {alias}.player_id AND {d_in('a.activity_date', s)})")


for tag, s in (("", M), ("_market", MN)):
    p = s.previous()
    register(f"evidence_ngr_change{tag}", lambda wh, s=s: ev.ngr_change(wh, s), q(f"""
WITH c AS (SELECT COALESCE(SUM(casino_ggr), 0) AS casino, COALESCE(SUM(sports_ggr), 0) AS sports, COALESCE(SUM(payment_fees), 0) AS fees,
                  COALESCE(SUM(total_ggr), 0) AS ggr FROM mart_executive_daily WHERE {d_in('metric_date', s)}{mk(s)}),
pr AS (SELECT COALESCE(SUM(casino_ggr), 0) AS casino, COALESCE(SUM(sports_ggr), 0) AS sports, COALESCE(SUM(payment_fees), 0) AS fees,
              COALESCE(SUM(total_ggr), 0) AS ggr FROM mart_executive_daily WHERE {d_in('metric_date', p)}{mk(s)}),
d AS (SELECT 'Casino GGR' AS "Driver", CAST(c.casino AS DOUBLE) AS "Current", CAST(pr.casino AS DOUBLE) AS "Previous" FROM c, pr
      UNION ALL SELECT 'Sportsbook GGR', CAST(c.sports AS DOUBLE), CAST(pr.sports AS DOUBLE) FROM c, pr
      UNION ALL SELECT 'Payment fees', CAST(c.fees AS DOUBLE), CAST(pr.fees AS DOUBLE) FROM c, pr),
d2 AS (SELECT *, "Current" - "Previous" AS "Absolute_change",
              CASE WHEN "Previous" <> 0 THEN ("Current" - "Previous") / abs("Previous") ELSE 0.0 END AS "Relative_change" FROM d),
n AS (SELECT CAST(c.ggr AS DOUBLE) - CAST(c.fees AS DOUBLE) - GREATEST(CAST(c.ggr AS DOUBLE), 0.0) * 0.16 AS ngr,
             CAST(pr.ggr AS DOUBLE) - CAST(pr.fees AS DOUBLE) - GREATEST(CAST(pr.ggr AS DOUBLE), 0.0) * 0.16 AS prior_ngr FROM c, pr)
SELECT d2.*, n.ngr, n.prior_ngr, n.ngr - n.prior_ngr AS ngr_change,
       CASE WHEN n.prior_ngr <> 0 THEN (n.ngr - n.prior_ngr) / abs(n.prior_ngr) ELSE 0.0 END AS ngr_relative_change,
       (SELECT "Driver" FROM d2 ORDER BY abs("Absolute_change") DESC, "Driver" LIMIT 1) AS largest_driver
FROM d2, n"""))
    register(f"evidence_weakest_games{tag}", lambda wh, s=s: ev.weakest_games(wh, s), q(f"""
SELECT game_name AS "Game", provider AS "Provider", CAST(SUM(ggr) AS DOUBLE) AS "GGR", CAST(SUM(bets) AS DOUBLE) AS "Bets",
       CAST(SUM(ggr) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS "Margin",
       CAST(SUM(payouts) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS "Actual_RTP",
       CAST(SUM(bets * theoretical_rtp) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS "Theoretical_RTP",
       CAST(SUM(payouts) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) - CAST(SUM(bets * theoretical_rtp) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS "RTP_variance"
FROM mart_game_performance_daily WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY game_name, provider HAVING SUM(bets) > 0
ORDER BY "Margin" ASC, "GGR" ASC, "Game", "Provider" LIMIT 5"""))
    register(f"evidence_churn_value_at_risk{tag}", lambda wh, s=s: ev.churn_value_at_risk(wh, s), q(f"""
SELECT CASE WHEN churn_probability_30d >= 0.75 THEN 'Critical ≥75%' WHEN churn_probability_30d >= 0.60 THEN 'High 60–75%' ELSE 'Watch 45–60%' END AS "Risk_band",
       COUNT(*) AS "Players", CAST(SUM(remaining_ltv_90d) AS DOUBLE) AS "Future_value",
       CAST(SUM(remaining_ltv_90d * churn_probability_30d) AS DOUBLE) AS "Value_at_risk",
       CAST(SUM(churn_probability_30d) AS DOUBLE) / COUNT(churn_probability_30d) AS "Avg_risk"
FROM v_player_scores v WHERE churn_probability_30d >= 0.45 AND {mk_only(s, 'v.country')} AND {act(s)} GROUP BY 1""", SC))
    register(f"evidence_vip_attention{tag}", lambda wh, s=s: ev.vip_attention(wh, s), q(f"""
SELECT 'Player ' || upper(substr(sha256(CAST(player_id AS VARCHAR)), 1, 8)) AS "Player", vip_level,
       CAST(remaining_ltv_90d AS DOUBLE) AS remaining_ltv_90d, CAST(churn_probability_30d AS DOUBLE) AS churn_probability_30d,
       CAST(fraud_risk AS DOUBLE) AS fraud_risk, CAST(rg_risk AS DOUBLE) AS rg_risk, recommended_action,
       (churn_probability_30d >= 0.6 OR fraud_risk >= 0.55 OR rg_risk >= 0.55) AS urgent
FROM v_player_scores v WHERE vip_level IN ('Gold', 'Platinum') AND {mk_only(s, 'v.country')} AND {act(s)}
ORDER BY GREATEST(churn_probability_30d, fraud_risk, rg_risk) DESC NULLS LAST, remaining_ltv_90d DESC, player_id LIMIT 10""", SC))
    wsql = lambda sc, tag2: f"""SELECT payment_method AS "Payment_method", CAST(COUNT(*) AS DOUBLE) AS "Attempts_{tag2}",
  CAST(SUM(CASE WHEN transaction_status = 'Declined' THEN 1 ELSE 0 END) AS DOUBLE) AS "Failed_{tag2}",
  1.0 * SUM(CASE WHEN transaction_status = 'Declined' THEN 1 ELSE 0 END) / NULLIF(COUNT(*), 0) AS "Failure_rate_{tag2}"
  FROM v_transactions_enriched WHERE transaction_type = 'Withdrawal' AND {t_in('transaction_date', sc)}{mk(s)} GROUP BY payment_method"""  # noqa: E731
    register(f"evidence_withdrawal_failures{tag}", lambda wh, s=s: ev.withdrawal_failures(wh, s), q(f"""
WITH cur AS ({wsql(s, 'current')}), prv AS ({wsql(p, 'previous')})
SELECT COALESCE(cur."Payment_method", prv."Payment_method") AS "Payment_method",
  COALESCE("Attempts_current", 0.0) AS "Attempts_current", COALESCE("Failed_current", 0.0) AS "Failed_current",
  COALESCE("Failure_rate_current", 0.0) AS "Failure_rate_current", COALESCE("Attempts_previous", 0.0) AS "Attempts_previous",
  COALESCE("Failed_previous", 0.0) AS "Failed_previous", COALESCE("Failure_rate_previous", 0.0) AS "Failure_rate_previous",
  COALESCE("Failure_rate_current", 0.0) - COALESCE("Failure_rate_previous", 0.0) AS "Failure_change"
FROM cur FULL OUTER JOIN prv ON cur."Payment_method" = prv."Payment_method\""""))
    register(f"evidence_casino_summary{tag}", lambda wh, s=s: ev.casino_summary(wh, s), q(f"""
WITH g AS (SELECT game_name, SUM(ggr) AS ggr, SUM(bets) AS bets, SUM(sessions) AS sessions, SUM(payouts) AS payouts
           FROM mart_game_performance_daily WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY game_name)
SELECT game_name AS "Game", CAST(ggr AS DOUBLE) AS "GGR", CAST(bets AS DOUBLE) AS "Bets", CAST(sessions AS BIGINT) AS "Sessions",
       CAST(payouts AS DOUBLE) / NULLIF(CAST(bets AS DOUBLE), 0) AS "RTP", CAST(ggr AS DOUBLE) / NULLIF(CAST(bets AS DOUBLE), 0) AS "Margin",
       (SELECT CAST(SUM(payouts) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) FROM g) AS "Portfolio_RTP" FROM g"""))
    register(f"evidence_payments_summary{tag}", lambda wh, s=s: ev.payments_summary(wh, s), q(f"""
WITH g AS (SELECT payment_method, COUNT(*) AS n, SUM(amount) AS v, SUM(CASE WHEN transaction_status = 'Approved' THEN 1 ELSE 0 END) AS ok,
             SUM(CASE WHEN transaction_type = 'Deposit' AND transaction_status = 'Approved' THEN amount ELSE 0 END) AS dep,
             SUM(CASE WHEN transaction_type = 'Withdrawal' AND transaction_status = 'Approved' THEN amount ELSE 0 END) AS wd
           FROM v_transactions_enriched WHERE {t_in('transaction_date', s)}{mk(s)} GROUP BY payment_method)
SELECT payment_method AS "Payment_method", n AS "Transactions", CAST(v AS DOUBLE) AS "Volume",
       CAST(ok AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) AS "Approval_rate", CAST(dep AS DOUBLE) AS "Deposits", CAST(wd AS DOUBLE) AS "Withdrawals",
       (SELECT CAST(SUM(ok) AS DOUBLE) / NULLIF(CAST(SUM(n) AS DOUBLE), 0) FROM g) AS "Weighted_approval" FROM g"""))
    register(f"evidence_data_coverage{tag}", lambda wh, s=s: ev.data_coverage(wh, s), q(f"""
WITH d AS (SELECT 'Players' AS "Dataset", COUNT(DISTINCT player_id) AS "Rows" FROM players WHERE {mk_only(s)}
  UNION ALL SELECT 'Casino sessions', COUNT(*) FROM v_sessions_enriched WHERE {t_in('session_start', s)}{mk(s)}
  UNION ALL SELECT 'Sportsbook bets', COUNT(*) FROM v_sports_bets_enriched WHERE {t_in('bet_date', s)}{mk(s)}
  UNION ALL SELECT 'Transactions', COUNT(*) FROM v_transactions_enriched WHERE {t_in('transaction_date', s)}{mk(s)})
SELECT "Dataset", "Rows", "Rows" = 0 AS missing FROM d"""))

for tag, s in (("", S_HALF), ("_market", S_HALF.with_country(MARKET))):
    register(f"evidence_sportsbook_summary{tag}", lambda wh, s=s: ev.sportsbook_summary(wh, s), q(f"""
WITH g AS (SELECT sport, SUM(stake) AS h, SUM(sportsbook_ggr) AS g, COUNT(*) AS n FROM v_sports_bets_enriched
           WHERE {t_in('bet_date', s)}{mk(s)} GROUP BY sport)
SELECT sport AS "Sport", CAST(h AS DOUBLE) AS "Handle", CAST(g AS DOUBLE) AS "GGR", CAST(g AS DOUBLE) / NULLIF(CAST(h AS DOUBLE), 0) AS "Hold",
       n AS "Bets", (SELECT CAST(SUM(g) AS DOUBLE) / NULLIF(CAST(SUM(h) AS DOUBLE), 0) FROM g) AS "Total_hold" FROM g"""))

for tag, s in (("", S_MAIN.__class__("1995-01-01", "1995-12-31")), ("_market", S_MAIN.__class__("1995-01-01", "1995-12-31", MARKET))):
    register(f"evidence_acquisition_budget{tag}", lambda wh, s=s: ev.acquisition_budget(wh, s), q(f"""
SELECT p.channel AS "Channel", COUNT(*) AS "Players",
       CAST(SUM(CASE p.channel WHEN 'Google' THEN 34 WHEN 'Meta' THEN 38 WHEN 'Organic' THEN 8 WHEN 'Affiliate Alpha' THEN 47
            WHEN 'Affiliate Nova' THEN 61 WHEN 'Influencers' THEN 73 ELSE 40 END) AS DOUBLE) / COUNT(*) AS "Estimated_CAC",
       CAST(SUM(v.remaining_ltv_90d) AS DOUBLE) / COUNT(*) AS "Predicted_remaining_LTV_90D",
       (CAST(SUM(v.remaining_ltv_90d) AS DOUBLE) / COUNT(*)) / NULLIF(CAST(SUM(CASE p.channel WHEN 'Google' THEN 34 WHEN 'Meta' THEN 38 WHEN 'Organic' THEN 8
            WHEN 'Affiliate Alpha' THEN 47 WHEN 'Affiliate Nova' THEN 61 WHEN 'Influencers' THEN 73 ELSE 40 END) AS DOUBLE) / COUNT(*), 0) AS "Predicted_ROAS",
       CAST(SUM(v.churn_probability_30d) AS DOUBLE) / COUNT(*) AS "Churn_risk"
FROM players p JOIN v_player_scores v USING (player_id) WHERE {t_in('p.registration_date', s)} AND {mk_only(s, 'p.country')}
GROUP BY p.channel""", SC))

def _priority_sql():
    from croupier.catalog_rules import PRIORITY, _with_tail
    return _with_tail(PRIORITY)


register("evidence_priority_actions", lambda wh: ev.priority_actions(wh, S_MAIN).select("Priority", "Owner", "Impact", "Confidence", "Signal"),
         _priority_sql())
