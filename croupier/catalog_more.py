"""Registered KPI-reference (O), quality-gate (G) and freshness (H) queries."""

from __future__ import annotations

from pyspark.sql import functions as _F

from croupier.catalog import MARKET, S_1995, S_MAIN, d_in, mk, mk_only, register, t_in
from croupier.oracle import q, scores_ctes
from croupier.plans import quality
from croupier.queries import freshness, kpi_reference as kr

M, MN = S_MAIN, S_MAIN.with_country(MARKET)
SC = scores_ctes("2000-03-31")

for tag, s in (("", M), ("_market", MN)):
    in_play = f"kind <> 'cash' AND valid AND {t_in('moment', s)}{mk(s)}"
    register(f"kpi_ggr_ngr_margin{tag}", lambda wh, s=s: kr.ggr_ngr_margin(wh, s), q(f"""
SELECT CAST(put AS DOUBLE) AS wagers, CAST(got AS DOUBLE) AS payouts, CAST(put - got AS DOUBLE) AS ggr,
       CAST(put - got AS DOUBLE) / NULLIF(CAST(put AS DOUBLE), 0) AS ggr_margin,
       CAST(put - got - fees - if(put > got, put - got, 0) * 0.065 - if(put > got, put - got, 0) * 0.095 AS DOUBLE) AS estimated_ngr_mvp
FROM (SELECT SUM(put) FILTER ({in_play}) AS put, SUM(got) FILTER ({in_play}) AS got, COALESCE(SUM(fee) FILTER (ok AND {t_in('moment', s)}{mk(s)}), 0) AS fees FROM booked)"""))
    register(f"kpi_active_players{tag}", lambda wh, s=s: kr.active_players(wh, s), q(f"""
SELECT COUNT(DISTINCT player_id) FILTER ({in_play}) AS active_players FROM booked"""))
    register(f"kpi_rtp_by_game{tag}", lambda wh, s=s: kr.rtp_by_game(wh, s), q(f"""
SELECT game_name, CAST(b AS DOUBLE) AS bets, CAST(p AS DOUBLE) AS payouts, CAST(p AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) AS actual_rtp,
       CAST(w AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) AS weighted_theoretical_rtp,
       CAST(p AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) - CAST(w AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) AS rtp_variance
FROM (SELECT game_name, SUM(bets) AS b, SUM(payouts) AS p, SUM(bets * theoretical_rtp) AS w FROM mart_game_performance_daily
      WHERE {d_in('metric_date', s)}{mk(s)} GROUP BY game_name)"""))
    register(f"kpi_latest_scores{tag}", lambda wh, s=s: kr.latest_scores(wh, s), q(f"""
SELECT player_id, CAST(predicted_ltv_90d AS DOUBLE) AS predicted_ltv_90d, CAST(churn_probability AS DOUBLE) AS churn_probability,
       CAST(fraud_risk AS DOUBLE) AS fraud_risk, CAST(rg_risk AS DOUBLE) AS rg_risk, CAST(model_confidence AS DOUBLE) AS model_confidence,
       'closed-form-v1' AS model_version, TIMESTAMP '2000-03-31 23:59:59' AS scored_at
FROM v_player_scores WHERE {mk_only(s)}""", SC))

for tag, s in (("", S_1995), ("_market", S_1995.with_country(MARKET)), ("_2000", M)):
    register(f"kpi_ftd{tag}", lambda wh, s=s: kr.ftd(wh, s), q(f"""
SELECT COUNT(*) AS ftd_count FROM firsts SEMI JOIN (SELECT player_id FROM dim_player WHERE {mk_only(s)}) USING (player_id) WHERE {t_in('paid_in', s)}"""))
    register(f"kpi_ftd_conversion_d30{tag}", lambda wh, s=s: kr.ftd_conversion_d30(wh, s), q(f"""
SELECT COUNT(*) AS eligible_registrations, SUM(quick)::BIGINT AS converted_d30, CAST(SUM(quick) AS DOUBLE) / nullif(COUNT(*), 0) AS ftd_conversion_d30
FROM (SELECT CAST(epoch(paid_in) - epoch(registration_at) >= 0 AND epoch(paid_in) - epoch(registration_at) < 30 * 86400 AS INT) AS quick
      FROM dim_player LEFT JOIN firsts USING (player_id)
      WHERE {t_in('registration_at', s)} AND registration_at + INTERVAL 30 DAY <= TIMESTAMP '{s.bound_day.isoformat()} 00:00:00' AND {mk_only(s)})"""))
    register(f"kpi_average_deposit{tag}", lambda wh, s=s: kr.average_deposit(wh, s), q(f"""
SELECT CAST(SUM(put) AS DOUBLE) / nullif(COUNT(*), 0) AS average_deposit FROM booked WHERE ok AND direction = 'Deposit' AND {t_in('moment', s)}{mk(s)}"""))

# ---------------------------------------------------------------- G: quality gate
#: One row of counts per table, laid on its side.
GATE = """
per_player AS (SELECT COUNT(*) - COUNT(DISTINCT player_id) AS duplicate_players FROM {player}),
per_game AS (SELECT COUNT(*) FILTER (NOT theoretical_rtp BETWEEN 0 AND 1) AS invalid_rtp FROM {game}),
per_session AS (
  SELECT COUNT(*) - COUNT(DISTINCT session_id) AS duplicate_sessions, COUNT(*) FILTER (player_id NOT IN (SELECT player_id FROM dim_player)) AS orphan_session_players,
         COUNT(*) FILTER (game_id NOT IN (SELECT game_id FROM dim_game)) AS orphan_session_games,
         COUNT(*) FILTER (abs(casino_ggr + total_payout_amount - total_bet_amount) > 0.01) AS casino_ggr_mismatch,
         abs(COUNT(*) - (SELECT COUNT(*) FROM raw_sessions)) AS raw_fact_session_delta FROM {session}),
per_transaction AS (
  SELECT COUNT(*) - COUNT(DISTINCT transaction_id) AS duplicate_transactions, COUNT(*) FILTER (player_id NOT IN (SELECT player_id FROM dim_player)) AS orphan_transaction_players,
         abs(COUNT(*) - (SELECT COUNT(*) FROM raw_transactions)) AS raw_fact_transaction_delta FROM fact_transaction),
per_bet AS (
  SELECT COUNT(*) - COUNT(DISTINCT bet_id) AS duplicate_sports_bets, COUNT(*) FILTER (player_id NOT IN (SELECT player_id FROM dim_player)) AS orphan_sports_players,
         COUNT(*) FILTER (abs(sportsbook_ggr + payout - stake) > 0.01) AS sports_ggr_mismatch,
         abs(COUNT(*) - (SELECT COUNT(*) FROM raw_sports_bets)) AS raw_fact_sports_delta FROM {bet}),
per_score AS (
  SELECT COUNT(*) FILTER (NOT (churn_probability BETWEEN 0 AND 1 AND fraud_risk BETWEEN 0 AND 1 AND rg_risk BETWEEN 0 AND 1)) AS invalid_ml_probability,
         COUNT(*) - COUNT(DISTINCT player_id) AS duplicate_ml_players, COUNT(*) FILTER (player_id NOT IN (SELECT player_id FROM dim_player)) AS orphan_ml_players FROM {score}),
counted AS (SELECT COLUMNS(*)::BIGINT FROM per_player, per_game, per_session, per_transaction, per_bet, per_score)"""
HEALTHY = {"player": "dim_player", "game": "dim_game", "session": "fact_casino_session", "bet": "fact_sports_bet", "score": "model_scores"}
SPOILED = {
    "player": "dim_player", "game": "(SELECT * REPLACE (if(game_id LIKE '%1', theoretical_rtp + 1, theoretical_rtp) AS theoretical_rtp) FROM dim_game)",
    "session": "(SELECT * REPLACE (if(bet_count % 7 = 0, casino_ggr + 1, casino_ggr) AS casino_ggr) FROM "
               "(SELECT * FROM fact_casino_session UNION ALL SELECT * FROM fact_casino_session WHERE day(session_date) = 1))",
    "bet": "(SELECT * REPLACE (if(is_live = 1, sportsbook_ggr - 1, sportsbook_ggr) AS sportsbook_ggr) FROM "
           "(SELECT * FROM fact_sports_bet UNION ALL SELECT * FROM fact_sports_bet WHERE day(bet_day) <= 15))",
    "score": "(SELECT * REPLACE (if(session_count % 3 = 0, fraud_risk + 1.5, fraud_risk) AS fraud_risk, if(session_count % 5 = 0, player_id || '?', player_id) AS player_id) "
             "FROM (SELECT * FROM model_scores UNION ALL SELECT * FROM model_scores WHERE session_count % 2 = 0))",
}
_SIDEWAYS = 'SELECT "check", value FROM (UNPIVOT counted ON COLUMNS(*) INTO NAME "check" VALUE value)'


def spoiled(wh):
    """The warehouse with faults in facts, games and scores, so that no check of these stays at 0."""
    t = {"dim_player": wh.dim_player, "fact_transaction": wh.fact_transaction}
    t["dim_game"] = wh.dim_game.withColumn("theoretical_rtp", _F.when(_F.col("game_id").endswith("1"), _F.col("theoretical_rtp") + 1).otherwise(_F.col("theoretical_rtp")))
    s = wh.fact_casino_session.unionByName(wh.fact_casino_session.filter(_F.day("session_date") == 1))
    t["fact_casino_session"] = s.withColumn("casino_ggr", _F.when(_F.col("bet_count") % 7 == 0, _F.col("casino_ggr") + 1).otherwise(_F.col("casino_ggr")))
    b = wh.fact_sports_bet.unionByName(wh.fact_sports_bet.filter(_F.day("bet_day") <= 15))
    t["fact_sports_bet"] = b.withColumn("sportsbook_ggr", _F.when(_F.col("is_live") == 1, _F.col("sportsbook_ggr") - 1).otherwise(_F.col("sportsbook_ggr")))
    m = wh.model_scores.unionByName(wh.model_scores.filter(_F.col("session_count") % 2 == 0))
    t["model_scores"] = m.withColumns({"fraud_risk": _F.when(_F.col("session_count") % 3 == 0, _F.col("fraud_risk").cast("decimal(9,4)") + 1.5).otherwise(_F.col("fraud_risk")),
                                       "player_id": _F.when(_F.col("session_count") % 5 == 0, _F.concat("player_id", _F.lit("?"))).otherwise(_F.col("player_id"))})
    return type(wh)(wh.spark, raw=wh.raw, tables=t)


register("quality_checks", lambda wh: quality.quality_checks(wh, include_ml=True), q(_SIDEWAYS, SC + "," + GATE.format(**HEALTHY)))
register("quality_checks_spoiled", lambda wh: quality.quality_checks(spoiled(wh), include_ml=True), q(_SIDEWAYS, SC + "," + GATE.format(**SPOILED)))

# ---------------------------------------------------------------- H: scope and freshness
register("scope_date_bounds", lambda wh: freshness.date_bounds(wh), q("""
SELECT CAST(MIN(t) AS DATE) AS min_date, CAST(MAX(t) AS DATE) AS max_date FROM (
  SELECT session_start AS t FROM fact_casino_session UNION ALL SELECT transaction_date FROM fact_transaction
  UNION ALL SELECT bet_date FROM fact_sports_bet)"""))
register("scope_countries", lambda wh: freshness.countries(wh), q("""
SELECT DISTINCT country FROM dim_player WHERE country IS NOT NULL ORDER BY country"""))
register("scope_latest_event", lambda wh: freshness.latest_event(wh, "2001-12-01"), q("""
SELECT MAX(t) AS latest_event, date_diff('day', CAST(MAX(t) AS DATE), DATE '2001-12-01') > 2 AS is_stale FROM (
  SELECT session_start AS t FROM fact_casino_session UNION ALL SELECT transaction_date FROM fact_transaction
  UNION ALL SELECT bet_date FROM fact_sports_bet)"""))
for tag, s in (("", M), ("_market", MN)):
    ev = f"""
  SELECT session_start AS t FROM v_sessions_enriched WHERE {t_in('session_start', s)}{mk(s)}
  UNION ALL SELECT transaction_date FROM v_transactions_enriched WHERE {t_in('transaction_date', s)}{mk(s)}
  UNION ALL SELECT bet_date FROM v_sports_bets_enriched WHERE {t_in('bet_date', s)}{mk(s)}"""
    register(f"scope_event_count{tag}", lambda wh, s=s: freshness.event_count(wh, s), q(f"SELECT COUNT(*) AS events FROM ({ev})"))
    register(f"scope_last_updated{tag}", lambda wh, s=s: freshness.last_updated(wh, s), q(f"SELECT MAX(t) AS last_updated FROM ({ev})"))

# ---------------------------------------------------------------- N1 / N16 / N18 score tables
from croupier.plans import rules as _rules  # noqa: E402
from croupier.plans import scores as _scores  # noqa: E402
from croupier.plans import semantic as _sem  # noqa: E402

SNAP_COLS = ["player_id", "tenure_days", "session_count", "active_days", "recency_days", "total_bets", "historical_ggr", "avg_duration",
             "max_duration", "distinct_games", "bet_count", "deposit_count", "deposit_amount", "withdrawal_count", "withdrawal_amount",
             "decline_rate", "payment_methods", "sports_bets", "sports_stake", "sports_ggr", "future_activity", "future_ggr", "last_activity"]
MONEY_COLS = {"total_bets", "historical_ggr", "deposit_amount", "withdrawal_amount", "sports_stake", "sports_ggr", "future_ggr"}


def _snap_select(prefix=""):
    return [(_F.col(c).cast("double").alias(c) if c in MONEY_COLS else _F.col(c).cast("bigint").alias(c)
             if c in ("tenure_days", "recency_days", "session_count", "active_days", "distinct_games", "bet_count", "deposit_count",
                      "withdrawal_count", "payment_methods", "sports_bets", "future_activity") else _F.col(c)) for c in SNAP_COLS]


SNAP_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY_COLS else f"CAST({c} AS BIGINT) AS {c}"
                     if c in ("tenure_days", "recency_days", "session_count", "active_days", "distinct_games", "bet_count", "deposit_count",
                              "withdrawal_count", "payment_methods", "sports_bets", "future_activity") else c for c in SNAP_COLS)
register("ml_snapshot", lambda wh: _scores.snapshot(wh, "2000-03-31", 1).select(*_snap_select()), q(f"SELECT {SNAP_SQL} FROM snapshot", SC))

SCORE_COLS = ["predicted_ltv_90d", "churn_probability", "fraud_risk", "rg_risk", "churn_probability_7d", "churn_probability_14d",
              "churn_probability_30d", "observed_value", "remaining_ltv_30d", "remaining_ltv_90d", "remaining_ltv_180d",
              "predicted_total_ltv_30d", "predicted_total_ltv_90d", "predicted_total_ltv_180d", "model_confidence", "estimated_value_at_stake",
              "lifetime_ggr"]
register("scores_model_scores", lambda wh: wh.model_scores.select(
    "player_id", *[_F.col(c).cast("double").alias(c) for c in SCORE_COLS], "recommended_action", "last_session",
    _F.col("session_count").cast("bigint").alias("session_count")),
    q(f"SELECT player_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in SCORE_COLS)}, recommended_action, last_session, "
      f"CAST(session_count AS BIGINT) AS session_count FROM model_scores", SC))
register("scores_next_best_actions", lambda wh: _scores.next_best_actions_table(wh).select(
    "player_id", "recommended_action", "reason", _F.col("action_confidence").cast("double").alias("action_confidence"),
    _F.col("estimated_value_at_stake").cast("double").alias("estimated_value_at_stake")), q("""
SELECT player_id, recommended_action,
  CASE recommended_action WHEN 'Limit communications · RG review' THEN 'Responsible Gaming safeguard' WHEN 'Manual fraud review' THEN 'Payment anomaly'
    WHEN 'Send retention campaign' THEN 'High churn × future value' WHEN 'Recommend preferred game' THEN 'Value retention opportunity'
    WHEN 'Offer governed bonus' THEN 'High future value' ELSE 'No material intervention signal' END AS reason,
  CAST(model_confidence AS DOUBLE) AS action_confidence, CAST(estimated_value_at_stake AS DOUBLE) AS estimated_value_at_stake FROM model_scores""", SC))

def _register_sql():
    from croupier.catalog_rules import REGISTER, _with_tail
    return _with_tail(REGISTER)


register("rules_register_kpis", lambda wh: _rules.register_kpis(_rules.alert_register(_rules.alerts(wh, M))), _register_sql())
register("semantic_lead_row_games", lambda wh: _sem.lead_row(
    _sem.compile_plan(wh, _sem.QueryPlan("casino", ("game",), ("ggr",), "ggr", "DESC", 10), M),
    _sem.QueryPlan("casino", ("game",), ("ggr",), "ggr", "DESC", 10)), q(f"""
WITH r AS (SELECT game_name AS "Game", CAST(SUM(ggr) AS DOUBLE) AS ggr FROM mart_game_performance_daily WHERE {d_in('metric_date', M)}
           GROUP BY game_name ORDER BY ggr DESC NULLS LAST, "Game" LIMIT 10)
SELECT * FROM (SELECT * FROM r ORDER BY ggr DESC NULLS LAST, "Game" LIMIT 1) CROSS JOIN (SELECT COUNT(*) AS rows FROM r)"""))
