"""Every warehouse layer table registered with an oracle (C, D, E, F): the layers are checked
table by table, not only through the KPIs built on them."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from croupier.catalog import register
from croupier.oracle import q, scores_ctes
from croupier.plans import loads
from croupier.scope import month_key
from croupier.session import released_shuffles, shared_dir


def _doubles(df, cols):
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


MONEY_FACT = {"total_bet_amount", "total_payout_amount", "casino_ggr", "amount", "processing_fee", "stake", "payout", "sportsbook_ggr",
              "odds", "theoretical_rtp"}

register("layer_dim_date", lambda wh: wh.dim_date, q("""
WITH b AS (SELECT MIN(d) AS lo, MAX(d) AS hi FROM (
    SELECT registration_date AS d FROM stg_players UNION ALL SELECT session_date FROM stg_sessions
    UNION ALL SELECT transaction_day FROM stg_transactions UNION ALL SELECT bet_day FROM stg_sports_bets)),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM b)
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS calendar_date, CAST(year(d) AS INTEGER) AS year,
       CAST((month(d) - 1) // 3 + 1 AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, strftime(d, '%B') AS month_name,
       CAST(strftime(d, '%W') AS INTEGER) + 1 AS week_of_year, CAST(day(d) AS INTEGER) AS day_of_month,
       CASE dayofweek(d) WHEN 0 THEN 7 ELSE CAST(dayofweek(d) AS INTEGER) END AS day_of_week, strftime(d, '%A') AS day_name,
       CASE WHEN dayofweek(d) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend FROM days"""))
register("layer_dim_player", lambda wh: wh.dim_player, q("SELECT * FROM dim_player"))
register("layer_dim_game", lambda wh: _doubles(wh.dim_game, MONEY_FACT), q(
    "SELECT game_id, game_name, game_family, CAST(theoretical_rtp AS DOUBLE) AS theoretical_rtp, provider FROM dim_game"))
register("layer_fact_casino_session", lambda wh: _doubles(wh.sessions.drop("session_id", "event_month"), MONEY_FACT), q("""
SELECT player_id, game_id, CAST(strftime(session_date, '%Y%m%d') AS INTEGER) AS date_key, session_start, session_date, duration_minutes,
       CAST(total_bet_amount AS DOUBLE) AS total_bet_amount, CAST(total_payout_amount AS DOUBLE) AS total_payout_amount,
       CAST(casino_ggr AS DOUBLE) AS casino_ggr, bet_count FROM fact_casino_session"""))
register("layer_fact_transaction", lambda wh: _doubles(wh.transactions.drop("event_month"), MONEY_FACT), q("""
SELECT transaction_id, player_id, CAST(strftime(transaction_day, '%Y%m%d') AS INTEGER) AS date_key, transaction_date, transaction_day,
       transaction_type, CAST(amount AS DOUBLE) AS amount, transaction_status, payment_method, CAST(processing_fee AS DOUBLE) AS processing_fee
FROM fact_transaction"""))
register("layer_fact_sports_bet", lambda wh: _doubles(wh.sports_bets.drop("event_month"), MONEY_FACT), q("""
SELECT bet_id, player_id, CAST(strftime(bet_day, '%Y%m%d') AS INTEGER) AS date_key, bet_date, bet_day, sport, is_live,
       CAST(odds AS DOUBLE) AS odds, CAST(stake AS DOUBLE) AS stake, CAST(payout AS DOUBLE) AS payout,
       CAST(sportsbook_ggr AS DOUBLE) AS sportsbook_ggr, event_name FROM fact_sports_bet"""))
register("layer_int_player_first_deposit", lambda wh: wh.int_player_first_deposit, q("SELECT * FROM int_player_first_deposit"))
register("layer_int_player_first_activity", lambda wh: wh.int_player_first_activity, q("SELECT * FROM int_player_first_activity"))
register("layer_int_player_activity_daily", lambda wh: wh.int_player_activity_daily, q("SELECT * FROM int_player_activity_daily"))
register("layer_v_player_activity_enriched", lambda wh: wh.v_player_activity_enriched, q("SELECT * FROM v_player_activity_enriched"))
REV = ["casino_bets", "casino_payouts", "casino_ggr", "sports_stake", "sports_payout", "sports_ggr"]
register("layer_int_daily_gaming_revenue", lambda wh: _doubles(wh.int_daily_gaming_revenue, set(REV)), q(
    "SELECT calendar_date, country, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in REV) + " FROM int_daily_gaming_revenue"))
EXEC = REV + ["total_wagers", "total_ggr", "deposits", "withdrawals", "payment_fees", "estimated_ngr"]
register("layer_mart_executive_daily", lambda wh: _doubles(wh.mart_executive_daily.drop("definition_version"), set(EXEC)), q(
    "SELECT metric_date, country, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in EXEC)
    + ", ggr_margin, CAST(active_players AS BIGINT) AS active_players, payment_approval_rate FROM mart_executive_daily"))
GAME = ["bets", "payouts", "ggr", "theoretical_rtp"]
register("layer_mart_game_performance_daily", lambda wh: _doubles(wh.mart_game_performance_daily.drop("definition_version"), set(GAME)), q("""
SELECT metric_date, country, game_id, game_name, game_family, provider, CAST(theoretical_rtp AS DOUBLE) AS theoretical_rtp, sessions, active_players,
       CAST(bets AS DOUBLE) AS bets, CAST(payouts AS DOUBLE) AS payouts, CAST(ggr AS DOUBLE) AS ggr,
       CAST(ggr AS DOUBLE) / NULLIF(CAST(bets AS DOUBLE), 0) AS ggr_margin, CAST(payouts AS DOUBLE) / NULLIF(CAST(bets AS DOUBLE), 0) AS actual_rtp,
       CAST(payouts AS DOUBLE) / NULLIF(CAST(bets AS DOUBLE), 0) - CAST(theoretical_rtp AS DOUBLE) AS rtp_variance,
       CAST(ggr AS DOUBLE) / NULLIF(CAST(sessions AS DOUBLE), 0) AS ggr_per_session FROM mart_game_performance_daily"""))
register("layer_mart_acquisition_daily", lambda wh: wh.mart_acquisition_daily.drop("definition_version"), q("""
SELECT metric_date, country, channel, CAST(registrations AS BIGINT) AS registrations, CAST(kyc_verified AS BIGINT) AS kyc_verified,
       CAST(ftd AS BIGINT) AS ftd FROM mart_acquisition_daily"""))
register("layer_mart_payments_daily", lambda wh: _doubles(wh.mart_payments_daily.drop("definition_version"), {"volume", "approved_fees"}), q("""
SELECT metric_date, country, payment_method, transaction_type, transactions, CAST(volume AS DOUBLE) AS volume, approval_rate,
       CAST(approved_fees AS DOUBLE) AS approved_fees FROM mart_payments_daily"""))
P360 = ["predicted_ltv_90d", "churn_probability", "fraud_risk", "rg_risk", "model_confidence", "observed_value", "lifetime_ggr"]
register("layer_mart_player_360", lambda wh: wh.mart_player_360.select(
    "player_id", "country", "vip_level", *[F.col(c).cast("double").alias(c) for c in P360], "recommended_action", "ftd_date", "first_activity_date"),
    q("SELECT player_id, country, vip_level, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in P360)
      + ", recommended_action, ftd_date, first_activity_date FROM v_player_scores", scores_ctes("2000-03-31")))


# ---- append loads (D1-D3): a first load, a second with changed and moved rows, the first one again ----
FIRST, SECOND, AGAIN = "2026-01-01 00:00:00", "2026-01-02 00:00:00", "2025-12-31 00:00:00"
LOADED = {"fact_casino_session": ("casino_ggr", "session_date", "session_start"), "fact_transaction": ("amount", "transaction_day", "transaction_date"),
          "fact_sports_bet": ("stake", "bet_day", "bet_date")}


def loaded(wh, name: str):
    """What is left of a fact after three loads; every row of the fact takes part."""
    value, day, moment = LOADED[name]
    path = shared_dir(wh.spark, f"croupier-loads-{uuid.uuid4().hex[:12]}")
    first = type(wh)(wh.spark, raw=wh.raw)
    first.loaded_at = dt.datetime.fromisoformat(FIRST)
    fact = getattr(first, name)
    with released_shuffles(wh.spark):
        fact.write.partitionBy("event_month").parquet(f"{path}/{name}")
    built = type(wh)(wh.spark, tables={name: type(wh)._read(wh.spark, f"{path}/{name}", name, fact.schema)})
    rows = built._tables[name].drop("loaded_at")
    later = F.date_add(day, 40)
    changed = rows.filter(F.day(day) <= 10).withColumns({value: (F.col(value) + 1).cast(rows.schema[value].dataType), "event_month": month_key(later), day: later})
    loads.append_load(built, path, name, changed, dt.datetime.fromisoformat(SECOND))
    loads.append_load(built, path, name, fact.drop("loaded_at"), dt.datetime.fromisoformat(AGAIN))
    return built._tables[name].groupBy(F.col("event_month").cast("bigint").alias("month"), F.col("loaded_at").cast("string").alias("loaded_at")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(loads.key_of(name)).alias("keys"), F.sum(value).cast("double").alias("total"), F.max(day).alias("last_day"))


def loaded_sql(name: str) -> str:
    value, day, _ = LOADED[name]
    key = {"fact_casino_session": "session_id", "fact_transaction": "transaction_id", "fact_sports_bet": "bet_id"}[name]
    return q(f"""
SELECT CAST(year(d) * 100 + month(d) AS BIGINT) AS month, stamp AS loaded_at, COUNT(*) AS rows, COUNT(DISTINCT key) AS keys, CAST(SUM(v) AS DOUBLE) AS total, MAX(d) AS last_day
FROM (SELECT {key} AS key, CASE WHEN day({day}) <= 10 THEN {day} + 40 ELSE {day} END AS d, CASE WHEN day({day}) <= 10 THEN {value} + 1 ELSE {value} END AS v,
             CASE WHEN day({day}) <= 10 THEN '{SECOND}' ELSE '{FIRST}' END AS stamp FROM {name}) GROUP BY 1, 2""")


for _name in LOADED:
    register(f"loads_{_name}", lambda wh, n=_name: loaded(wh, n), loaded_sql(_name))
