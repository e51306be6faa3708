"""Registered model and series queries (N, I4, I45-I48, J16-J17, J22).

Model outputs cannot be reproduced by SQL, so most of these carry no oracle (rows-only
check); the next-best-action summary is computed from the closed-form score table and has one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.catalog import S_MAIN, register
from croupier.ml import forecasts, models, series, training
from croupier.oracle import q, scores_ctes
from croupier.plans.scores import DEFAULT_CUTOFF, next_best_actions_table
from croupier.queries import overview, pages
from croupier.scope import Scope

S_ALL = Scope("1995-01-01", "2001-12-31")


def _cached(wh, key: str, build):
    """One result per warehouse object, kept on the object itself."""
    results = wh.__dict__.setdefault("_results", {})
    if key not in results:
        from croupier.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(wh.spark)
        results[key] = build()
    return results[key]


def trained(wh, *names: tuple[str, int]) -> dict[str, DataFrame]:
    """The written tables of one training run over the warehouse: all horizons, forecasters and anomalies.
    A query that shows some models names them, and only those are fitted (unless all are already)."""
    from croupier.session import shared_dir

    run_id = uuid.uuid4().hex[:12]
    key = "trained" if not names or "trained" in wh.__dict__.get("_results", {}) else f"trained {sorted(names)}"
    return _cached(wh, key, lambda: training.train(wh, shared_dir(wh.spark, f"croupier-models-{run_id}"), DEFAULT_CUTOFF, run_id, names=list(names) or None))


def backtest(wh) -> DataFrame:
    return _cached(wh, "backtest", lambda: forecasts.forecast_backtest(wh).checkpoint(eager=True))


def anomaly_rows(wh) -> DataFrame:
    return _cached(wh, "anomalies", lambda: series.anomalies(wh).checkpoint(eager=True))


def with_trained_scores(wh):
    """The warehouse with the trained ``model_scores`` in place of the closed form."""
    scores = trained(wh)["model_scores"].drop("import_run_id")
    return wh.scored_from(wh.training_facts, model_scores=scores)


def metrics_of(wh, kind: str, days: int) -> DataFrame:
    return trained(wh, (kind, days))["model_metrics"].filter(F.col("model_name") == f"{kind}_{days}d")


# every fact row as one event, measured where it has something to measure
DAILY_CTES = """
events_of_day AS (
  SELECT session_date AS date, player_id, casino_ggr AS casino, total_bet_amount AS bet, total_payout_amount AS paid, NULL AS sport, NULL AS stake, NULL AS label, NULL AS deposit FROM fact_casino_session
  UNION ALL SELECT bet_day, player_id, NULL, NULL, NULL, sportsbook_ggr, stake, event_name, NULL FROM fact_sports_bet
  UNION ALL SELECT transaction_day, player_id, NULL, NULL, NULL, NULL, NULL, NULL, amount FROM fact_transaction WHERE transaction_type = 'Deposit' AND transaction_status = 'Approved'),
span AS (SELECT least((SELECT MIN(registration_date) FROM dim_player), (SELECT MIN(d) FROM (SELECT MIN(date) AS d FROM events_of_day UNION ALL SELECT MIN(transaction_day) FROM fact_transaction))) AS lo,
                greatest((SELECT MAX(registration_date) FROM dim_player), (SELECT MAX(d) FROM (SELECT MAX(date) AS d FROM events_of_day UNION ALL SELECT MAX(transaction_day) FROM fact_transaction))) AS hi),
measured AS (
  SELECT date, COALESCE(SUM(casino), 0) AS casino, COALESCE(SUM(sport), 0) AS sport, COALESCE(SUM(deposit), 0) AS deposits,
         CAST(SUM(paid) AS DOUBLE) / NULLIF(CAST(SUM(bet) AS DOUBLE), 0) AS rtp,
         COUNT(DISTINCT player_id) FILTER (bet IS NOT NULL) AS players, COUNT(DISTINCT player_id) FILTER (deposit IS NOT NULL) AS depositors
  FROM events_of_day GROUP BY date),
largest AS (
  SELECT date, MAX(abs(g)) FILTER (kind = 'channel') AS channel, MAX(g) FILTER (kind = 'event') AS event
  FROM (SELECT e.date, 'channel' AS kind, p.channel AS part, SUM(e.casino) AS g FROM events_of_day e JOIN dim_player p USING (player_id) WHERE e.bet IS NOT NULL GROUP BY ALL
        UNION ALL SELECT date, 'event', label, SUM(stake) FROM events_of_day WHERE stake IS NOT NULL GROUP BY ALL) GROUP BY date),
daily AS (
  SELECT d.date, CAST(COALESCE(m.casino, 0) AS DOUBLE) AS casino_ggr, CAST(COALESCE(m.sport, 0) AS DOUBLE) AS sportsbook_ggr,
         CAST(COALESCE(m.casino, 0) + COALESCE(m.sport, 0) AS DOUBLE) AS ggr, CAST((COALESCE(m.casino, 0) + COALESCE(m.sport, 0)) * 0.84 AS DOUBLE) AS ngr,
         CAST(COALESCE(m.deposits, 0) AS DOUBLE) AS deposits, CAST(COALESCE(m.depositors, 0) AS DOUBLE) AS ftd, COALESCE(m.rtp, 0.0) AS rtp,
         CAST(COALESCE(m.players, 0) AS DOUBLE) AS player_activity, CAST(COALESCE(l.channel, 0) AS DOUBLE) AS channel_performance,
         CAST(COALESCE(l.event, 0) AS DOUBLE) AS event_exposure
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span) d
  LEFT JOIN measured m USING (date) LEFT JOIN largest l USING (date))"""
FEATURE_CTES = DAILY_CTES + """,
long_targets AS (UNPIVOT (SELECT date, ggr, ngr, deposits, ftd, casino_ggr, sportsbook_ggr FROM daily) ON ggr, ngr, deposits, ftd, casino_ggr, sportsbook_ggr INTO NAME metric VALUE actual),
lagged AS (SELECT *, lag(actual, 1) OVER w AS lag_1, lag(actual, 7) OVER w AS lag_7, lag(actual, 14) OVER w AS lag_14,
             CASE WHEN row_number() OVER w > 7 THEN avg(actual) OVER (PARTITION BY metric ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS rolling_7,
             CASE WHEN row_number() OVER w > 28 THEN avg(actual) OVER (PARTITION BY metric ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) END AS rolling_28
           FROM long_targets WINDOW w AS (PARTITION BY metric ORDER BY date)),
placed AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM lagged WHERE rolling_28 IS NOT NULL),
features AS (SELECT *, CASE WHEN i < floor(n * 0.65) THEN 'train' WHEN i < floor(n * 0.82) THEN 'validation' ELSE 'test' END AS split FROM placed),
naive AS (SELECT metric, date, actual, split, greatest(lag_7, 0.0) AS predicted FROM features),
gaps AS (SELECT metric, quantile_cont(actual - predicted, 0.1) AS lo, quantile_cont(actual - predicted, 0.9) AS hi FROM naive WHERE split = 'validation' GROUP BY metric),
banded AS (SELECT n.*, greatest(predicted + lo, 0.0) AS lower, greatest(predicted + hi, 0.0) AS upper FROM naive n JOIN gaps USING (metric))"""


def naive_backtest(wh) -> DataFrame:
    """The band and metrics on predictions set by a formula: the value of the same weekday last week."""
    rows = series.forecast_features(series.daily_series(wh)).select(
        "metric", "date", "actual", "split", F.greatest("lag_7", F.lit(0.0)).alias("predicted"))
    return series.with_band(rows)


def naive_metrics(wh) -> DataFrame:
    renamed = naive_backtest(wh).select("metric", "split", F.round("actual", 4).alias("actual_value"), F.col("predicted").alias("predicted_value"),
                                        F.round("lower", 4).alias("lower_bound"), F.round("upper", 4).alias("upper_bound"))
    return series.forecast_metrics(renamed).select("model_name", "split", "metric_name", F.round("metric_value", 4).alias("metric_value"))


register("ml_forecast_features", lambda wh: series.forecast_features(series.daily_series(wh)).select(
    "metric", "date", "actual", "lag_1", "lag_7", "lag_14", F.round("rolling_7", 4).alias("rolling_7"), F.round("rolling_28", 4).alias("rolling_28"), "split"),
    q("SELECT metric, date, actual, lag_1, lag_7, lag_14, round(rolling_7, 4) AS rolling_7, round(rolling_28, 4) AS rolling_28, split FROM features", FEATURE_CTES))
register("ml_forecast_band", lambda wh: naive_backtest(wh).select(
    "metric", "date", "split", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper")),
    q("SELECT metric, date, split, round(lower, 4) AS lower, round(upper, 4) AS upper FROM banded", FEATURE_CTES))
register("ml_forecast_metrics_naive", naive_metrics, q("""
SELECT 'forecast_' || metric AS model_name, split, m.name AS metric_name,
       round(round(CASE m.name WHEN 'mae' THEN avg(abs(actual - predicted)) WHEN 'wape' THEN sum(abs(actual - predicted)) / greatest(sum(abs(actual)), 1.0)
             ELSE avg(CASE WHEN round(actual, 4) BETWEEN round(lower, 4) AND round(upper, 4) THEN 1.0 ELSE 0.0 END) END, 5), 4) AS metric_value
FROM banded, (VALUES ('mae'), ('wape'), ('interval_80_coverage')) AS m(name) WHERE split <> 'train' GROUP BY metric, split, m.name""", FEATURE_CTES))
register("ml_daily_series", lambda wh: series.daily_series(wh), q("SELECT * FROM daily", DAILY_CTES))
register("ml_forecast_backtest", backtest, None)
register("ml_forecast_metrics", lambda wh: series.forecast_metrics(backtest(wh)), None)
register("ml_anomalies", anomaly_rows, q("""
SELECT date AS detected_date, metric, value AS current_value, usual AS usual_value, score AS anomaly_score,
       CASE WHEN place <= ceil(n * 0.02) THEN 'High' ELSE 'Medium' END AS severity, 'Distance from rolling median' AS method, 'series-v1' AS model_version
FROM ranked WHERE place <= ceil(n * 0.045) AND score > 0""", DAILY_CTES + """,
long_metrics AS (UNPIVOT (SELECT date, ggr, rtp, deposits, player_activity, channel_performance, event_exposure FROM daily)
                 ON ggr, rtp, deposits, player_activity, channel_performance, event_exposure INTO NAME metric VALUE value),
known AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY date) AS seen, median(value) OVER (PARTITION BY metric ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS recent,
                 median(value) OVER (PARTITION BY metric) AS whole FROM long_metrics),
spread AS (SELECT *, round(CASE WHEN seen >= 7 THEN recent ELSE whole END, 6) AS usual FROM known),
scaled AS (SELECT *, round(median(abs(value - usual)) OVER (PARTITION BY metric), 6) AS typical FROM spread),
scored AS (SELECT *, round(abs(value - usual) / NULLIF(typical, 0), 6) AS score FROM scaled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC NULLS LAST, date) AS place, count(*) OVER (PARTITION BY metric) AS n FROM scored)"""))
for _kind, _spans in training.KINDS.items():
    for _days in _spans:
        register(f"ml_{_kind}_{_days}d_scores", lambda wh, k=_kind, d=_days: trained(wh, (k, d))["model_scores"].select("player_id", "observed_value", training.column(k, d)), None)
        register(f"ml_{_kind}_{_days}d_metrics", lambda wh, k=_kind, d=_days: metrics_of(wh, k, d).drop("measured_at"), None)
register("ml_model_scores_trained", lambda wh: trained(wh)["model_scores"].drop("import_run_id"), None)
register("ml_model_list", lambda wh: trained(wh)["model_list"], None)
register("ml_run_report", lambda wh: series.run_report(wh.model_scores, anomaly_rows(wh)), None)
register("ml_market_forecast", forecasts.market_backtest, None)
register("ml_risk_summary_trained", lambda wh: overview.risk_summary(with_trained_scores(wh), S_MAIN), None)

# every horizon's snapshots, from events joined to their cut-offs by range
_SPECS = ", ".join(f"({s.horizon}, '{s.split}', DATE '{s.cutoff}', TIMESTAMP '{s.cutoff} 23:59:59')" for s in models.specs_for(DEFAULT_CUTOFF))
TEMPORAL_CTES = f"""
specs AS (SELECT * FROM (VALUES {_SPECS}) AS v(horizon, split, cutoff, cut)),
happened AS (
  SELECT player_id, session_start AS t, 'c' AS kind, casino_ggr AS ggr, total_bet_amount AS put, duration_minutes AS minutes, bet_count AS bets, game_id AS game, NULL AS status, NULL AS method FROM fact_casino_session
  UNION ALL SELECT player_id, bet_date, 's', sportsbook_ggr, stake, NULL, NULL, NULL, NULL, NULL FROM fact_sports_bet
  UNION ALL SELECT player_id, transaction_date, left(transaction_type, 1), NULL, amount, NULL, NULL, NULL, transaction_status, payment_method FROM fact_transaction),
known_by AS (
  SELECT s.horizon, s.split, s.cutoff, s.cut, h.player_id, h.t <= s.cut AS old, h.* EXCLUDE (player_id), h.status = 'Approved' AS ok
  FROM specs s JOIN happened h ON h.t <= s.cut + to_days(s.horizon)),
summed AS (
  SELECT horizon, split, cutoff, cut, player_id, COUNT(*) FILTER (old AND kind = 'c') AS session_count, COUNT(DISTINCT CAST(t AS DATE)) FILTER (old AND kind = 'c') AS active_days,
    MAX(t) FILTER (old AND kind = 'c') AS last_session, MAX(t) FILTER (old AND kind = 's') AS last_bet, SUM(put) FILTER (old AND kind = 'c') AS total_bets,
    SUM(ggr) FILTER (old) AS historical_ggr, AVG(minutes) FILTER (old) AS avg_duration, MAX(minutes) FILTER (old) AS max_duration, COUNT(DISTINCT game) FILTER (old) AS distinct_games,
    SUM(bets) FILTER (old) AS bet_count, COUNT(*) FILTER (old AND ok AND kind = 'D') AS deposit_count, SUM(put) FILTER (old AND ok AND kind = 'D') AS deposit_amount,
    COUNT(*) FILTER (old AND ok AND kind = 'W') AS withdrawal_count, SUM(put) FILTER (old AND ok AND kind = 'W') AS withdrawal_amount,
    CAST(COUNT(*) FILTER (old AND status = 'Declined') AS DOUBLE) / NULLIF(COUNT(status) FILTER (old), 0) AS decline_rate, COUNT(DISTINCT method) FILTER (old) AS payment_methods,
    COUNT(*) FILTER (old AND kind = 's') AS sports_bets, SUM(put) FILTER (old AND kind = 's') AS sports_stake, SUM(ggr) FILTER (old AND kind = 's') AS sports_ggr,
    COUNT(*) FILTER (NOT old AND kind IN ('c', 's')) AS future_activity, SUM(ggr) FILTER (NOT old) AS future_ggr
  FROM known_by GROUP BY ALL)"""
_MONEY = ("total_bets", "historical_ggr", "deposit_amount", "withdrawal_amount", "sports_stake", "sports_ggr", "future_ggr")
_COUNTS = ("session_count", "active_days", "distinct_games", "bet_count", "deposit_count", "withdrawal_count", "payment_methods", "sports_bets", "future_activity")


def temporal_rows(wh) -> DataFrame:
    d = models.temporal_dataset(wh, DEFAULT_CUTOFF)
    return d.select("horizon", "split", "cutoff", "player_id", "country", "channel", "device", "vip_level", "kyc_status", F.col("tenure_days").cast("bigint").alias("tenure_days"),
                    F.col("recency_days").cast("bigint").alias("recency_days"), *[F.col(c).cast("bigint").alias(c) for c in _COUNTS],
                    *[F.col(c).cast("double").alias(c) for c in _MONEY], F.round("avg_duration", 6).alias("avg_duration"), "max_duration",
                    F.round("decline_rate", 9).alias("decline_rate"), "last_activity")


register("ml_temporal_dataset", temporal_rows, q(f"""
SELECT horizon, split, cutoff, player_id, country, channel, device, vip_level, kyc_status, CAST(cutoff - CAST(registration_at AS DATE) AS BIGINT) AS tenure_days,
  CAST(least(COALESCE(cutoff - CAST(last_session AS DATE), 999), COALESCE(cutoff - CAST(last_bet AS DATE), 999)) AS BIGINT) AS recency_days,
  {", ".join(f"CAST(COALESCE({c}, 0) AS BIGINT) AS {c}" for c in _COUNTS)}, {", ".join(f"CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}" for c in _MONEY)},
  round(COALESCE(avg_duration, 0.0), 6) AS avg_duration, COALESCE(max_duration, 0.0) AS max_duration, round(COALESCE(decline_rate, 0.0), 9) AS decline_rate,
  greatest(COALESCE(last_session, last_bet), COALESCE(last_bet, last_session)) AS last_activity
FROM summed JOIN dim_player USING (player_id) WHERE registration_at <= cut - INTERVAL 14 DAY AND session_count + sports_bets + deposit_count > 0""", TEMPORAL_CTES))

# dashboard reads of the model tables
register("overview_revenue_forecast", lambda wh: overview.revenue_forecast(series.revenue_forecast(backtest(wh))), None)
register("ai_anomalies", lambda wh: anomaly_rows(wh).filter(S_ALL.date_in("detected_date")).select(
    "detected_date", "metric", "current_value", "usual_value", "anomaly_score", "severity", "method").orderBy(F.desc("anomaly_score")), None)
register("ai_forecast_backtest", lambda wh: backtest(wh).filter(S_ALL.date_in("forecast_date")).select(
    "metric", "forecast_date", "actual_value", "predicted_value", "lower_bound", "upper_bound", "split").orderBy("forecast_date"), None)
register("ai_ml_metrics", lambda wh: trained(wh)["model_metrics"].drop("measured_at").orderBy("model_name", "split", "metric_name"), None)
register("ai_next_best_action_summary", lambda wh: next_best_actions_table(wh).groupBy("recommended_action").agg(
    F.count(F.lit(1)).cast("bigint").alias("players"), F.sum("estimated_value_at_stake").cast("double").alias("value_at_stake"),
    (F.sum("action_confidence").cast("double") / F.count("action_confidence")).alias("confidence")).orderBy(F.desc("value_at_stake")),
    q("""SELECT recommended_action, COUNT(*) AS players, CAST(SUM(estimated_value_at_stake) AS DOUBLE) AS value_at_stake,
       CAST(SUM(model_confidence) AS DOUBLE) / COUNT(model_confidence) AS confidence FROM model_scores GROUP BY recommended_action""",
      scores_ctes(DEFAULT_CUTOFF)))
register("pages_forecast_outlook", lambda wh: pages.forecast_outlook(wh, S_MAIN.with_country("NATION_7"), series.revenue_forecast(backtest(wh))), None)
register("pages_weekly_forecast", lambda wh: pages.weekly_forecast(series.revenue_forecast(backtest(wh))), None)


def scorecard(wh) -> DataFrame:
    """The anomalies are those of the training run, which has built the daily series for its forecasters; the closed-form
    scores are computed from the facts it has written."""
    run = trained(wh, ("churn", 30))
    return pages.ml_scorecard(run["model_metrics"], run["ml_anomalies"], next_best_actions_table(wh.scored_from(wh.training_facts)))


register("pages_ml_scorecard", scorecard, None)


def _streamed(wh) -> DataFrame:
    import uuid

    from croupier.session import shared_dir
    from croupier.streaming.daily_refresh import stream_daily_revenue
    return stream_daily_revenue(wh, shared_dir(wh.spark, f"croupier-stream-{uuid.uuid4().hex[:8]}"))


register("streaming_daily_gaming_revenue", _streamed, q("""
SELECT calendar_date, country, CAST(casino_bets AS DOUBLE) AS casino_bets, CAST(casino_payouts AS DOUBLE) AS casino_payouts,
       CAST(casino_ggr AS DOUBLE) AS casino_ggr, CAST(sports_stake AS DOUBLE) AS sports_stake, CAST(sports_payout AS DOUBLE) AS sports_payout,
       CAST(sports_ggr AS DOUBLE) AS sports_ggr FROM int_daily_gaming_revenue"""))
