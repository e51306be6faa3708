"""Registered decision-rule queries (K) with their oracle SQL (every market evaluated separately)."""

from __future__ import annotations

from pyspark.sql import functions as F

from croupier.catalog import MARKET, S_HALF, S_MAIN, d_in, register, t_in
from croupier.oracle import q, scores_ctes
from croupier.plans import rules
from croupier.sources.driver_tables import read_table

SC = scores_ctes("2000-03-31")
ALERT_COLS = ["market", "rule_id", "severity", "priority", "current_metric", "usual_metric", "financial_impact",
              "confidence", "revenue_potential", "workflow_id", "probable_cause"]


def sev(x, hi, crit):
    return f"CASE WHEN {x} >= {crit} THEN 'Critical' WHEN {x} >= {hi} THEN 'High' ELSE 'Medium' END"


def chg(c, u):
    return f"(CASE WHEN COALESCE(CAST({u} AS DOUBLE), 0.0) <> 0 THEN (COALESCE(CAST({c} AS DOUBLE), 0.0) - CAST({u} AS DOUBLE)) / abs(CAST({u} AS DOUBLE)) ELSE 0.0 END)"


def alerts_sql(s, market: str | None = None, tail: str | None = None) -> str:
    p = s.previous()
    cur_d = lambda c: d_in(c, s)
    prev_d = lambda c: d_in(c, p)
    start, detected = s.start_day.strftime("%d %b %Y"), s.end_day.strftime("%d %b %Y")
    body = f"""
WITH ex AS (
  SELECT country,
    COALESCE(SUM(CASE WHEN {cur_d('metric_date')} THEN total_ggr END), 0) AS ggr,
    COALESCE(SUM(CASE WHEN {prev_d('metric_date')} THEN total_ggr END), 0) AS ggr0,
    COALESCE(SUM(CASE WHEN {cur_d('metric_date')} THEN withdrawals END), 0) AS wd,
    COALESCE(SUM(CASE WHEN {prev_d('metric_date')} THEN withdrawals END), 0) AS wd0
  FROM mart_executive_daily WHERE {prev_d('metric_date')} OR {cur_d('metric_date')} GROUP BY country),
k1 AS (SELECT country AS market, 'GGR_DROP' AS rule_id, {sev('-' + chg('ggr', 'ggr0'), 0.18, 0.30)} AS severity,
         {chg('ggr', 'ggr0')} AS current_metric, CAST(ggr0 AS DOUBLE) AS usual_metric,
         GREATEST(CAST(ggr0 AS DOUBLE) - CAST(ggr AS DOUBLE), 0.0) AS financial_impact, 0.94 AS confidence, NULL AS probable_cause
       FROM ex WHERE {chg('ggr', 'ggr0')} <= -0.10),
k2 AS (SELECT country, 'WITHDRAWAL_SPIKE', {sev(chg('wd', 'wd0'), 0.35, 0.60)}, {chg('wd', 'wd0')}, CAST(wd0 AS DOUBLE),
         GREATEST(CAST(wd AS DOUBLE) - CAST(wd0 AS DOUBLE), 0.0), 0.96, NULL FROM ex WHERE {chg('wd', 'wd0')} >= 0.20),
gm AS (
  SELECT country, game_name, provider, SUM(bets) AS bets,
         CAST(SUM(payouts) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS actual_rtp,
         CAST(SUM(bets * theoretical_rtp) AS DOUBLE) / NULLIF(CAST(SUM(bets) AS DOUBLE), 0) AS expected_rtp
  FROM mart_game_performance_daily WHERE {cur_d('metric_date')} GROUP BY country, game_name, provider HAVING SUM(bets) >= 10000),
gm1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY abs(actual_rtp - expected_rtp) DESC NULLS LAST, game_name, provider) AS rk FROM gm) WHERE rk = 1),
k3 AS (SELECT country, 'RTP_ANOMALY', {sev('abs(actual_rtp - expected_rtp)', 0.035, 0.05)}, actual_rtp, expected_rtp,
         abs(actual_rtp - expected_rtp) * CAST(bets AS DOUBLE), 0.91,
         game_name || ' (' || provider || ') has the largest statistically material variance in the filtered scope.'
       FROM gm1 WHERE abs(actual_rtp - expected_rtp) >= 0.02),
pv AS (
  SELECT c.country, c.provider, c.ggr, u.ggr AS ggr0, (CAST(c.ggr AS DOUBLE) - CAST(u.ggr AS DOUBLE)) / abs(CAST(u.ggr AS DOUBLE)) AS change
  FROM (SELECT country, provider, SUM(ggr) AS ggr FROM mart_game_performance_daily WHERE {cur_d('metric_date')} GROUP BY 1, 2) c
  JOIN (SELECT country, provider, SUM(ggr) AS ggr FROM mart_game_performance_daily WHERE {prev_d('metric_date')} GROUP BY 1, 2) u
    USING (country, provider) WHERE u.ggr <> 0),
pv1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY change, provider) AS rk FROM pv) WHERE rk = 1),
k4 AS (SELECT country, 'SUPPLIER_DROP', {sev('-change', 0.25, 0.40)}, change, CAST(ggr0 AS DOUBLE),
         GREATEST(CAST(ggr0 AS DOUBLE) - CAST(ggr AS DOUBLE), 0.0), 0.88,
         provider || ' lost the most momentum, potentially from traffic mix, game availability or payout variance.'
       FROM pv1 WHERE change <= -0.15),
cm AS (
  SELECT p.country, p.channel,
    SUM(CASE p.channel WHEN 'Google' THEN 34 WHEN 'Meta' THEN 38 WHEN 'Organic' THEN 8 WHEN 'Affiliate Alpha' THEN 47
        WHEN 'Affiliate Nova' THEN 61 WHEN 'Influencers' THEN 73 ELSE 40 END) AS cost, SUM(v.predicted_ltv_90d) AS value
  FROM players p JOIN v_player_scores v USING (player_id) WHERE {t_in('p.registration_date', s)} GROUP BY 1, 2),
cm1 AS (SELECT * FROM (SELECT *, CAST(value AS DOUBLE) / NULLIF(CAST(cost AS DOUBLE), 0) AS roas,
          ROW_NUMBER() OVER (PARTITION BY country ORDER BY CAST(value AS DOUBLE) / NULLIF(CAST(cost AS DOUBLE), 0) ASC NULLS FIRST, channel) AS rk FROM cm) WHERE rk = 1),
k5 AS (SELECT country, 'CAMPAIGN_LOSS', CASE WHEN COALESCE(roas, 0.0) < 1 THEN 'Critical' ELSE 'High' END, COALESCE(roas, 0.0), 1.5,
         GREATEST(CAST(cost AS DOUBLE) - CAST(value AS DOUBLE), 0.0), 0.78,
         channel || ' combines the weakest predicted LTV Proxy with its estimated channel acquisition cost.'
       FROM cm1 WHERE COALESCE(roas, 99.0) < 1.5),
ac AS (
  SELECT country,
    SUM(CASE WHEN {cur_d('metric_date')} THEN ftd END) AS ftd, SUM(CASE WHEN {cur_d('metric_date')} THEN registrations END) AS regs,
    SUM(CASE WHEN {prev_d('metric_date')} THEN ftd END) AS ftd0, SUM(CASE WHEN {prev_d('metric_date')} THEN registrations END) AS regs0
  FROM mart_acquisition_daily WHERE {prev_d('metric_date')} OR {cur_d('metric_date')} GROUP BY country),
ac1 AS (SELECT a.*, CAST(ftd AS DOUBLE) / NULLIF(CAST(regs AS DOUBLE), 0) AS conv, CAST(ftd0 AS DOUBLE) / NULLIF(CAST(regs0 AS DOUBLE), 0) AS conv0,
          d.avg_dep FROM ac a LEFT JOIN (
            SELECT country, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_dep FROM v_transactions_enriched
            WHERE transaction_type = 'Deposit' AND transaction_status = 'Approved' AND {t_in('transaction_date', s)} GROUP BY country) d USING (country)),
k6 AS (SELECT country, 'CONVERSION_DROP', {sev('-' + chg('conv', 'conv0'), 0.25, 0.40)}, COALESCE(conv, 0.0), COALESCE(conv0, 0.0),
         GREATEST(COALESCE(CAST(regs AS DOUBLE), 0.0) * COALESCE(conv0, 0.0) - COALESCE(CAST(ftd AS DOUBLE), 0.0), 0.0) * COALESCE(avg_dep, 0.0),
         0.90, NULL FROM ac1 WHERE -{chg('conv', 'conv0')} >= 0.15),
evx AS (SELECT country, event_name, SUM(stake) AS handle FROM v_sports_bets_enriched WHERE {t_in('bet_date', s)} GROUP BY 1, 2),
ev1 AS (SELECT * FROM (SELECT *, COALESCE(CAST(handle AS DOUBLE) / NULLIF(CAST(SUM(handle) OVER (PARTITION BY country) AS DOUBLE), 0), 0.0) AS share,
          ROW_NUMBER() OVER (PARTITION BY country ORDER BY handle DESC, event_name) AS rk FROM evx) WHERE rk = 1),
k7 AS (SELECT country, 'SPORTS_EXPOSURE', {sev('share', 0.45, 0.60)}, share, 0.35, CAST(handle AS DOUBLE) * GREATEST(share - 0.35, 0.0), 0.97,
         event_name || ' concentrates an unusually large portion of handle in the selected scope.' FROM ev1 WHERE share >= 0.35),
pg AS (SELECT country, player_id, SUM(ggr) AS ggr FROM (
         SELECT country, player_id, SUM(casino_ggr) AS ggr FROM v_sessions_enriched WHERE {t_in('session_start', s)} GROUP BY 1, 2
         UNION ALL SELECT country, player_id, SUM(sportsbook_ggr) FROM v_sports_bets_enriched WHERE {t_in('bet_date', s)} GROUP BY 1, 2) GROUP BY 1, 2),
pg1 AS (SELECT country, SUM(CASE WHEN rk <= 10 THEN GREATEST(ggr, 0) ELSE 0 END) AS top_ggr, SUM(GREATEST(ggr, 0)) AS total_ggr FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY ggr DESC, player_id) AS rk FROM pg) GROUP BY country),
pg2 AS (SELECT *, COALESCE(CAST(top_ggr AS DOUBLE) / NULLIF(CAST(total_ggr AS DOUBLE), 0), 0.0) AS share FROM pg1),
k8 AS (SELECT country, 'REVENUE_CONCENTRATION', {sev('share', 0.35, 0.50)}, share, 0.25, CAST(top_ggr AS DOUBLE) * GREATEST(share - 0.25, 0.0), 0.95, NULL
       FROM pg2 WHERE share >= 0.25),
pr AS (SELECT country, COUNT(*) AS active, SUM(CASE WHEN fraud_risk >= 0.55 THEN 1 ELSE 0 END) AS fc, SUM(CASE WHEN rg_risk >= 0.55 THEN 1 ELSE 0 END) AS rc,
         COALESCE(SUM(CASE WHEN fraud_risk >= 0.55 THEN predicted_ltv_90d * fraud_risk END), 0) AS fi,
         CAST(SUM(CASE WHEN fraud_risk >= 0.55 THEN model_confidence END) AS DOUBLE) / NULLIF(SUM(CASE WHEN fraud_risk >= 0.55 THEN 1 ELSE 0 END), 0) AS fconf,
         CAST(SUM(CASE WHEN rg_risk >= 0.55 THEN model_confidence END) AS DOUBLE) / NULLIF(SUM(CASE WHEN rg_risk >= 0.55 THEN 1 ELSE 0 END), 0) AS rconf
       FROM v_player_scores v WHERE EXISTS (SELECT 1 FROM int_player_activity_daily a WHERE a.player_id = v.player_id AND {d_in('a.activity_date', s)})
       GROUP BY country),
k9 AS (SELECT country, 'FRAUD_SIGNAL', {sev('CAST(fc AS DOUBLE) / GREATEST(active, 1)', 0.08, 0.15)}, CAST(fc AS DOUBLE), 0.55, CAST(fi AS DOUBLE),
         COALESCE(fconf, 0.70), NULL FROM pr WHERE fc > 0),
k10 AS (SELECT country, 'RG_SIGNAL', {sev('CAST(rc AS DOUBLE) / GREATEST(active, 1)', 0.08, 0.15)}, CAST(rc AS DOUBLE), 0.55, 0.0,
         COALESCE(rconf, 0.70), NULL FROM pr WHERE rc > 0),
al AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5
       UNION ALL SELECT * FROM k6 UNION ALL SELECT * FROM k7 UNION ALL SELECT * FROM k8 UNION ALL SELECT * FROM k9 UNION ALL SELECT * FROM k10),
alerts_out AS (SELECT market, rule_id, severity, CASE severity WHEN 'Critical' THEN 'P0' WHEN 'High' THEN 'P1' ELSE 'P2' END AS priority,
       CAST(current_metric AS DOUBLE) AS current_metric, CAST(usual_metric AS DOUBLE) AS usual_metric,
       CAST(financial_impact AS DOUBLE) AS financial_impact, CAST(confidence AS DOUBLE) AS confidence,
       GREATEST(CAST(financial_impact AS DOUBLE), 0.0) * CASE severity WHEN 'Critical' THEN 0.45 WHEN 'High' THEN 0.32 WHEN 'Medium' THEN 0.20 ELSE 0.12 END AS revenue_potential,
       rule_id || ':' || market || ':{start}:{detected}' AS workflow_id,
       COALESCE(probable_cause, '') AS probable_cause
FROM al)
"""
    body += tail or ("SELECT * FROM alerts_out" + (f" WHERE market = '{market}'" if market else ""))
    return body


def _alerts_projection(wh, s):
    a = rules.alerts(wh, s)
    return a.select(*[c for c in ALERT_COLS if c != "probable_cause"],
                    F.when(F.col("rule_id").isin("RTP_ANOMALY", "SUPPLIER_DROP", "CAMPAIGN_LOSS", "SPORTS_EXPOSURE"),
                           F.col("probable_cause")).otherwise(F.lit("")).alias("probable_cause"))


for tag, s in (("", S_MAIN), ("_half", S_HALF)):
    register(f"rules_alerts{tag}", lambda wh, s=s: _alerts_projection(wh, s), q(alerts_sql(s), SC))
    register(f"rules_alerts{tag}_market", lambda wh, s=s: _alerts_projection(wh, s.with_country(MARKET)),
             q(alerts_sql(s, MARKET), SC))

CATALOG_VALUES = ", ".join(f"('{k}', '{v[0]}', '{v[2]}')" for k, v in rules.RULE_CATALOG.items())
TOP = """, ranked AS (SELECT *, CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS sr,
  ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END,
                     financial_impact DESC, market) AS rk FROM alerts_out)
SELECT rule_id, market, severity, financial_impact FROM ranked WHERE rk = 1 ORDER BY sr, financial_impact DESC, rule_id LIMIT 6"""
GOV = f""", cat AS (SELECT * FROM (VALUES {CATALOG_VALUES}) AS c(rule_id, title, team)),
hits AS (SELECT rule_id, COUNT(*) AS n FROM alerts_out GROUP BY rule_id)
SELECT c.rule_id, c.title, c.team, CAST(COALESCE(h.n, 0) AS BIGINT) AS alerts,
       CASE WHEN h.n > 0 THEN 'Triggered' ELSE 'Within threshold' END AS state
FROM cat c LEFT JOIN hits h USING (rule_id)"""
TEAM = f""", cat AS (SELECT * FROM (VALUES {CATALOG_VALUES}) AS c(rule_id, title, team))
SELECT c.team, round(SUM(a.revenue_potential), 6) AS revenue_potential FROM alerts_out a JOIN cat c USING (rule_id) GROUP BY c.team"""



def _with_tail(tail: str) -> str:
    """The alerts CTEs of the main scope followed by a custom final SELECT."""
    head = alerts_sql(S_MAIN).rsplit("SELECT * FROM alerts_out", 1)[0].rstrip()
    return q(head + tail, SC)


register("rules_top_alerts", lambda wh: rules.top_alerts(rules.alerts(wh, S_MAIN)).select("rule_id", "market", "severity", "financial_impact"),
         _with_tail(TOP))
PRIORITY = f""", cat AS (SELECT * FROM (VALUES {CATALOG_VALUES}) AS c(rule_id, title, team))
SELECT a.priority AS "Priority", c.team AS "Owner", a.financial_impact AS "Impact", a.confidence AS "Confidence", c.title AS "Signal"
FROM alerts_out a JOIN cat c USING (rule_id)
ORDER BY CASE a.severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, a.financial_impact DESC, a.market, a.rule_id LIMIT 5"""
REGISTER = """
SELECT CAST(COUNT(*) AS BIGINT) AS active_alerts, CAST(COUNT(*) FILTER (WHERE severity = 'Critical') AS BIGINT) AS critical_alerts,
       round(COALESCE(SUM(financial_impact), 0.0), 6) AS financial_impact, round(COALESCE(SUM(revenue_potential), 0.0), 6) AS revenue_potential,
       CAST(0 AS BIGINT) AS reviewed FROM alerts_out"""

register("rules_governance", lambda wh: rules.rule_governance(rules.alerts(wh, S_MAIN)).drop("definition"),
         _with_tail(GOV))
register("rules_recovery_by_team", lambda wh: rules.recovery_by_team(rules.alerts(wh, S_MAIN)),
         _with_tail(TEAM))

# ---- the register with statuses (K16, K19) and a team's block of alerts (K14) ------------------
RULE_IDS = sorted(rules.RULE_CATALOG)
STATUS_OF = {"view": "Reviewed", "signup": "Reviewed", "purchase": "Resolved", "click": "New", "error": "New"}


def status_changes(wh):
    """Every row of ``events`` as a status change of one workflow of the main scope."""
    e = read_table(wh.spark, wh.sf_dir, "events")
    nation = read_table(wh.spark, wh.sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("market"))
    rule = F.element_at(F.array(*[F.lit(r) for r in RULE_IDS]), (F.col("event_id") % len(RULE_IDS) + 1).cast("int"))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), F.col("event_type"))
    days = [F.lit(d.strftime("%d %b %Y")) for d in (S_MAIN.start_day, S_MAIN.end_day)]
    return e.join(nation, F.col("user_id") % 25 == F.col("n_nationkey")).select(
        F.concat_ws(":", rule, "market", *days).alias("workflow_id"), status.alias("status"),
        F.concat(F.lit("case "), F.col("event_id").cast("string")).alias("result"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"))


def status_register(wh):
    return rules.alert_register(rules.alerts(wh, S_MAIN), rules.latest_statuses(status_changes(wh)))


_LISTED = ", ".join(f"'{r}'" for r in RULE_IDS)
_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items())
STATUSES = f""", cat AS (SELECT * FROM (VALUES {CATALOG_VALUES}) AS c(rule_id, title, team)),
changed AS (
  SELECT ([{_LISTED}])[CAST(event_id % {len(RULE_IDS)} AS INT) + 1] || ':' || n_name || ':{S_MAIN.start_day:%d %b %Y}:{S_MAIN.end_day:%d %b %Y}' AS workflow_id,
         CASE event_type {_STATUS} END AS status, 'case ' || event_id AS result, ts, event_id
  FROM events JOIN nation ON n_nationkey = user_id % 25),
newest AS (SELECT * FROM changed QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY ts DESC, event_id DESC) = 1),
listed AS (SELECT a.*, c.team, c.title, COALESCE(n.status, 'New') AS status, COALESCE(n.result, '') AS result
           FROM alerts_out a JOIN cat c USING (rule_id) LEFT JOIN newest n USING (workflow_id))"""
QUEUE = {"severities": ["Critical", "High"], "statuses": ["New", "Reviewed"], "teams": ["Casino Operations", "Growth", "Revenue & Finance"]}
TEAMS = ["Casino Operations", "Payments"]
_q = lambda values: ", ".join(f"'{v}'" for v in values)

register("rules_register", lambda wh: status_register(wh).select("workflow_id", "rule_id", "market", "severity", "team", "status", "result"),
         _with_tail(STATUSES + " SELECT workflow_id, rule_id, market, severity, team, status, result FROM listed"))
register("rules_register_kpis_reviewed", lambda wh: rules.register_kpis(status_register(wh)), _with_tail(STATUSES + """
SELECT COUNT(*) FILTER (status <> 'Resolved') AS active_alerts, COUNT(*) FILTER (status <> 'Resolved' AND severity = 'Critical') AS critical_alerts,
       round(COALESCE(SUM(financial_impact) FILTER (status <> 'Resolved'), 0.0), 6) AS financial_impact,
       round(COALESCE(SUM(revenue_potential) FILTER (status <> 'Resolved'), 0.0), 6) AS revenue_potential,
       COUNT(*) FILTER (status IN ('Reviewed', 'Resolved')) AS reviewed FROM listed"""))
register("rules_alert_queue", lambda wh: rules.alert_queue(status_register(wh), **QUEUE).select("workflow_id", "severity", "team", "status"), _with_tail(STATUSES + f"""
SELECT workflow_id, severity, team, status FROM listed
WHERE severity IN ({_q(QUEUE['severities'])}) AND status IN ({_q(QUEUE['statuses'])}) AND team IN ({_q(QUEUE['teams'])})"""))
register("rules_team_alerts", lambda wh: rules.top_alerts(rules.alerts(wh, S_MAIN), TEAMS, 3).select("rule_id", "market", "severity", "financial_impact"),
         _with_tail(STATUSES + f""", worst AS (
  SELECT *, list_position(['Critical', 'High', 'Medium'], severity) AS place FROM listed WHERE team IN ({_q(TEAMS)})
  QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY list_position(['Critical', 'High', 'Medium'], severity), financial_impact DESC, market) = 1)
SELECT rule_id, market, severity, financial_impact FROM worst ORDER BY place, financial_impact DESC, rule_id LIMIT 3"""))
