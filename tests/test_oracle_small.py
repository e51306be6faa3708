"""A fast slice of the correctness gate: Spark query vs independent DuckDB SQL at sf0.001."""

import math

import re

import pytest

import __spark_entry__ as ent

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "overview_performance_summary", "overview_daily_ggr_trend_market", "casino_game_performance", "sportsbook_event_liability_half",
    "finance_weekly_deposits_withdrawals", "player_retention_d30", "acquisition_source_performance", "risk_case_queue",
    "crm_segments", "rules_alerts", "semantic_executive_by_country", "evidence_ngr_change", "quality_checks", "kpi_rtp_by_game",
]


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(("f", round(v, 9)) if isinstance(v, float) and not math.isnan(v) else ("v", str(v)) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = ent.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = duck.execute(ent.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    assert _norm(srows) == _norm(drows)


def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"ggr", "ngr", "players", "deposits", "ftd"}


#: Outputs of trained models and the reads built on them, and the optional training-data queries.
WITHOUT_ORACLE = re.compile(r"ml_(churn|ltv)_|ml_model_(scores_trained|list)$|ml_market_forecast$|ml_risk_summary_trained$|ml_forecast_(backtest|metrics)$|ml_run_report$|overview_revenue_forecast$|"
                            r"ai_(anomalies|forecast_backtest|ml_metrics)$|pages_(forecast_outlook|weekly_forecast|ml_scorecard)$|op\d+_|pipeline$")


def test_every_query_but_model_outputs_has_an_oracle():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q)
    assert [n for n in q if n not in o and not WITHOUT_ORACLE.match(n)] == []
