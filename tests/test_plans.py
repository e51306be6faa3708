"""Plan-shape guard: no cartesian products, nested-loop joins or keyless windows; top-k per
group planned with WindowGroupLimit; scope filters prune the stored fact partitions."""

import re
import uuid

import pytest

import __spark_entry__ as ent
from croupier.catalog import S_MAIN
from croupier.plans import rules
from croupier.plans.warehouse import Warehouse
from croupier.queries import casino
from tools.plan_audit import audit

SAMPLE = ["overview_performance_summary", "overview_market_share_market", "sportsbook_event_liability", "rules_alerts",
          "evidence_ngr_change", "evidence_casino_summary", "pages_peer_comparison_vip_active", "pages_objectives",
          "semantic_kpi_executive_ggr", "semantic_lead_row_games", "quality_checks", "kpi_ggr_ngr_margin", "player_retention_d30",
          "player_favorite_games", "finance_waterfall", "risk_case_queue"]


@pytest.mark.parametrize("name", SAMPLE)
def test_no_non_scaling_shapes(spark, name):
    df = ent.queries()[name](spark, "/root/testdata/sf0.001")
    assert audit(df._jdf.queryExecution().executedPlan().toString()) == []


def test_topk_uses_window_group_limit(wh):
    plan = rules.revenue_concentration(wh, S_MAIN)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scope_prunes_month_partitions(spark, tmp_path):
    built = Warehouse.from_driver_tables(spark, "/root/testdata/sf0.001").write(str(tmp_path / uuid.uuid4().hex))
    plan = casino.sessions_heatmap(built, S_MAIN)._jdf.queryExecution().executedPlan().toString()
    parts = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("event_month" in p and "200001" in p and "200003" in p for p in parts)


def test_fact_queries_need_no_join(spark, tmp_path):
    """On the written warehouse, with broadcasts off: the facts carry the market."""
    from croupier.catalog import S_HALF
    from croupier.queries import finance, freshness, sportsbook

    built = Warehouse.from_driver_tables(spark, "/root/testdata/sf0.001").write(str(tmp_path / uuid.uuid4().hex))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (casino.sessions_heatmap(built, S_MAIN), sportsbook.bet_composition(built, S_HALF), sportsbook.daily_handle_by_sport(built, S_HALF),
                   sportsbook.sport_performance(built, S_HALF), finance.payment_methods(built, S_MAIN), finance.weekly_deposits_withdrawals(built, S_MAIN),
                   finance.transactions_summary(built, S_MAIN), freshness.event_count(built, S_MAIN), built.mart_payments_daily,
                   built.mart_game_performance_daily):
            assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
