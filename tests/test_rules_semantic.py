"""Decision rules and semantic layer invariants (catalog, union of markets, parity, validation)."""

import pytest
from pyspark.sql import functions as F

from croupier.catalog import S_MAIN
from croupier.plans import rules, semantic
from croupier.queries import overview


def test_rule_catalog_complete():
    assert set(rules.RULE_CATALOG) == set(rules.RULE_TEXT) and len(rules.RULE_CATALOG) == 10


def test_alerts_all_markets_is_union_of_single_markets(wh):
    everything = rules.alerts(wh, S_MAIN)
    ids = [r["workflow_id"] for r in everything.select("workflow_id").collect()]
    assert len(ids) == len(set(ids))
    markets = [r["market"] for r in everything.select("market").distinct().collect()]
    for m in markets[:3]:
        one = {r["workflow_id"] for r in rules.alerts(wh, S_MAIN.with_country(m)).select("workflow_id").collect()}
        assert one == {i for i in ids if f":{m}:" in i}


def test_governance_lists_every_rule(wh):
    gov = rules.rule_governance(rules.alerts(wh, S_MAIN)).collect()
    assert len(gov) == 10 and {r["state"] for r in gov} <= {"Triggered", "Within threshold"}


def test_semantic_validation_rejects():
    with pytest.raises(semantic.PlanError):
        semantic.validate_plan(semantic.QueryPlan("casino", ("nope",), ("ggr",), "ggr"))
    with pytest.raises(semantic.PlanError):
        semantic.validate_plan(semantic.QueryPlan("casino", (), ("ggr",), "bets"))
    for too_much in (semantic.QueryPlan("casino", ("game", "provider", "country"), ("ggr",), "ggr"),
                     semantic.QueryPlan("casino", ("game",), ("ggr", "bets", "rtp", "margin"), "ggr"),
                     semantic.QueryPlan("casino", ("game",), ("ggr",), "ggr", limit=0)):
        with pytest.raises(semantic.PlanError):
            semantic.validate_plan(too_much)


def test_nothing_is_cut_by_default(wh):
    days = semantic.compile_plan(wh, semantic.QueryPlan("executive", ("day",), ("ggr",), "ggr"), S_MAIN.__class__("1992-01-01", "2002-12-31"))
    assert days.count() > 100


@pytest.mark.parametrize("scope", [S_MAIN, S_MAIN.with_country("NATION_7"), S_MAIN.__class__("2000-01-10", "2000-01-10")])
def test_semantic_kpis_equal_dashboard_queries(wh, scope):
    perf = overview.performance_summary(wh, scope).first()
    ggr = semantic.kpi(wh, "executive", "ggr", scope).first()["current_value"]
    ngr = semantic.kpi(wh, "executive", "estimated_ngr", scope).first()["current_value"]
    act = semantic.kpi(wh, "player_activity", "active_players", scope).first()["current_value"]
    assert (ggr or 0.0) == perf["ggr"] and (ngr or 0.0) == perf["ngr"] and (act or 0) == perf["players"]


def test_templates_are_valid_and_run(wh):
    for key, (_, widgets) in semantic.TEMPLATES.items():
        for w in widgets:
            assert semantic.validate_widget(w) is None, (key, w.title)
    assert len(semantic.TEMPLATES) == 7
    for key in semantic.TEMPLATES:
        assert all(df.count() >= 1 for _, df in semantic.run_template(wh, key, S_MAIN)), key


def test_widget_rules():
    assert semantic.validate_widget(semantic.Widget("pie", "x", "casino", "game", measures=("ggr", "bets"))) is not None
    assert semantic.validate_widget(semantic.Widget("scatter", "x", "casino", measures=("ggr",))) is not None
    assert semantic.validate_widget(semantic.Widget("kpi", "x", "casino", measures=("ggr",))) is None
    merged = semantic.merge_filters([("provider", "Evolution")], [("casino", "provider", ["Ezugi"]), ("casino", "country", ["NATION_1"]),
                                                                  ("casino", "game", ["a", "b"])], "casino")
    assert merged == [("provider", "Evolution"), ("country", "NATION_1")]
