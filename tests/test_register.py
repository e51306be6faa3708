"""Alert register: latest status wins, whatever the order of arrival."""

import datetime as dt

from croupier.plans import rules
from croupier.sources import publish

SCHEMA = "workflow_id string, status string, result string, changed_at timestamp, change_id long"


def change(w, status, minute, number, result=""):
    return (w, status, result, dt.datetime(2026, 1, 1, 10, minute), number)


def rows(df):
    return sorted((r.workflow_id, r.status, r.result) for r in df.collect())


def test_latest_change_wins_and_redelivery_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "register")
    first = spark.createDataFrame([change("a", "Reviewed", 5, 1), change("b", "Resolved", 5, 2, "done"), change("a", "New", 1, 3)], SCHEMA)
    saved = rules.save_changes(spark, root, first)
    assert rows(saved) == [("a", "Reviewed", ""), ("b", "Resolved", "done")]
    before = publish.active(spark, root)
    assert rows(rules.save_changes(spark, root, first)) == rows(saved)
    late = spark.createDataFrame([change("b", "New", 2, 9), change("a", "Resolved", 9, 4, "x"), change("c", "Reviewed", 5, 5), change("c", "Resolved", 5, 6)], SCHEMA)
    assert rows(rules.save_changes(spark, root, late)) == [("a", "Resolved", "x"), ("b", "Resolved", "done"), ("c", "Resolved", "")]
    assert rows(publish.open_tables(spark, before[1])["statuses"]) == rows(saved)  # older versions stay as they were


def test_register_kpis_count_unresolved_and_reviewed(spark):
    alerts = spark.createDataFrame([("a", "Critical", "T", 10.0, 1.0), ("b", "Critical", "T", 20.0, 2.0), ("c", "High", "U", 40.0, 4.0), ("d", "Medium", "U", 80.0, 8.0)],
                                   "workflow_id string, severity string, team string, financial_impact double, revenue_potential double")
    statuses = rules.latest_statuses(spark.createDataFrame([change("a", "Resolved", 1, 1), change("c", "Reviewed", 1, 2), change("zzz", "Resolved", 1, 3)], SCHEMA))
    register = rules.alert_register(alerts, statuses)
    k = rules.register_kpis(register).first()
    assert (k.active_alerts, k.critical_alerts, k.financial_impact, k.revenue_potential, k.reviewed) == (3, 1, 140.0, 14.0, 2)
    pick = lambda **f: sorted(r.workflow_id for r in rules.alert_queue(register, **f).collect())
    assert pick() == ["a", "b", "c", "d"] and pick(statuses=["New"]) == ["b", "d"] and pick(teams=["T"], severities=["Critical"], statuses=["Resolved"]) == ["a"]
    assert rules.register_kpis(rules.alert_register(alerts)).first().reviewed == 0
