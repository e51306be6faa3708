"""Importer contracts and checks on micro-fixtures (alias mapping, type errors, duplicates,
orphans, delimiter, RTP range, training gate, activation)."""

import uuid

import pytest
from pyspark.sql import functions as F


from croupier.ml import training
from croupier.plans.quality import WarehouseQualityError
from croupier.queries import crm, freshness, risk
from croupier.scope import Scope
from croupier.sources import activation as act
from croupier.sources import csv_import as ci
from croupier.sources import publish


def _csv(tmp_path, name, text):
    p = tmp_path / f"{uuid.uuid4().hex[:6]}_{name}"
    p.write_text(text, encoding="utf-8")
    return str(p)


def _load(spark, tmp_path, name, text, dataset=None):
    df = ci.read_csv(spark, _csv(tmp_path, name, text))
    ds = dataset or ci.infer_dataset(name, df.columns)
    return ds, ci.validate(spark, ds, df, ci.suggest_mapping(ds, df.columns))


def _codes(v):
    return {(r["code"], r["column"]) for r in v.issues.collect()}


PLAYERS = "customer_id,signup_date,market,source\nC1,2026-01-03,Canada,Google\n"
TX = "payment_id,customer_id,created_at,type,value,status,method\nT1,C1,2026-01-04 10:00:00,Deposit,25.5,Approved,Visa\n"


def test_alias_mapping_and_clean_files(spark, tmp_path):
    ds, v = _load(spark, tmp_path, "players.csv", PLAYERS)
    assert ds == "players"
    assert ci.suggest_mapping("players", ["customer_id", "signup_date", "market", "source"])["player_id"] == "customer_id"
    assert not [c for c in _codes(v) if c[0] not in ("OPTIONAL_MISSING",)]
    ds, t = _load(spark, tmp_path, "transactions.csv", TX)
    assert ds == "transactions" and not [c for c in _codes(t) if c[0] != "OPTIONAL_MISSING"]
    row = t.frame.first()
    assert row["amount"] == 25.5 and row["processing_fee"] == 0.0 and row["transaction_type"] == "Deposit"


def test_invalid_type_reports_file_line(spark, tmp_path):
    _, t = _load(spark, tmp_path, "transactions.csv", TX.replace("25.5", "not-a-number"))
    bad = [r for r in t.issues.collect() if r["code"] == "INVALID_TYPE"]
    assert len(bad) == 1 and bad[0]["column"] == "amount" and bad[0]["row"] == 2


def test_duplicate_key_and_missing_value(spark, tmp_path):
    _, v = _load(spark, tmp_path, "players.csv", PLAYERS + "C1,2026-01-05,,Meta\n")
    codes = _codes(v)
    assert ("DUPLICATE_KEY", "player_id") in codes and ("MISSING_VALUE", "country") in codes


def test_orphans_and_summary(spark, tmp_path):
    _, p = _load(spark, tmp_path, "players.csv", PLAYERS)
    _, t = _load(spark, tmp_path, "transactions.csv", TX.replace("T1,C1", "T1,UNKNOWN"))
    cross = ci.cross_validate(spark, {"players": p.frame, "transactions": t.frame})
    assert [r["code"] for r in cross.collect()] == ["ORPHAN_PLAYER"]
    summary = ci.quality_summary({"players": p.frame, "transactions": t.frame}, p.issues.unionByName(t.issues).unionByName(cross))
    assert summary["errors"] >= 1 and not summary["ready"]


def test_semicolon_delimiter(spark, tmp_path):
    df = ci.read_csv(spark, _csv(tmp_path, "export.csv", "customer_id;signup_date;market\nC9;2026-02-01;Spain\n"))
    assert df.columns[:-1] == ["customer_id", "signup_date", "market"]
    assert ci.infer_dataset("export.csv", df.columns) == "players"


def test_rtp_range_and_unknown_game(spark, tmp_path):
    _, ok = _load(spark, tmp_path, "games.csv", "game_id,name,rtp\nG1,Roulette,0.99\n")
    assert ("INVALID_RANGE", "theoretical_rtp") not in _codes(ok)
    _, bad = _load(spark, tmp_path, "games.csv", "game_id,name,rtp\nG1,Roulette,1.4\n")
    assert ("INVALID_RANGE", "theoretical_rtp") in _codes(bad)
    _, s = _load(spark, tmp_path, "sessions.csv",
                 "session_id,player_id,game_id,started_at,wager_amount,win_amount\nS1,C1,G404,2026-01-04 10:00:00,10,5\n")
    cross = ci.cross_validate(spark, {"games": ok.frame, "casino_sessions": s.frame})
    assert "ORPHAN_GAME" in [r["code"] for r in cross.collect()]
    assert s.frame.first()["casino_ggr"] == 5.0
    derived = ci.derive_games(s.frame).first()
    assert derived["game_name"] == "G404" and derived["theoretical_rtp"] == 0.96


def test_training_gate(spark, tmp_path):
    _, s = _load(spark, tmp_path, "sessions.csv",
                 "session_id,player_id,game_id,started_at,wager_amount,win_amount\nS1,C1,G1,2026-04-01 10:00:00,10,5\n")
    assert not act.training_gate({"casino_sessions": s.frame}, "2026-01-15", "2026-08-04")
    _, s2 = _load(spark, tmp_path, "sessions.csv",
                  "session_id,player_id,game_id,started_at,wager_amount,win_amount\nS1,C1,G1,2026-01-01 10:00:00,10,5\nS2,C1,G1,2026-08-04 10:00:00,1,1\n")
    assert act.training_gate({"casino_sessions": s2.frame}, "2026-01-15", "2026-08-04")


def test_activation_writes_versioned_warehouse_and_registry(spark, tmp_path):
    _, p = _load(spark, tmp_path, "players.csv", PLAYERS)
    _, t = _load(spark, tmp_path, "transactions.csv", TX)
    root = str(tmp_path / "imports")
    issues = p.issues.unionByName(t.issues)
    run_id, path = act.activate(spark, {"players": p.frame, "transactions": t.frame}, issues, ["players.csv", "transactions.csv"],
                               root, "2026-01-15", "2026-08-04")
    hist = act.import_history(spark, root).collect()
    assert hist[0]["run_id"] == run_id and hist[0]["status"] == "SUCCESS"
    assert act.active_warehouse(spark, root) == path
    scores = spark.read.parquet(f"{path}/model_scores").collect()
    assert len(scores) == 1 and scores[0]["recommended_action"] == "Missing data"


def test_quotes_newlines_ragged_rows_and_empty_files(spark, tmp_path):
    text = 'game_id,name,rtp\nG1,"Big ""Win"", x",0.95\nG2,"two\nlines",0.96\n'
    df = ci.read_csv(spark, _csv(tmp_path, "games.csv", text), quoted_newlines=True)
    g = ci.validate(spark, "games", df, ci.suggest_mapping("games", df.columns))
    assert sorted(r["game_name"] for r in g.frame.collect()) == ['Big "Win", x', "two\nlines"]
    _, bad = _load(spark, tmp_path, "games.csv", "game_id,name,rtp\nG1,Roulette,0.95,extra\nG2,Poker,0.96\n")
    assert [(r["code"], r["row"]) for r in bad.issues.collect() if r["code"] == "MALFORMED_ROW"] == [("MALFORMED_ROW", 2)]
    _, short = _load(spark, tmp_path, "games.csv", "game_id,name,rtp\nG1\nG2,Poker\nG3,Roulette,0.95\n")  # missing cells, as in any other row
    assert sorted((r["game_id"], r["game_name"]) for r in short.frame.collect())[1:] == [("G2", "Poker"), ("G3", "Roulette")]
    assert _codes(short) >= {("MISSING_VALUE", "game_name")} and "MALFORMED_ROW" not in {code for code, _ in _codes(short)}
    for empty in ("game_id,name,rtp\n", ""):
        with pytest.raises(Exception):
            ci.read_csv(spark, _csv(tmp_path, "games.csv", empty))


def test_files_with_different_separators_are_refused(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("game_id,name\nG1,A\n")
    (folder / "b.csv").write_text("game_id;name\nG2,B\n")
    with pytest.raises(ValueError):
        ci.read_csv(spark, str(folder))
    assert ci.read_csv(spark, str(folder), sep=",").count() == 2


def test_every_wrong_cell_is_an_issue(spark, tmp_path):
    rows = "".join(f"T{i},C1,2026-01-04,Deposit,x{i},Approved,Visa\n" for i in range(60))
    df = ci.read_csv(spark, _csv(tmp_path, "transactions.csv", TX.splitlines()[0] + "\n" + rows))
    mapping = ci.suggest_mapping("transactions", df.columns)
    assert ci.validate(spark, "transactions", df, mapping).issues.filter("code = 'INVALID_TYPE'").count() == 60
    few = ci.validate(spark, "transactions", df, mapping, sample=25).issues.filter("code = 'INVALID_TYPE'")
    assert sorted(r["row"] for r in few.collect()) == list(range(2, 27))


def test_mapping_one_column_twice(spark, tmp_path):
    df = ci.read_csv(spark, _csv(tmp_path, "games.csv", "game_id,name\nG1,A\n"))
    v = ci.validate(spark, "games", df, {"game_id": "game_id", "game_name": "game_id"})
    assert ("DUPLICATE_MAPPING", "game_id") in _codes(v)


def test_failed_gate_keeps_the_active_warehouse(spark, tmp_path):
    """Rows that staging refuses change the row counts, so the gate stops the activation."""
    _, p = _load(spark, tmp_path, "players.csv", PLAYERS)
    _, t = _load(spark, tmp_path, "transactions.csv", TX)
    root = str(tmp_path / "imports")
    none = p.issues.filter("severity = 'ERROR'")
    _, first = act.activate(spark, {"players": p.frame, "transactions": t.frame}, none, ["a"], root, "2026-01-15", "2026-08-04")
    refused = t.frame.withColumn("transaction_status", F.lit("approved"))  # staging knows 'Approved' only
    with pytest.raises(WarehouseQualityError):
        act.activate(spark, {"players": p.frame, "transactions": refused}, none, ["b"], root, "2026-01-15", "2026-08-04")
    assert act.active_warehouse(spark, root) == first
    assert sorted(r["status"] for r in act.import_history(spark, root).collect()) == ["FAILED", "SUCCESS"]
    import os
    assert len([d for d in os.listdir(root) if d.startswith("warehouse_")]) == 1


TRAINING_TX = TX + "T2,C1,2026-08-05 10:00:00,Deposit,10,Approved,Visa\nT3,C1,2025-12-01 10:00:00,Deposit,10,Approved,Visa\n"


def _activate(spark, tmp_path, root, tx=TRAINING_TX):
    _, p = _load(spark, tmp_path, "players.csv", PLAYERS)
    _, t = _load(spark, tmp_path, "transactions.csv", tx)
    return act.activate(spark, {"players": p.frame, "transactions": t.frame}, p.issues.filter("severity = 'ERROR'"), ["a"], root, "2026-01-15", "2026-08-04",
                        params={"maxIter": 2})


def test_activation_with_training_span_publishes_every_model_table(spark, tmp_path):
    root = str(tmp_path / "imports")
    run_id, path = _activate(spark, tmp_path, root)
    assert {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/app_metadata").collect()}["model_status"] == "available"
    listed = {r["table_name"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    assert set(training.TABLES) < set(listed) and {r["version"] for r in listed.values()} == {run_id}
    opened = publish.open_tables(spark, path)
    assert all(opened[name].count() == r["rows"] for name, r in listed.items())
    assert freshness.model_available(spark, path) and publish.active(spark, root) == (run_id, path)
    wh = act.open_active(spark, root)
    assert wh.mart_player_360.count() == wh.model_scores.count() == 1
    assert {r.split for r in wh._tables["forecast_backtest"].select("split").distinct().collect()} >= {"validation", "test", "future"}


def test_activation_without_models_leaves_scores_missing(spark, tmp_path):
    root = str(tmp_path / "imports")
    _, path = _activate(spark, tmp_path, root, TX)
    assert not freshness.model_available(spark, path) and not freshness.model_available(spark, str(tmp_path / "nothing"))
    wh = act.open_active(spark, root)
    scope = Scope("2026-01-01", "2026-01-31")
    row = risk.metrics(wh, scope).first()
    assert row["accounts"] == 0 and row["cases"] is None and crm.segments(wh, scope).count() == 5
    assert [r.recommended_action for r in wh.v_player_scores.collect()] == ["Missing data"]


@pytest.mark.parametrize("step", ["croupier.plans.warehouse.Warehouse.write", "croupier.plans.quality.quality_checks", "croupier.ml.training.train",
                                  "croupier.sources.publish.write_manifest", "croupier.sources.publish.point_to"])
def test_a_failure_in_any_step_leaves_the_old_version_active(spark, tmp_path, monkeypatch, step):
    import os

    root = str(tmp_path / "imports")
    first = act.activate(spark, *_frames(spark, tmp_path, TX), ["a"], root, "2026-01-15", "2026-08-04")

    def fails(*_, **__):
        raise RuntimeError(step)

    monkeypatch.setattr(step, fails)
    with pytest.raises(RuntimeError, match=step.rsplit(".", 1)[1]):
        _activate(spark, tmp_path, root)
    assert publish.active(spark, root) == first
    assert [d for d in os.listdir(root) if d.startswith("warehouse_")] == [first[1].rsplit("/", 1)[1]]
    assert [r["status"] for r in act.import_history(spark, root).collect()] == ["FAILED", "SUCCESS"]


def _frames(spark, tmp_path, tx):
    _, p = _load(spark, tmp_path, "players.csv", PLAYERS)
    _, t = _load(spark, tmp_path, "transactions.csv", tx)
    return {"players": p.frame, "transactions": t.frame}, p.issues.filter("severity = 'ERROR'")


def test_planted_orphans_cover_every_event_and_order(spark, wh):
    from croupier import catalog_import as cat

    events, orders = (spark.read.parquet(f"{wh.sf_dir}/{t}.parquet").count() for t in ("events", "orders"))
    found = {(r.dataset, r.code): r.message for r in cat.planted_orphans(wh).collect()}
    assert found["kyc_risk_events", "ORPHAN_PLAYER"].startswith(f"{events:,} rows")
    assert found["bonuses", "ORPHAN_PLAYER"].startswith(f"{orders:,} rows")


def test_headers_are_read_without_a_job_and_large_files_are_split(spark, tmp_path):
    rows = "".join(f"G{i},Name {i},0.95\n" for i in range(20_000))
    path = _csv(tmp_path, "games.csv", "game_id,name,rtp\n" + rows)
    group = f"headers-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    assert ci.header_lines(spark, path) == ["game_id,name,rtp"]
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert ci.read_csv(spark, path).rdd.getNumPartitions() > 3
        assert ci.read_csv(spark, path, quoted_newlines=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
