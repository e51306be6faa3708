"""One-pass snapshots, the training run, saved models and forecasters."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from croupier.ml import boosting, forecasts, models, series, training
from croupier.ml.snapshots import Spec, snapshots
from croupier.plans.scores import snapshot
from croupier.queries import overview, risk
from croupier.scope import Scope

CUTOFF = "2000-03-31"
QUICK = {"maxIter": 3}


def rounded(df):
    return sorted(map(tuple, df.withColumn("avg_duration", F.round("avg_duration", 9)).collect()))


def test_one_pass_equals_a_snapshot_per_cutoff(wh):
    specs = models.specs_for(CUTOFF) + [Spec(CUTOFF, 1, "current"), Spec("1992-01-20", 30, "early")]
    data = snapshots(wh, specs).cache()
    for s in [specs[0], specs[5], specs[-6], specs[-2], specs[-1]]:
        own = data.filter((F.col("horizon") == s.horizon) & (F.col("split") == s.split) & (F.col("cutoff") == s.cutoff)).drop("horizon", "split", "cutoff")
        assert rounded(own) == rounded(snapshot(wh, s.cutoff, s.horizon).select(*own.columns))
    assert data.filter("split = 'train'").select("horizon", "cutoff").distinct().count() == 10


def test_every_fact_is_scanned_once(spark, wh, tmp_path):
    built = wh.write(str(tmp_path / "wh"))
    plan = models.temporal_dataset(built, CUTOFF, current=True)._jdf.queryExecution().optimizedPlan().toString()
    leaves = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("session_start" in x for x in leaves) == sum("transaction_date" in x for x in leaves) == sum("bet_date" in x for x in leaves) == 1


def test_snapshots_of_hand_made_events(spark, wh):
    """A day, game or method counts once, in the segment of its first event; a mark belongs to the segment before it."""
    from croupier.plans.warehouse import Warehouse

    t = lambda s: dt.datetime.fromisoformat(s)
    dim = spark.createDataFrame([("p", t("2000-01-01T00:00:00"), dt.date(2000, 1, 1), "A", "x", "y", "v", "k")],
                                "player_id string, registration_at timestamp_ntz, registration_date date, country string, channel string, device string, "
                                "vip_level string, kyc_status string")
    times = ["2000-02-01T10:00:00", "2000-02-01T23:59:59", "2000-02-02T00:00:00", "2000-02-03T23:59:59", "2000-02-04T00:00:00", "2000-02-20T00:00:00"]
    games = ["g", "h", "g", "g", "i", "j"]
    sessions = spark.createDataFrame([(str(i), "p", g, t(x), t(x).date(), 2.0 + i, 10, 3, 1) for i, (x, g) in enumerate(zip(times, games))],
                                     "session_id string, player_id string, game_id string, session_start timestamp_ntz, session_date date, duration_minutes double, "
                                     "total_bet_amount int, casino_ggr int, bet_count int").withColumns(
        {c: F.col(c).cast("decimal(18,2)") for c in ("total_bet_amount", "casino_ggr")})
    made = Warehouse(spark, tables={"dim_player": dim})
    empty = wh.transactions.limit(0), wh.sports_bets.limit(0)
    shown = type("Made", (), {"sessions": sessions, "transactions": empty[0], "sports_bets": empty[1], "dim_player": made.dim_player})()
    rows = {r.split: r for r in snapshots(shown, [Spec("2000-02-01", 2, "a"), Spec("2000-02-03", 1, "b"), Spec("2000-01-10", 7, "c")]).collect()}
    assert set(rows) == {"a", "b"}  # nothing happened before c
    a, b = rows["a"], rows["b"]
    assert (a.session_count, a.active_days, a.distinct_games, a.future_activity, a.future_ggr) == (2, 1, 2, 2, 6)
    assert (b.session_count, b.active_days, b.distinct_games, b.future_activity, b.max_duration, b.recency_days) == (4, 3, 2, 1, 5.0, 0)


@pytest.fixture(scope="module")
def run(spark, wh, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    return folder, training.train(wh, folder, CUTOFF, "r1", QUICK)


def test_model_scores_come_from_trained_models(run, wh):
    _, tables = run
    scores = tables["model_scores"]
    status = {r.model_name: r.status for r in tables["model_list"].collect()}
    assert set(status) == {"churn_7d", "churn_14d", "churn_30d", "ltv_30d", "ltv_90d", "ltv_180d"} and status["ltv_30d"] == "trained"
    assert scores.count() == scores.select("player_id").distinct().count() == wh.model_scores.count()
    bad = " OR ".join([f"churn_probability_{h}d NOT BETWEEN 0 AND 1" for h in (7, 14, 30)] + [f"remaining_ltv_{h}d < 0" for h in (30, 90, 180)]
                      + [f"predicted_total_ltv_{h}d <> observed_value + remaining_ltv_{h}d" for h in (30, 90, 180)] + ["churn_probability IS NULL"])
    assert scores.filter(bad).count() == 0
    assert scores.drop("import_run_id").columns == wh.model_scores.columns
    closed = {r.player_id: r.remaining_ltv_90d for r in wh.model_scores.collect()}
    assert any(closed[r.player_id] != r.remaining_ltv_90d for r in scores.collect())
    assert tables["predictions"].count() == 6 * scores.count() and tables["next_best_actions"].count() == scores.count()


def test_metrics_and_report(run):
    _, tables = run
    m = tables["model_metrics"].collect()
    assert {r.split for r in m} == {"validation", "test"}
    trained = {r.model_name for r in tables["model_list"].collect() if r.status == "trained"}
    assert trained | {f"forecast_{t}" for t in series.TARGETS} == {r.model_name for r in m}
    assert all(r.metric_value == round(r.metric_value, 5) for r in m)
    assert sum(r.players for r in tables["run_report"].collect()) == tables["model_scores"].count()


def test_loaded_models_give_the_same_scores(run, wh):
    folder, tables = run
    again = training.score(wh, folder)
    of = lambda df: sorted(map(str, df.select("player_id", *[training.column(k, h) for k, h in training.NAMES], "recommended_action").collect()))
    assert of(again) == of(tables["model_scores"])


def test_training_twice_gives_the_same_scores(run, wh, tmp_path):
    _, tables = run
    again = training.train(wh, str(tmp_path / "again"), CUTOFF, "r2", QUICK)
    of = lambda t: sorted(map(str, t["model_scores"].drop("import_run_id").collect()))
    assert of(again) == of(tables)


def test_kpis_run_on_trained_scores(run, wh):
    _, tables = run
    shown = type(wh)(wh.spark, raw=wh.raw, tables={**wh._tables, "model_scores": tables["model_scores"].drop("import_run_id")})
    scope = Scope("2000-01-01", "2000-03-31")
    assert overview.risk_summary(shown, scope).count() == 1 and risk.metrics(shown, scope).count() == 1
    assert shown.mart_player_360.count() == tables["model_scores"].count()


def test_horizon_that_cannot_train_keeps_the_closed_form(wh, tmp_path):
    """Before the first events there is nothing to train on."""
    tables = training.train(wh, str(tmp_path / "early"), "1992-03-01", "r3", QUICK)
    assert {r.status for r in tables["model_list"].collect()} == {"closed form"}
    early = type(wh)(wh.spark, raw=wh.raw, tables=dict(wh._tables))
    early._tables.pop("model_scores", None)
    early.scoring_cutoff = "1992-03-01"
    columns = ["player_id", *[training.column(k, h) for k, h in training.NAMES]]
    assert sorted(map(str, tables["model_scores"].select(*columns).collect())) == sorted(map(str, early.model_scores.select(*columns).collect()))


def test_trees_fit_a_step_and_stop_at_small_leaves():
    r = np.random.default_rng(0)
    x = r.uniform(0, 10, (400, 3)).round(1)  # fewer values than bins: every threshold can be found
    y = np.where(x[:, 1] > 4, 50.0, 10.0) + np.where(x[:, 0] > 7, 5.0, 0.0)
    trees = boosting.boost(x, y)
    assert np.abs(trees.predict(x) - y).max() < 1.0 and len(trees.roots) == boosting.ROUNDS
    few = boosting.boost(x[:30], y[:30])  # no split leaves 20 rows on both sides
    assert np.allclose(few.predict(x), y[:30].mean())


def test_split_band_and_recursion_equal_brute_force(spark, wh):
    daily = series.daily_series(wh).cache()
    fitted = forecasts.fit(daily).cache()
    got = forecasts.apply(daily, fitted).toPandas()
    assert sorted(got.metric.unique()) == sorted(series.TARGETS)
    frame = daily.toPandas().sort_values("date").reset_index(drop=True)
    model = fitted.filter("metric = 'ggr'").toPandas().iloc[0]
    y = frame["ggr"].astype(float)
    full = pd.DataFrame({"date": frame.date, "actual": y, "dow": [float(d.weekday()) for d in frame.date], "month": [float(d.month) for d in frame.date],
                         **{f"lag_{k}": y.shift(k) for k in (1, 7, 14)}, **{f"rolling_{k}": y.shift(1).rolling(k).mean() for k in (7, 28)}}).dropna()
    a, b = math.floor(len(full) * 0.65), math.floor(len(full) * 0.82)
    x = full[forecasts.FEATURES].to_numpy(float)
    first = boosting.boost(x[:a], full.actual.to_numpy()[:a])
    expected = np.maximum(first.predict(x), 0)
    own = got[got.metric == "ggr"]
    for split, lo, hi in (("validation", a, b), ("test", b, len(full))):
        part = own[own.split == split].sort_values("forecast_date")
        assert list(part.forecast_date) == list(full.date[lo:hi])
        assert np.allclose(part.predicted_value, expected[lo:hi], rtol=1e-6)
    low, high = np.quantile(full.actual.to_numpy()[a:b] - expected[a:b], [0.1, 0.9])
    assert np.isclose(low, model.low) and np.isclose(high, model.high)
    assert np.allclose(own.lower_bound, np.maximum(own.predicted_value + low, 0)) and np.allclose(own.upper_bound, np.maximum(own.predicted_value + high, 0))
    again, values = boosting.boost(x[:b], full.actual.to_numpy()[:b]), y.tolist()
    for k in range(1, 31):
        day = frame.date.iloc[-1] + dt.timedelta(days=k)
        row = [day.weekday(), day.month, values[-1], values[-7], values[-14], np.mean(values[-7:]), np.mean(values[-28:])]
        values.append(max(0.0, again.predict(np.array([row], float))[0]))
    future = own[own.split == "future"].sort_values("forecast_date")
    assert np.allclose(future.predicted_value, values[-30:], rtol=1e-6)


def test_saved_forecasters_give_the_same_rows(run, spark, wh):
    folder, tables = run
    daily = spark.read.parquet(f"{folder}/daily_series")
    saved = forecasts.load(spark, f"{folder}/forecasters").drop("scoring_cutoff")
    again = forecasts.apply(daily, saved).drop("market").select(*tables["forecast_backtest"].columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, tables["forecast_backtest"].collect()))


def test_series_of_markets_are_independent(spark):
    """Two markets with unlike patterns, and one too short to train."""
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=i), m, *[float(f(i))] * len(series.TARGETS))
            for m, n, f in (("a", 300, lambda i: 100 + 50 * (i % 7 == 0)), ("b", 300, lambda i: 10.0), ("c", 20, lambda i: i)) for i in range(n)]
    daily = spark.createDataFrame(rows, "date date, market string, " + ", ".join(f"{t} double" for t in series.TARGETS))
    out = forecasts.apply(daily, forecasts.fit(daily)).filter("metric = 'ggr' AND split = 'future'").toPandas()
    assert set(out.market) == {"a", "b"} and len(out) == 60
    assert np.allclose(out[out.market == "b"].predicted_value, 10.0)
    a = out[out.market == "a"].sort_values("forecast_date").predicted_value.to_numpy()
    assert max(abs(v - (100 + 50 * ((300 + k) % 7 == 0))) for k, v in enumerate(a)) < 10


def test_a_run_for_one_model_fits_that_model_only(wh, tmp_path):
    tables = training.train(wh, str(tmp_path / "one"), CUTOFF, "r4", QUICK, names=[("churn", 14)])
    assert [(r.model_name, r.status) for r in tables["model_list"].collect()] == [("churn_14d", "trained")]
    measured = {r.model_name for r in tables["model_metrics"].select("model_name").collect()}
    assert "churn_14d" in measured and not measured & {f"{k}_{h}d" for k, h in training.NAMES if (k, h) != ("churn", 14)}
    assert tables["model_scores"].count() > 0


def test_refit_runs_beside_the_first_fit(spark, monkeypatch):
    import threading

    both = threading.Barrier(2, timeout=60)

    def fitted(rows, kind, params):
        both.wait()
        return sorted(r.split for r in rows.collect())

    monkeypatch.setattr(models, "trainable", lambda *_: True)
    monkeypatch.setattr(models, "_labelled", lambda data, kind: data)
    monkeypatch.setattr(models, "_fitted", fitted)
    monkeypatch.setattr(models, "predicted", lambda model, kind, rows: rows)
    monkeypatch.setattr(models, "regression_metrics", lambda rows: {"mae": float(rows.count())})
    data = spark.createDataFrame([("train", 1.0), ("train", 2.0), ("validation", 3.0), ("test", 4.0)], "split string, value double")
    model, rows = models.fit(data, "ltv", 30)
    assert model == ["train", "train", "validation"]
    assert [(r[2], r[4]) for r in rows] == [("validation", 1.0), ("test", 1.0)]


def test_partitions_of_a_fit_are_one_wave_of_tasks():
    """36 partitions of 100,000 rows were three waves of short tasks in each of some 700 jobs."""
    assert training.partitions(0, 12) == 1 and training.partitions(360_000, 12) == 3
    assert training.partitions(3_600_000, 12) == 12  # what 12 cores run at a time
    assert training.partitions(21_600_000, 12) == 44  # and no partition grows beyond the bound


def test_scorecard_counts_the_anomalies_of_its_training_run(wh, monkeypatch):
    from croupier import catalog_ml

    spark = wh.spark
    metrics = spark.createDataFrame([("churn_30d", "test", "roc_auc", 0.75), ("churn_30d", "test", "lift_top_10pct", 2.5), ("forecast_ggr", "test", "wape", 0.25)],
                                    "model_name string, split string, metric_name string, metric_value double")
    monkeypatch.setattr(catalog_ml, "trained", lambda w, *names: {"model_metrics": metrics, "ml_anomalies": spark.range(4)})
    monkeypatch.setattr(catalog_ml, "next_best_actions_table", lambda w: spark.createDataFrame([("Do nothing",), ("Manual fraud review",)], "recommended_action string"))
    monkeypatch.setattr(series, "anomalies", lambda *a: pytest.fail("the daily series is built a second time"))
    fresh = type(wh)(spark, raw=wh.raw)
    assert [tuple(r) for r in catalog_ml.scorecard(fresh).collect()] == [(0.75, 2.5, 0.75, 4, 1)]


def test_training_facts_give_the_same_rows_from_one_derivation(wh):
    facts = type(wh)(wh.spark, raw=wh.raw).training_facts
    specs = models.specs_for(CUTOFF) + [Spec(CUTOFF, 1, "current")]
    assert rounded(snapshots(facts, specs)) == rounded(snapshots(wh, specs))
    assert sorted(map(tuple, series.daily_series(facts).collect())) == sorted(map(tuple, series.daily_series(wh).collect()))
    sessions = facts.fact_casino_session
    assert "/training-facts-" in sessions.inputFiles()[0] and sessions is facts.sessions
    assert wh.spark.read.parquet(sessions.inputFiles()[0].rsplit("/", 1)[0]).count() == wh.fact_casino_session.count()


def test_marks_count_a_day_and_a_game_once(spark, wh):
    """Also with a missing game, a repeated row, a late evening behind a mark and rows without a time."""
    from croupier.plans.warehouse import Warehouse, _TrainingFacts

    t = lambda s: dt.datetime.fromisoformat(s) if s else None
    dim = spark.createDataFrame([(p, t("2000-01-01T00:00:00"), dt.date(2000, 1, 1), "A", "x", "y", "v", "k") for p in "pq"],
                                "player_id string, registration_at timestamp_ntz, registration_date date, country string, channel string, device string, "
                                "vip_level string, kyc_status string")
    seen = [("p", "2000-02-01T10:00:00", "g"), ("p", "2000-02-01T10:00:00", "g"), ("p", "2000-02-01T23:59:59.500", "h"), ("p", "2000-02-02T00:00:00", None),
            ("p", "2000-02-03T09:00:00", "g"), ("p", None, "i"), ("p", "2000-02-03T10:00:00", "i"), ("q", "2000-02-01T23:59:59.500", "g"), ("q", "2000-02-02T01:00:00", None)]
    empty = {n: getattr(wh, n).limit(0) for n in ("fact_casino_session", "fact_transaction", "fact_sports_bet")}
    made = spark.createDataFrame([(p, g, t(x), t(x).date() if x else None, 2.0, 10, 7, 3, 1, True, "x") for p, x, g in seen],
                                 "player_id string, game_id string, session_start timestamp_ntz, session_date date, duration_minutes double, total_bet_amount int, "
                                 "total_payout_amount int, casino_ggr int, bet_count int, player_known boolean, channel string").withColumns(
        {c: F.col(c).cast("decimal(18,2)") for c in ("total_bet_amount", "total_payout_amount", "casino_ggr")})
    source = Warehouse(spark, raw=wh.raw, tables={**empty, "fact_casino_session": made, "dim_player": dim, "dim_game": wh.dim_game})
    facts = _TrainingFacts(source)
    plain = type("Plain", (), {"sessions": made, "transactions": source.transactions, "sports_bets": source.sports_bets, "dim_player": dim})()
    specs = [Spec("2000-02-01", 1, "a"), Spec("2000-02-02", 1, "b"), Spec("2000-02-04", 1, "c")]
    got = {(r.player_id, r.split): (r.session_count, r.active_days, r.distinct_games) for r in snapshots(facts, specs).collect()}
    assert got == {("p", "a"): (2, 1, 1), ("p", "b"): (4, 2, 2), ("p", "c"): (6, 3, 3), ("q", "b"): (2, 2, 1), ("q", "c"): (2, 2, 1)}
    assert rounded(snapshots(facts, specs)) == rounded(snapshots(plain, specs))


def test_models_at_a_time_keep_their_rows_in_memory():
    gb = 1_000_000_000
    assert training.at_a_time(3_600_000, None) == training.at_a_time(0, gb) == training.at_a_time(36_000, 10 * gb) == training.THREADS
    assert 2 <= training.at_a_time(3_600_000, 10 * gb) < 3  # two of six models at 1 GB of input on 10 GB of storage
    assert 0 < training.at_a_time(21_600_000, 10 * gb) < 1  # one fit after the other


def test_a_refit_without_room_waits_for_the_first_fit(spark, monkeypatch):
    order = []

    def fitted(rows, kind, params):
        order.append(sorted(r.split for r in rows.collect()))
        return order[-1]

    monkeypatch.setattr(models, "trainable", lambda *_: True)
    monkeypatch.setattr(models, "_labelled", lambda data, kind: data)
    monkeypatch.setattr(models, "_fitted", fitted)
    monkeypatch.setattr(models, "predicted", lambda model, kind, rows: rows)
    monkeypatch.setattr(models, "regression_metrics", lambda rows: order.append("measured") or {"mae": 1.0})
    data = spark.createDataFrame([("train", 1.0), ("train", 2.0), ("validation", 3.0), ("test", 4.0)], "split string, value double")
    model, rows = models.fit(data, "ltv", 30, beside=False)
    assert order == [["train", "train"], "measured", "measured", ["train", "train", "validation"]] and model == order[-1] and len(rows) == 2


def test_scorecard_and_trained_scores_read_the_facts_of_the_run(wh, monkeypatch):
    """Both derived every fact once more."""
    from croupier import catalog_ml

    fresh = type(wh)(wh.spark, raw=wh.raw)
    read = []
    monkeypatch.setattr(catalog_ml, "trained", lambda w, *names: {"model_scores": wh.model_scores.withColumn("import_run_id", F.lit("r")),
                                                                  "model_metrics": None, "ml_anomalies": None})
    monkeypatch.setattr(catalog_ml, "next_best_actions_table", lambda w: read.append(w))
    monkeypatch.setattr(catalog_ml.pages, "ml_scorecard", lambda *a: None)
    catalog_ml.scorecard(fresh)
    read.append(catalog_ml.with_trained_scores(fresh))
    assert all(w.by_player is fresh.training_facts for w in read) and len(read) == 2 and fresh._player_order is None
    facts = fresh.training_facts
    of = lambda w: sorted(map(str, w.mart_player_360.select("player_id", "ftd_date", "first_activity_date", "churn_probability").collect()))
    assert of(read[1]) == of(wh)
    assert sorted(map(str, fresh.scored_from(facts).model_scores.collect())) == sorted(map(str, wh.model_scores.collect()))
