"""The daily series reads each fact once; players with several channels on a day count once."""

import datetime as dt
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from croupier.ml import series
from croupier.plans.warehouse import Warehouse

FACTS = ("fact_casino_session", "fact_transaction", "fact_sports_bet")


def test_each_fact_is_read_once_and_the_result_is_held(spark):
    reads = Counter()

    class Counted(Warehouse):
        def __getattribute__(self, name):
            reads.update([name] if name in FACTS else [])
            return super().__getattribute__(name)

    daily = series.daily_series(Counted.from_driver_tables(spark, "/root/testdata/sf0.001"))
    assert {n: reads[n] for n in FACTS} == dict.fromkeys(FACTS, 1)
    assert "parquet" not in daily._jdf.queryExecution().optimizedPlan().toString()


def test_hand_made_days(spark):
    day = lambda d: dt.date(2000, 1, d)
    sessions = [("p", day(3), 10, 4, 6, True, "Google"), ("p", day(3), 10, 4, 6, True, "Meta"), ("p", day(3), 10, 20, -10, True, "Meta"),
                ("q", day(3), 5, 5, 0, True, None), ("x", day(3), 100, 0, 100, False, None), ("q", None, 7, 0, 7, True, "Meta"), ("q", day(5), 0, 0, 0, True, "Meta")]
    money = "decimal(18,2)"
    own = spark.createDataFrame([(str(i), *r) for i, r in enumerate(sessions)],
                                "session_id string, player_id string, session_date date, total_bet_amount int, total_payout_amount int, casino_ggr int, player_known boolean, channel string")
    own = own.withColumns({c: F.col(c).cast(money) for c in ("total_bet_amount", "total_payout_amount", "casino_ggr")})
    missing = lambda df, name: df.select("*", *[F.lit(None).alias(c) for c in (*Warehouse.FACT_COLUMNS[name], "event_month") if c not in df.columns])
    paid = spark.createDataFrame([("p", day(4), "Deposit", Decimal("3.50"), "Approved"), ("p", day(4), "Deposit", Decimal("1"), "Approved"),
                                  ("q", day(6), "Deposit", Decimal("9"), "Declined")],
                                 f"player_id string, transaction_day date, transaction_type string, amount {money}, transaction_status string")
    bets = spark.createDataFrame([("q", day(3), "e", Decimal("2"), Decimal("1")), ("q", day(3), "f", Decimal("1"), Decimal("1")), ("p", day(3), "e", Decimal("2"), Decimal("-5"))],
                                 f"player_id string, bet_day date, event_name string, stake {money}, sportsbook_ggr {money}")
    dim = spark.createDataFrame([("p", day(2)), ("q", None)], "player_id string, registration_date date")
    wh = Warehouse(spark, tables={"dim_player": dim, **{n: missing(t, n) for n, t in zip(FACTS, (own, paid, bets))}})
    rows = {r.date.day: r for r in series.daily_series(wh).collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6]
    r = rows[3]
    assert (r.casino_ggr, r.sportsbook_ggr, r.ggr, r.player_activity, r.event_exposure) == (102.0, -3.0, 99.0, 3.0, 4.0)
    assert (r.channel_performance, r.rtp) == (6.0, 33 / 135)  # Google 6, Meta -4, no channel 0; the unknown player's 100 left out
    assert (rows[4].deposits, rows[4].ftd, rows[6].deposits, rows[6].ftd, rows[5].player_activity, rows[2].ggr) == (4.5, 1.0, 0.0, 0.0, 1.0, 0.0)
    given = spark.createDataFrame([(day(4),), (day(9),)], "calendar_date date")
    assert sorted(r.date.day for r in series.daily_series(wh.with_tables(dim_date=given)).collect()) == [4, 9]


def test_series_tables_are_built_while_models_are_fitted(wh, tmp_path, monkeypatch):
    from threading import Event

    from croupier.ml import models, training

    done, waited = Event(), []
    build = training._series_tables
    monkeypatch.setattr(training, "_series_tables", lambda *a: (build(*a), done.set())[0])
    monkeypatch.setattr(models, "fit", lambda *a: (waited.append(done.wait(120)), (None, []))[1])
    tables = training.train(wh, str(tmp_path / "run"), "2000-03-31", "r", names=[("churn", 7)])
    assert waited == [True]
    assert {"forecasters", "forecast_backtest", "revenue_forecast", "ml_anomalies", "model_scores", "model_metrics", "run_report"} <= set(tables)
