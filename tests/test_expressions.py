"""Semantics traps on tiny hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from croupier.functions.exprs import avg_if, day_of_week, max2, min2, monday_week, ratio, sum_if, week_of_year
from croupier.scope import Scope


def test_scalar_max_min_propagate_null(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = df.select(max2("a", "b").alias("mx"), min2("a", "b").alias("mn")).collect()
    assert got[0]["mx"] is None and got[0]["mn"] is None
    assert got[1]["mx"] == 2.0 and got[1]["mn"] == 1.0


def test_sum_of_condition_is_null_over_no_rows(spark):
    empty = spark.createDataFrame([], "x int")
    assert empty.agg(sum_if(F.col("x") > 0).alias("s")).first()["s"] is None
    nulls = spark.createDataFrame([(None,), (None,)], "x int")
    assert nulls.agg(sum_if(F.col("x") > 0).alias("s")).first()["s"] is None
    some = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    row = some.agg(sum_if(F.col("x") > 0).alias("s"), avg_if(F.col("x") > 0).alias("a")).first()
    assert row["s"] == 1 and row["a"] == 0.5


def test_ratio_is_null_on_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "n double, d double")
    assert [r["r"] for r in df.select(ratio("n", "d").alias("r")).collect()] == [None, None, 1.5]


def test_week_numbers_match_monday_first_convention(spark):
    start = dt.date(1999, 12, 20)
    days = [start + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", week_of_year("d").alias("w"), day_of_week("d").alias("dow"), monday_week("d").alias("mon")).collect()
    for r in got:
        assert r["w"] == int(r["d"].strftime("%W")) + 1
        assert r["dow"] == r["d"].isoweekday()
        assert r["mon"] == r["d"] - dt.timedelta(days=r["d"].weekday())


def test_scope_previous_and_bounds():
    s = Scope("2000-01-16", "2000-01-30")
    p = s.previous()
    assert (p.start, p.end) == ("2000-01-01", "2000-01-15")
    assert s.bound_day == dt.date(2000, 1, 31) and s.days == 15
    day = Scope("2000-01-10", "2000-01-10")
    assert day.previous().start == "2000-01-09" and day.previous().end == "2000-01-09"


def test_scope_single_day_includes_boundary(spark):
    s = Scope("2000-01-10", "2000-01-10")
    df = spark.createDataFrame([(dt.datetime(2000, 1, 10, 0, 0),), (dt.datetime(2000, 1, 10, 23, 59, 59),),
                                (dt.datetime(2000, 1, 11, 0, 0),), (dt.datetime(2000, 1, 9, 23, 59),)], "t timestamp_ntz")
    assert df.filter(s.ts_in("t")).count() == 2
