"""Append loads of facts: newest row per key, touched months only, redelivery without effect."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from croupier.plans import loads
from croupier.scope import month_key

NAME = "fact_transaction"


def at(day):
    return dt.datetime(2026, 1, day)


@pytest.fixture()
def built(wh, tmp_path):
    path = str(tmp_path / "wh")
    first = type(wh)(wh.spark, raw=wh.raw)
    first.loaded_at = at(1)
    return first.write(path), path


def state(wh):
    return sorted((r.transaction_id, r.amount, r.transaction_day, r.loaded_at) for r in wh._tables[NAME].collect())


def files(path):
    top = f"{path}/{NAME}"
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs if f.startswith("part-")}


def test_changed_moved_new_and_redelivered_rows(spark, built):
    wh, path = built
    rows = wh._tables[NAME].drop("loaded_at")
    before, original = state(wh), rows.count()
    assert {r[3] for r in before} == {at(1)}
    old = files(path)
    assert loads.append_load(wh, path, NAME, rows, at(1)) == [] and files(path) == old  # the same file again
    assert loads.append_load(wh, path, NAME, rows.withColumn("amount", F.col("amount") * 0), dt.datetime(2025, 1, 1)) == [] and files(path) == old  # an older one

    day = rows.agg(F.min("transaction_day")).first()[0]
    one = rows.filter(F.col("transaction_day") == day)
    moved = one.withColumn("transaction_day", F.lit(dt.date(2030, 5, 5))).withColumn("event_month", month_key(F.col("transaction_day")))
    new = one.limit(1).withColumn("transaction_id", F.lit("NEW"))
    load = spark.createDataFrame(moved.unionByName(new).collect(), moved.schema)
    months = loads.append_load(wh, path, NAME, load, at(2))
    assert months == [day.year * 100 + day.month, 203005]
    after = state(wh)
    ids = {r[0] for r in load.collect()}
    assert len(after) == original + 1 and [r for r in after if r[0] not in ids] == [r for r in before if r[0] not in ids]
    assert {(r[2], r[3]) for r in after if r[0] in ids - {"NEW"}} == {(dt.date(2030, 5, 5), at(2))}
    untouched = {f for f in old if f"event_month={months[0]}" not in f}
    assert all(files(path).get(f) == old[f] for f in untouched)  # other months keep their files
    now = files(path)
    assert loads.append_load(wh, path, NAME, load, at(2)) == [] and files(path) == now and state(wh) == after


def test_a_month_that_empties_loses_its_folder(spark, built):
    wh, path = built
    rows = wh._tables[NAME].drop("loaded_at")
    first = rows.agg(F.min("event_month")).first()[0]
    away = rows.filter(F.col("event_month") == first).withColumn("transaction_day", F.lit(dt.date(2031, 1, 1))).withColumn("event_month", F.lit(203101))
    total = rows.count()
    load = spark.createDataFrame(away.collect(), away.schema)
    assert loads.append_load(wh, path, NAME, load, at(3)) == [first, 203101]
    assert not os.path.exists(f"{path}/{NAME}/event_month={first}") and wh._tables[NAME].count() == total


def test_repeated_keys_in_one_load_keep_one_row(spark, built):
    wh, path = built
    rows = wh._tables[NAME].drop("loaded_at")
    twice = [r.asDict() for r in rows.limit(1).collect()] * 2
    twice[1] = {**twice[1], "payment_method": "other"}
    load = spark.createDataFrame([tuple(t[c] for c in rows.columns) for t in twice], rows.schema)
    total = rows.count()
    loads.append_load(wh, path, NAME, load, at(4))
    assert wh._tables[NAME].count() == total and wh._tables[NAME].filter(F.col("loaded_at") == F.lit(at(4))).count() == 1


def shuffle_files(spark):
    names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {os.path.basename(n) for n in names if "/shuffle_" in n}


def test_shuffle_files_of_a_load_go_with_its_steps(spark, built):
    import time

    wh, path = built
    rows = wh._tables[NAME].drop("loaded_at")
    before = shuffle_files(spark)
    loads.append_load(wh, path, NAME, rows.withColumn("amount", F.col("amount") + 1), at(5))
    for _ in range(40):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    assert not left


def test_months_in_several_steps_give_the_same_fact(spark, built, monkeypatch):
    wh, path = built
    steps = []
    monkeypatch.setattr(loads, "ROWS_A_STEP", 1)
    monkeypatch.setattr(loads, "MOST_STEPS", 3)
    monkeypatch.setattr(loads, "_steps", lambda sizes, f=loads._steps: steps.append(f(sizes)) or steps[-1])
    rows = wh._tables[NAME].drop("loaded_at")
    expected = {r.transaction_id: (r.amount + 2, r.transaction_day) for r in rows.collect()}
    months = loads.append_load(wh, path, NAME, rows.withColumn("amount", (F.col("amount") + 2).cast("decimal(18,2)")), at(6))
    assert len(steps[0]) == 3 and [m for some in steps[0] for m in some] == months
    assert {r[0]: (r[1], r[2]) for r in state(wh)} == expected and {r[3] for r in state(wh)} == {at(6)}


def test_rows_without_a_key_are_versions_of_none(spark, built):
    wh, path = built
    rows = wh._tables[NAME].drop("loaded_at")
    total, one = rows.count(), rows.limit(1).collect()[0].asDict()
    load = spark.createDataFrame([tuple({**one, "transaction_id": None}[c] for c in rows.columns)] * 2, rows.schema)
    loads.append_load(wh, path, NAME, load, at(7))
    loads.append_load(wh, path, NAME, load, at(8))
    assert wh._tables[NAME].count() == total + 2 and wh._tables[NAME].filter("transaction_id IS NULL").count() == 2
