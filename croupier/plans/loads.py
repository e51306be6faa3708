"""Append loads of facts (D1-D3): the newest ``loaded_at`` of a key wins, only touched months are rewritten.

A load brings fact rows with the time they were loaded. Per key the row with the greatest ``loaded_at``
stays (at equal times the one with the smaller row hash, so the order of arrival does not matter). A row that
changes its day may leave a month; the months to rewrite are those of the winning rows and those
the same keys held before. Everything else is untouched on disk, and a load without a winning row,
such as a redelivered file, writes nothing.

A load is judged by keys, days, load times and row hashes alone, in one aggregation over the fact and the load;
whole rows are moved only for touched months, and only those of the load that win. The new content of these months is
written to the shared folder some months at a time, so that the shuffle files of one step, which go when it ends,
stay bounded; then all of it replaces the months at once. The fact is never read and overwritten by the same job.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.plans.warehouse import Warehouse
from croupier.scope import MONTH_COLUMN
from croupier.session import released_shuffles, shared_dir

NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
ROW = "__row"  # number of a row of the load
# The new content of touched months is derived in at most MOST_STEPS parts of whole months; each part reads the load anew,
# so small ones are not divided further.
MOST_STEPS, ROWS_A_STEP = 8, 4_000_000


def key_of(name: str) -> str:
    return Warehouse.FACT_DAY[name][1]


def _order(rows: DataFrame) -> F.Column:
    """Sorts versions of a row: load time, then a hash of the other columns; the smaller hash is the newer."""
    content = [c for c in sorted(rows.columns) if c not in ("loaded_at", MONTH_COLUMN)]
    return F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.bitwise_not(F.xxhash64(*content)).alias("tie"))


def _month() -> F.Column:
    return F.coalesce(MONTH_COLUMN, F.lit(-1))


def _winners(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Per key whose newest row is one of ``rows``: that row's number and month, and the months the key held.

    Rows of the fact without a key are no version of each other, so they lose to none."""
    held = existing.filter(F.col(key).isNotNull()).select(key, _order(existing).alias("old"), _month().alias("old_month"))
    come = rows.select(key, F.struct(_order(rows.drop(ROW)).alias("order"), _month().alias("month"), ROW).alias("new"))
    judged = held.unionByName(come, allowMissingColumns=True).groupBy(key).agg(
        F.max("old").alias("old"), F.max("new").alias("new"), F.collect_set("old_month").alias("old_months"))
    return judged.filter(F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.order") > F.col("old")))).select(
        key, F.col(f"new.{ROW}"), "new.month", "old_months")


def _steps(sizes: dict[int, int]) -> list[list[int]]:
    """Months in order, dealt to steps of about the same number of rows."""
    steps, held = [], 0
    room = max(ROWS_A_STEP, sum(sizes.values()) / MOST_STEPS)
    for month in sorted(sizes):
        if not steps or held >= room:
            steps, held = [*steps, []], 0
        steps[-1].append(month)
        held += sizes[month]
    return steps


def append_load(wh: Warehouse, path: str, name: str, load: DataFrame, loaded_at: dt.datetime) -> list[int | None]:
    """Merge ``load`` (rows of fact ``name``, without ``loaded_at``) into the written warehouse at ``path``;
    returns the months that were rewritten."""
    with released_shuffles(wh.spark):
        return _append_load(wh, path, name, load, loaded_at)


def _append_load(wh: Warehouse, path: str, name: str, load: DataFrame, loaded_at: dt.datetime) -> list[int | None]:
    from croupier.sources.activation import delete_folder

    spark, key = wh.spark, key_of(name)
    target = f"{path.rstrip('/')}/{name}"
    existing = wh._tables[name]
    scratch = shared_dir(spark, f"loads-{uuid.uuid4().hex}")
    stamped = load.withColumn("loaded_at", F.lit(loaded_at)).select(*[F.col(f.name).cast(f.dataType) for f in existing.schema])
    stamped.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(f"{scratch}/load")
    rows = spark.read.parquet(f"{scratch}/load")
    _winners(existing, rows, key).write.parquet(f"{scratch}/winners")
    wins = spark.read.parquet(f"{scratch}/winners")

    touched = wins.select(F.explode(F.array_union(F.array("month"), "old_months")).alias("m")).distinct()
    months = sorted(r["m"] for r in touched.collect())  # one number a month
    if not months:
        delete_folder(spark, scratch)
        return []
    sizes = dict.fromkeys(months, 0)
    for counted in (existing, wins.select(F.col("month").alias(MONTH_COLUMN))):  # one number a month
        for r in counted.filter(_month().isin(months)).groupBy(_month().alias("m")).count().collect():
            sizes[r["m"]] += r["count"]
    day = Warehouse.FACT_DAY[name][0]
    for some in _steps(sizes):
        # what the load replaces goes, what it wins comes
        replaced = wins.filter(F.arrays_overlap("old_months", F.array(*map(F.lit, some)))).select(key)
        kept = existing.filter(_month().isin(some)).join(replaced, key, "left_anti").select(*existing.columns)
        won = rows.filter(_month().isin(some)).join(wins.filter(F.col("month").isin(some)).select(ROW), ROW, "left_semi")
        (kept.unionByName(won.select(*existing.columns)).hint("rebalance", MONTH_COLUMN).sortWithinPartitions(MONTH_COLUMN, day)
         .write.mode("append").partitionBy(MONTH_COLUMN).parquet(f"{scratch}/months"))
    for done in ("load", "winners"):
        delete_folder(spark, f"{scratch}/{done}")
    content = spark.read.schema(existing.schema).parquet(f"{scratch}/months").select(*existing.columns)
    (content.sortWithinPartitions(MONTH_COLUMN, day)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH_COLUMN).parquet(target))
    filled = {r["m"] for r in content.select(_month().alias("m")).distinct().collect()}
    for m in set(months) - filled:  # every row of the month moved away
        delete_folder(spark, f"{target}/{MONTH_COLUMN}={NO_MONTH if m == -1 else m}")
    delete_folder(spark, scratch)
    wh._tables[name] = Warehouse._read(spark, target, name, existing.schema)
    spark.catalog.refreshByPath(target)
    return [None if m == -1 else m for m in months]
