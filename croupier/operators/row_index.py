"""Contiguous 0-based row index in file order, without a global sort or a single task.

``monotonically_increasing_id`` encodes (partition, position). One aggregate counts the rows of
each partition; a running sum over those counts (one row per partition) gives every partition's
first index, which joins back by partition. Both sides must see the same ids, so anything but rows
straight from files, whose partitions do not depend on a shuffle, is written to the shared folder first.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from croupier.operators.scalars import attach_scalars
from croupier.session import shared_dir

CHUNK = 4096  # partitions summed in one window
SHUFFLED = re.compile(r"^[ :+-]*(Join|Aggregate|Window|Sort|Distinct|Repartition|RepartitionByExpression|RebalancePartitions|Union|GlobalLimit|Generate)\b", re.M)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    if SHUFFLED.search(df._jdf.queryExecution().optimizedPlan().toString()):
        path = shared_dir(df.sparkSession, f"row-index-{uuid.uuid4().hex}")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    tagged = df.withColumn("__mid", F.monotonically_increasing_id())
    pid = F.shiftright("__mid", 33)
    tagged = tagged.withColumn("__pid", pid)
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.floor(F.col("__pid") / CHUNK))
    before = Window.partitionBy("chunk").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # chunk totals: one entry per CHUNK partitions, kept as one array
    totals = counts.groupBy("chunk").agg(F.sum("n").alias("t")).agg(F.collect_list(F.struct("chunk", "t")).alias("all"))
    earlier = F.aggregate(F.filter("all", lambda c: c["chunk"] < F.col("chunk")), F.lit(0).cast("bigint"), lambda a, c: a + c["t"])
    starts = attach_scalars(within, totals).select(F.col("__pid").alias("__p"), (F.col("inside") + earlier).alias("__first"))
    position = F.col("__mid") - F.shiftleft("__pid", 33)
    # one row per partition: broadcast, so that the rows themselves are not shuffled to meet it
    return (tagged.join(F.broadcast(starts), tagged["__pid"] == starts["__p"])
            .withColumn(name, (F.col("__first") + position).cast("long")).drop("__mid", "__pid", "__p", "__first"))
