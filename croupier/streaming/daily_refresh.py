"""Incremental refresh of the day x market gaming-revenue mart from arriving fact files.

New casino-session and sportsbook-bet parquet files are read as two streams, joined to the
(static) player dimension for the market, and aggregated per one-day event-time window and market.
The watermark is on that window: a day whose end lies more than ``late`` before the newest event
leaves the state, and events that arrive for it afterwards are dropped (``late`` says how long
corrections are accepted; choose it longer than any expected delay).

Each micro-batch holds the groups it changed. ``foreachBatch`` writes them as one new folder of
changed groups, named by the batch id and overwritten if the batch runs again, so a retry changes
nothing. Readers take, per group, the row of the highest batch among those listed in the pointer
table; a batch is listed only after its folder is complete, so a half-written batch is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, dec
from croupier.sources.publish import read_if_there

KEYS = ["calendar_date", "country"]
VALUES = ["casino_bets", "casino_payouts", "casino_ggr", "sports_stake", "sports_payout", "sports_ggr"]
LATE_DATA = "36500 days"  # corrections of any age by default; the state then holds one row per day and market


def _events(spark: SparkSession, sessions_dir: str, bets_dir: str, sessions_schema, bets_schema, players: DataFrame,
            max_files: int) -> DataFrame:
    zero = dec("0").cast(MONEY)
    p = players.select("player_id", "country")
    s = (spark.readStream.schema(sessions_schema).option("maxFilesPerTrigger", max_files).parquet(sessions_dir)
         .join(p, "player_id")
         .select(F.col("session_start").cast("timestamp").alias("event_time"), "country", F.col("total_bet_amount").alias("casino_bets"),
                 F.col("total_payout_amount").alias("casino_payouts"), F.col("casino_ggr"),
                 zero.alias("sports_stake"), zero.alias("sports_payout"), zero.alias("sports_ggr")))
    b = (spark.readStream.schema(bets_schema).option("maxFilesPerTrigger", max_files).parquet(bets_dir)
         .join(p, "player_id")
         .select(F.col("bet_date").cast("timestamp").alias("event_time"), "country", zero.alias("casino_bets"), zero.alias("casino_payouts"),
                 zero.alias("casino_ggr"), F.col("stake").alias("sports_stake"), F.col("payout").alias("sports_payout"),
                 F.col("sportsbook_ggr").alias("sports_ggr")))
    return s.unionByName(b)


def listed_batches(spark: SparkSession, sink: str) -> list[int]:
    """Complete batches; none before the first one. A pointer table that cannot be read is an error."""
    listed = read_if_there(spark, f"{sink}/pointer")
    return sorted({r.batch for r in listed.select("batch").collect()}) if listed is not None else []


def current_mart(spark: SparkSession, sink: str) -> DataFrame | None:
    """Per day and market the row of the newest complete batch that changed it."""
    batches = listed_batches(spark, sink)
    if not batches:
        return None
    rows = spark.read.parquet(*[f"{sink}/batch={b}" for b in batches])
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("written_by"))
    return rows.withColumn("place", F.row_number().over(newest)).filter("place = 1").select(*KEYS, *VALUES)


def merge_batch(sink: str):
    """The ``foreachBatch`` function: write the changed groups, then list the batch."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select(*KEYS, *VALUES).withColumn("written_by", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if batch_id not in listed_batches(spark, sink):
            spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).write.mode("append").parquet(f"{sink}/pointer")
    return merge


def start_daily_revenue_refresh(spark: SparkSession, sessions_dir: str, bets_dir: str, sessions_schema, bets_schema,
                                players: DataFrame, sink: str, checkpoint: str, available_now: bool = True, max_files: int = 4,
                                late: str = LATE_DATA):
    """Start the refresh; returns the ``StreamingQuery``."""
    events = _events(spark, sessions_dir, bets_dir, sessions_schema, bets_schema, players, max_files)
    daily = (events.withWatermark("event_time", late)
             .groupBy(F.window("event_time", "1 day").alias("day"), "country")
             .agg(*[F.sum(c).alias(c) for c in VALUES])
             # windows begin at midnight UTC, so the window's start is the event day
             .select(F.to_date("day.start").alias("calendar_date"), "country", *VALUES))
    writer = daily.writeStream.outputMode("update").foreachBatch(merge_batch(sink)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def stream_daily_revenue(wh, root: str) -> DataFrame:
    """Replay the warehouse facts as arriving files through the refresh and return the mart."""
    spark = wh.spark
    s_dir, b_dir = f"{root}/arrivals/sessions", f"{root}/arrivals/bets"
    sessions = wh.fact_casino_session.select("player_id", "session_start", "total_bet_amount", "total_payout_amount", "casino_ggr")
    bets = wh.fact_sports_bet.select("player_id", "bet_date", "stake", "payout", "sportsbook_ggr")
    sessions.hint("rebalance").write.mode("overwrite").parquet(s_dir)
    bets.hint("rebalance").write.mode("overwrite").parquet(b_dir)
    q = start_daily_revenue_refresh(spark, s_dir, b_dir, spark.read.parquet(s_dir).schema, spark.read.parquet(b_dir).schema,
                                    wh.dim_player, f"{root}/mart", f"{root}/checkpoint")
    q.awaitTermination()
    return current_mart(spark, f"{root}/mart").select(*KEYS, *[F.col(c).cast("double").alias(c) for c in VALUES])
