"""Streaming refresh of the daily revenue mart equals the batch mart; a restart with the same
checkpoint picks up only new files."""

import uuid

from pyspark.sql import functions as F

from croupier.streaming.daily_refresh import KEYS, VALUES, current_mart, merge_batch, start_daily_revenue_refresh, stream_daily_revenue


def _rows(df):
    return sorted(tuple(r) for r in df.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in VALUES]).collect())


def test_stream_equals_batch(wh, tmp_path):
    streamed = stream_daily_revenue(wh, str(tmp_path / uuid.uuid4().hex))
    assert _rows(streamed) == _rows(wh.int_daily_gaming_revenue.withColumnRenamed("calendar_date", "calendar_date"))


def test_restart_reads_only_new_files(spark, wh, tmp_path):
    root = str(tmp_path / uuid.uuid4().hex)
    s_dir, b_dir = f"{root}/s", f"{root}/b"
    sess = wh.fact_casino_session.select("player_id", "session_start", "total_bet_amount", "total_payout_amount", "casino_ggr")
    bets = wh.fact_sports_bet.select("player_id", "bet_date", "stake", "payout", "sportsbook_ggr")
    first, second = sess.filter(F.year("session_start") < 1998), sess.filter(F.year("session_start") >= 1998)
    first.write.parquet(s_dir)
    bets.write.parquet(b_dir)
    args = (spark, s_dir, b_dir, sess.schema, bets.schema, wh.dim_player, f"{root}/mart", f"{root}/ckpt")
    start_daily_revenue_refresh(*args).awaitTermination()
    second.write.mode("append").parquet(s_dir)
    start_daily_revenue_refresh(*args).awaitTermination()  # same checkpoint: only the appended files are new
    assert _rows(current_mart(spark, f"{root}/mart")) == _rows(wh.int_daily_gaming_revenue)


def test_a_batch_that_runs_twice_changes_nothing(spark, wh, tmp_path):
    sink = str(tmp_path / uuid.uuid4().hex)
    rows = wh.int_daily_gaming_revenue
    merge = merge_batch(sink)
    merge(rows, 0)
    merge(rows, 0)
    merge(rows.limit(3), 1)
    assert _rows(current_mart(spark, sink)) == _rows(rows)


def test_a_batch_that_is_not_listed_is_not_read(spark, wh, tmp_path):
    sink = str(tmp_path / uuid.uuid4().hex)
    rows = wh.int_daily_gaming_revenue
    merge_batch(sink)(rows, 0)
    doubled = rows.withColumn("casino_bets", F.col("casino_bets") * 2)
    doubled.select(*KEYS, *VALUES).withColumn("written_by", F.lit(1).cast("long")).write.parquet(f"{sink}/batch=1")
    assert _rows(current_mart(spark, sink)) == _rows(rows)


def test_days_beyond_the_watermark_are_closed(spark, wh, tmp_path):
    """Newest files first, with two days of patience: old days that arrive later are dropped."""
    root = str(tmp_path / uuid.uuid4().hex)
    s_dir, b_dir = f"{root}/s", f"{root}/b"
    sess = wh.fact_casino_session.select("player_id", "session_start", "total_bet_amount", "total_payout_amount", "casino_ggr")
    bets = wh.fact_sports_bet.select("player_id", "bet_date", "stake", "payout", "sportsbook_ggr").limit(0)
    new, old = sess.filter(F.year("session_start") >= 1998), sess.filter(F.year("session_start") < 1998)
    new.write.parquet(s_dir)
    bets.write.parquet(b_dir)
    args = (spark, s_dir, b_dir, sess.schema, bets.schema, wh.dim_player, f"{root}/mart", f"{root}/ckpt")
    start_daily_revenue_refresh(*args, late="2 days").awaitTermination()
    before = _rows(current_mart(spark, f"{root}/mart"))
    old.write.mode("append").parquet(s_dir)
    start_daily_revenue_refresh(*args, late="2 days").awaitTermination()
    assert _rows(current_mart(spark, f"{root}/mart")) == before
