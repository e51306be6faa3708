"""Scope helpers over the facts (H3-H9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.plans.warehouse import Warehouse
from croupier.scope import Scope
from croupier.sources.publish import read_if_there

STALE_AFTER_DAYS = 2


def _events(wh: Warehouse, enriched: bool = False) -> DataFrame:
    if enriched:
        return (wh.v_sessions_enriched.select("player_id", "country", F.col("session_start").alias("t"), F.col("session_date").alias("d"))
                .unionByName(wh.v_transactions_enriched.select("player_id", "country", F.col("transaction_date").alias("t"),
                                                               F.col("transaction_day").alias("d")))
                .unionByName(wh.v_sports_bets_enriched.select("player_id", "country", F.col("bet_date").alias("t"), F.col("bet_day").alias("d"))))
    return (wh.sessions.select(F.col("session_start").alias("t"))
            .unionByName(wh.transactions.select(F.col("transaction_date").alias("t")))
            .unionByName(wh.sports_bets.select(F.col("bet_date").alias("t"))))


def date_bounds(wh: Warehouse) -> DataFrame:
    """H3: first and last event day over the three facts."""
    return _events(wh).agg(F.to_date(F.min("t")).alias("min_date"), F.to_date(F.max("t")).alias("max_date"))


def countries(wh: Warehouse) -> DataFrame:
    """H4: sorted distinct markets."""
    return wh.dim_player.select("country").filter(F.col("country").isNotNull()).distinct().orderBy("country")


def latest_event(wh: Warehouse, today: str) -> DataFrame:
    """H5: latest event time and whether it is more than two days older than ``today``."""
    last = _events(wh).agg(F.max("t").alias("latest_event"))
    age = F.datediff(F.lit(today).cast("date"), F.to_date("latest_event"))
    return last.select("latest_event", (age > STALE_AFTER_DAYS).alias("is_stale"))


def event_count(wh: Warehouse, scope: Scope) -> DataFrame:
    """H6: sessions + transactions + bets in scope."""
    return _events(wh, True).filter(scope.date_and_market("d")).agg(F.count(F.lit(1)).cast("bigint").alias("events"))


def last_updated(wh: Warehouse, scope: Scope) -> DataFrame:
    """H7: latest event time in scope."""
    return _events(wh, True).filter(scope.date_and_market("d")).agg(F.max("t").alias("last_updated"))


def period_delta(current, previous) -> F.Column:
    """H8: relative change, NULL when either side is missing or the previous is ~0."""
    cur = F.col(current) if isinstance(current, str) else current
    prev = F.col(previous) if isinstance(previous, str) else previous
    return F.when(cur.isNull() | prev.isNull() | (F.abs(prev) < 1e-12), F.lit(None)).otherwise((cur - prev) / F.abs(prev))


def model_available(spark, path: str) -> bool:
    """H9: both model tables exist under the warehouse folder and the status row is not 'unavailable'."""
    if read_if_there(spark, f"{path}/model_scores") is None or read_if_there(spark, f"{path}/model_metrics") is None:
        return False
    meta = read_if_there(spark, f"{path}/app_metadata")
    row = meta.filter(F.col("key") == "model_status").select("value").first() if meta is not None else None
    return not (row and row["value"] == "unavailable")
