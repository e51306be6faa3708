"""Player snapshots at many cut-offs from one pass over each fact.

Cut-offs and the ends of their outcome windows are marks on the time axis. Every event falls into the
segment that ends at the first mark not before it. Measures are summed per (player, segment); a
distinct day, game or payment method counts once, in the segment where the player shows it first, so
distinct counts add up like sums. A snapshot is then the sum of the segments up to its cut-off, and its
outcome the sum of the segments from there to the end of its window.

Facts are read once, whatever the number of snapshots. Sessions with marks on the first one of a day and of a game
(``Warehouse.training_facts``) need no key for these: marks are summed per (player, segment). Otherwise the first
aggregation has (player, kind, key) as its key. Both are partial before their shuffle, so a player with a third of all
events is at most one row per task, segment, day, game or method.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, dec
from croupier.plans.scores import ELIGIBLE_TENURE_DAYS, MISSING_RECENCY
from croupier.session import shuffle_partitions


@dataclass(frozen=True)
class Spec:
    """One snapshot: features as of ``cutoff`` 23:59:59, outcome over the ``horizon`` days behind it."""

    cutoff: str
    horizon: int
    split: str

    @property
    def end(self) -> str:
        return (dt.date.fromisoformat(self.cutoff) + dt.timedelta(days=self.horizon)).isoformat()


def _mark(day: str) -> Column:
    return F.lit(f"{day} 23:59:59").cast("timestamp_ntz")


def _segment(t: Column, marks: list[str]) -> Column:
    """Number of the first mark not before ``t``; NULL behind the last one."""
    out = F.when(t <= _mark(marks[0]), 0)
    for i, m in enumerate(marks[1:], 1):
        out = out.when(t <= _mark(m), i)
    return out


def _by_segment(events: DataFrame, sums: dict[str, Column], largest: dict[str, Column], firsts: dict[str, Column]) -> DataFrame:
    """(player_id, segment) with sums, maxima and, per entry of ``firsts``, how many of its values are new there."""
    reduced = [F.sum(n).alias(n) for n in sums] + [F.max(n).alias(n) for n in largest]
    measures = {**sums, **largest}
    if not firsts:
        return events.select("player_id", "segment", *[c.alias(n) for n, c in measures.items()]).groupBy("player_id", "segment").agg(*reduced)
    cell = lambda kind, key, own: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"),
                                           *[(c if own else F.when(F.lit(False), c)).alias(n) for n, c in measures.items()])
    rows = events.select("player_id", "segment", F.inline(F.array(cell("sum", F.col("segment"), True), *[cell(n, c, False) for n, c in firsts.items()])))
    rows = rows.filter(F.col("key").isNotNull())
    once = rows.groupBy("player_id", "kind", "key").agg(F.min("segment").alias("segment"), *reduced)
    new = [F.count(F.when(F.col("kind") == n, 1)).alias(n) for n in firsts]
    return once.groupBy("player_id", "segment").agg(*reduced, *new)


def _events(df: DataFrame, t: str, day: str, marks: list[str]) -> DataFrame:
    in_reach = F.col(day) <= F.lit(marks[-1]).cast("date")
    return df.filter(in_reach).withColumn("segment", _segment(F.col(t), marks)).filter(F.col("segment").isNotNull())


def _history(wh, marks: list[str]) -> DataFrame:
    """Everything the snapshots need, per (player, segment); a column is NULL where its fact has no event."""
    one = F.lit(1)
    sessions = wh.sessions
    new = {"active_days": "new_day", "distinct_games": "new_game"}
    marked = set(new.values()) <= set(sessions.columns)  # the first session of a day and of a game bears a mark: a sum counts them
    s = _by_segment(
        _events(sessions, "session_start", "session_date", marks),
        {"session_count": one, "total_bets": F.col("total_bet_amount"), "casino_ggr": F.col("casino_ggr"), "minutes": F.col("duration_minutes"),
         "timed": F.when(F.col("duration_minutes").isNotNull(), 1), "bet_count": F.col("bet_count"),
         **{n: F.col(c) for n, c in new.items() if marked}},
        {"max_duration": F.col("duration_minutes"), "last_session": F.col("session_start")},
        {} if marked else {"active_days": F.col("session_date"), "distinct_games": F.col("game_id")})
    approved = F.col("transaction_status") == "Approved"
    deposit, withdrawal = approved & (F.col("transaction_type") == "Deposit"), approved & (F.col("transaction_type") == "Withdrawal")
    t = _by_segment(
        _events(wh.transactions, "transaction_date", "transaction_day", marks),
        {"deposit_count": F.when(deposit, 1), "deposit_amount": F.when(deposit, F.col("amount")), "withdrawal_count": F.when(withdrawal, 1),
         "withdrawal_amount": F.when(withdrawal, F.col("amount")), "declined": F.when(F.col("transaction_status") == "Declined", 1),
         "judged": F.when(F.col("transaction_status").isNotNull(), 1)},
        {}, {"payment_methods": F.col("payment_method")})
    b = _by_segment(
        _events(wh.sports_bets, "bet_date", "bet_day", marks),
        {"sports_bets": one, "sports_stake": F.col("stake"), "sports_ggr": F.col("sportsbook_ggr")}, {"last_bet": F.col("bet_date")}, {})
    return s.unionByName(t, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)


_SUMS = ["session_count", "active_days", "total_bets", "casino_ggr", "minutes", "timed", "distinct_games", "bet_count", "deposit_count", "deposit_amount",
         "withdrawal_count", "withdrawal_amount", "declined", "judged", "payment_methods", "sports_bets", "sports_stake", "sports_ggr"]
_MAXIMA = ["max_duration", "last_session", "last_bet"]


def snapshots(wh, specs: list[Spec]) -> DataFrame:
    """One row per spec and eligible player: horizon, split, cutoff, the features and the outcome."""
    marks = sorted({s.cutoff for s in specs} | {s.end for s in specs})
    at = {m: i for i, m in enumerate(marks)}
    listed = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(at[s.cutoff]).alias("here"), F.lit(at[s.end]).alias("there")) for i, s in enumerate(specs)])
    # dealt by player before the rows of a player multiply: neither their sums nor the join with the players shuffle them
    dealt = _history(wh, marks).repartition(shuffle_partitions(wh.dim_player.sparkSession), "player_id")
    rows = dealt.select("*", F.inline(listed)).filter("segment <= there")
    past = lambda c: F.when(F.col("segment") <= F.col("here"), F.col(c))
    ahead = lambda c: F.when(F.col("segment") > F.col("here"), F.col(c))
    per = rows.groupBy("player_id", "spec").agg(
        *[F.sum(past(c)).alias(c) for c in _SUMS], *[F.max(past(c)).alias(c) for c in _MAXIMA],
        *[F.sum(ahead(c)).alias(f"future_{c}") for c in ("session_count", "sports_bets", "casino_ggr", "sports_ggr")])

    of = lambda values: F.element_at(F.array(*values), F.col("spec") + 1)
    cutoff = of([F.lit(s.cutoff).cast("date") for s in specs])
    cut = of([_mark(s.cutoff) for s in specs])
    zero = dec("0").cast(MONEY)
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    m0 = lambda c: F.coalesce(F.col(c), zero).cast(MONEY)
    since = lambda c: F.coalesce(F.datediff("cutoff", F.to_date(c)), F.lit(MISSING_RECENCY))
    later = F.when(F.col("last_bet").isNull() | (F.col("last_session") >= F.col("last_bet")), F.col("last_session")).otherwise(F.col("last_bet"))
    seen = n0("session_count") + n0("sports_bets") + n0("deposit_count") > 0
    joined = per.filter(seen).withColumns({"cutoff": cutoff, "cut": cut}).join(wh.dim_player, "player_id")
    joined = joined.filter(F.col("registration_at") <= F.col("cut") - F.make_dt_interval(F.lit(ELIGIBLE_TENURE_DAYS)))
    return joined.select(
        of([F.lit(s.horizon) for s in specs]).alias("horizon"), of([F.lit(s.split) for s in specs]).alias("split"), F.col("cutoff"),
        "player_id", "country", "channel", "device", "vip_level", "kyc_status",
        F.datediff("cutoff", "registration_date").alias("tenure_days"), n0("session_count").alias("session_count"), n0("active_days").alias("active_days"),
        F.least(since("last_session"), since("last_bet")).alias("recency_days"), m0("total_bets").alias("total_bets"),
        (m0("casino_ggr") + m0("sports_ggr")).cast(MONEY).alias("historical_ggr"),
        F.coalesce(F.try_divide(F.col("minutes"), F.col("timed")), F.lit(0.0)).alias("avg_duration"),
        F.coalesce("max_duration", F.lit(0.0)).alias("max_duration"), n0("distinct_games").alias("distinct_games"), n0("bet_count").alias("bet_count"),
        n0("deposit_count").alias("deposit_count"), m0("deposit_amount").alias("deposit_amount"),
        n0("withdrawal_count").alias("withdrawal_count"), m0("withdrawal_amount").alias("withdrawal_amount"),
        F.coalesce(F.try_divide(n0("declined").cast("double"), F.col("judged")), F.lit(0.0)).alias("decline_rate"),
        n0("payment_methods").alias("payment_methods"), n0("sports_bets").alias("sports_bets"), m0("sports_stake").alias("sports_stake"),
        m0("sports_ggr").alias("sports_ggr"), (n0("future_session_count") + n0("future_sports_bets")).alias("future_activity"),
        (m0("future_casino_ggr") + m0("future_sports_ggr")).cast(MONEY).alias("future_ggr"), later.alias("last_activity"),
        F.col("cutoff").alias("snapshot_date"))
