"""Casino KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, dec, out, ratio
from croupier.plans.warehouse import Warehouse
from croupier.scope import Scope

# ---- fixed values ------------------------------------------------------------------
WEEKDAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# ------------------------------------------------------------------------------------


def _games(wh: Warehouse, scope: Scope) -> DataFrame:
    return wh.mart_game_performance_daily.filter(scope.date_and_market("metric_date"))


def daily_ggr_by_game(wh: Warehouse, scope: Scope) -> DataFrame:
    return (_games(wh, scope).groupBy(F.col("metric_date").alias("date"), "game_name")
            .agg(out(F.sum("ggr"), "casino_ggr")).orderBy("date", "game_name"))


def game_performance(wh: Warehouse, scope: Scope) -> DataFrame:
    g = _games(wh, scope).groupBy("game_name").agg(
        F.max("theoretical_rtp").alias("rtp"), F.sum("ggr").alias("ggr"), F.sum("sessions").alias("sessions"),
        F.sum("bets").alias("bets"), F.sum("payouts").alias("payouts"),
        F.sum(F.col("bets") * F.col("theoretical_rtp")).alias("weighted_rtp"),
    )
    actual = ratio("payouts", "bets")
    return g.select(
        "game_name", out("rtp", "theoretical_rtp"), out("ggr", "GGR"), F.col("sessions").cast("bigint").alias("Sessions"),
        out("bets", "Bets"), out("payouts", "Payout"), actual.alias("actual_rtp"),
        (actual - ratio("weighted_rtp", "bets")).alias("rtp_variance"),
        ratio("ggr", "sessions").alias("ggr_per_session"), ratio("ggr", "bets").alias("ggr_margin"),
    ).orderBy(F.desc("GGR"), "game_name")


def metrics(wh: Warehouse, scope: Scope) -> DataFrame:
    zero = dec("0").cast(MONEY)
    return _games(wh, scope).agg(
        out(F.coalesce(F.sum("bets"), zero), "bets"), out(F.coalesce(F.sum("payouts"), zero), "payout"),
        out(F.coalesce(F.sum("ggr"), zero), "ggr"), F.countDistinct("game_id").cast("bigint").alias("games"),
    )


def sessions_heatmap(wh: Warehouse, scope: Scope) -> DataFrame:
    """Sessions by weekday label x hour."""
    s = wh.v_sessions_enriched.filter(scope.date_and_market("session_date"))
    label = F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), F.weekday("session_start") + 1)
    return s.groupBy(label.alias("day"), F.hour("session_start").cast("int").alias("hour")).agg(
        F.count(F.lit(1)).cast("bigint").alias("sessions"))


def heatmap_matrix(wh: Warehouse, scope: Scope) -> DataFrame:
    """Weekday x 24 hour columns, zero filled, Monday first."""
    h = sessions_heatmap(wh, scope)
    days = h.sparkSession.createDataFrame([(i, d) for i, d in enumerate(WEEKDAY_LABELS)], "ord int, day string")
    wide = h.groupBy("day").pivot("hour", list(range(24))).agg(F.first("sessions"))
    wide = days.join(wide, "day", "left").na.fill(0)
    return wide.orderBy("ord").drop("ord").select("day", *[F.col(str(i)).cast("bigint").alias(f"h{i:02d}") for i in range(24)])


def rtp_variance_label(col: str = "rtp_variance") -> F.Column:
    """Reading of an RTP variance."""
    v = F.col(col)
    return (F.when(v.isNull(), "No bets").when(v > 0.005, "Paying above theoretical")
            .when(v < -0.005, "Paying below theoretical").otherwise("In line with theoretical"))


def largest_variance_game(wh: Warehouse, scope: Scope) -> DataFrame:
    """The game with the largest absolute RTP variance (ties by name)."""
    g = game_performance(wh, scope).filter(F.col("rtp_variance").isNotNull())
    return (g.orderBy(F.abs("rtp_variance").desc(), "game_name").limit(1)
            .select("game_name", "rtp_variance", rtp_variance_label().alias("meaning")))


def cards(wh: Warehouse, scope: Scope) -> DataFrame:
    """Casino margin and RTP cards from the metrics row."""
    m = metrics(wh, scope)
    return m.select("*", ratio("ggr", "bets").alias("margin"), ratio("payout", "bets").alias("rtp"))
