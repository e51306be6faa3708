"""Layered warehouse: staging -> dimensions -> facts -> intermediate -> daily marts.

Every layer is a DataFrame function of the layer below. ``Warehouse`` builds them lazily
from five raw tables; ``Warehouse.write`` materialises the dimensions, facts and marts as
parquet (facts partitioned by month) and ``Warehouse.load`` reads them back, so dashboard
queries scan pre-aggregated marts instead of recomputing them.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, RATE, avg_if, date_key, dec, day_of_week, max2, money, ratio, sum_if, week_of_year
from croupier.scope import MONTH_COLUMN, month_key
from croupier.sources.driver_tables import RawTables, load_raw_tables

# ---- fixed values ------------------------------------------------------------------
NGR_PROVISION_RATES = ("0.065", "0.095")   # two provisions on positive GGR
TRANSACTION_TYPES = ("Deposit", "Withdrawal")
TRANSACTION_STATUSES = ("Approved", "Declined", "Pending")
# ------------------------------------------------------------------------------------


def _trim(c: str) -> F.Column:
    return F.trim(F.col(c).cast("string"))


# ---------------------------------------------------------------- staging
def stg_players(raw: DataFrame) -> DataFrame:
    ts = F.col("registration_date").try_cast("timestamp_ntz")
    return raw.filter(F.col("player_id").isNotNull()).select(
        _trim("player_id").alias("player_id"),
        ts.alias("registration_at"),
        F.to_date(ts).alias("registration_date"),
        *[_trim(c).alias(c) for c in ("country", "channel", "device", "vip_level", "kyc_status", "age_group")],
    )


def stg_games(raw: DataFrame) -> DataFrame:
    rtp = F.col("theoretical_rtp").try_cast(RATE)
    return raw.filter(F.col("game_id").isNotNull() & rtp.between(0, 1)).select(
        _trim("game_id").alias("game_id"), _trim("game_name").alias("game_name"),
        _trim("game_family").alias("game_family"), rtp.alias("theoretical_rtp"), _trim("provider").alias("provider"),
    )


def stg_sessions(raw: DataFrame) -> DataFrame:
    bet, payout = F.col("total_bet_amount").try_cast(MONEY), F.col("total_payout_amount").try_cast(MONEY)
    dur = F.col("duration_minutes").try_cast("double")
    ts = F.col("session_start").try_cast("timestamp_ntz")
    return raw.filter(
        F.col("session_id").isNotNull() & F.col("player_id").isNotNull() & F.col("game_id").isNotNull()
        & (bet >= 0) & (payout >= 0) & (dur >= 0)
    ).select(
        _trim("session_id").alias("session_id"), _trim("player_id").alias("player_id"), _trim("game_id").alias("game_id"),
        ts.alias("session_start"), F.to_date(ts).alias("session_date"), dur.alias("duration_minutes"),
        bet.alias("total_bet_amount"), payout.alias("total_payout_amount"), money(bet - payout).alias("casino_ggr"),
        F.col("bet_count").try_cast("int").alias("bet_count"),
    )


def stg_transactions(raw: DataFrame) -> DataFrame:
    amount = F.col("amount").try_cast(MONEY)
    ts = F.col("transaction_date").try_cast("timestamp_ntz")
    return raw.filter(
        F.col("transaction_id").isNotNull() & F.col("player_id").isNotNull() & (amount >= 0)
        & F.col("transaction_type").isin(*TRANSACTION_TYPES) & F.col("transaction_status").isin(*TRANSACTION_STATUSES)
    ).select(
        _trim("transaction_id").alias("transaction_id"), _trim("player_id").alias("player_id"),
        ts.alias("transaction_date"), F.to_date(ts).alias("transaction_day"),
        F.col("transaction_type"), amount.alias("amount"), _trim("transaction_status").alias("transaction_status"),
        _trim("payment_method").alias("payment_method"), F.col("processing_fee").try_cast(MONEY).alias("processing_fee"),
    )


def stg_sports_bets(raw: DataFrame) -> DataFrame:
    stake, payout = F.col("stake").try_cast(MONEY), F.col("payout").try_cast(MONEY)
    odds = F.col("odds").try_cast("decimal(10,4)")
    ts = F.col("bet_date").try_cast("timestamp_ntz")
    return raw.filter(
        F.col("bet_id").isNotNull() & F.col("player_id").isNotNull() & (stake >= 0) & (payout >= 0) & (odds >= 1)
    ).select(
        _trim("bet_id").alias("bet_id"), _trim("player_id").alias("player_id"),
        ts.alias("bet_date"), F.to_date(ts).alias("bet_day"), _trim("sport").alias("sport"),
        F.col("is_live").try_cast("int").alias("is_live"), odds.alias("odds"), stake.alias("stake"), payout.alias("payout"),
        money(stake - payout).alias("sportsbook_ggr"), _trim("event_name").alias("event_name"),
    )


def event_month(day_col: str) -> F.Column:
    """yyyyMM partition key of a fact row (facts are stored partitioned by it)."""
    return month_key(F.col(day_col)).alias(MONTH_COLUMN)


# ---------------------------------------------------------------- dimensions
def dim_date(players: DataFrame, sessions: DataFrame, transactions: DataFrame, bets: DataFrame) -> DataFrame:
    """One row per calendar day between the first and last day seen in any source."""
    bounds = (
        players.select(F.col("registration_date").alias("d"))
        .unionByName(sessions.select(F.col("session_date").alias("d")))
        .unionByName(transactions.select(F.col("transaction_day").alias("d")))
        .unionByName(bets.select(F.col("bet_day").alias("d")))
        .agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    )
    d = F.col("calendar_date")
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias("calendar_date")).select(
        date_key(d).alias("date_key"), d,
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), week_of_year(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day_of_month"), day_of_week(d).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"),
    )


PLAYER_ATTRIBUTES = ("country", "channel", "device", "vip_level", "kyc_status")
GAME_ATTRIBUTES = ("game_name", "game_family", "theoretical_rtp", "provider")


def with_attributes(fact: DataFrame, dim: DataFrame, key: str, attributes: tuple[str, ...], flag: str) -> DataFrame:
    """Add a dimension's columns to a fact, once, when the fact is written. ``flag`` tells whether
    the key is known: rows without a dimension row stay in the fact (the quality gate counts them)
    and are left out of the enriched selections."""
    side = dim.select(F.col(key).alias("__key"), *attributes).dropDuplicates(["__key"]).withColumn(flag, F.lit(True))
    joined = fact.join(side, fact[key] == side["__key"], "left").drop("__key")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


class Warehouse:
    """Lazily built layers over five raw tables (or over materialised parquet layers)."""

    def __init__(self, spark: SparkSession, raw: RawTables | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.raw = raw
        self._tables = dict(tables or {})
        self._built: set[str] = set()  # tables built here, not given
        self._player_order: Warehouse | None = None
        self._training_facts: Warehouse | None = None
        self.loaded_at: dt.datetime | None = None  # of the facts built here; set when they are written

    # construction ---------------------------------------------------------------------
    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        wh = cls(spark, raw=load_raw_tables(spark, sf_dir))
        wh.sf_dir = sf_dir
        return wh

    @classmethod
    def from_raw(cls, spark: SparkSession, raw: RawTables) -> "Warehouse":
        return cls(spark, raw=raw)

    def _get(self, name: str, build):
        if name not in self._tables:
            self._tables[name] = build()
            self._built.add(name)
        return self._tables[name]

    def with_tables(self, **tables: DataFrame) -> "Warehouse":
        """This warehouse with some tables in place of its own."""
        stale = {"mart_player_360"} if "model_scores" in tables else set()
        other = type(self)(self.spark, raw=self.raw, tables={k: v for k, v in {**self._tables, **tables}.items() if k not in stale})
        other._built, other._player_order, other._training_facts = self._built - set(tables), self._player_order, self._training_facts
        return other

    # facts in player order --------------------------------------------------------------
    PLAYER_COLUMNS = {
        "fact_casino_session": ("player_id", "game_id", "session_start", "session_date", "duration_minutes", "total_bet_amount", "casino_ggr",
                                "bet_count", "country", "game_name", "player_known", "game_known", MONTH_COLUMN),
        "fact_transaction": ("player_id", "transaction_date", "transaction_day", "transaction_type", "amount", "transaction_status",
                             "payment_method", "country", "player_known", MONTH_COLUMN),
        "fact_sports_bet": ("player_id", "bet_date", "bet_day", "stake", "sportsbook_ggr", "country", "player_known", MONTH_COLUMN),
    }

    @property
    def by_player(self) -> "Warehouse":
        """The facts as per-player measures read them: those columns only, written to the shared folder once.

        A lazily built fact is joined anew by every measure that reads it. Written straight from its join
        with the players, the rows of a player lie together, so each later aggregation by player is all
        but done before its shuffle, and a player with many rows is one row a task. A warehouse whose facts
        are given (written tables) is used as it is."""
        if self._facts_given:
            return self
        if self._player_order is None:
            self._player_order = _PlayerOrder(self)
        return self._player_order

    @property
    def _facts_given(self) -> bool:
        return self.raw is None or all(n in self._tables and n not in self._built for n in self.PLAYER_COLUMNS)

    @property
    def training_facts(self) -> "Warehouse":
        """The facts as a training run reads them, for its snapshots and its daily series alike: sessions and bets are derived
        once and written to the shared folder, sessions in player order and with marks on the first one of a player's
        day and of a player's game, so that distinct days and games are sums. Given facts are used as they are."""
        if self._facts_given:
            return self
        if self._training_facts is None:
            self._training_facts = _TrainingFacts(self)
        return self._training_facts

    def scored_from(self, facts: "Warehouse", **tables: DataFrame) -> "Warehouse":
        """This warehouse with some tables, whose per-player measures of scored players read ``facts``, unless others are written already."""
        other = self.with_tables(**tables)
        if other._player_order is None and facts is not self:
            other._player_order = facts
        return other

    # staging --------------------------------------------------------------------------
    @property
    def stg_players(self) -> DataFrame:
        return self._get("stg_players", lambda: stg_players(self.raw.players))

    @property
    def stg_games(self) -> DataFrame:
        return self._get("stg_games", lambda: stg_games(self.raw.games))

    @property
    def stg_sessions(self) -> DataFrame:
        return self._get("stg_sessions", lambda: stg_sessions(self.raw.sessions))

    @property
    def stg_transactions(self) -> DataFrame:
        return self._get("stg_transactions", lambda: stg_transactions(self.raw.transactions))

    @property
    def stg_sports_bets(self) -> DataFrame:
        return self._get("stg_sports_bets", lambda: stg_sports_bets(self.raw.sports_bets))

    # dimensions -----------------------------------------------------------------------
    @property
    def dim_date(self) -> DataFrame:
        return self._get("dim_date", lambda: dim_date(self.dim_player, self.fact_casino_session, self.fact_transaction, self.fact_sports_bet))

    @property
    def dim_player(self) -> DataFrame:
        return self._get("dim_player", lambda: self.stg_players)

    @property
    def dim_game(self) -> DataFrame:
        return self._get("dim_game", lambda: self.stg_games)

    # facts (D1-D3): measures, keys, and the player's and game's columns -----------------
    FACT_COLUMNS = {
        "fact_casino_session": ("session_id", "player_id", "game_id", "date_key", "session_start", "session_date", "duration_minutes",
                                "total_bet_amount", "total_payout_amount", "casino_ggr", "bet_count"),
        "fact_transaction": ("transaction_id", "player_id", "date_key", "transaction_date", "transaction_day", "transaction_type",
                             "amount", "transaction_status", "payment_method", "processing_fee"),
        "fact_sports_bet": ("bet_id", "player_id", "date_key", "bet_date", "bet_day", "sport", "is_live", "odds", "stake", "payout",
                            "sportsbook_ggr", "event_name"),
    }

    def _fact(self, name: str, staged: DataFrame, day: str, game: bool = False) -> DataFrame:
        at = F.lit(self.loaded_at).cast("timestamp_ntz").alias("loaded_at")
        rows = staged.withColumn("date_key", date_key(day)).select(*self.FACT_COLUMNS[name], event_month(day), at)
        rows = with_attributes(rows, self.dim_player, "player_id", PLAYER_ATTRIBUTES, "player_known")
        return with_attributes(rows, self.dim_game, "game_id", GAME_ATTRIBUTES, "game_known") if game else rows

    @property
    def fact_casino_session(self) -> DataFrame:
        return self._get("fact_casino_session", lambda: self._fact("fact_casino_session", self.stg_sessions, "session_date", game=True))

    @property
    def fact_transaction(self) -> DataFrame:
        return self._get("fact_transaction", lambda: self._fact("fact_transaction", self.stg_transactions, "transaction_day"))

    @property
    def fact_sports_bet(self) -> DataFrame:
        return self._get("fact_sports_bet", lambda: self._fact("fact_sports_bet", self.stg_sports_bets, "bet_day"))

    # compatibility projections (E9) -----------------------------------------------------
    @property
    def players(self) -> DataFrame:
        """``registration_date`` here is the registration *timestamp*."""
        return self.dim_player.select(
            "player_id", F.col("registration_at").alias("registration_date"), "country", "channel", "device",
            "vip_level", "kyc_status", "age_group",
        )

    @property
    def games(self) -> DataFrame:
        return self.dim_game.select("game_id", "game_name", "game_family", "theoretical_rtp", "provider")

    def _own_columns(self, name: str) -> DataFrame:
        return getattr(self, name).select(*self.FACT_COLUMNS[name], MONTH_COLUMN)

    @property
    def sessions(self) -> DataFrame:
        return self._own_columns("fact_casino_session")

    @property
    def transactions(self) -> DataFrame:
        return self._own_columns("fact_transaction")

    @property
    def sports_bets(self) -> DataFrame:
        return self._own_columns("fact_sports_bet")

    # intermediate (E1-E8) ---------------------------------------------------------------
    @property
    def int_player_first_deposit(self) -> DataFrame:
        def build():
            t = self.fact_transaction.filter((F.col("transaction_type") == "Deposit") & (F.col("transaction_status") == "Approved"))
            return t.groupBy("player_id").agg(F.min("transaction_date").alias("ftd_at")).withColumn("ftd_date", F.to_date("ftd_at"))
        return self._get("int_player_first_deposit", build)

    @property
    def activity_events(self) -> DataFrame:
        """Player x day x product rows from both products (before de-duplication)."""
        return self._get("activity_events", lambda: (
            self.fact_casino_session.select("player_id", F.col("session_date").alias("activity_date"),
                                            F.lit(1).alias("casino_active"), F.lit(0).alias("sports_active"))
            .unionByName(self.fact_sports_bet.select("player_id", F.col("bet_day").alias("activity_date"),
                                                     F.lit(0).alias("casino_active"), F.lit(1).alias("sports_active")))
        ))

    @property
    def int_player_first_activity(self) -> DataFrame:
        return self._get("int_player_first_activity", lambda: (
            self.activity_events.groupBy("player_id").agg(F.min("activity_date").alias("first_activity_date"))
        ))

    @property
    def int_player_activity_daily(self) -> DataFrame:
        return self._get("int_player_activity_daily", lambda: (
            self.activity_events.groupBy("activity_date", "player_id")
            .agg(F.max("casino_active").alias("casino_active"), F.max("sports_active").alias("sports_active"))
        ))

    @property
    def v_player_activity_enriched(self) -> DataFrame:
        return self._get("v_player_activity_enriched", lambda: (
            self.int_player_activity_daily.select("activity_date", "player_id")
            .join(self.dim_player.select("player_id", "country"), "player_id")
        ))

    @property
    def v_sessions_enriched(self) -> DataFrame:
        return self._get("v_sessions_enriched", lambda: self.fact_casino_session.filter("player_known AND game_known"))

    @property
    def v_transactions_enriched(self) -> DataFrame:
        return self._get("v_transactions_enriched", lambda: self.fact_transaction.filter("player_known"))

    @property
    def v_sports_bets_enriched(self) -> DataFrame:
        return self._get("v_sports_bets_enriched", lambda: self.fact_sports_bet.filter("player_known"))

    @property
    def int_daily_gaming_revenue(self) -> DataFrame:
        """Day x market revenue of both products, straight from the facts."""
        def build():
            zero = dec("0").cast(MONEY)
            casino = (
                self.fact_casino_session.filter("player_known").groupBy(F.col("session_date").alias("calendar_date"), "country")
                .agg(F.sum("total_bet_amount").alias("cb"), F.sum("total_payout_amount").alias("cp"), F.sum("casino_ggr").alias("cg"))
                .select("calendar_date", "country", "cb", "cp", "cg", zero.alias("ss"), zero.alias("sp"), zero.alias("sg"))
            )
            sports = (
                self.fact_sports_bet.filter("player_known").groupBy(F.col("bet_day").alias("calendar_date"), "country")
                .agg(F.sum("stake").alias("ss"), F.sum("payout").alias("sp"), F.sum("sportsbook_ggr").alias("sg"))
                .select("calendar_date", "country", zero.alias("cb"), zero.alias("cp"), zero.alias("cg"), "ss", "sp", "sg")
            )
            return casino.unionByName(sports).groupBy("calendar_date", "country").agg(
                F.sum("cb").alias("casino_bets"), F.sum("cp").alias("casino_payouts"), F.sum("cg").alias("casino_ggr"),
                F.sum("ss").alias("sports_stake"), F.sum("sp").alias("sports_payout"), F.sum("sg").alias("sports_ggr"),
            )
        return self._get("int_daily_gaming_revenue", build)

    # marts (F1-F4) ----------------------------------------------------------------------
    @property
    def mart_executive_daily(self) -> DataFrame:
        def build():
            p = self.dim_player.select("player_id", "country")
            activity = (
                self.int_player_activity_daily.join(p, "player_id")
                .groupBy(F.col("activity_date").alias("metric_date"), "country").agg(F.count(F.lit(1)).alias("active_players"))
            )
            approved = F.col("transaction_status") == "Approved"
            zero = dec("0").cast(MONEY)
            payments = (
                self.fact_transaction.filter("player_known")
                .groupBy(F.col("transaction_day").alias("metric_date"), "country").agg(
                    F.sum(F.when(approved & (F.col("transaction_type") == "Deposit"), F.col("amount")).otherwise(zero)).alias("deposits"),
                    F.sum(F.when(approved & (F.col("transaction_type") == "Withdrawal"), F.col("amount")).otherwise(zero)).alias("withdrawals"),
                    F.sum(F.when(approved, F.col("processing_fee")).otherwise(zero)).alias("payment_fees"),
                    avg_if(approved).alias("payment_approval_rate"),
                )
            )
            r = self.int_daily_gaming_revenue.withColumnRenamed("calendar_date", "metric_date")
            ggr = F.col("casino_ggr") + F.col("sports_ggr")
            pos = max2(ggr, dec("0"))
            fees = F.coalesce(F.col("payment_fees"), zero)
            return (
                r.join(activity, ["metric_date", "country"], "left").join(payments, ["metric_date", "country"], "left")
                .select(
                    "metric_date", "country", "casino_bets", "casino_payouts", "casino_ggr", "sports_stake", "sports_payout", "sports_ggr",
                    (F.col("casino_bets") + F.col("sports_stake")).alias("total_wagers"),
                    ggr.alias("total_ggr"),
                    ratio(ggr, F.col("casino_bets") + F.col("sports_stake")).alias("ggr_margin"),
                    F.coalesce(F.col("active_players"), F.lit(0)).cast("bigint").alias("active_players"),
                    F.coalesce(F.col("deposits"), zero).alias("deposits"),
                    F.coalesce(F.col("withdrawals"), zero).alias("withdrawals"),
                    fees.alias("payment_fees"),
                    F.col("payment_approval_rate"),
                    (ggr - fees - pos * dec(NGR_PROVISION_RATES[0]) - pos * dec(NGR_PROVISION_RATES[1])).alias("estimated_ngr"),
                    F.lit("1.0").alias("definition_version"),
                )
            )
        return self._get("mart_executive_daily", build)

    @property
    def mart_game_performance_daily(self) -> DataFrame:
        def build():
            agg = (
                self.v_sessions_enriched
                .groupBy(F.col("session_date").alias("metric_date"), "country", "game_id", "game_name", "game_family", "provider", "theoretical_rtp").agg(
                    F.count(F.lit(1)).alias("sessions"), F.countDistinct("player_id").alias("active_players"),
                    F.sum("total_bet_amount").alias("bets"), F.sum("total_payout_amount").alias("payouts"),
                    F.sum("casino_ggr").alias("ggr"),
                )
            )
            actual = ratio("payouts", "bets")
            return agg.select(
                "metric_date", "country", "game_id", "game_name", "game_family", "provider", "theoretical_rtp",
                "sessions", "active_players", "bets", "payouts", "ggr",
                ratio("ggr", "bets").alias("ggr_margin"), actual.alias("actual_rtp"),
                (actual - F.col("theoretical_rtp").cast("double")).alias("rtp_variance"),
                ratio("ggr", "sessions").alias("ggr_per_session"), F.lit("1.0").alias("definition_version"),
            )
        return self._get("mart_game_performance_daily", build)

    @property
    def mart_acquisition_daily(self) -> DataFrame:
        def build():
            keys = ["metric_date", "country", "channel"]
            regs = self.dim_player.groupBy(F.col("registration_date").alias("metric_date"), "country", "channel").agg(
                F.count(F.lit(1)).alias("registrations"), sum_if(F.col("kyc_status") == "Verified").alias("kyc_verified"))
            ftd = (
                self.int_player_first_deposit.join(self.dim_player.select("player_id", "country", "channel"), "player_id")
                .groupBy(F.col("ftd_date").alias("metric_date"), "country", "channel").agg(F.count(F.lit(1)).alias("ftd"))
            )
            return regs.join(ftd, keys, "full_outer").select(
                *keys,
                F.coalesce("registrations", F.lit(0)).cast("bigint").alias("registrations"),
                F.coalesce("kyc_verified", F.lit(0)).cast("bigint").alias("kyc_verified"),
                F.coalesce("ftd", F.lit(0)).cast("bigint").alias("ftd"),
                F.lit("1.0").alias("definition_version"),
            )
        return self._get("mart_acquisition_daily", build)

    @property
    def mart_payments_daily(self) -> DataFrame:
        def build():
            approved = F.col("transaction_status") == "Approved"
            return (
                self.fact_transaction.filter("player_known")
                .groupBy(F.col("transaction_day").alias("metric_date"), "country", "payment_method", "transaction_type").agg(
                    F.count(F.lit(1)).alias("transactions"), F.sum("amount").alias("volume"),
                    avg_if(approved).alias("approval_rate"),
                    F.sum(F.when(approved, F.col("processing_fee")).otherwise(dec("0").cast(MONEY))).alias("approved_fees"),
                )
                .withColumn("definition_version", F.lit("1.0"))
            )
        return self._get("mart_payments_daily", build)

    # post-ML mart (F5) ------------------------------------------------------------------
    @property
    def model_scores(self) -> DataFrame:
        from croupier.plans.scores import model_scores
        return self._get("model_scores", lambda: model_scores(self))

    @property
    def mart_player_360(self) -> DataFrame:
        def build():
            ms = self.model_scores
            return (
                self.dim_player.join(ms, "player_id")
                .join(self.by_player.int_player_first_deposit, "player_id", "left")
                .join(self.by_player.int_player_first_activity, "player_id", "left")
            )
        return self._get("mart_player_360", build)

    @property
    def v_player_scores(self) -> DataFrame:
        return self.mart_player_360

    # materialisation --------------------------------------------------------------------
    LAYERS = (
        ("dim_player", "dim_game"),
        ("fact_casino_session", "fact_transaction", "fact_sports_bet"),
        ("dim_date", "int_player_first_deposit", "int_player_first_activity", "int_player_activity_daily", "int_daily_gaming_revenue"),
        ("mart_executive_daily", "mart_game_performance_daily", "mart_acquisition_daily", "mart_payments_daily"),
    )
    WRITE_THREADS = 4
    FACT_DAY = {
        "fact_casino_session": ("session_date", "session_id"),
        "fact_transaction": ("transaction_day", "transaction_id"),
        "fact_sports_bet": ("bet_day", "bet_id"),
    }

    def write(self, path: str, with_scores: bool = False) -> "Warehouse":
        """Write the layers once as parquet under ``path``, layer by layer, each layer computed
        from the written tables of the layer below; return a warehouse reading them.

        Facts are partitioned by ``event_month`` and sorted by day inside each file, so parquet
        row-group statistics prune days inside a month. The written tables also cut lineage for
        every later job.
        """
        source: Warehouse = self
        stamp = self.loaded_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)  # facts built here carry the time of this load
        written: dict[str, DataFrame] = {}
        self.write_seconds: dict[str, float] = {}
        layers = list(self.LAYERS) + ([("model_scores",), ("mart_player_360",)] if with_scores else [])

        def write_one(src: "Warehouse", name: str) -> tuple[str, DataFrame]:
            started = time.time()
            df = getattr(src, name)
            target = f"{path.rstrip('/')}/{name}"
            if name in self.FACT_DAY:
                day, _ = self.FACT_DAY[name]
                # REBALANCE: adaptive execution splits large months (a hot month is
                # written by several tasks) and merges small ones; no sampling pass
                (df.hint("rebalance", MONTH_COLUMN).sortWithinPartitions(MONTH_COLUMN, day)
                   .write.mode("overwrite").partitionBy(MONTH_COLUMN).parquet(target))
            else:
                df.write.mode("overwrite").parquet(target)
            self.write_seconds[name] = round(time.time() - started, 3)
            return name, self._read(self.spark, target, name, df.schema)

        # tables of one layer only read layers below, so they are written as concurrent jobs
        with ThreadPoolExecutor(max_workers=self.WRITE_THREADS) as pool:
            for layer in layers:
                for name, df in pool.map(lambda n, src=source: write_one(src, n), layer):
                    written[name] = df
                source = Warehouse(self.spark, raw=self.raw, tables=dict(written))
                source.scoring_cutoff, source.loaded_at = getattr(self, "scoring_cutoff", None), stamp
        return source

    @classmethod
    def _read(cls, spark: SparkSession, target: str, name: str, schema=None) -> DataFrame:
        """Read a written layer; with the known schema an empty (file-less) table still reads."""
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(target)
        return df.select(*schema.fieldNames()) if schema is not None else df

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> "Warehouse":
        names = tuple(names or [n for layer in cls.LAYERS for n in layer])
        tables = {name: cls._read(spark, f"{path.rstrip('/')}/{name}", name) for name in names}
        return cls(spark, raw=None, tables=tables)


class _PlayerOrder(Warehouse):
    """The facts of another warehouse, each written on first use with the columns per-player measures need."""

    def __init__(self, source: Warehouse):
        super().__init__(source.spark, raw=source.raw, tables={"dim_player": source.dim_player, "dim_game": source.dim_game})
        self._source = source

    @property
    def by_player(self) -> Warehouse:
        return self

    def _fact(self, name: str, staged: DataFrame, day: str, game: bool = False) -> DataFrame:
        from croupier.session import shared_dir

        rows = getattr(self._source, name).select(*self.PLAYER_COLUMNS[name])
        target = shared_dir(self.spark, f"player-order-{uuid.uuid4().hex}/{name}")
        rows.write.parquet(target)
        return self._read(self.spark, target, name, rows.schema)

    def _own_columns(self, name: str) -> DataFrame:
        return getattr(self, name).select(*[c for c in self.PLAYER_COLUMNS[name] if c in self.FACT_COLUMNS[name]], MONTH_COLUMN)


class _TrainingFacts(Warehouse):
    """The facts of another warehouse with the columns of a training run; sessions and bets are written on first use."""

    COLUMNS = {
        "fact_casino_session": ("player_id", "game_id", "session_start", "session_date", "duration_minutes", "total_bet_amount", "total_payout_amount",
                                "casino_ggr", "bet_count", "player_known", "channel"),
        "fact_sports_bet": ("player_id", "bet_date", "bet_day", "stake", "sportsbook_ggr", "event_name"),
    }

    def __init__(self, source: Warehouse):
        given = {n: source._tables[n] for n in ("dim_date",) if n in source._tables and n not in source._built}
        super().__init__(source.spark, raw=source.raw, tables={"dim_player": source.dim_player, "dim_game": source.dim_game, **given})
        self._source = source

    @property
    def by_player(self) -> Warehouse:
        return self

    @property
    def training_facts(self) -> Warehouse:
        return self

    def _fact(self, name: str, staged: DataFrame, day: str, game: bool = False) -> DataFrame:
        from croupier.session import shared_dir

        rows = getattr(self._source, name)
        if name not in self.COLUMNS:
            return rows
        rows = rows.select(*self.COLUMNS[name])
        if game:  # the join with the players left a player's rows in one task: a sort, no shuffle of its own
            first = lambda of: F.row_number().over(Window.partitionBy("player_id", of).orderBy(F.asc_nulls_last("session_start"))) == 1
            rows = rows.withColumns({mark: (first(of) & F.col(of).isNotNull()).cast("int") for mark, of in (("new_day", "session_date"), ("new_game", "game_id"))})
        target = shared_dir(self.spark, f"training-facts-{uuid.uuid4().hex}/{name}")
        rows.write.parquet(target)
        return self._read(self.spark, target, name, rows.schema)

    def _own_columns(self, name: str) -> DataFrame:
        return getattr(self, name)
