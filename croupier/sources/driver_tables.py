"""The five operator raw tables derived from the star-schema parquet tables.

Every column is a formula over the given tables (see FIXTURES.md §2), so the work grows
with them. Money is computed in exact decimals and rounded half-up to cents, which makes
Spark and any SQL engine agree to the cent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from croupier.functions.exprs import MONEY, RATE, dec, player_key, to_money

# ---- fixed values ------------------------------------------------------------------
# Day from which the registration of a customer without orders is derived.
NO_ORDER_DAY = "1992-01-01"
# Acquisition channels by customer key modulo 7.
CHANNELS = ["Google", "Meta", "Organic", "Affiliate Alpha", "Affiliate Nova", "Influencers", "Partner"]
# Devices by customer key modulo 3.
DEVICES = ["Mobile", "Desktop", "Tablet"]
# Age bands by market segment.
AGE_GROUPS = {
    "AUTOMOBILE": "18-24",
    "BUILDING": "25-34",
    "FURNITURE": "35-44",
    "HOUSEHOLD": "45-54",
    "MACHINERY": "55+",
}
# Game families by brand number modulo 5, providers by brand number modulo 4.
GAME_FAMILIES = ["Blackjack", "Roulette", "Baccarat", "Poker", "Dragon Tiger"]
PROVIDERS = ["Evolution", "Pragmatic Play", "Playtech", "Ezugi"]
# Payment methods and their processing-fee rates by order key modulo 4.
PAYMENT_METHODS = ["Visa", "Mastercard", "Bank Transfer", "Apple Pay"]
FEE_RATES = ["0.0145", "0.0155", "0.0065", "0.009"]
# ------------------------------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the given tables, as their file system tells; no job runs. 0 on a client without a SparkContext."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001  (no SparkContext on this client: the session's own settings apply)
        return 0
    total = 0
    for name in TABLES:
        at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = at.getFileSystem(conf)
        total += fs.getContentSummary(at).getLength() if fs.exists(at) else 0
    return total


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


@dataclass
class RawTables:
    players: DataFrame
    games: DataFrame
    sessions: DataFrame
    transactions: DataFrame
    sports_bets: DataFrame


def raw_players(customer: DataFrame, nation: DataFrame, orders: DataFrame) -> DataFrame:
    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order_at"))
    age = F.create_map(*[F.lit(x) for kv in AGE_GROUPS.items() for x in kv])
    k = F.col("c_custkey")
    return (
        customer.join(first_order, customer.c_custkey == first_order.o_custkey, "left")
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            player_key(k).alias("player_id"),
            F.date_sub(F.coalesce(F.to_date("first_order_at"), F.lit(NO_ORDER_DAY).cast("date")), (k % 45).cast("int"))
            .cast("timestamp_ntz").alias("registration_date"),
            F.col("n_name").alias("country"),
            _pick(CHANNELS, k % 7).alias("channel"),
            _pick(DEVICES, k % 3).alias("device"),
            F.when(F.col("c_acctbal") < 2000, "Standard").when(F.col("c_acctbal") < 5000, "Silver")
            .when(F.col("c_acctbal") < 8500, "Gold").otherwise("Platinum").alias("vip_level"),
            F.when(k % 20 == 0, "Rejected").when(k % 10 == 3, "Pending").otherwise("Verified").alias("kyc_status"),
            F.element_at(age, F.col("c_mktsegment")).alias("age_group"),
        )
    )


def _brand_number(col: str = "p_brand") -> F.Column:
    return F.regexp_extract(F.col(col), r"(\d+)$", 1).cast("int")


def raw_games(part: DataFrame) -> DataFrame:
    n = F.col("n")
    return (
        part.select("p_brand").distinct()
        .withColumn("n", _brand_number())
        .select(
            F.col("p_brand").alias("game_id"),
            F.concat(F.lit("Game "), n.cast("string")).alias("game_name"),
            _pick(GAME_FAMILIES, n % 5).alias("game_family"),
            (dec("0.95") + (n % 5).cast("decimal(3,0)") * dec("0.01")).cast(RATE).alias("theoretical_rtp"),
            _pick(PROVIDERS, n % 4).alias("provider"),
        )
    )


def raw_sessions(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    o = orders.select("o_orderkey", "o_custkey")
    p = part.select("p_partkey", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    bet = to_money(F.col("l_extendedprice").cast("decimal(18,6)") * dec("0.01"))
    rate = dec("0.86") + F.abs(F.col("l_discount")).cast("decimal(18,6)") + F.col("l_tax").cast("decimal(18,6)")
    # (l_orderkey, l_linenumber) repeats; the full row does not. A hash of the remaining columns
    # makes the id unique without a window over the pair (no shuffle, no hot partition).
    row_hash = F.xxhash64(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    hours = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 24).cast("int")
    minutes = (F.col("l_partkey") % 60).cast("int")
    return j.select(
        F.concat_ws("-", F.lit("S"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.hex(row_hash)).alias("session_id"),
        player_key("o_custkey").alias("player_id"),
        F.col("p_brand").alias("game_id"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), hours, minutes)).alias("session_start"),
        (F.col("l_quantity") * (1 + 0.25 * (F.col("o_custkey") % 6))).cast("double").alias("duration_minutes"),
        bet.alias("total_bet_amount"),
        to_money(bet * rate).alias("total_payout_amount"),
        F.col("l_quantity").cast("int").alias("bet_count"),
    )


def raw_transactions(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    amount = to_money(F.col("o_totalprice").cast("decimal(18,6)") * dec("0.0025"))
    fee_rate = F.element_at(F.array(*[dec(r).cast(RATE) for r in FEE_RATES]), (key % 4 + 1).cast("int"))
    return orders.select(
        F.concat(F.lit("TRX-"), key.cast("string")).alias("transaction_id"),
        player_key("o_custkey").alias("player_id"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), ((key * 11) % 1440).cast("int"))).alias("transaction_date"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"), "Deposit").otherwise("Withdrawal").alias("transaction_type"),
        amount.alias("amount"),
        F.when(F.col("o_orderstatus") != "P", "Approved").when(key % 2 == 0, "Declined").otherwise("Pending").alias("transaction_status"),
        _pick(PAYMENT_METHODS, key % 4).alias("payment_method"),
        to_money(amount * fee_rate).alias("processing_fee"),
    )


def raw_sports_bets(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.withColumn("k", k)
    odds = (dec("1.05") + F.col("k").cast("decimal(6,0)") * dec("0.04")).cast("decimal(6,2)")
    stake = to_money(F.col("value").cast("decimal(18,6)"))
    draw = (F.col("event_id") * 31 + F.col("k")) % 100
    wins = draw.cast("decimal(20,0)") * odds < dec("94")
    return e.select(
        F.concat(F.lit("BET-"), F.col("event_id").cast("string")).alias("bet_id"),
        player_key("user_id").alias("player_id"),
        F.expr("ts - INTERVAL '24' YEAR").alias("bet_date"),
        F.col("event_type").alias("sport"),
        F.when(F.col("k") % 3 == 0, 1).otherwise(0).cast("int").alias("is_live"),
        odds.alias("odds"),
        stake.alias("stake"),
        F.when(wins, to_money(stake * odds)).otherwise(dec("0").cast(MONEY)).cast(MONEY).alias("payout"),
        F.concat(F.col("event_type"), F.lit(" "), (F.col("event_id") % 4).cast("string")).alias("event_name"),
    )


def load_raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    t = {name: read_table(spark, sf_dir, name) for name in ("nation", "customer", "part", "orders", "lineitem", "events")}
    return RawTables(
        players=raw_players(t["customer"], t["nation"], t["orders"]),
        games=raw_games(t["part"]),
        sessions=raw_sessions(t["lineitem"], t["orders"], t["part"]),
        transactions=raw_transactions(t["orders"]),
        sports_bets=raw_sports_bets(t["events"]),
    )
