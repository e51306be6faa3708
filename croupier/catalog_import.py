"""Registered import checks (A): the operator tables derived from the given tables go through the
import contracts as text, once as they are and once with bad cells planted by formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from croupier.catalog import register
from croupier.oracle import q
from croupier.sources import csv_import as ci
from croupier.sources.driver_tables import read_table

AS_IMPORT = {"players": "players", "casino_sessions": "sessions", "sportsbook_bets": "sports_bets", "transactions": "transactions", "games": "games"}


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(x).cast("string").alias(x) for x in df.columns])


def _validate(spark, dataset: str, source: DataFrame) -> ci.Validated:
    return ci.validate(spark, dataset, source, ci.suggest_mapping(dataset, source.columns))


def imported(wh) -> dict[str, ci.Validated]:
    return {ds: _validate(wh.spark, ds, _as_text(getattr(wh.raw, attr))) for ds, attr in AS_IMPORT.items()}


def all_issues(wh) -> DataFrame:
    v = imported(wh)
    return reduce(DataFrame.unionByName, [x.issues for x in v.values()] + [ci.cross_validate(wh.spark, {k: x.frame for k, x in v.items()})])


def coverage_frame(wh) -> DataFrame:
    return wh.spark.createDataFrame(ci.coverage({k: x.frame for k, x in imported(wh).items()}), "dataset string, rows bigint, columns int")


# ---- planted cells: column -> [(condition on the row's number n, text)] -----------------------
def _plant(df: DataFrame, number: Column, cells: dict[str, list[tuple[str, str | None]]]) -> DataFrame:
    text = _as_text(df).withColumn("n", number)
    for column, planted in cells.items():
        value = F.col(column)
        for condition, cell in planted:
            value = F.when(F.expr(condition), F.lit(cell)).otherwise(value)
        text = text.withColumn(column, value)
    return text.drop("n")


def _tail(column: str) -> Column:
    return F.regexp_extract(column, r"(\d+)$", 1).cast("bigint")


PLANTED = {
    "players": {"player_id": [("n % 97 = 1", "")], "country": [("n % 97 = 2", " ")], "registration_date": [("n % 97 = 3", "soon")],
                "age_group": [("n % 5 = 4", "nan")]},
    "transactions": {
        "amount": [("n % 97 = 0", "abc"), ("n % 97 = 1", "-5"), ("n % 97 = 7", "NaN"), ("n % 97 = 10", "12f"), ("n % 97 = 11", "1e2")],
        "transaction_type": [("n % 97 = 2", "Refund"), ("n % 97 = 12", "DEPOSIT")], "transaction_status": [("n % 97 = 3", "")],
        "player_id": [("n % 97 = 4", None), ("n % 97 = 5", "GHOST")],
        "transaction_date": [("n % 97 = 6", "03/04/2026"), ("n % 97 = 8", "12/25/2026"), ("n % 97 = 13", "25/12/2026")],
        "transaction_id": [("n % 97 = 9", "TRX-SAME")], "processing_fee": [("n % 97 = 14", "-0.01"), ("n % 97 = 15", "none")]},
    "sportsbook_bets": {
        "odds": [("n % 97 = 0", "0.5"), ("n % 97 = 1", "-2"), ("n % 97 = 2", "x")], "stake": [("n % 97 = 3", "-1"), ("n % 97 = 4", "NA")],
        "is_live": [("n % 97 = 5", "live"), ("n % 97 = 6", "pre_match"), ("n % 97 = 7", "maybe")], "bet_id": [("n % 97 = 8", "BET-SAME")],
        "player_id": [("n % 97 = 9", "GHOST")]},
    "games": {"theoretical_rtp": [("n % 5 = 0", "1.4"), ("n % 5 = 1", "")], "game_name": [("n % 5 = 2", "None")]},
}
NUMBERS = {"players": "player_id", "transactions": "transaction_id", "sportsbook_bets": "bet_id", "games": "game_id"}


def _campaigns(wh) -> DataFrame:
    """Made from suppliers: end before start for every 7th, a broken funnel for every 11th and 13th."""
    n = F.col("s_suppkey")
    return _supplier(wh).select(
        F.concat(F.lit("CMP-"), n.cast("string")).alias("campaign_id"), F.col("s_name").alias("name"), F.lit("Meta").alias("channel"),
        F.lit("2026-02-01").alias("started_at"), F.when(n % 7 == 0, "2026-01-01").otherwise("2026-03-01").alias("ended_at"),
        F.when(n % 17 == 0, "-1").otherwise("100").alias("budget"), F.lit("1000").alias("impressions"),
        F.when(n % 11 == 0, "1001").otherwise("2.5").alias("clicks"), F.when(n % 13 == 0, "3").otherwise("1").alias("conversions"))


def _supplier(wh) -> DataFrame:
    return read_table(wh.spark, wh.sf_dir, "supplier")


def _bonuses(wh) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(wh.spark, wh.sf_dir, "orders").select(
        F.concat(F.lit("BON-"), k.cast("string")).alias("bonus_id"), F.lit("PLR-0000001").alias("player_id"), F.lit("2026-01-05").alias("granted_at"),
        F.lit("Free bet").alias("type"), F.when(k % 70 == 0, "-3").otherwise("5").alias("amount"),
        F.when(k % 30 == 0, None).otherwise(F.concat(F.lit("CMP-"), (k % 400).cast("string"))).alias("campaignid"))


def _risk_events(wh) -> DataFrame:
    k = F.col("event_id")
    return read_table(wh.spark, wh.sf_dir, "events").select(
        F.concat(F.lit("EV-"), k.cast("string")).alias("case_id"), F.lit("GHOST").alias("customer_id"), F.lit("2026-01-05").alias("detected_at"),
        F.lit("AML").alias("risk_type"), F.lit("High").alias("risk_level"),
        F.when(k % 350 == 0, "1.5").when(k % 450 == 0, "").otherwise("0.5").alias("score"))


def planted(wh) -> dict[str, ci.Validated]:
    sources = {ds: _plant(getattr(wh.raw, AS_IMPORT[ds]), _tail(NUMBERS[ds]), cells) for ds, cells in PLANTED.items()}
    sources |= {"campaigns": _campaigns(wh), "bonuses": _bonuses(wh), "kyc_risk_events": _risk_events(wh)}
    sources["casino_sessions"] = _as_text(wh.raw.sessions).withColumn("game_id", F.when(F.col("game_id") == "Brand#11", "Brand#99").otherwise(F.col("game_id"))) \
        .withColumn("total_bet_amount", F.when(F.col("total_bet_amount").cast("double") < 50, "-1").otherwise(F.col("total_bet_amount")))
    return {ds: _validate(wh.spark, ds, s) for ds, s in sources.items()}


def planted_issues(wh) -> DataFrame:
    """Per severity, dataset, column and code: how many issues, and the message."""
    issues = reduce(DataFrame.unionByName, [v.issues for v in planted(wh).values()])
    return issues.groupBy("severity", "dataset", "column", "code").agg(F.count(F.lit(1)).cast("bigint").alias("issues"), F.max("message").alias("message"))


def planted_orphans(wh) -> DataFrame:
    return ci.cross_validate(wh.spark, {k: v.frame for k, v in planted(wh).items()}).select("severity", "dataset", "column", "code", "message")


def planted_transactions(wh) -> DataFrame:
    """What the coerced and filled transactions hold, by type and status."""
    f = planted(wh)["transactions"].frame
    return f.groupBy("transaction_type", "transaction_status").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.count("amount").cast("bigint").alias("amounts"), F.count("player_id").cast("bigint").alias("players"),
        F.sum(F.when(F.to_date("transaction_date") == F.lit("2026-03-04").cast("date"), 1).otherwise(0)).cast("bigint").alias("march_fourth"),
        F.sum(F.when(F.to_date("transaction_date") == F.lit("2026-12-25").cast("date"), 1).otherwise(0)).cast("bigint").alias("christmas"),
        F.count("transaction_date").cast("bigint").alias("dates"), F.sum(F.when(F.col("processing_fee") == 0, 1).otherwise(0)).cast("bigint").alias("free"),
        F.sum(F.when(F.col("amount") == 100, 1).otherwise(0)).cast("bigint").alias("hundreds"))


def planted_bets(wh) -> DataFrame:
    f = planted(wh)["sportsbook_bets"].frame
    return f.groupBy("is_live").agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.count("odds").cast("bigint").alias("odds"),
                                    F.count("stake").cast("bigint").alias("stakes"), F.count("sportsbook_ggr").cast("bigint").alias("ggr"))


def planted_games(wh) -> DataFrame:
    return planted(wh)["games"].frame.select("game_id", "game_name", "game_family", "theoretical_rtp", "provider")


def planted_campaigns(wh) -> DataFrame:
    """Integers round half to even: 2.5 clicks are 2."""
    return planted(wh)["campaigns"].frame.select("campaign_id", "clicks", F.to_date("end_date").alias("end_day"), "channel")


def file_duplicates(wh) -> DataFrame:
    tx = _validate(wh.spark, "transactions", _as_text(wh.raw.transactions)).frame
    again = tx.filter(F.col("transaction_status") == "Pending")
    return ci.cross_file_duplicates(wh.spark, "transactions", [tx, again]).select("severity", "dataset", "column", "code", "message")


def derived_games(wh) -> DataFrame:
    s = _validate(wh.spark, "casino_sessions", _as_text(wh.raw.sessions)).frame
    return ci.derive_games(s)


def _counted(ds: str, col: str, cond: str, table: str, required: bool = True) -> str:
    sev, code, text = ("ERROR", "MISSING_VALUE", "required") if required else ("WARNING", "OPTIONAL_MISSING", "optional")
    return f"""SELECT '{sev}' AS severity, '{ds}' AS dataset, '{col}' AS "column", '{code}' AS code, CAST(1 AS BIGINT) AS issues,
        format('{{:,}}', count(*)) || ' {text} values are missing.' AS message FROM {table} WHERE {cond} HAVING count(*) > 0"""


def _fixed(ds: str, col: str, code: str, cond: str, table: str, message: str) -> str:
    return f"""SELECT 'ERROR' AS severity, '{ds}' AS dataset, '{col}' AS "column", '{code}' AS code, CAST(1 AS BIGINT) AS issues,
        '{message}' AS message FROM {table} WHERE {cond} HAVING count(*) > 0"""


def _typed(ds: str, col: str, kind: str, cond: str, table: str) -> str:
    return f"""SELECT 'ERROR' AS severity, '{ds}' AS dataset, '{col}' AS "column", 'INVALID_TYPE' AS code, count(*) AS issues,
        'Value cannot be parsed as {kind}.' AS message FROM {table} WHERE {cond} HAVING count(*) > 0"""


def _same(ds: str, col: str, cond: str, table: str) -> str:
    return f"""SELECT 'ERROR' AS severity, '{ds}' AS dataset, '{col}' AS "column", 'DUPLICATE_KEY' AS code, CAST(1 AS BIGINT) AS issues,
        format('{{:,}}', count(*) - 1) || ' duplicate primary keys detected.' AS message FROM {table} WHERE {cond} HAVING count(*) > 1"""


_P = "(SELECT CAST(regexp_extract(player_id, '(\\d+)$', 1) AS BIGINT) AS n FROM raw_players)"
_T = "(SELECT *, CAST(regexp_extract(transaction_id, '(\\d+)$', 1) AS BIGINT) AS n FROM raw_transactions)"
_B = "(SELECT *, CAST(regexp_extract(bet_id, '(\\d+)$', 1) AS BIGINT) AS n FROM raw_sports_bets)"
_G = "(SELECT *, CAST(regexp_extract(game_id, '(\\d+)$', 1) AS BIGINT) AS n FROM raw_games)"
_S = "raw_sessions"
_E = "(SELECT event_id AS k FROM events)"
_O = "(SELECT o_orderkey AS k FROM orders)"
_ISSUES = [
    _counted("players", "player_id", "n % 97 = 1", _P), _counted("players", "country", "n % 97 = 2", _P),
    _counted("players", "registration_date", "n % 97 = 3", _P), _counted("players", "age_group", "n % 5 = 4", _P, False),
    _typed("players", "registration_date", "datetime", "n % 97 = 3", _P),
    _counted("transactions", "amount", "n % 97 IN (0, 7, 10)", _T), _counted("transactions", "player_id", "n % 97 = 4", _T),
    _counted("transactions", "transaction_status", "n % 97 = 3", _T), _counted("transactions", "transaction_date", "n % 97 = 13", _T),
    _counted("transactions", "processing_fee", "n % 97 = 15", _T, False),
    _same("transactions", "transaction_id", "n % 97 = 9", _T),
    _fixed("transactions", "amount", "INVALID_RANGE", "n % 97 = 1", _T, "''amount'' cannot be negative."),
    _fixed("transactions", "processing_fee", "INVALID_RANGE", "n % 97 = 14", _T, "''processing_fee'' cannot be negative."),
    _fixed("transactions", "transaction_type", "INVALID_DOMAIN", "n % 97 = 2", _T, "''transaction_type'' contains values outside: deposit, withdrawal."),
    _typed("transactions", "amount", "number", "n % 97 IN (0, 10)", _T), _typed("transactions", "transaction_date", "datetime", "n % 97 = 13", _T),
    _counted("sportsbook_bets", "odds", "n % 97 = 2", _B), _counted("sportsbook_bets", "stake", "n % 97 = 4", _B),
    _counted("sportsbook_bets", "is_live", "n % 97 = 7", _B, False),
    _same("sportsbook_bets", "bet_id", "n % 97 = 8", _B),
    f"""SELECT 'ERROR' AS severity, 'sportsbook_bets' AS dataset, 'odds' AS "column", 'INVALID_RANGE' AS code, CAST(2 AS BIGINT) AS issues,
        'Decimal odds must be at least 1.' AS message FROM {_B} WHERE n % 97 = 1 HAVING count(*) > 0""",
    _fixed("sportsbook_bets", "stake", "INVALID_RANGE", "n % 97 = 3", _B, "''stake'' cannot be negative."),
    _typed("sportsbook_bets", "odds", "number", "n % 97 = 2", _B), _typed("sportsbook_bets", "is_live", "boolean", "n % 97 = 7", _B),
    _counted("games", "theoretical_rtp", "n % 5 = 1", _G, False), _counted("games", "game_name", "n % 5 = 2", _G),
    _fixed("games", "theoretical_rtp", "INVALID_RANGE", "n % 5 IN (0, 1)", _G, "RTP must be between 0 and 1."),
    _fixed("casino_sessions", "total_bet_amount", "INVALID_RANGE", "total_bet_amount < 50", _S, "''total_bet_amount'' cannot be negative."),
    _fixed("campaigns", "end_date", "INVALID_DATE_ORDER", "s_suppkey % 7 = 0", "supplier", "Campaign end date cannot precede its start date."),
    _fixed("campaigns", "funnel", "INVALID_FUNNEL", "s_suppkey % 11 = 0 OR s_suppkey % 13 = 0", "supplier",
           "Campaign funnel counts must satisfy conversions <= clicks <= impressions."),
    _fixed("campaigns", "spend", "INVALID_RANGE", "s_suppkey % 17 = 0", "supplier", "''spend'' cannot be negative."),
    _counted("bonuses", "campaign_id", "k % 30 = 0", _O, False),
    _fixed("bonuses", "bonus_amount", "INVALID_RANGE", "k % 70 = 0", _O, "''bonus_amount'' cannot be negative."),
    _counted("kyc_risk_events", "risk_score", "k % 450 = 0 AND k % 350 <> 0", _E, False),
    _fixed("kyc_risk_events", "risk_score", "INVALID_RANGE", "k % 350 = 0 OR k % 450 = 0", _E, "Risk score must be between 0 and 1."),
]

register("import_issues", all_issues, q("""
SELECT CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS dataset, CAST(NULL AS VARCHAR) AS "column",
       CAST(NULL AS BIGINT) AS "row", CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS message
FROM raw_players WHERE player_id IS NULL
UNION ALL SELECT 'ERROR', 'casino_sessions', 'player_id', NULL, 'ORPHAN_PLAYER', format('{:,}', COUNT(*)) || ' rows reference players absent from players.csv.'
FROM raw_sessions s WHERE NOT EXISTS (SELECT 1 FROM raw_players p WHERE p.player_id = s.player_id) HAVING COUNT(*) > 0
UNION ALL SELECT 'ERROR', 'transactions', 'player_id', NULL, 'ORPHAN_PLAYER', format('{:,}', COUNT(*)) || ' rows reference players absent from players.csv.'
FROM raw_transactions s WHERE NOT EXISTS (SELECT 1 FROM raw_players p WHERE p.player_id = s.player_id) HAVING COUNT(*) > 0
UNION ALL SELECT 'ERROR', 'sportsbook_bets', 'player_id', NULL, 'ORPHAN_PLAYER', format('{:,}', COUNT(*)) || ' rows reference players absent from players.csv.'
FROM raw_sports_bets s WHERE NOT EXISTS (SELECT 1 FROM raw_players p WHERE p.player_id = s.player_id) HAVING COUNT(*) > 0
UNION ALL SELECT 'ERROR', 'casino_sessions', 'game_id', NULL, 'ORPHAN_GAME', format('{:,}', COUNT(*)) || ' sessions reference games absent from games.csv.'
FROM raw_sessions s WHERE NOT EXISTS (SELECT 1 FROM raw_games g WHERE g.game_id = s.game_id) HAVING COUNT(*) > 0"""))

register("import_coverage", coverage_frame, q("""
SELECT 'players' AS dataset, COUNT(*) AS rows, 8 AS columns FROM raw_players
UNION ALL SELECT 'casino_sessions', COUNT(*), 13 FROM raw_sessions
UNION ALL SELECT 'sportsbook_bets', COUNT(*), 10 FROM raw_sports_bets
UNION ALL SELECT 'transactions', COUNT(*), 8 FROM raw_transactions
UNION ALL SELECT 'games', COUNT(*), 5 FROM raw_games"""))

register("import_planted_issues", planted_issues, q("\nUNION ALL ".join(_ISSUES)))

register("import_planted_orphans", planted_orphans, q(f"""
SELECT 'ERROR' AS severity, 'transactions' AS dataset, 'player_id' AS "column", 'ORPHAN_PLAYER' AS code,
       format('{{:,}}', count(*)) || ' rows reference players absent from players.csv.' AS message
FROM {_T} t LEFT JOIN (SELECT player_id AS p FROM raw_players WHERE CAST(regexp_extract(player_id, '(\\d+)$', 1) AS BIGINT) % 97 <> 1) x
  ON x.p = t.player_id AND n % 97 NOT IN (4, 5) WHERE x.p IS NULL HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'sportsbook_bets', 'player_id', 'ORPHAN_PLAYER', format('{{:,}}', count(*)) || ' rows reference players absent from players.csv.'
FROM {_B} t LEFT JOIN (SELECT player_id AS p FROM raw_players WHERE CAST(regexp_extract(player_id, '(\\d+)$', 1) AS BIGINT) % 97 <> 1) x
  ON x.p = t.player_id AND n % 97 <> 9 WHERE x.p IS NULL HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'casino_sessions', 'player_id', 'ORPHAN_PLAYER', format('{{:,}}', count(*)) || ' rows reference players absent from players.csv.'
FROM raw_sessions t LEFT JOIN (SELECT player_id AS p FROM raw_players WHERE CAST(regexp_extract(player_id, '(\\d+)$', 1) AS BIGINT) % 97 <> 1) x
  ON x.p = t.player_id WHERE x.p IS NULL HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'kyc_risk_events', 'player_id', 'ORPHAN_PLAYER', format('{{:,}}', count(*)) || ' rows reference players absent from players.csv.'
FROM {_E} HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'bonuses', 'player_id', 'ORPHAN_PLAYER', format('{{:,}}', count(*)) || ' rows reference players absent from players.csv.'
FROM {_O} HAVING count(*) > 0
UNION ALL SELECT 'WARNING', 'bonuses', 'campaign_id', 'ORPHAN_CAMPAIGN', format('{{:,}}', count(*)) || ' bonuses reference unknown campaigns.'
FROM {_O} WHERE k % 30 <> 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k % 400) HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'casino_sessions', 'game_id', 'ORPHAN_GAME', format('{{:,}}', count(*)) || ' sessions reference games absent from games.csv.'
FROM raw_sessions WHERE game_id = 'Brand#11' HAVING count(*) > 0"""))

register("import_planted_transactions", planted_transactions, q(f"""
SELECT CASE n % 97 WHEN 2 THEN 'Refund' WHEN 12 THEN 'DEPOSIT' ELSE transaction_type END AS transaction_type,
       CASE n % 97 WHEN 3 THEN 'Pending' ELSE transaction_status END AS transaction_status, count(*) AS rows,
       count(*) FILTER (n % 97 NOT IN (0, 7, 10)) AS amounts, count(*) FILTER (n % 97 <> 4) AS players,
       count(*) FILTER (n % 97 = 6) AS march_fourth, count(*) FILTER (n % 97 = 8) AS christmas, count(*) FILTER (n % 97 <> 13) AS dates,
       count(*) FILTER (n % 97 = 15 OR (processing_fee = 0 AND n % 97 <> 14)) AS free, count(*) FILTER (n % 97 = 11 OR (amount = 100 AND n % 97 NOT IN (0, 1, 7, 10))) AS hundreds
FROM {_T} GROUP BY 1, 2"""))

register("import_planted_bets", planted_bets, q(f"""
SELECT CAST(CASE n % 97 WHEN 5 THEN 1 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE is_live END AS BIGINT) AS is_live, count(*) AS rows,
       count(*) FILTER (n % 97 <> 2) AS odds, count(*) FILTER (n % 97 <> 4) AS stakes, count(*) FILTER (n % 97 <> 4) AS ggr
FROM {_B} GROUP BY 1"""))

register("import_planted_games", planted_games, q(f"""
SELECT game_id, CASE WHEN n % 5 = 2 THEN 'Unknown' ELSE game_name END AS game_name, game_family,
       CASE n % 5 WHEN 0 THEN 1.4 WHEN 1 THEN 0.96 ELSE CAST(theoretical_rtp AS DOUBLE) END AS theoretical_rtp, provider FROM {_G}"""))

register("import_planted_campaigns", planted_campaigns, """
SELECT 'CMP-' || s_suppkey AS campaign_id, CAST(CASE WHEN s_suppkey % 11 = 0 THEN 1001 ELSE 2 END AS BIGINT) AS clicks,
       CASE WHEN s_suppkey % 7 = 0 THEN DATE '2026-01-01' ELSE DATE '2026-03-01' END AS end_day, 'Meta' AS channel FROM supplier""")

register("import_file_duplicates", file_duplicates, q("""
SELECT 'ERROR' AS severity, 'transactions' AS dataset, 'transaction_id' AS "column", 'DUPLICATE_KEY' AS code,
       format('{:,}', count(*)) || ' duplicate primary keys across files.' AS message
FROM raw_transactions WHERE transaction_status = 'Pending' HAVING count(*) > 0"""))

register("import_derived_games", derived_games, q("""
SELECT DISTINCT game_id, game_id AS game_name, 'Unknown' AS game_family, CAST(0.96 AS DOUBLE) AS theoretical_rtp, 'Unknown' AS provider FROM raw_sessions"""))


# ---- the quality gate over raw tables with bad rows ---------------------------------------------
def faulty_warehouse(wh):
    """Every 500th player twice, unknown players and games, rows that staging refuses, one id for many rows."""
    from croupier.plans.warehouse import Warehouse
    from croupier.sources.driver_tables import RawTables

    r = wh.raw
    players = r.players.unionByName(r.players.filter(_tail("player_id") % 500 == 1))
    order = F.regexp_extract("session_id", r"^S-(\d+)-", 1).cast("bigint") % 100
    sessions = (r.sessions.withColumn("player_id", F.when(order == 7, "GHOST").otherwise(F.col("player_id")))
                .withColumn("game_id", F.when(order == 3, "Brand#99").otherwise(F.col("game_id")))
                .withColumn("duration_minutes", F.when(order == 1, -1.0).otherwise(F.col("duration_minutes"))))
    n = _tail("transaction_id") % 100
    transactions = (r.transactions.withColumn("transaction_type", F.when(n == 3, "Refund").otherwise(F.col("transaction_type")))
                    .withColumn("player_id", F.when(n == 5, "GHOST").otherwise(F.col("player_id")))
                    .withColumn("transaction_id", F.when(n == 4, "TRX-SAME").otherwise(F.col("transaction_id"))))
    b = _tail("bet_id") % 100
    bets = (r.sports_bets.withColumn("odds", F.when(b == 6, 0.5).otherwise(F.col("odds")))
            .withColumn("player_id", F.when(b == 2, "GHOST").otherwise(F.col("player_id"))))
    return Warehouse.from_raw(wh.spark, RawTables(players=players, games=r.games, sessions=sessions, transactions=transactions, sports_bets=bets))


def _faulty_gate(wh) -> DataFrame:
    from croupier.plans.quality import quality_checks

    return quality_checks(faulty_warehouse(wh))


register("quality_checks_faulty", _faulty_gate, q(f"""
SELECT unnest(['duplicate_players', 'invalid_rtp', 'duplicate_sessions', 'orphan_session_players', 'orphan_session_games', 'casino_ggr_mismatch',
               'duplicate_transactions', 'orphan_transaction_players', 'duplicate_sports_bets', 'orphan_sports_players', 'sports_ggr_mismatch',
               'raw_fact_session_delta', 'raw_fact_transaction_delta', 'raw_fact_sports_delta']) AS "check",
       unnest([(SELECT count(*) FROM {_P} WHERE n % 500 = 1), 0, 0, s.ghosts, s.games, 0, t.same, t.ghosts, 0, b.ghosts, 0, s.refused, t.refused, b.refused])::BIGINT AS value
FROM (SELECT count(*) FILTER (n <> 1 AND (n = 7 OR p IS NULL)) AS ghosts, count(*) FILTER (n = 3) AS games, count(*) FILTER (n = 1) AS refused
      FROM (SELECT CAST(regexp_extract(session_id, '^S-(\\d+)-', 1) AS BIGINT) % 100 AS n, x.player_id AS p FROM raw_sessions s LEFT JOIN raw_players x USING (player_id))) s,
     (SELECT count(*) FILTER (n <> 3 AND (n = 5 OR p IS NULL)) AS ghosts, greatest(count(*) FILTER (n = 4) - 1, 0) AS same, count(*) FILTER (n = 3) AS refused
      FROM (SELECT n % 100 AS n, x.player_id AS p FROM {_T} t LEFT JOIN raw_players x ON x.player_id = t.player_id)) t,
     (SELECT count(*) FILTER (n <> 6 AND (n = 2 OR p IS NULL)) AS ghosts, count(*) FILTER (n = 6) AS refused
      FROM (SELECT n % 100 AS n, x.player_id AS p FROM {_B} t LEFT JOIN raw_players x ON x.player_id = t.player_id)) b"""))
