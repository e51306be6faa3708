"""Registry of every implemented query: a Spark callable and, where SQL can express it,
an independent DuckDB oracle statement. ``__spark_entry__`` only re-exports this."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from croupier.oracle import q
from croupier.plans.warehouse import Warehouse
from croupier.scope import Scope
from croupier.session import configure, size_partitions
from croupier.sources.driver_tables import input_bytes

# Scopes used by the registered queries (FIXTURES.md §2.2).
S_MAIN = Scope("2000-01-01", "2000-03-31")
S_HALF = Scope("2000-01-16", "2000-01-30")
S_1995 = Scope("1995-01-01", "1995-12-31")
S_DAY = Scope("2000-01-10", "2000-01-10")
MARKET = "NATION_7"


@dataclass
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}
_WAREHOUSES: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """One lazily built warehouse per (session, data folder); its plans are reused, not data."""
    configure(spark)
    key = (_session_key(spark), sf_dir)
    if key not in _WAREHOUSES:
        _WAREHOUSES[key] = Warehouse.from_driver_tables(spark, sf_dir)
        _WAREHOUSES[key].input_bytes = input_bytes(spark, sf_dir)
    size_partitions(spark, _WAREHOUSES[key].input_bytes)
    return _WAREHOUSES[key]


def _session_key(spark: SparkSession) -> str:
    """Identity of a running session: a stopped and recreated session never reuses a cache entry."""
    try:
        return f"{spark.sparkContext.applicationId}:{id(spark)}"
    except Exception:  # noqa: BLE001  (no SparkContext on this client)
        return f"session:{id(spark)}"


def register(name: str, fn: Callable[[Warehouse], DataFrame], sql: str | None) -> None:
    _ENTRIES[name] = Entry(name, lambda spark, sf_dir, fn=fn: fn(warehouse(spark, sf_dir)), sql)


def entries() -> dict[str, Entry]:
    """All entries: every catalog module is imported here, whichever of them was imported before."""
    from croupier import (catalog_entries, catalog_evidence, catalog_more, catalog_rules,  # noqa: F401  (fill the registry)
                          catalog_import, catalog_layers, catalog_ml, catalog_pages, catalog_scores, catalog_semantic)
    return _ENTRIES


# ---- SQL helpers for the oracle ---------------------------------------------------------
def d_in(col: str, s: Scope) -> str:
    """Half-open day predicate for a DATE column."""
    return f"{col} >= DATE '{s.start}' AND {col} < DATE '{s.bound_day.isoformat()}'"


def t_in(col: str, s: Scope) -> str:
    """Half-open predicate for a TIMESTAMP column, written with timestamp bounds."""
    return f"{col} >= TIMESTAMP '{s.start} 00:00:00' AND {col} < TIMESTAMP '{s.bound_day.isoformat()} 00:00:00'"


def mk(s: Scope, col: str = "country") -> str:
    return "" if s.all_markets else f" AND {col} = '{s.country}'"


def mk_only(s: Scope, col: str = "country") -> str:
    return "TRUE" if s.all_markets else f"{col} = '{s.country}'"


__all__ = ["Entry", "register", "entries", "warehouse", "q", "d_in", "t_in", "mk", "mk_only",
           "S_MAIN", "S_HALF", "S_1995", "S_DAY", "MARKET"]
