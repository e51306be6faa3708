"""croupier: operator analytics (casino, sportsbook, payments) as Spark DataFrame jobs.

Layers: ``sources`` (raw tables), ``plans`` (warehouse layers, quality gates, scores,
rules, semantic aggregation, evidence jobs), ``queries`` (dashboard KPIs), ``operators``
(reusable DataFrame building blocks), ``functions`` (column expressions), ``ml`` (MLlib
models) and ``streaming`` (incremental refresh of the daily marts).
"""

from croupier.scope import Scope

__all__ = ["Scope"]
