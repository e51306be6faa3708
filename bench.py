"""Benchmark: build the warehouse once at $BENCH_SF_DIR, then time the headline queries.

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
``value`` is the total wall time (warehouse build + every query).
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from croupier.catalog import S_1995, S_HALF, S_MAIN  # noqa: E402
from croupier.plans import evidence, quality, rules, semantic  # noqa: E402
from croupier.plans.warehouse import Warehouse  # noqa: E402
from croupier.queries import acquisition, casino, crm, finance, overview, player, risk, sportsbook  # noqa: E402
from croupier.session import local_session, shared_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def _sf_label(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    return base[2:] if base.startswith("sf") else base


HEADLINE = {
    "performance_summary": lambda wh: overview.performance_summary(wh, S_MAIN),
    "daily_ggr_trend": lambda wh: overview.daily_ggr_trend(wh, S_MAIN),
    "game_performance": lambda wh: casino.game_performance(wh, S_MAIN),
    "sessions_heatmap": lambda wh: casino.sessions_heatmap(wh, S_MAIN),
    "event_liability": lambda wh: sportsbook.event_liability(wh, S_HALF),
    "payment_methods": lambda wh: finance.payment_methods(wh, S_MAIN),
    "weekly_deposits": lambda wh: finance.weekly_deposits_withdrawals(wh, S_MAIN),
    "retention_d30": lambda wh: player.retention_d30(wh, S_1995),
    "ftd_conversion_d30": lambda wh: acquisition.ftd_conversion_d30(wh, S_1995),
    "player_base": lambda wh: player.player_base(wh, S_MAIN),
    "kpi_summary": lambda wh: player.kpi_summary(wh, S_MAIN),
    "risk_case_queue": lambda wh: risk.case_queue(wh, S_MAIN),
    "crm_segments": lambda wh: crm.segments(wh, S_MAIN),
    "source_performance": lambda wh: acquisition.source_performance(wh, S_1995),
    "rules_alerts": lambda wh: rules.alerts(wh, S_MAIN),
    "semantic_casino": lambda wh: semantic.compile_plan(
        wh, semantic.QueryPlan("casino", ("game", "provider"), ("ggr", "rtp"), "ggr"), S_MAIN),
    "evidence_ngr_change": lambda wh: evidence.ngr_change(wh, S_MAIN),
    "quality_gate": lambda wh: quality.quality_checks(wh, include_ml=True),
    "player_timeline": lambda wh: player.player_timeline(wh),
}


def main() -> None:
    spark = local_session(CPUS, int(CPUS) * 2, app="croupier-bench")
    timings: dict[str, float] = {}
    target = shared_dir(spark, f"croupier-bench-{uuid.uuid4().hex[:8]}")

    t0 = time.time()
    source = Warehouse.from_driver_tables(spark, SF_DIR)
    built = source.write(target, with_scores=True)
    built.raw = source.raw
    timings["warehouse_build"] = round(time.time() - t0, 3)

    for name, fn in HEADLINE.items():
        t = time.time()
        # the noop sink runs the whole plan without shipping rows to the driver
        fn(built).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t, 3)

    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "warehouse_build_plus_headline_queries", "value": total, "unit": "sec",
                      "queries": timings, "sf": _sf_label(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
