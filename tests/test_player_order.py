"""Facts in player order: read instead of joined anew, with the same rows."""

from croupier.plans.scores import snapshot
from croupier.plans.warehouse import Warehouse
from croupier.queries import pages, player
from croupier.scope import Scope
from croupier.sources.driver_tables import load_raw_tables

SMALL = "/root/testdata/sf0.001"
SCOPE = Scope("2000-01-01", "2000-03-31")


def relations(df, column: str) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation [" in line and column in line for line in plan.splitlines())


def rows(df):
    return sorted(map(str, df.collect()))


def test_player_measures_read_the_written_facts(spark):
    lazy = Warehouse(spark, raw=load_raw_tables(spark, SMALL))
    for df in (snapshot(lazy, "2000-03-31"), player.player_base(lazy, SCOPE), player.kpi_summary(lazy, SCOPE)):
        assert relations(df, "l_orderkey") == 0 and relations(df, "session_start") > 0
    assert lazy.by_player is lazy.by_player and lazy.by_player.by_player is lazy.by_player
    plan = snapshot(lazy, "2000-03-31")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # distinct counts copy no rows


def test_given_facts_are_used_as_they_are(spark, tmp_path):
    lazy = Warehouse(spark, raw=load_raw_tables(spark, SMALL))
    written = lazy.write(str(tmp_path / "wh"))
    assert written.by_player is written
    assert rows(snapshot(lazy, "2000-03-31")) == rows(snapshot(written, "2000-03-31"))
    assert rows(player.player_base(lazy, SCOPE)) == rows(player.player_base(written, SCOPE))


def test_period_behaviour_is_part_of_the_player_base(spark):
    lazy = Warehouse(spark, raw=load_raw_tables(spark, SMALL))
    columns = ["player_id", "sessions", "sports_bets", "casino_ggr", "sports_ggr"]
    assert rows(player.period_behaviour(lazy, SCOPE)) == rows(player.player_base(lazy, SCOPE).select(*columns))
    assert pages.prepare_players(lazy, SCOPE).count() == player.player_base(lazy, SCOPE).count()


def test_replaced_scores_do_not_keep_the_mart_built_from_the_old_ones(spark):
    lazy = Warehouse(spark, raw=load_raw_tables(spark, SMALL))
    lazy.mart_player_360
    other = lazy.with_tables(model_scores=lazy.model_scores.limit(1))
    assert other.mart_player_360.count() <= 1 and other.by_player is lazy.by_player
