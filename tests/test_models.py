import pytest
import datetime as dt
import threading

from pyspark.sql import functions as F

from snapledger.operators.quality import TableChecks, observed, run_checks
from snapledger.plans import checks, registry
from snapledger.plans.registry import MODELS
from tests.tree import DAY1, DAY2


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def day(text):
    return dt.date.fromisoformat(text)


def test_every_model_builds(ctx):
    built = ctx.build()
    assert set(built) == set(MODELS)
    assert all(df.count() > 0 for df in built.values())
    assert set(ctx.edges["transfer_decision"]) == {
        "players", "positions", "teams", "season_player_map", "season_players", "fixture_difficulty"
    }


def test_players_are_typed(ctx):
    players = rows(ctx.ref("players"), "load_date", "player_id")
    assert len(players) == 25
    assert len(ctx.ref("players").columns) == 52
    first = players[day(DAY1), 2]
    assert (first.now_cost, first.form, first.transfers_in_total) == (62, None, 5_000_000_000)
    assert first.news_added == dt.datetime(2025, 8, 30, 10, 0, 7, 250000)
    assert players[day(DAY1), 1].news is None
    assert players[day(DAY2), 13].now_cost is None


def test_fixtures_are_typed(ctx):
    row = rows(ctx.ref("fixtures").filter(F.col("load_date") == DAY1), "fixture_id")
    assert row[1].kickoff_time == dt.datetime(2025, 8, 16, 14)
    assert row[4].kickoff_time is None and row[4].finished is False
    assert row[1].fixture_code == 9_000_000_001


def test_matches(ctx):
    row = rows(ctx.ref("matches"), "match_id")
    assert (row[501].home_goals, row[501].away_goals, row[501].home_team_ws_id) == (2, 0, 11)
    assert [row[k].season_start_year for k in (501, 502, 503)] == [2024, 2025, 2025]


def test_match_events_keep_duplicates(ctx):
    events = ctx.ref("match_events")
    assert events.count() == 7
    assert events.filter("event_ws_id = 2").count() == 2
    start = events.filter("event_type = 'Start'").first()
    assert start.player_ws_id is None and start.is_successful is None
    qualifier = events.select(F.try_variant_get("qualifiers", "$[0].value", "string").alias("v")).first()
    assert qualifier.v == "80.1"


def test_match_players_take_the_usual_name(ctx):
    row = rows(ctx.ref("match_players"), "player_ws_id")
    assert row[101].player_name == "Corin Vale" and row[101].n_squad_appearances == 3
    assert row[102].player_name == "Ilmar Tuncag"


def test_season_models_use_the_latest_load(ctx):
    players = rows(ctx.ref("season_players"), "player_ud_id")
    assert len(players) == 8 and players[205].player_name == "Lorne O'Carrick"
    assert players[201].load_date == day(DAY2) and players[201].xg == 3.5
    matches = rows(ctx.ref("season_matches"), "match_ud_id")
    assert matches[302].is_result is False and matches[302].home_goals is None
    team = rows(ctx.ref("season_team_matches"), "team_ud_id")
    assert team[83].ppda == 8.0 and team[83].ppda_allowed is None and team[83].match_date == day("2025-08-16")


def test_player_map_ladder(ctx):
    row = rows(ctx.ref("player_map"), "player_ws_id")
    assert (row[101].player_id, row[101].match_rule) == (1, "first_tokens")
    assert (row[102].player_id, row[102].match_rule) == (2, "full_name")
    assert (row[104].player_id, row[104].match_rule) == (7, "short_name")
    assert (row[105].player_id, row[105].match_rule) == (8, "web_name")
    # A letter that does not decompose never matches, and a shared key is dropped.
    assert 103 not in row and 106 not in row


def test_overrides_win(ctx):
    row = rows(ctx.ref("season_player_map"), "player_ud_id")
    assert (row[203].player_id, row[203].match_rule) == (3, "manual")
    assert (row[208].player_id, row[208].player_code) == (5, 1005)
    # 205 -> 9 beats the ladder pair 207 -> 9; the absent code is ignored.
    assert row[205].player_id == 9 and 207 not in row and 299 not in row
    assert row[206].match_rule == "full_name"


def test_momentum_and_trend(ctx):
    row = rows(ctx.ref("price_momentum"), "load_date", "player_id")
    assert row[day(DAY1), 2].price_trend == "no_prior_snapshot"
    assert row[day(DAY2), 2].price_trend == "rising" and row[day(DAY2), 2].price_change_since_prev_snapshot == 1
    assert row[day(DAY2), 9].price_trend == "falling" and row[day(DAY2), 3].price_trend == "stable"
    assert row[day(DAY2), 1].ownership_change_since_prev_snapshot == 7.75
    assert row[day(DAY2), 13].price_trend == "no_prior_snapshot"
    trend = rows(ctx.ref("form_trend"), "load_date", "player_id")
    assert trend[day(DAY2), 1].form_change_since_prev_snapshot == 0.0
    assert trend[day(DAY2), 2].form_change_since_prev_snapshot is None


def test_availability(ctx):
    row = rows(ctx.ref("availability_risk").filter(F.col("load_date") == DAY1), "player_id")
    assert {k: r.availability_risk for k, r in row.items()} == {
        1: "available", 2: "doubtful", 3: "likely", 4: "high_risk", 5: "unknown", 7: "unknown",
        8: "available", 9: "high_risk", 11: "available", 12: "available",
    }


def test_value(ctx):
    row = rows(ctx.ref("player_value").filter(F.col("load_date") == DAY1), "player_id")
    assert 6 not in row and 10 not in row
    assert row[8].points_per_million is None
    assert row[2].points_per_million == 3.23
    assert row[12].value_rank_in_position == 1 and row[11].value_rank_in_position == 2


def test_fixture_run(ctx):
    row = rows(ctx.ref("fixture_difficulty").filter(F.col("load_date") == DAY1), "fixture_id", "team_id")
    assert row[1, 1].upcoming_fixture_number is None and row[1, 1].avg_difficulty_next_5 is None
    numbers = {f: row[f, 1].upcoming_fixture_number for f in range(4, 11)}
    assert numbers == {5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 6, 4: 7}
    assert row[5, 1].avg_difficulty_next_5 == 3.4  # 2, 3, 3, 5, 4
    assert row[4, 1].avg_difficulty_next_5 == 5.0
    assert row[5, 1].opponent_name == "Brightwell" and row[5, 1].is_home


def test_league_table(ctx):
    row = rows(ctx.ref("league_table").filter(F.col("load_date") == DAY2), "team_id")
    assert [row[k].position for k in (3, 1, 2)] == [1, 2, 3]
    assert (row[3].points, row[3].goal_difference, row[3].won, row[3].drawn) == (4, 3, 1, 1)
    assert row[1].form_last_5 == "W D" and row[2].form_last_5 == "L L"


def test_transfer_decision(ctx):
    decision = ctx.ref("transfer_decision")
    assert len(decision.columns) == 29
    row = rows(decision, "load_date", "player_id")
    first = row[day(DAY1), 2]
    # NULL form ranks last, so at the top of the midfielders.
    assert first.form is None and first.form_pctl == 1.0
    assert row[day(DAY1), 4].recommendation == "drop"
    assert row[day(DAY1), 1].underlying_pctl is None  # keepers are not rated
    assert first.npxg_xa_per90 == 0.4
    assert row[day(DAY1), 4].npxg_xa_per90 is None  # 449 minutes
    assert row[day(DAY2), 13].recommendation_trend == "no_prior_snapshot"
    # Derwent has no fixtures: neutral.
    assert row[day(DAY1), 8].fixture_pctl is None
    assert first.price_m == 6.2
    expected = round(100 * (0.30 * 0.0 + 0.25 * 1.0 + 0.20 * 0.0 + 0.15 * 0.0 + 0.10 * 0.0), 1)
    assert first.value_pctl == 0.0 and first.transfer_score >= expected


def test_defensive_outlook(ctx):
    row = rows(ctx.ref("defensive_outlook").filter(F.col("load_date") == DAY1), "team_id")
    assert set(row) == {1, 2, 3}
    assert row[1].team_clean_sheets == 2 and row[1].clean_sheet_rate == 1.0
    assert row[3].clean_sheet_pctl is not None


def test_data_checks(ctx):
    broken = {name: df.count() for name, df in checks.checks(ctx)}
    assert len(broken) == 70
    failing = {k: v for k, v in broken.items() if v}
    assert failing == {}
    assert {r.check: r.violations for r in checks.all_checks(ctx).collect()} == broken


def test_checks_of_a_table_in_one_scan(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 5, 5), (1, "b", None, 3, 2), (2, "c", 1, 1, 1), (2, "c", 4, 1, 2), (None, None, 4, 1, 1)],
        "d int, g string, k int, plus int, minus int",
    )
    wanted = TableChecks(
        rows={"g_known": F.col("g").isNull(), "g_listed": ~F.col("g").isin("a", "b")},
        keys={"k": ["k"], "dg": ["d", "g"], "d": ["d"]},
        balances={"by_d": (["d"], "plus", "minus")},
    )
    found = run_checks(df, wanted)
    assert {r.check: r.violations for r in found.collect()} == {"g_known": 1, "g_listed": 2, "k": 2, "dg": 1, "d": 2, "by_d": 2}
    assert {r.violations for r in run_checks(df.limit(0), wanted).collect()} == {0}
    plan = run_checks(df, wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange") == 2
    seen_df, seen = observed(df, wanted)
    seen_df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"g_known": 1, "g_listed": 2}


def test_models_that_need_each_other_are_named(spark, monkeypatch):
    added = {
        name: registry.Model(name, "gold", "view", False, needs, lambda ctx: ctx.spark.range(1))
        for name, needs in {"one": ("two",), "two": ("three",), "three": ("one",), "four": ("players",)}.items()
    }
    monkeypatch.setattr(registry, "MODELS", {**MODELS, **added})
    with pytest.raises(ValueError, match="need each other: .*(one -> two|two -> three|three -> one)"):
        registry.Context(spark, lambda name: None).build("one")


def test_models_say_what_they_need(spark, monkeypatch):
    model = registry.Model("eager", "gold", "view", False, (), lambda ctx: ctx.ref("players"))
    monkeypatch.setattr(registry, "MODELS", {**MODELS, "eager": model})
    with pytest.raises(ValueError, match="eager asks for players"):
        registry.Context(spark, lambda name: None).build("eager")


def test_independent_models_are_built_at_once(spark, monkeypatch):
    """Each of two models waits for the other to have started."""
    meeting = threading.Barrier(2, timeout=60)

    def build(ctx):
        meeting.wait()
        return ctx.spark.range(3)

    added = {n: registry.Model(n, "gold", "view", False, (), build) for n in ("left", "right")}
    added["both"] = registry.Model("both", "gold", "view", False, ("left", "right"), lambda ctx: ctx.ref("left").union(ctx.ref("right")))
    monkeypatch.setattr(registry, "MODELS", added)
    ctx = registry.Context(spark, lambda name: None)
    assert ctx.ref("both").count() == 6 and ctx.edges == {"both": ["left", "right"]}
    assert list(registry.build_order("both").get_ready()) and set(registry.needed("both")) == {"left", "right", "both"}


def test_publish(ctx, spark):
    ctx.publish("players", "positions", "league_table")
    other = spark.newSession()
    assert other.table("silver.players").count() == 25
    assert other.table("silver.positions").count() == ctx.ref("positions").count()
    assert other.table("gold.league_table").count() == 6
    kinds = {t.name: t.tableType for t in other.catalog.listTables("silver")}
    assert kinds["players"] == kinds["positions"] == "VIEW" and kinds["players_rows"] == "EXTERNAL"


def test_published_tables_keep_their_folders(ctx, spark):
    ctx.publish("transfer_decision")
    kept = spark.table("gold.transfer_decision")
    assert kept.count() == ctx.ref("transfer_decision").count()
    plan = kept.filter("load_date = date'2026-07-10'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in plan


@pytest.mark.parametrize("slices", [1, 30])
def test_decisions_are_the_same_in_any_number_of_slices(ctx, spark, slices):
    from snapledger.operators import scoring

    parts = [ctx.ref(n) for n in ("players", "positions", "teams", "season_player_map", "season_players")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        ease = scoring.fixture_ease(ctx.ref("fixture_difficulty"))
        decisions = scoring.transfer_decision(*parts, ease)
        outlook = scoring.defensive_outlook(ctx.ref("players"), ctx.ref("league_table"), ease)
        assert sorted(map(str, decisions.collect())) == sorted(map(str, ctx.ref("transfer_decision").collect()))
        assert sorted(map(str, outlook.collect())) == sorted(map(str, ctx.ref("defensive_outlook").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
