import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapledger.plans import serving
from snapledger.plans.registry import store
from snapledger.sources.catalog import read_source
from tests import tree


@pytest.fixture(scope="module")
def latest(ctx, spark, tmp_path_factory):
    shown = serving.latest_decisions(
        ctx.ref("transfer_decision"), ctx.ref("players"), ctx.ref("teams"), "photos/p%d.png", "badges/t%d.png"
    )
    return store(shown, str(tmp_path_factory.mktemp("latest") / "t"))


def ids(df, column="player_id"):
    return [r[column] for r in df.collect()]


def test_latest_decisions(latest):
    rows = {r.player_id: r for r in latest.collect()}
    assert {r.load_date for r in rows.values()} == {dt.date.fromisoformat(tree.DAY2)}
    assert rows[1].photo == "photos/p1001.png" and rows[1].badge == "badges/t3.png"
    assert rows[4].verdict == "Sell" and rows[13].prev_verdict is None


def test_latest_snapshot_reads_one_folder(ctx):
    from snapledger.operators.snapshots import latest_snapshot

    newest = latest_snapshot(ctx.ref("transfer_decision"))
    newest.collect()
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in plan


def test_stored_tables_are_rebalanced(ctx):
    hinted = ctx.ref("players").hint("rebalance", "load_date")
    assert "REBALANCE" in hinted._jdf.queryExecution().executedPlan().toString()


def test_picks(ctx, latest):
    best = latest.orderBy(F.col("transfer_score").desc(), "player_id").first()
    assert ids(serving.top_pick(latest)) == [best.player_id]
    scores = [r.transfer_score for r in serving.by_score(latest).collect()]
    assert scores == sorted(scores, reverse=True)
    per_position = serving.top_by_position(latest).collect()
    assert len(per_position) == len({r.position_short_name for r in per_position}) == 4
    cheap = serving.budget_picks(latest, cap=5.5, k=1).collect()
    assert all(r.price_m <= 5.5 for r in cheap)
    assert all(r.selected_by_percent <= 5 for r in serving.differentials(latest).collect())
    moved = serving.movers(latest, 0.0, 1).collect()
    assert len({r.recommendation_trend for r in moved}) == len(moved)
    back_line = serving.clean_sheet_picks(latest, ctx.ref("defensive_outlook"), 2).collect()
    assert {r.position_short_name for r in back_line} <= {"GKP", "DEF"}
    captains = {r.player_id: r for r in serving.captain_picks(latest, ctx.ref("fixture_difficulty"), 20).collect()}
    assert captains[1].opponent_name == "Brightwell" and captains[8].opponent_name is None
    assert serving.ease_published(ctx.ref("defensive_outlook")).first().published is True


def test_search(latest):
    assert set(ids(serving.search(latest, ["MID"], [], "ØSTV|ashford"))) == {2, 4}
    assert serving.search(latest).count() == latest.count()
    assert ids(serving.search(latest, verdicts=["Sell"])) and ids(serving.search(latest, ["XXX"])) == []


def test_signal_breakdown(latest):
    rows = serving.signal_breakdown(latest.filter("player_id = 8")).collect()
    assert len(rows) == 5
    assert {r.signal: r.pctl for r in rows}["Fixtures (15%)"] == 0.5


def test_table_queries(ctx):
    table = ctx.ref("league_table")
    shown = serving.latest_table(table).collect()
    assert [r.position for r in shown] == [1, 2, 3]
    assert [r.zone for r in shown] == ["top"] * 3 and shown[0].season_label == "2025/26"
    leader = serving.league_leader(table).first()
    assert leader.team_name == "Chelmer" and leader.season_complete is False
    assert serving.league_leader(table, games=2).first().season_complete is True
    cards = {r.card: (r.team_name, r.goals) for r in serving.best_attack_defence(table).collect()}
    assert cards == {"best_attack": ("Chelmer", 4), "best_defence": ("Chelmer", 1)}
    best = serving.best_defence(ctx.ref("defensive_outlook"), ctx.ref("teams")).first()
    assert best.team_code in (3, 8, 36)


def test_season_queries(ctx):
    players = ctx.ref("season_players")
    gap = serving.goal_gap(players).first()
    assert gap.player_name == "Corin Vale" and gap.delta == 0.5
    extremes = serving.finishing_extremes(players)
    assert extremes.count() == 14  # 7 qualify, so each is on both sides
    matches = ctx.ref("season_team_matches")
    table = {r.team_name: r for r in serving.team_xg_table(matches, 2025).collect()}
    assert table["Ashford"].points_minus_xpts == -0.8 and table["Ashford"].ppda == 8.0
    assert serving.team_xg_table(matches, 2024).count() == 0
    delta = {r.team_name: r.defensive_delta for r in serving.defence_delta(serving.team_xg_table(matches)).collect()}
    assert delta == {"Ashford": -0.1, "Chelmer": 0.5}
    assert ids(serving.xg_table_by_points(matches), "team_name") == ["Ashford", "Chelmer"]
    assert ids(serving.seasons(matches), "season") == [2025]
    bounds = serving.points_range(serving.team_xg_table(matches)).first()
    assert bounds.axis_min == pytest.approx(-3.1) and bounds.axis_max == pytest.approx(5.8)


def test_player_stats(ctx):
    stats = serving.season_stats(ctx.ref("players"), ctx.ref("teams"), ctx.ref("positions"))
    assert stats.count() == 13
    assert ids(serving.leaders(stats, "goals_scored", 3)) == [3, 7, 11]
    kept = serving.shooters(stats, 900, ["MID"])
    assert {r.player_id: r.xg_delta for r in kept.collect()} == {2: 0.75, 4: -1.25, 7: 1.75, 13: -0.25}
    assert ids(serving.largest_absolute(kept, "xg_delta", "player_id", 2)) == [7, 4]
    assert serving.shooter_names(stats).count() == 12


@pytest.fixture(scope="module")
def squad(spark, latest):
    picks = [(1, 1, 1), (1, 2, 2), (1, 4, 3), (1, 11, 12), (1, 99, 4), (2, 4, 1), (2, 9, 2), (3, 11, 1), (3, 12, 2)]
    df = spark.createDataFrame(
        [(m, e, s, s == 1 and m != 3, s == 2) for m, e, s in picks],
        "manager_id int, element int, position int, is_captain boolean, is_vice_captain boolean",
    )
    return serving.squads(df, latest)


def test_squads(squad):
    rows = {(r.manager_id, r.element): r for r in squad.collect()}
    assert rows[1, 1].role == "captain" and rows[1, 2].role == "vice" and rows[1, 11].squad_slot == "bench"
    assert rows[1, 99].player_id is None
    assert {r.manager_id: r.unresolved for r in serving.unresolved(squad).collect()} == {1: 1, 2: 0, 3: 0}


def test_captain_suggestion(squad):
    got = {r.manager_id: r for r in serving.captain_suggestion(squad).collect()}
    # Manager 2 has no fit starter; manager 3 named no captain.
    assert got[2].outcome == "no_fit_starter" and got[3].outcome == "no_captain"
    assert got[1].outcome in ("keep", "change") and got[1].best_player_id in (1, 2)


def test_weak_links(spark, squad, latest):
    banks = spark.createDataFrame([(1, 100), (2, 0), (3, 0)], "manager_id int, bank int")
    got = {(r.manager_id, r.player_id): r for r in serving.weak_links(squad, banks, latest).collect()}
    pool = {r.player_id: r for r in latest.collect()}
    owned = {(r.manager_id, r.element) for r in squad.collect()}
    assert (2, 4) in got
    for (manager, player), row in got.items():
        budget = round(pool[player].price_m * 10) + {1: 100, 2: 0, 3: 0}[manager]
        fits = [
            (-p.transfer_score, k) for k, p in pool.items()
            if p.position_short_name == pool[player].position_short_name and p.price_m is not None
            and round(p.price_m * 10) <= budget and (manager, k) not in owned and p.availability_risk != "high_risk"
        ]
        assert row.item == (min(fits)[1] if fits else None)


def test_current_period(spark, landed):
    got = {r.load_date.isoformat(): r for r in serving.current_period(read_source(spark, landed, "bootstrap")).collect()}
    # Day 1 marks a finished period and queues none; day 2 marks none.
    assert (got[tree.DAY1].period, got[tree.DAY1].is_offseason) == (2, True)
    assert (got[tree.DAY2].period, got[tree.DAY2].is_offseason) == (2, False)


def test_live(spark, ctx):
    payload = '{"elements": [{"id": 1, "stats": {"minutes": 90, "total_points": 7}}, {"id": 2, "stats": {"minutes": 0}}]}'
    raw = spark.createDataFrame([(payload,)], "p string").select(
        F.try_variant_get(F.parse_json("p"), "$.elements", "array<variant>").alias("elements")
    )
    stats = serving.season_stats(ctx.ref("players"), ctx.ref("teams"), ctx.ref("positions"))
    top = serving.live_top(serving.live_stats(raw), stats.select("player_id", "web_name", "team_name")).collect()
    assert [(r.player_id, r.total_points, r.web_name) for r in top] == [(1, 7, "Vale")]


def test_leagues(spark):
    payload = '[{"id": 5, "name": "Friends", "league_type": "x"}, {"id": 6, "name": "Overall", "league_type": "s"}]'
    entries = spark.createDataFrame([(1, payload), (2, payload)], "entry bigint, p string").select(
        "entry", F.parse_json("p").cast("array<variant>").alias("leagues")
    )
    leagues = serving.private_leagues(entries)
    assert {(r.entry, r.league_id) for r in leagues.collect()} == {(1, 5), (2, 5)}
    standings = spark.createDataFrame([(5, 1, 30), (5, 3, 20), (6, 1, 9)], "league_id bigint, entry bigint, total int")
    assert [(r.entry, r.total) for r in serving.own_standings(leagues, standings).collect()] == [(1, 30)]
    viewers = spark.createDataFrame([(5, 3)], "league_id bigint, viewer bigint")
    assert {r.entry: r.you for r in serving.league_views(standings, viewers).collect()} == {1: False, 3: True}


def test_tables_of_rows_are_not_broadcast_for_squads(spark):
    """Newest decisions and banks grow with the input, whatever their files weigh."""
    picks = spark.createDataFrame([(1, 7, 1, True, False)], "manager_id int, element int, position int, is_captain boolean, is_vice_captain boolean")
    shown = spark.createDataFrame(
        [(7, "x", "DEF", "drop", 4.0, 50.0, "likely")],
        "player_id int, web_name string, position_short_name string, recommendation string, price_m double, transfer_score double, availability_risk string",
    )
    banks = spark.createDataFrame([(1, 3)], "manager_id int, bank int")
    squad = serving.squads(picks, shown)
    assert "Broadcast" not in squad._jdf.queryExecution().executedPlan().toString()
    plan = serving.weak_links(squad, banks, shown)._jdf.queryExecution().executedPlan().toString()
    # the one left is of `row_numbers`: at most two rows for each slice
    assert plan.count("BroadcastHashJoin") == 1


def test_codes_of_old_snapshots_stay_behind(spark):
    decision = spark.createDataFrame(
        [("2024-01-02", 1, 1, "hold", "drop")], "load_date string, player_id int, team_id int, recommendation string, prev_recommendation string"
    )
    players = spark.createDataFrame([(d, 1, 9) for d in ("2024-01-01", "2024-01-02")], "load_date string, player_id int, player_code int")
    teams = spark.createDataFrame([(1, 901)], "team_id int, team_code int")
    shown = serving.latest_decisions(decision, players, teams)
    assert [(r.player_code, r.team_code) for r in shown.collect()] == [(9, 901)]
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") >= 2


def test_difficulty_takes_runs_that_are_there(spark, monkeypatch):
    from snapledger.operators import fixtures as ops

    rows = [(2024, 2024, i, 1, i % 2 + 1, 3, i % 5 + 1, 2, i, False) for i in range(6)]
    games = spark.createDataFrame(
        rows, "load_date int, season int, fixture_id int, gameweek int, home_team_id int, away_team_id int, home_difficulty int, away_difficulty int, kickoff_time int, finished boolean",
    )
    teams = spark.createDataFrame([(i, f"T{i}") for i in (1, 2, 3)], "team_id int, team_name string")
    expected, runs = ops.fixture_difficulty(games, teams).collect(), ops.fixture_runs(games)
    monkeypatch.setattr(ops, "next_n_run", None)
    assert sorted(ops.fixture_difficulty(games, teams, runs).collect()) == sorted(expected) and len(expected) == 12
