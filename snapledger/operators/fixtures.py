"""Two-sided results: per-side rows, look-ahead runs, standings and form guides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.labels import result_letter
from snapledger.functions.numbers import round_half_away
from snapledger.operators.ordering import Key, down, ordered, over_rows, row_numbers, up

RECORD_COUNTS = ("won", "drawn", "lost", "goals_for", "goals_against", "goal_difference", "points")


def team_key(teams: DataFrame) -> list[str]:
    """Join key of a team dimension: a snapshot series has one row per team and load date."""
    return [c for c in ("load_date", "team_id") if c in teams.columns]


def two_sided_unpivot(fixtures: DataFrame, keep: Sequence[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """One row per side and fixture in a single pass over the fixtures.

    `home` and `away` map output columns to the fixture column that holds them for that side;
    `is_home` tells the sides apart.
    """

    def side(columns: dict[str, str], is_home: bool) -> Column:
        return F.struct(*[F.col(c).alias(out) for out, c in columns.items()], F.lit(is_home).alias("is_home"))

    sides = F.array(side(home, True), side(away, False))
    return fixtures.select(*keep, F.explode(sides).alias("_side")).select(*keep, "_side.*")


def team_fixtures(fixtures: DataFrame) -> DataFrame:
    """Fixture list from each team's point of view."""
    return two_sided_unpivot(
        fixtures,
        ["load_date", "season", "fixture_id", "gameweek", "kickoff_time", "finished"],
        {"team_id": "home_team_id", "opponent_team_id": "away_team_id", "difficulty": "home_difficulty"},
        {"team_id": "away_team_id", "opponent_team_id": "home_team_id", "difficulty": "away_difficulty"},
    )


def team_results(fixtures: DataFrame) -> DataFrame:
    """Finished results from each team's point of view."""
    return two_sided_unpivot(
        fixtures.filter("finished"),
        ["load_date", "season", "fixture_id", "kickoff_time"],
        {"team_id": "home_team_id", "goals_for": "home_score", "goals_against": "away_score"},
        {"team_id": "away_team_id", "goals_for": "away_score", "goals_against": "home_score"},
    )


def next_n_run(
    sides: DataFrame,
    group: Sequence[str],
    order: Sequence[Key],
    value: str,
    n: int = 5,
    open_rows: str = "not finished",
    number: str = "upcoming_fixture_number",
    out: str = "avg_difficulty_next_5",
) -> DataFrame:
    """Number the open rows of a group and average `value` over each and the n - 1 after it.

    Other rows pass through with NULLs. `order` must end in a unique column.
    """
    is_open = F.coalesce(F.expr(open_rows), F.lit(False))
    run = over_rows(
        sides.filter(is_open),
        group,
        order,
        lambda w: {out: round_half_away(F.avg(value).over(w.rowsBetween(0, n - 1)), 2)},
        after=n - 1,
        number=number,
    )
    rest = sides.filter(~is_open).withColumns(
        {number: F.lit(None).cast("bigint"), out: F.lit(None).cast("double")}
    )
    return run.unionByName(rest)


def fixture_runs(fixtures: DataFrame) -> DataFrame:
    """Every team's fixtures with its upcoming run."""
    return next_n_run(
        team_fixtures(fixtures),
        ["load_date", "team_id"],
        [up("kickoff_time"), up("fixture_id")],
        "difficulty",
    )


def fixture_difficulty(fixtures: DataFrame, teams: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Every team's fixtures with its upcoming run and both team names; `runs` may hold their `fixture_runs` already."""
    run = fixture_runs(fixtures) if runs is None else runs
    key = team_key(teams)
    own = teams.select(*key, "team_name")
    opponent = own.withColumnsRenamed({"team_id": "opponent_team_id", "team_name": "opponent_name"})
    return (
        run.join(own, key, "left")
        .join(opponent, [*key[:-1], "opponent_team_id"], "left")
        .select(
            "load_date",
            "season",
            "fixture_id",
            "gameweek",
            "team_id",
            "team_name",
            "opponent_team_id",
            "opponent_name",
            "is_home",
            "difficulty",
            "kickoff_time",
            "finished",
            "upcoming_fixture_number",
            "avg_difficulty_next_5",
        )
    )


def form_guide(
    results: DataFrame, group: Sequence[str], newest_first: Sequence[Key], n: int = 5, out: str = "form_last_5"
) -> DataFrame:
    """Last n results per group as letters, oldest first. The order must be unique in a group.

    Every task keeps n rows per group before the shuffle, so a group never gathers whole.
    """
    place = F.row_number().over(ordered(group, newest_first))
    recent = results.withColumn("_place", place).filter(F.col("_place") <= n)
    letter = result_letter(F.col("goals_for"), F.col("goals_against"))
    oldest_first = F.array_sort(F.collect_list(F.struct((-F.col("_place")).alias("age"), letter.alias("letter"))))
    text = F.array_join(F.transform(oldest_first, lambda result: result["letter"]), " ")
    return recent.groupBy(*group).agg(text.alias(out))


def season_records(results: DataFrame, group: Sequence[str], points: tuple[int, int, int] = (3, 1, 0)) -> DataFrame:
    """Played, won, drawn, lost, goals and points per group."""
    scored, conceded = F.col("goals_for"), F.col("goals_against")
    win, draw, loss = scored > conceded, scored == conceded, scored < conceded
    earned = F.when(win, points[0]).when(draw, points[1]).otherwise(points[2])
    return results.groupBy(*group).agg(
        F.count("*").alias("played"),
        F.count_if(win).alias("won"),
        F.count_if(draw).alias("drawn"),
        F.count_if(loss).alias("lost"),
        F.sum(scored).alias("goals_for"),
        F.sum(conceded).alias("goals_against"),
        (F.sum(scored) - F.sum(conceded)).alias("goal_difference"),
        F.sum(earned).alias("points"),
    )


def standings(
    records: DataFrame,
    table: Sequence[str],
    order: Sequence[Key] = (down("points"), down("goal_difference"), down("goals_for"), up("team_name")),
    out: str = "position",
) -> DataFrame:
    """Position of each record in its table; the order must end in a column unique per table."""
    return row_numbers(records, table, order, out)


def league_table(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Standings of every snapshot with names and form, from finished fixtures."""
    results = team_results(fixtures)
    key = ["load_date", "team_id"]
    form = form_guide(results, key, [down("kickoff_time"), down("fixture_id")])
    names = teams.select(*team_key(teams), "team_name", "team_short_name", "team_code")
    records = season_records(results, ["load_date", "season", "team_id"])
    named = records.join(names, team_key(teams), "left")
    placed = standings(
        named,
        ["load_date"],
        [down("points"), down("goal_difference"), down("goals_for"), up("team_name"), up("team_id")],
    )
    return placed.join(form, key, "left").select(
        "load_date",
        "season",
        "position",
        "team_id",
        "team_name",
        "team_short_name",
        "team_code",
        "played",
        *[F.col(c).cast("int").alias(c) for c in RECORD_COUNTS],
        "form_last_5",
    )
