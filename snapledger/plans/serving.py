"""Queries over the decision tables. Filters and limits stay in the plan; only answers leave it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions import labels
from snapledger.functions.fields import fields, pick, typed
from snapledger.functions.numbers import round_half_away
from snapledger.functions.text import contains_pattern, link, season_label
from snapledger.operators.fixtures import team_key
from snapledger.operators.ordering import down, row_numbers, sorts, top, top_per_group, up
from snapledger.operators.replacement import best_affordable
from snapledger.operators.snapshots import latest_snapshot, latest_value

# Display texts and page defaults.
VERDICTS = {"transfer_in": "Buy", "hold": "Hold", "monitor": "Monitor", "drop": "Sell"}
SIGNAL_LABELS = {
    "value_pctl": "Value (30%)",
    "form_pctl": "Form (25%)",
    "underlying_pctl": "Underlying xG (20%)",
    "fixture_pctl": "Fixtures (15%)",
    "momentum_pctl": "Momentum (10%)",
}
KEEPER, DEFENDER = "GKP", "DEF"
SEASON_GAMES = 38
MIN_MINUTES = 900
PRIVATE_LEAGUE = "x"


def _best(*more: str) -> list:
    return [down("transfer_score"), *[up(m) for m in (more or ("player_id",))]]


# Decision table


def latest_decisions(
    decision: DataFrame,
    players: DataFrame,
    teams: DataFrame,
    photo_template: str | None = None,
    badge_template: str | None = None,
) -> DataFrame:
    """Newest decisions with display codes, verdict texts and optional image links."""
    newest = F.col("load_date") == latest_value(decision, "load_date")
    codes = players.select("load_date", "player_id", "player_code").filter(newest).hint("merge")
    badges = teams.select(*team_key(teams), "team_code")
    shown = (
        latest_snapshot(decision)
        .join(codes, ["load_date", "player_id"], "left")
        .join(badges, team_key(teams), "left")
        .withColumns(
            {
                "verdict": labels.lookup(F.col("recommendation"), VERDICTS),
                "prev_verdict": labels.lookup(F.col("prev_recommendation"), VERDICTS),
            }
        )
    )
    if photo_template:
        shown = shown.withColumn("photo", link(photo_template, F.col("player_code")))
    if badge_template:
        shown = shown.withColumn("badge", link(badge_template, F.col("team_code")))
    return shown


def by_score(latest: DataFrame) -> DataFrame:
    """The whole table in page order. Stored tables have no order; pages sort what they show."""
    return latest.orderBy(*sorts(_best()))


def positioned(latest: DataFrame) -> DataFrame:
    """The table with the place of each row in page order, which tells the order wherever the rows are stored."""
    return row_numbers(latest, ["load_date"], _best(), "page_position")


def top_pick(latest: DataFrame) -> DataFrame:
    return top(latest, _best())


def movers(latest: DataFrame, min_owned: float = 5.0, k: int = 5) -> DataFrame:
    """Most owned entries whose verdict went up or down, k per direction."""
    moved = latest.filter(
        F.col("recommendation_trend").isin("upgraded", "downgraded")
        & (F.col("selected_by_percent") >= min_owned)
    )
    return top_per_group(moved, ["recommendation_trend"], [down("selected_by_percent"), up("player_id")], k)


def budget_picks(latest: DataFrame, cap: float = 6.0, k: int = 3) -> DataFrame:
    return top_per_group(latest.filter(F.col("price_m") <= cap), ["position_short_name"], _best(), k)


def differentials(latest: DataFrame, max_owned: float = 5.0, k: int = 5) -> DataFrame:
    return top(latest.filter(F.col("selected_by_percent") <= max_owned), _best(), k)


def clean_sheet_picks(latest: DataFrame, outlook: DataFrame, k: int = 4) -> DataFrame:
    """Best keeper and best defender of each of the k teams with the best defensive outlook."""
    leaders = top(latest_snapshot(outlook), [down("defensive_outlook_score"), up("team_id")], k).select(
        "team_id", "defensive_outlook_score"
    )
    back_line = latest.filter(F.col("position_short_name").isin(KEEPER, DEFENDER)).join(leaders, "team_id")
    return top_per_group(back_line, ["team_id", "position_short_name"], _best())


def ease_published(outlook: DataFrame) -> DataFrame:
    """Whether any team of the newest snapshot has a fixture signal."""
    published = F.coalesce(F.bool_or(F.col("fixture_pctl").isNotNull()), F.lit(False))
    return latest_snapshot(outlook).agg(published.alias("published"))


def captain_picks(latest: DataFrame, difficulty: DataFrame, k: int = 5) -> DataFrame:
    """Best scores with their team's next fixture. Cut to k first, so the join sees k rows."""
    following = latest_snapshot(difficulty).filter(F.col("upcoming_fixture_number") == 1)
    chosen = top(latest, _best(), k)
    return chosen.join(following.select("team_id", "opponent_name", "is_home", "difficulty"), "team_id", "left")


def top_by_position(latest: DataFrame) -> DataFrame:
    return top_per_group(latest, ["position_short_name"], _best())


def search(
    latest: DataFrame, positions: Sequence[str] = (), verdicts: Sequence[str] = (), text: str = ""
) -> DataFrame:
    """Rows passing every filter that is set; the text is a pattern over player and team name."""
    if positions:
        latest = latest.filter(F.col("position_short_name").isin(*positions))
    if verdicts:
        latest = latest.filter(F.col("verdict").isin(*verdicts))
    if text:
        latest = latest.filter(contains_pattern(text, F.col("web_name"), F.col("team_name")))
    return latest


def signal_breakdown(latest: DataFrame, keep: Sequence[str] = ("player_id",)) -> DataFrame:
    """The signals of each entry as rows; a missing one shows as neutral."""
    long = latest.unpivot(list(keep), list(SIGNAL_LABELS), "_signal", "_pctl")
    return long.select(
        *keep,
        labels.lookup(F.col("_signal"), SIGNAL_LABELS).alias("signal"),
        F.coalesce("_pctl", F.lit(labels.NEUTRAL)).alias("pctl"),
    )


# Teams and seasons


def goal_gap(season_players: DataFrame, min_minutes: int = MIN_MINUTES) -> DataFrame:
    """Largest gap between goals and expected goals in the newest season."""
    newest = season_players.filter(
        (F.col("season") == latest_value(season_players, "season")) & (F.col("minutes") >= min_minutes)
    )
    gap = F.col("goals") - F.col("xg")
    ranked = newest.withColumns({"delta": gap, "_gap": F.abs(gap)})
    return top(ranked, [down("_gap"), up("player_ud_id")]).select(
        "player_name", "team_name", "goals", "xg", "delta", "season"
    )


def best_defence(outlook: DataFrame, teams: DataFrame) -> DataFrame:
    best = top(latest_snapshot(outlook), [down("defensive_outlook_score"), up("team_id")])
    codes = teams.select(*team_key(teams), "team_code")
    return best.join(codes, team_key(teams), "left").select(
        "team_name", "defensive_outlook_score", "played", "team_code"
    )


def latest_table(table: DataFrame) -> DataFrame:
    """Newest standings in table order, with zones and the season's display label."""
    shown = latest_snapshot(table).withColumns(
        {"zone": labels.zone(F.col("position")), "season_label": season_label(F.col("season"))}
    )
    return shown.orderBy("position")


def league_leader(table: DataFrame, games: int = SEASON_GAMES) -> DataFrame:
    """First of the newest standings, and whether every team has played the whole season."""
    latest = latest_snapshot(table)
    complete = latest.agg((F.min("played") >= games).alias("complete")).scalar()
    return latest.filter(F.col("position") == 1).select(
        "team_name", "points", "played", "team_code", "season", complete.alias("season_complete")
    )


def best_attack_defence(table: DataFrame) -> DataFrame:
    """Most goals scored and fewest conceded in the newest standings; ties go to the better placed."""
    latest = latest_snapshot(table)
    row = F.struct("team_name", "goals_for", "goals_against")
    first = latest.agg(
        F.max_by(row, F.struct("goals_for", -F.col("position"))).alias("attack"),
        F.min_by(row, F.struct("goals_against", "position")).alias("defence"),
    )

    def card(name: str, side: str, goals: str) -> Column:
        return F.struct(
            F.lit(name).alias("card"), F.col(f"{side}.team_name").alias("team_name"), F.col(f"{side}.{goals}").alias("goals")
        )

    cards = F.array(
        card("best_attack", "attack", "goals_for"), card("best_defence", "defence", "goals_against")
    )
    return first.select(F.inline(cards))


def season_stats(
    players: DataFrame, teams: DataFrame, positions: DataFrame, dates: DataFrame | None = None
) -> DataFrame:
    """Newest player statistics with team and position names; `dates` may name a smaller table of load dates."""
    return (
        latest_snapshot(players, source=dates)
        .join(teams.select(*team_key(teams), "team_name", "team_code"), team_key(teams), "left")
        .join(positions.select("position_id", "position_short_name"), "position_id", "left")
        .select(
            "load_date",
            "player_id",
            "web_name",
            "player_code",
            "team_name",
            "team_code",
            "position_short_name",
            "season",
            "goals_scored",
            "assists",
            "expected_goals",
            "expected_assists",
            "minutes",
            "total_points",
            "clean_sheets",
        )
    )


def leaders(stats: DataFrame, column: str, k: int = 10) -> DataFrame:
    return top(stats, [down(column), up("player_id")], k)


def shooters(
    stats: DataFrame, min_minutes: int = MIN_MINUTES, positions: Sequence[str] = ()
) -> DataFrame:
    """Goals minus expected goals of everyone with chances and enough minutes."""
    kept = stats.filter((F.col("minutes") >= min_minutes) & (F.col("expected_goals") > 0))
    if positions:
        kept = kept.filter(F.col("position_short_name").isin(*positions))
    return kept.withColumn("xg_delta", round_half_away(F.col("goals_scored") - F.col("expected_goals"), 2))


def largest_absolute(df: DataFrame, column: str, tie: str, k: int = 5) -> DataFrame:
    """The k rows furthest from zero."""
    return top(df.withColumn("_size", F.abs(column)), [down("_size"), up(tie)], k).drop("_size")


def shooter_names(stats: DataFrame) -> DataFrame:
    return stats.filter("expected_goals > 0").select("web_name").distinct().orderBy("web_name")


def seasons(team_matches: DataFrame) -> DataFrame:
    return team_matches.select("season").distinct().orderBy(F.col("season").desc())


def team_xg_table(team_matches: DataFrame, season: int | None = None) -> DataFrame:
    """Expected against actual totals per team, for one season or for each."""
    if season is not None:
        team_matches = team_matches.filter(F.col("season") == season)

    def total(column: str) -> Column:
        return round_half_away(F.sum(column), 1).alias(column)

    return team_matches.groupBy("season", "team_name").agg(
        F.count("*").alias("played"),
        F.sum("points").cast("int").alias("points"),
        total("expected_points"),
        round_half_away(F.sum("points") - F.sum("expected_points"), 1).alias("points_minus_xpts"),
        total("xg"),
        total("xga"),
        F.sum("goals_conceded").cast("int").alias("goals_conceded"),
        total("npxgd"),
        round_half_away(F.avg("ppda"), 1).alias("ppda"),
    )


def season_xg_table(spark: SparkSession, view: str, season: int) -> DataFrame:
    """`team_xg_table` of one season of a published view; the name and the season are bound, not written into the text."""
    chosen = spark.sql("select * from identifier(:view) where season = :season", {"view": view, "season": season})
    return team_xg_table(chosen)


def xg_table_by_points(team_matches: DataFrame, season: int | None = None) -> DataFrame:
    """`team_xg_table` in page order."""
    return team_xg_table(team_matches, season).orderBy(*sorts([down("points"), down("npxgd"), up("team_name")]))


def points_range(xg_table: DataFrame, margin: float = 4.0) -> DataFrame:
    """Smallest and largest of actual and expected points, widened by a margin."""
    return xg_table.agg(
        (F.least(F.min("points"), F.min("expected_points")) - margin).alias("axis_min"),
        (F.greatest(F.max("points"), F.max("expected_points")) + margin).alias("axis_max"),
    )


def finishing_extremes(season_players: DataFrame, min_minutes: int = MIN_MINUTES, k: int = 8) -> DataFrame:
    """k best and k worst finishers. Below 2k rows an entry appears on both sides, so twice."""
    finishers = season_players.filter(F.col("minutes") >= min_minutes).withColumn(
        "finishing_delta", round_half_away(F.col("goals") - F.col("xg"), 1)
    )
    best = top(finishers, [down("finishing_delta"), up("player_ud_id")], k)
    worst = top(finishers, [up("finishing_delta"), up("player_ud_id")], k)
    return best.unionByName(worst).orderBy(F.col("finishing_delta").desc(), "player_ud_id")


def defence_delta(xg_table: DataFrame) -> DataFrame:
    """Expected minus actual goals conceded, best first."""
    delta = round_half_away(F.col("xga") - F.col("goals_conceded"), 1)
    return xg_table.withColumn("defensive_delta", delta).orderBy(F.col("defensive_delta").desc(), "season", "team_name")


# Squads: for all managers at once


def squads(picks: DataFrame, latest: DataFrame) -> DataFrame:
    """Every manager's picks with the newest signals, role and slot. Unknown entries keep NULLs."""
    signals = latest.withColumn("element", F.col("player_id")).hint("merge")
    return picks.join(signals, "element", "left").withColumns(
        {
            "role": labels.squad_role(F.col("is_captain"), F.col("is_vice_captain")),
            "squad_slot": labels.squad_slot(F.col("position")),
        }
    )


def unresolved(squad: DataFrame) -> DataFrame:
    return squad.groupBy("manager_id").agg(F.count_if(F.col("player_id").isNull()).alias("unresolved"))


def captain_suggestion(squad: DataFrame) -> DataFrame:
    """Best fit starter of each manager against the captain they chose."""
    starters = squad.filter((F.col("squad_slot") == "starting") & F.col("player_id").isNotNull())
    fit, named = ~F.col("availability_risk").eqNullSafe("high_risk"), F.col("is_captain")
    entry = F.struct("player_id", "web_name", "transfer_score")
    best_first = F.struct(
        F.col("transfer_score").isNull().alias("u"), (-F.col("transfer_score")).alias("s"), F.col("player_id").alias("p")
    )
    advice = starters.groupBy("manager_id").agg(
        F.min_by(F.when(fit, entry), F.when(fit, best_first)).alias("best"),
        F.min_by(F.when(named, entry), F.when(named, F.struct("position", "player_id"))).alias("captain"),
    )
    outcome = (
        F.when(F.col("best").isNull(), "no_fit_starter")
        .when(F.col("captain").isNull(), "no_captain")
        .when(F.col("captain.player_id") == F.col("best.player_id"), "keep")
        .otherwise("change")
    )
    return advice.select(
        "manager_id",
        F.col("best.player_id").alias("best_player_id"),
        F.col("best.web_name").alias("best_web_name"),
        F.col("best.transfer_score").alias("best_score"),
        F.col("captain.player_id").alias("captain_player_id"),
        F.col("captain.web_name").alias("captain_web_name"),
        F.col("captain.transfer_score").alias("captain_score"),
        outcome.alias("outcome"),
    )


def weak_links(squad: DataFrame, banks: DataFrame, latest: DataFrame) -> DataFrame:
    """Squad entries to sell or watch, each with the best same-position entry the manager can pay.

    Several weak links of one manager may share a replacement. `banks` holds `manager_id` and
    `bank` in tenths; prices are compared in tenths.
    """

    def tenths(column: str) -> Column:
        return F.round(F.col(column) * 10).cast("bigint")

    weak = squad.filter(F.col("recommendation").isin("drop", "monitor") & F.col("player_id").isNotNull()).join(
        banks.select("manager_id", "bank").hint("merge"), "manager_id"
    )
    wanted = weak.select(
        "manager_id",
        "player_id",
        "web_name",
        "position_short_name",
        "recommendation",
        (tenths("price_m") + F.col("bank")).alias("budget"),
    )
    pool = latest.filter(~F.col("availability_risk").eqNullSafe("high_risk")).select(
        "position_short_name", F.col("player_id").alias("item"), tenths("price_m").alias("price"),
        F.col("transfer_score").alias("score"),
    )
    owned = squad.select("manager_id", F.col("element").alias("item"))
    return best_affordable(wanted, pool, owned, "position_short_name", "manager_id")


# Live payloads


def current_period(bootstrap: DataFrame) -> DataFrame:
    """Current period of each snapshot, the last finished one between seasons, and the gap flag."""
    spec = [*fields("bigint", "id"), *fields("boolean", "is_current", "is_next", "finished")]
    spec += fields("int", "average_entry_score", "highest_score")
    listed = bootstrap.select("season", "load_date", F.explode("events").alias("e")).select(
        "season", "load_date", *typed(F.col("e"), spec)
    )
    event = F.struct("id", "finished", "average_entry_score", "highest_score")
    periods = listed.groupBy("season", "load_date").agg(
        F.min_by(F.when(F.col("is_current"), event), F.when(F.col("is_current"), F.col("id"))).alias("marked"),
        F.max_by(F.when(F.col("finished"), event), F.when(F.col("finished"), F.col("id"))).alias("past"),
        F.coalesce(F.bool_or("is_next"), F.lit(False)).alias("has_next"),
    )
    now = periods.withColumn("now", F.coalesce("marked", "past"))
    return now.select(
        "season",
        "load_date",
        F.col("now.id").alias("period"),
        F.col("now.finished").alias("finished"),
        (F.col("now.finished") & ~F.col("has_next")).alias("is_offseason"),
        F.col("now.average_entry_score").alias("average_entry_score"),
        F.col("now.highest_score").alias("highest_score"),
    )


# Keys of the live statistics block.
LIVE_STATS = ("minutes", "goals_scored", "assists", "clean_sheets", "bonus", "total_points")


def live_stats(payloads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per player of a live payload, its statistics as columns."""
    exploded = payloads.select(*keep, F.explode("elements").alias("e"))
    element = F.col("e")
    stats = [pick(element, f"stats.{name}", "int").alias(name) for name in LIVE_STATS]
    return exploded.select(*keep, pick(element, "id", "bigint").alias("player_id"), *stats)


def live_top(live: DataFrame, meta: DataFrame, k: int = 15, group: Sequence[str] = ()) -> DataFrame:
    """Top scorers among those who have played, per group when one is given."""
    order = [down("total_points"), up("player_id")]
    played = live.filter("minutes > 0")
    best = top_per_group(played, group, order, k) if group else top(played, order, k)
    return best.join(meta, "player_id", "left")


def private_leagues(entries: DataFrame) -> DataFrame:
    """Leagues that managers created themselves, per entry."""
    exploded = entries.select("entry", F.explode("leagues").alias("l"))
    spec = [*fields("bigint", ("id", "league_id")), *fields("string", ("name", "league_name"), "league_type")]
    listed = exploded.select("entry", *typed(F.col("l"), spec))
    return listed.filter(F.col("league_type") == PRIVATE_LEAGUE).drop("league_type")


def league_views(standings: DataFrame, viewers: DataFrame) -> DataFrame:
    """Each league's standings with the row of its viewer flagged; one viewer per league."""
    flagged = standings.join(viewers, "league_id").withColumn("you", F.col("entry") == F.col("viewer"))
    return flagged.drop("viewer")


def own_standings(leagues: DataFrame, standings: DataFrame) -> DataFrame:
    """Every member's own row in each of their private leagues."""
    return leagues.join(standings, ["league_id", "entry"])
