"""Typed models over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.functions.fields import Field, fields, pick, typed
from snapledger.functions.numbers import ratio
from snapledger.functions.text import blank_to_null, decode_apostrophe, id_from_file, score_side, season_start_year
from snapledger.operators.matching import entity_names
from snapledger.operators.snapshots import flat_snapshot, latest_dimension, unnest_snapshot
from snapledger.plans.registry import Context, model

SNAPSHOT = ("load_date", "season")

# Source keys, column names and types of the typed models.
PLAYER_FIELDS = [
    Field("player_id", "id", "int"),
    *fields("string", "first_name", "second_name", "web_name"),
    *fields("int", ("code", "player_code"), ("team", "team_id"), ("element_type", "position_id")),
    *fields("int", "now_cost", "cost_change_event", "cost_change_start"),
    *fields("double", "selected_by_percent"),
    *fields("int", "transfers_in_event", "transfers_out_event"),
    *fields("bigint", ("transfers_in", "transfers_in_total"), ("transfers_out", "transfers_out_total")),
    *fields("double", "form", "points_per_game"),
    *fields("int", "total_points", "event_points"),
    *fields("double", ("ep_next", "expected_points_next"), ("ep_this", "expected_points_this")),
    *fields("double", "value_form", "value_season"),
    *fields("int", "minutes", "starts", "goals_scored", "assists", "clean_sheets", "goals_conceded"),
    *fields("int", "saves", "bonus", "bps"),
    *fields("double", "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists"),
    *fields("double", "expected_goal_involvements", "expected_goals_conceded"),
    *fields("int", "yellow_cards", "red_cards"),
    *fields("string", "status"),
    *fields("int", "chance_of_playing_next_round", "chance_of_playing_this_round"),
    *fields("string", "news"),
    *fields("timestamp_ntz", "news_added"),
    *fields("boolean", "can_transact", "can_select", "removed"),
]
TEAM_FIELDS = [
    Field("team_id", "id", "int"),
    *fields("string", ("name", "team_name"), ("short_name", "team_short_name")),
    *fields("int", ("code", "team_code"), "strength", "strength_overall_home", "strength_overall_away"),
    *fields("int", "strength_attack_home", "strength_attack_away"),
    *fields("int", "strength_defence_home", "strength_defence_away"),
    *fields("int", "played", "win", "draw", "loss", "points", ("position", "league_position")),
    *fields("double", "form"),
    *fields("boolean", "unavailable"),
]
POSITION_FIELDS = [
    Field("position_id", "id", "int"),
    *fields("string", ("singular_name", "position_name"), ("singular_name_short", "position_short_name")),
    *fields("int", "squad_min_play", "squad_max_play", "element_count"),
]
FIXTURE_FIELDS = [
    *fields("int", ("id", "fixture_id")),
    *fields("bigint", ("code", "fixture_code")),
    *fields("int", ("event", "gameweek"), ("team_h", "home_team_id"), ("team_a", "away_team_id")),
    *fields("int", ("team_h_score", "home_score"), ("team_a_score", "away_score")),
    *fields("int", ("team_h_difficulty", "home_difficulty"), ("team_a_difficulty", "away_difficulty")),
    *fields("timestamp_ntz", "kickoff_time"),
    *fields("boolean", "started", "finished"),
    *fields("int", ("minutes", "minutes_played")),
]
EVENT_FIELDS = [
    *fields("bigint", ("id", "event_ws_id")),
    *fields("int", "minute", "second"),
    *fields("bigint", ("teamId", "team_ws_id"), ("playerId", "player_ws_id")),
    Field("event_type", "type.displayName"),
]
SEASON_PLAYER_FIELDS = [
    *fields("int", ("id", "player_ud_id")),
    *fields("string", "player_name", ("team_title", "team_name"), "position"),
    *fields("int", "games", ("time", "minutes"), "goals", ("npg", "non_penalty_goals"), "assists", "shots"),
    *fields("int", "key_passes"),
    *fields("double", ("xG", "xg"), ("npxG", "npxg"), ("xA", "xa"), ("xGChain", "xg_chain")),
    *fields("double", ("xGBuildup", "xg_buildup")),
    *fields("int", "yellow_cards", "red_cards"),
]
SEASON_MATCH_FIELDS = [
    *fields("int", ("id", "match_ud_id")),
    *fields("string", ("datetime", "match_datetime")),
    *fields("boolean", ("isResult", "is_result")),
    *fields("int", ("h.id", "home_team_ud_id")),
    *fields("string", ("h.title", "home_team_name")),
    *fields("int", ("a.id", "away_team_ud_id")),
    *fields("string", ("a.title", "away_team_name")),
    *fields("int", ("goals.h", "home_goals"), ("goals.a", "away_goals")),
    *fields("double", ("xG.h", "home_xg"), ("xG.a", "away_xg")),
]
TEAM_MATCH_FIELDS = [
    *fields("string", "h_a"),
    *fields("int", ("scored", "goals_scored"), ("missed", "goals_conceded")),
    *fields("string", "result"),
    *fields("int", ("pts", "points")),
    *fields("double", ("xG", "xg"), ("xGA", "xga"), ("npxG", "npxg"), ("npxGA", "npxga"), ("npxGD", "npxgd")),
    *fields("double", ("xpts", "expected_points")),
]


@model("silver", "view", stored=True)
def players(ctx: Context) -> DataFrame:
    """One row per player and snapshot."""
    typed_rows = unnest_snapshot(ctx.source("bootstrap"), "elements", PLAYER_FIELDS, SNAPSHOT)
    return typed_rows.withColumn("news", blank_to_null(F.col("news")))


@model("silver", "view", stored=True)
def teams(ctx: Context) -> DataFrame:
    """One row per team and snapshot."""
    return unnest_snapshot(ctx.source("bootstrap"), "teams", TEAM_FIELDS, SNAPSHOT)


@model("silver", "view")
def positions(ctx: Context) -> DataFrame:
    """One row per position, from the newest snapshot that lists it."""
    newest = latest_dimension(ctx.source("bootstrap"), "element_types", POSITION_FIELDS, ["position_id"])
    return newest.drop("load_date")


@model("silver", "view", stored=True)
def fixtures(ctx: Context) -> DataFrame:
    """One row per fixture and snapshot."""
    raw = ctx.source("fixtures")
    return raw.select(*SNAPSHOT, *[pick(F.col(f.path), "$", f.type).alias(f.name) for f in FIXTURE_FIELDS])


def match_headers(payloads: DataFrame) -> DataFrame:
    """Match facts of payloads: id from the file name, split score, season from the date."""
    date = F.to_date("startDate")
    return payloads.select(
        id_from_file(F.col("filename")).try_cast("bigint").alias("match_id"),
        date.alias("match_date"),
        season_start_year(date).alias("season_start_year"),
        pick(F.col("home.teamId"), "$", "bigint").alias("home_team_ws_id"),
        F.col("home.name").alias("home_team_name"),
        pick(F.col("away.teamId"), "$", "bigint").alias("away_team_ws_id"),
        F.col("away.name").alias("away_team_name"),
        score_side(F.col("ftScore"), 1).alias("home_goals"),
        score_side(F.col("ftScore"), 2).alias("away_goals"),
        "attendance",
        F.col("venueName").alias("venue_name"),
        "load_date",
    )


def exported_events(payloads: DataFrame) -> DataFrame:
    """Event elements of payloads; the qualifiers stay VARIANT."""
    exploded = payloads.select(
        id_from_file(F.col("filename")).try_cast("bigint").alias("match_id"),
        "load_date",
        F.explode("events").alias("e"),
    )
    event = F.col("e")
    return exploded.select(
        "match_id",
        *typed(event, EVENT_FIELDS),
        (pick(event, "outcomeType.displayName") == "Successful").alias("is_successful"),
        *typed(event, [*fields("boolean", ("isTouch", "is_touch")), *fields("double", "x", "y")]),
        pick(event, "qualifiers", "variant").alias("qualifiers"),
        "load_date",
    )


@model("silver", "view")
def matches(ctx: Context) -> DataFrame:
    """One row per match payload."""
    return match_headers(ctx.source("match_payloads"))


@model("silver", "view")
def match_events(ctx: Context) -> DataFrame:
    """One row per exported event element; ids may repeat."""
    return exported_events(ctx.source("match_payloads"))


@model("silver", "view")
def match_players(ctx: Context) -> DataFrame:
    """One row per player id of the match payloads: usual spelling and squad appearances."""
    payloads = ctx.source("match_payloads").withColumn("match_id", id_from_file(F.col("filename")))
    named = entity_names(payloads, "playerIdNameDictionary", "match_id")
    return named.select(
        F.col("entity_id").alias("player_ws_id"),
        F.col("entity_name").alias("player_name"),
        F.col("appearances").alias("n_squad_appearances"),
    )


@model("silver", "view")
def season_players(ctx: Context) -> DataFrame:
    """One row per season and player, newest load of the season only."""
    newest = ctx.newest("season_players", ["season"])
    return flat_snapshot(newest, SEASON_PLAYER_FIELDS, SNAPSHOT).withColumn(
        "player_name", decode_apostrophe(F.col("player_name"))
    )


@model("silver", "view")
def season_matches(ctx: Context) -> DataFrame:
    """One row per season and match, newest load only; goals and xG are NULL until played."""
    newest = ctx.newest("season_matches", ["season"])
    return flat_snapshot(newest, SEASON_MATCH_FIELDS, SNAPSHOT)


@model("silver", "view")
def season_team_matches(ctx: Context) -> DataFrame:
    """One row per season, team and match date, newest load only."""
    newest = ctx.newest("season_teams", ["season"])
    exploded = newest.select(
        *SNAPSHOT,
        F.col("id").try_cast("int").alias("team_ud_id"),
        F.col("title").alias("team_name"),
        F.explode("history").alias("h"),
    )
    match = F.col("h")

    def pressing(block: str):
        return ratio(pick(match, f"{block}.att", "double"), pick(match, f"{block}.def", "double")).alias(block)

    return exploded.select(
        "season",
        "team_ud_id",
        "team_name",
        F.to_date(pick(match, "date", "timestamp_ntz")).alias("match_date"),
        *typed(match, TEAM_MATCH_FIELDS),
        pressing("ppda"),
        pressing("ppda_allowed"),
        *typed(match, fields("int", ("deep", "deep_completions"), ("deep_allowed", "deep_completions_allowed"))),
        "load_date",
    )
