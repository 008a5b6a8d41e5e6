"""Entity maps and decision tables over the typed models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import name_key, name_keys
from snapledger.operators import fixtures as fixture_ops
from snapledger.operators import scoring, snapshots
from snapledger.operators.matching import Rung, apply_overrides, common_value, match_ladder
from snapledger.plans.registry import Context, model

# The order of the name rules and the labels their pairs carry.
NAME_RUNGS = [
    Rung("full_name", "name_key", "full_name", takes_ambiguous=True),
    Rung("short_name", "name_key", "short_name"),
    Rung("first_tokens", "name_key", "first_tokens"),
    Rung("web_name", "name_key", "web_name"),
]


def _current_players(ctx: Context) -> DataFrame:
    """Kept players of the newest snapshot with all their name keys."""
    current = snapshots.latest_snapshot(ctx.ref("players")).filter(~F.col("removed"))
    keys = name_keys(F.col("first_name"), F.col("second_name"), F.col("web_name"))
    return current.select("player_id", "player_code", *[key.alias(name) for name, key in keys.items()])


@model("silver", "table", needs=["players", "match_players"])
def player_map(ctx: Context) -> DataFrame:
    """Players of the match payloads matched to the current snapshot by name."""
    listed = ctx.ref("match_players").select("player_ws_id", name_key(F.col("player_name")).alias("name_key"))
    return match_ladder(listed, _current_players(ctx), "player_ws_id", "player_id", NAME_RUNGS)


@model("silver", "table", needs=["players", "season_players"])
def season_player_map(ctx: Context) -> DataFrame:
    """Players of the season statistics matched by name, hand-verified pairs first."""
    usual = common_value(ctx.ref("season_players"), ["player_ud_id"], "player_name", "player_name")
    listed = usual.select("player_ud_id", name_key(F.col("player_name")).alias("name_key"))
    current = _current_players(ctx)
    ladder = match_ladder(listed, current, "player_ud_id", "player_id", NAME_RUNGS)
    overrides = ctx.seed("player_map_overrides").select("player_ud_id", "player_code")
    return apply_overrides(ladder, overrides, current, "player_ud_id", "player_id", "player_code")


@model("gold", "table", needs=["players"])
def price_momentum(ctx: Context) -> DataFrame:
    return snapshots.price_momentum(ctx.ref("players"))


@model("gold", "table", needs=["players"])
def form_trend(ctx: Context) -> DataFrame:
    return snapshots.form_trend(ctx.ref("players"))


@model("gold", "table", needs=["players"])
def availability_risk(ctx: Context) -> DataFrame:
    return snapshots.availability_risk(ctx.ref("players"))


@model("gold", "table", needs=["players"])
def player_value(ctx: Context) -> DataFrame:
    return snapshots.value_rank(ctx.ref("players"))


@model("gold", "table", needs=["fixtures", "teams"])
def fixture_difficulty(ctx: Context) -> DataFrame:
    return fixture_ops.fixture_difficulty(ctx.ref("fixtures"), ctx.ref("teams"))


@model("gold", "table", needs=["fixtures", "teams"])
def league_table(ctx: Context) -> DataFrame:
    return fixture_ops.league_table(ctx.ref("fixtures"), ctx.ref("teams"))


@model("gold", "table", needs=["players", "positions", "teams", "season_player_map", "season_players", "fixture_difficulty"])
def transfer_decision(ctx: Context) -> DataFrame:
    return scoring.transfer_decision(
        ctx.ref("players"),
        ctx.ref("positions"),
        ctx.ref("teams"),
        ctx.ref("season_player_map"),
        ctx.ref("season_players"),
        scoring.fixture_ease(ctx.ref("fixture_difficulty")),
    )


@model("gold", "table", needs=["players", "league_table", "fixture_difficulty"])
def defensive_outlook(ctx: Context) -> DataFrame:
    ease = scoring.fixture_ease(ctx.ref("fixture_difficulty"))
    return scoring.defensive_outlook(ctx.ref("players"), ctx.ref("league_table"), ease)
