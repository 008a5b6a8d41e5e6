"""Data tests of the models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.operators import quality
from snapledger.plans.registry import Context

# Which columns of which model are tested, and the accepted labels.
NOT_NULL = {
    "players": ["player_id", "load_date", "player_code"],
    "teams": ["team_id", "load_date", "team_code"],
    "fixtures": ["fixture_id", "load_date"],
    "positions": ["position_id"],
    "matches": ["match_id", "home_goals", "away_goals"],
    "match_events": ["match_id", "event_type"],
    "match_players": ["player_ws_id", "player_name"],
    "season_players": ["player_ud_id", "player_name", "season"],
    "season_matches": ["match_ud_id", "season"],
    "season_team_matches": ["team_ud_id", "team_name", "match_date"],
    "player_map": ["player_ws_id", "player_id", "match_rule"],
    "season_player_map": ["player_ud_id", "player_id", "player_code", "match_rule"],
    "league_table": ["team_id", "load_date", "points", "position"],
    "transfer_decision": ["player_id", "load_date", "transfer_score", "recommendation", "recommendation_trend"],
    "defensive_outlook": ["team_id", "load_date", "defensive_outlook_score"],
}
UNIQUE = {
    "positions": ["position_id"],
    "matches": ["match_id"],
    "match_players": ["player_ws_id"],
    "player_map": ["player_ws_id", "player_id"],
    "season_player_map": ["player_ud_id", "player_id", "player_code"],
}
BUCKETS = ["transfer_in", "hold", "monitor", "drop"]
RULES = ["full_name", "short_name", "first_tokens", "web_name"]
ACCEPTED = {
    ("player_map", "match_rule"): RULES,
    ("season_player_map", "match_rule"): [*RULES, "manual"],
    ("transfer_decision", "recommendation"): BUCKETS,
    ("transfer_decision", "prev_recommendation"): BUCKETS,
    ("transfer_decision", "recommendation_trend"): ["upgraded", "downgraded", "unchanged", "no_prior_snapshot"],
}
GRAINS = {
    "players": ["load_date", "player_id"],
    "season_players": ["season", "player_ud_id"],
    "season_matches": ["season", "match_ud_id"],
    "transfer_decision": ["load_date", "player_id"],
    "defensive_outlook": ["load_date", "team_id"],
}
SEED_KEYS = ("player_ud_id", "player_code")


def table_checks(name: str) -> quality.TableChecks:
    """All checks of one model that need no other."""
    rows = {f"not_null_{name}_{column}": F.col(column).isNull() for column in NOT_NULL.get(name, ())}
    for (table, column), values in ACCEPTED.items():
        if table == name:
            rows[f"accepted_values_{name}_{column}"] = ~F.col(column).isin(*values)
    keys = {f"unique_{name}_{column}": [column] for column in UNIQUE.get(name, ())}
    if name in GRAINS:
        keys[f"grain_{name}"] = GRAINS[name]
    balances = {"goals_balance": (["load_date"], "goals_for", "goals_against")} if name == "league_table" else {}
    return quality.TableChecks(rows, keys, balances)


def checked_tables() -> list[str]:
    return sorted({*NOT_NULL, *UNIQUE, *GRAINS, *(name for name, _ in ACCEPTED)})


def overrides_checks() -> quality.TableChecks:
    return quality.TableChecks(
        {f"not_null_overrides_{column}": F.col(column).isNull() for column in SEED_KEYS},
        {f"unique_overrides_{column}": [column] for column in SEED_KEYS},
        {},
    )


def all_checks(ctx: Context) -> DataFrame:
    """Every test as its name and the number of violations: one scan of each table, and one for each comparison of two."""
    found = [quality.run_checks(ctx.ref(name), table_checks(name)) for name in checked_tables()]
    found.append(quality.run_checks(ctx.seed("player_map_overrides"), overrides_checks()))
    found += [quality.violations(name, broken) for name, broken in comparisons(ctx)]
    return reduce(DataFrame.unionByName, found)


def checks(ctx: Context) -> Iterator[tuple[str, DataFrame]]:
    """Every test as its name and the rows that break it."""
    for name, columns in NOT_NULL.items():
        for column in columns:
            yield f"not_null_{name}_{column}", quality.not_null(ctx.ref(name), column)
    for name, columns in UNIQUE.items():
        for column in columns:
            yield f"unique_{name}_{column}", quality.unique(ctx.ref(name), column)
    for (name, column), values in ACCEPTED.items():
        yield f"accepted_values_{name}_{column}", quality.accepted_values(ctx.ref(name), column, values)
    for name, keys in GRAINS.items():
        yield f"grain_{name}", quality.grain(ctx.ref(name), keys)
    overrides = ctx.seed("player_map_overrides")
    for column in SEED_KEYS:
        yield f"not_null_overrides_{column}", quality.not_null(overrides, column)
        yield f"unique_overrides_{column}", quality.unique(overrides, column)
    table = ctx.ref("league_table")
    yield "goals_balance", quality.balance(table, ["load_date"], "goals_for", "goals_against")
    yield from comparisons(ctx)


def comparisons(ctx: Context) -> Iterator[tuple[str, DataFrame]]:
    """The tests that look at two tables."""
    matches, events = ctx.ref("matches"), ctx.ref("match_events")
    yield "events_belong_to_matches", quality.relationships(events, "match_id", matches, "match_id")
    goals = F.sum(F.col("home_goals") + F.col("away_goals"))
    yield "goal_events_match_scores", quality.totals_agree(
        events.filter("event_type = 'Goal'"), F.count("*"), matches, goals
    )
    finished = ctx.ref("season_matches").filter("is_result")
    yield "match_and_team_goals_agree", quality.groups_agree(
        finished, goals, ctx.ref("season_team_matches"), F.sum("goals_scored"), ["season"]
    )
    yield "sources_agree_on_goals", quality.groups_agree(
        matches.withColumnRenamed("season_start_year", "season"), goals, finished, goals, ["season"]
    )
