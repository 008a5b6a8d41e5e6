"""Percentile signals, weighted scores and the decision tables built from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions import labels
from snapledger.functions.numbers import per_90, price_in_millions, ratio, round_half_away
from snapledger.operators.fixtures import team_key
from snapledger.operators.ordering import Key, down, ranks, up
from snapledger.operators.snapshots import points_per_million, price_trend, snapshot_delta

MIN_RATED_MINUTES = 450


def percentile_signal(
    df: DataFrame,
    partition: Sequence[str],
    signals: dict[str, Key],
    eligible: Column | None = None,
) -> DataFrame:
    """Percent rank per partition; rows that are not eligible stay out of the population with NULL."""
    return ranks(df, partition, signals, eligible=None if eligible is None else dict.fromkeys(signals, eligible))


def weighted_score(weights: dict[str, float], neutral: float = labels.NEUTRAL) -> Column:
    """0-100 blend of percentiles with one decimal; a missing signal counts as neutral."""
    parts = [F.lit(w) * F.coalesce(F.col(signal), F.lit(neutral)) for signal, w in weights.items()]
    return round_half_away(F.lit(100.0) * reduce(add, parts), 1)


def ordinal_trend(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Key],
    bucket: str,
    previous: dict[str, str],
    ranking: dict[str, int] | None = None,
    out: str = "trend",
    bounded: bool = True,
) -> DataFrame:
    """Previous bucket (and other `previous` columns) and whether the bucket moved up or down."""
    ranked = df.withColumn("_rank", labels.ordinal(F.col(bucket), ranking))
    columns = {**previous, "_rank": "_prev_rank"}
    with_prev = snapshot_delta(ranked, key, order, columns, bounded)
    moved = labels.direction(F.col("_rank"), F.col("_prev_rank"), labels.BUCKET_TRENDS)
    return with_prev.withColumn(out, moved).drop("_rank", "_prev_rank")


def with_season_stats(
    players: DataFrame, positions: DataFrame, mapping: DataFrame, season_stats: DataFrame
) -> DataFrame:
    """Players with their position name and the other source's `npxg`, `xa` and `rated_minutes`.

    The stable code bridges the sources, as ids restart every season, and the season of the
    snapshot picks the season's stats. Codes, ids and seasons are unique on the joined sides, so
    no row is lost or repeated.
    """
    stats = season_stats.select(
        "player_ud_id", F.col("season").alias("_season"), "npxg", "xa", F.col("minutes").alias("rated_minutes")
    )
    return (
        players.withColumn("_season", F.col("season").try_cast("int"))
        .join(positions.select("position_id", "position_short_name"), "position_id", "left")
        .join(mapping.select("player_code", "player_ud_id"), "player_code", "left")
        .join(stats, ["player_ud_id", "_season"], "left")
        .drop("_season", "player_ud_id")
    )


def threat(keeper: str = "GKP", min_minutes: int = MIN_RATED_MINUTES) -> tuple[Column, Column]:
    """Whether a player is rated (outfield players who played enough), and their expected involvement per 90."""
    rated = (F.col("position_short_name") != keeper) & (F.col("rated_minutes") >= min_minutes)
    return rated, F.when(rated, per_90(F.col("npxg") + F.col("xa"), F.col("rated_minutes")))


def with_threat(df: DataFrame, keeper: str = "GKP", min_minutes: int = MIN_RATED_MINUTES) -> DataFrame:
    """Expected involvement per 90 and its percentile by position, of outfield players who played enough."""
    rated, rate = threat(keeper, min_minutes)
    ranked = percentile_signal(
        df.withColumn("_rate", rate), ["load_date", "position_id"], {"underlying_pctl": up("_rate")}, eligible=rated
    )
    return ranked.withColumn("npxg_xa_per90", round_half_away(F.col("_rate"), 2)).drop(
        "_rate", "npxg", "xa", "rated_minutes"
    )


def fixture_ease(difficulty: DataFrame) -> DataFrame:
    """Each team's run from its next fixture and the percentile of its ease (hardest = 0)."""
    upcoming = difficulty.filter(F.col("upcoming_fixture_number") == 1).select(
        "load_date", "team_id", "avg_difficulty_next_5"
    )
    return ranks(upcoming, ["load_date"], {"fixture_pctl": down("avg_difficulty_next_5")})


def transfer_decision(
    players: DataFrame,
    positions: DataFrame,
    teams: DataFrame,
    mapping: DataFrame,
    season_stats: DataFrame,
    ease: DataFrame,
    key: str = "player_id",
    min_minutes: int = MIN_RATED_MINUTES,
) -> DataFrame:
    """The decision table: signals, score, recommendation and its change per player and snapshot.

    All player signals come from one pass over the snapshots: change since the previous one by
    key, then all percentiles by (load_date, position) at once, then the trend by key. Removed players
    count for the underlying percentile and for the history, not for the other signals.
    """
    used = players.select(
        "load_date", "season", "player_id", "player_code", "web_name", "team_id", "position_id", "now_cost",
        "total_points", "form", "selected_by_percent", "transfers_in_event", "transfers_out_event", "status",
        "chance_of_playing_next_round", "news", "removed",
    )
    moved = snapshot_delta(used, [key], [up("load_date")], {"now_cost": "_prev_cost"}).withColumns(
        {
            "price_trend": price_trend(F.col("now_cost"), F.col("_prev_cost")),
            "net_transfers_event": F.col("transfers_in_event") - F.col("transfers_out_event"),
            "points_per_million": points_per_million(F.col("total_points"), F.col("now_cost")),
            "availability_risk": labels.availability_risk(
                F.col("status"), F.col("chance_of_playing_next_round")
            ),
        }
    )
    rated, rate = threat(min_minutes=min_minutes)
    bridged = with_season_stats(moved, positions, mapping, season_stats).withColumn("_rate", rate)
    signals = {
        "value_pctl": up("points_per_million"),
        "form_pctl": up("form"),
        "momentum_pctl": up("net_transfers_event"),
        "underlying_pctl": up("_rate"),
    }
    kept = ~F.col("removed")
    eligible = {**dict.fromkeys(signals, kept), "underlying_pctl": F.col("_rated")}
    # what follows needs; the other columns of the bridge would travel with every row
    bridged = bridged.select(
        "load_date", key, "web_name", "team_id", "position_id", "position_short_name", "now_cost", "total_points",
        "points_per_million", "form", "price_trend", "net_transfers_event", "selected_by_percent", "availability_risk",
        "news", "removed", "_rate", rated.alias("_rated"),
    )
    ranked = ranks(bridged, ["load_date", "position_id"], signals, eligible=eligible, by=key).filter(kept).drop("_rated")
    ranked = ranked.withColumn("npxg_xa_per90", round_half_away(F.col("_rate"), 2))
    scored = (
        ranked.join(ease, ["load_date", "team_id"], "left")
        .join(teams.select(*team_key(teams), "team_name"), team_key(teams), "left")
        .withColumn("transfer_score", weighted_score(labels.WEIGHTS))
        .withColumn("recommendation", labels.recommendation(F.col("transfer_score"), F.col("availability_risk")))
    )
    trended = ordinal_trend(
        scored,
        [key],
        [up("load_date")],
        "recommendation",
        {"transfer_score": "prev_transfer_score", "recommendation": "prev_recommendation"},
        out="recommendation_trend",
    )
    return trended.select(
        "load_date",
        "player_id",
        "web_name",
        "team_id",
        "team_name",
        "position_id",
        "position_short_name",
        price_in_millions(F.col("now_cost")).alias("price_m"),
        "total_points",
        "points_per_million",
        "form",
        "avg_difficulty_next_5",
        "price_trend",
        "net_transfers_event",
        "selected_by_percent",
        "availability_risk",
        "news",
        "npxg_xa_per90",
        *[round_half_away(F.col(signal), 2).alias(signal) for signal in labels.WEIGHTS],
        "transfer_score",
        "recommendation",
        "prev_transfer_score",
        round_half_away(F.col("transfer_score") - F.col("prev_transfer_score"), 1).alias(
            "score_change_since_prev_snapshot"
        ),
        "prev_recommendation",
        "recommendation_trend",
    )


def defensive_outlook(players: DataFrame, table: DataFrame, ease: DataFrame) -> DataFrame:
    """Clean-sheet record of each team blended with the ease of its next fixtures.

    A team's clean sheets are the most any kept player of it has; teams that have not played
    are not ranked and count as neutral.
    """
    key = ["load_date", "team_id"]
    sheets = (
        players.filter(~F.col("removed"))
        .groupBy(*key)
        .agg(F.max("clean_sheets").alias("team_clean_sheets"), F.lit(True).alias("_has_players"))
    )
    league = table.select(*key, "team_name", "played").join(sheets, key, "left")
    played = F.col("_has_players") & (F.col("played") > 0)
    rated = percentile_signal(
        league.withColumn("_rate", F.when(played, ratio(F.col("team_clean_sheets"), F.col("played")))),
        ["load_date"],
        {"clean_sheet_pctl": up("_rate")},
        eligible=played,
    )
    return rated.join(ease, key, "left").select(
        *key,
        "team_name",
        "played",
        "team_clean_sheets",
        round_half_away(F.col("_rate"), 2).alias("clean_sheet_rate"),
        "clean_sheet_pctl",
        "avg_difficulty_next_5",
        round_half_away(F.col("fixture_pctl"), 2).alias("fixture_pctl"),
        weighted_score(labels.OUTLOOK_WEIGHTS).alias("defensive_outlook_score"),
    )
