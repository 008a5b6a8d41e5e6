"""Nested snapshots to typed series, latest loads, and change between snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from snapledger.functions import labels
from snapledger.functions.fields import Field, typed
from snapledger.functions.numbers import ratio, round_half_away
from snapledger.operators.ordering import Key, down, over_rows, ranks, up


def unnest_snapshot(
    raw: DataFrame, array_col: str, spec: Iterable[Field], keep: Sequence[str | Column] = ()
) -> DataFrame:
    """One typed row per element of an array of VARIANT, with the `keep` columns of its payload."""
    kept = [F.col(c) if isinstance(c, str) else c for c in keep]
    exploded = raw.select(*kept, F.explode(array_col).alias("_element"))
    names = [c for c in exploded.columns if c != "_element"]
    return exploded.select(*names, *typed(F.col("_element"), spec))


def flat_snapshot(raw: DataFrame, spec: Iterable[Field], keep: Sequence[str] = ()) -> DataFrame:
    """Typed rename of a flat raw table: each field reads one (possibly nested) column."""
    return raw.select(*keep, *[F.col(f.path).try_cast(f.type).alias(f.name) for f in spec])


def latest_value(df: DataFrame, column: str) -> Column:
    """Largest value of a column as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


def latest_snapshot(df: DataFrame, column: str = "load_date", source: DataFrame | None = None) -> DataFrame:
    """Rows of the newest snapshot; `source` may name a smaller table to take the date from."""
    return df.filter(F.col(column) == latest_value(df if source is None else source, column))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the largest `order` value per key, NULL below all; then the largest `ties`.

    A key that only has NULL order values keeps a row. Combined map-side, no window.
    """
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"), *[F.col(t) for t in ties])
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), place)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row.alias("_row")).select("_row.*")


def latest_dimension(
    raw: DataFrame, array_col: str, spec: Sequence[Field], keys: Sequence[str], order: str = "load_date"
) -> DataFrame:
    """Nested array of a snapshot series as a dimension: each key's newest row."""
    return latest_per_key(unnest_snapshot(raw, array_col, spec, [order]), keys, order)


def of_partitions(partitions: Iterable[Row]) -> Column:
    """Whether a row lies in one of some partitions, given as rows of partition values.

    As a condition on partition columns alone it is answered from folder names: no other folder is opened.
    """
    rows = [tuple(p) for p in partitions]
    if not rows:
        return F.lit(False)

    def place(values: Sequence[Column]) -> Column:
        return F.concat_ws("/", *[F.coalesce(v.cast("string"), F.lit("\0")) for v in values])

    names = next(iter(partitions)).__fields__
    return place([F.col(n) for n in names]).isin(["/".join("\0" if v is None else str(v) for v in r) for r in rows])


def newest_loads(raw: DataFrame, loads: DataFrame, group: Sequence[str], load_col: str = "load_date") -> DataFrame:
    """Rows of each group's newest load of a table that is partitioned by the group and the load date.

    `loads` has the table's partition values, from a listing. The newest of them, as few as there are groups of partitions,
    become a partition filter, so the table is scanned once and only in the newest folders.
    """
    newest = loads.groupBy(*group).agg(F.max(load_col).alias(load_col)).collect()
    return raw.filter(of_partitions(newest))


def latest_load_per_group(raw: DataFrame, group: Sequence[str], load_col: str = "load_date") -> DataFrame:
    """Rows of each group's newest load; older loads of the group are superseded.

    For tables that are not partitioned by these columns, or have many groups; see `newest_loads`.
    """
    newest = raw.groupBy(*group).agg(F.max(load_col).alias(load_col))
    return raw.join(newest, [*group, load_col], "left_semi")


def snapshot_delta(
    df: DataFrame, key: Sequence[str], order: Sequence[Key], previous: dict[str, str], bounded: bool = True
) -> DataFrame:
    """Add the previous snapshot's values: `previous` maps a column to its output name.

    A key has one row per load date, so a key's history is as long as the calendar. Pass
    `bounded=False` for tables without that grain.
    """
    return over_rows(
        df,
        key,
        order,
        lambda w: {out: F.lag(column).over(w) for column, out in previous.items()},
        before=1,
        bounded=bounded,
    )


def latest_with_previous(
    df: DataFrame, key: str, previous: dict[str, str], load_col: str = "load_date"
) -> DataFrame:
    """Rows of the newest snapshot with values of each key's own snapshot before it: `previous` maps a column to its output name.

    Only the newest earlier row of a key in the newest snapshot is looked for, by an aggregate that is combined before the
    shuffle, so no history is put in order.
    """
    newest = latest_value(df, load_col)
    current = df.filter(F.col(load_col) == newest)
    earlier = df.filter(F.col(load_col) < newest).join(current.select(key), key, "left_semi")
    values = F.struct(*[F.col(c).alias(out) for c, out in previous.items()])
    before = earlier.groupBy(key).agg(F.max_by(values, load_col).alias("_before"))
    return current.join(before, key, "left").select(*[current[c] for c in df.columns], "_before.*")


def price_trend(cost: Column, previous: Column) -> Column:
    return labels.direction(cost, previous, labels.PRICE_TRENDS)


def points_per_million(points: Column, tenths: Column) -> Column:
    """Points per million of price, two decimals; NULL for a price of 0."""
    return round_half_away(ratio(points, tenths.cast("double") / F.lit(10.0)), 2)


def form_trend(players: DataFrame, key: str = "player_id") -> DataFrame:
    """Form and points against the previous snapshot."""
    with_prev = snapshot_delta(
        players, [key], [up("load_date")], {"form": "prev_form", "total_points": "_prev_points"}
    )
    return with_prev.select(
        "load_date",
        "player_id",
        "web_name",
        "team_id",
        "position_id",
        "form",
        "prev_form",
        round_half_away(F.col("form") - F.col("prev_form"), 2).alias("form_change_since_prev_snapshot"),
        "total_points",
        (F.col("total_points") - F.col("_prev_points")).alias("points_gained_since_prev_snapshot"),
        "event_points",
    )


def price_momentum(players: DataFrame, key: str = "player_id") -> DataFrame:
    """Price, ownership and transfer flow against the previous snapshot."""
    with_prev = snapshot_delta(
        players,
        [key],
        [up("load_date")],
        {"now_cost": "prev_now_cost", "selected_by_percent": "prev_selected_by_percent"},
    )
    cost, prev_cost = F.col("now_cost"), F.col("prev_now_cost")
    owned, prev_owned = F.col("selected_by_percent"), F.col("prev_selected_by_percent")
    return with_prev.select(
        "load_date",
        "player_id",
        "web_name",
        "team_id",
        "position_id",
        "now_cost",
        "prev_now_cost",
        (cost - prev_cost).alias("price_change_since_prev_snapshot"),
        "selected_by_percent",
        "prev_selected_by_percent",
        round_half_away(owned - prev_owned, 2).alias("ownership_change_since_prev_snapshot"),
        "transfers_in_event",
        "transfers_out_event",
        (F.col("transfers_in_event") - F.col("transfers_out_event")).alias("net_transfers_event"),
        price_trend(cost, prev_cost).alias("price_trend"),
    )


def availability_risk(players: DataFrame) -> DataFrame:
    """Status, chance and news of every kept player as one risk bucket."""
    return players.filter(~F.col("removed")).select(
        "load_date",
        "player_id",
        "web_name",
        "team_id",
        "position_id",
        "status",
        "chance_of_playing_next_round",
        "chance_of_playing_this_round",
        "news",
        "news_added",
        labels.availability_risk(F.col("status"), F.col("chance_of_playing_next_round")).alias(
            "availability_risk"
        ),
    )


def value_rank(players: DataFrame) -> DataFrame:
    """Points per million and its rank inside (load_date, position). The rounded ratio is ranked."""
    valued = players.filter(~F.col("removed")).select(
        "load_date",
        "player_id",
        "web_name",
        "team_id",
        "position_id",
        "now_cost",
        "total_points",
        points_per_million(F.col("total_points"), F.col("now_cost")).alias("points_per_million"),
        "form",
        "points_per_game",
        "minutes",
    )
    return ranks(valued, ["load_date", "position_id"], {"value_rank_in_position": down("points_per_million")}, kind="rank")
