"""Roles of the operators bound to the supplied tables.

Each function derives the columns an operator expects from the given parquet tables, over all
of their rows. The SQL constants state the same derivations for the result comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions.fields import pick
from snapledger.functions.numbers import ratio, round_half_away

# Fixed values of the bindings.
STATUSES = ("a", "d", "i", "s", "n")
POSITION_NAMES = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}


class Tables:
    """The supplied tables of one folder and the roles derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # opened once per query
        return table

    # Snapshot series: one row per user and day.

    def daily(self) -> DataFrame:
        kind = F.col("event_type")
        cents = round_half_away(F.col("value") * 100).cast("bigint")
        k = pick(F.try_parse_json("props"), "k", "bigint")
        return self.events.groupBy(F.to_date("ts").alias("load_date"), "user_id").agg(
            F.count("*").alias("n"),
            *[F.count_if(kind == name).alias(f"{name}s") for name in ("view", "click", "signup", "purchase", "error")],
            F.sum(cents).alias("cents"),
            F.coalesce(F.sum(F.when(kind == "purchase", cents)), F.lit(0)).alias("purchase_cents"),
            F.sum(k).alias("k"),
        )

    def players(self) -> DataFrame:
        """Snapshot series with the columns of typed players."""
        day = F.dayofmonth("load_date")
        status = F.element_at(
            F.array(*[F.lit(s) for s in STATUSES]), (F.pmod(F.col("user_id") + day, F.lit(5)) + 1).cast("int")
        )
        return self.daily().select(
            "load_date",
            F.year("load_date").alias("season"),
            F.col("user_id").alias("player_id"),
            (F.col("user_id") + 100000).alias("player_code"),
            F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("web_name"),
            (F.col("user_id") % 25).cast("int").alias("team_id"),
            (F.col("user_id") % 4 + 1).cast("int").alias("position_id"),
            (F.col("n") + 40).alias("now_cost"),
            round_half_away(F.lit(100.0) * F.col("views") / F.col("n"), 1).alias("selected_by_percent"),
            F.col("purchases").alias("transfers_in_event"),
            F.col("errors").alias("transfers_out_event"),
            ratio(F.col("purchase_cents"), F.col("purchases")).alias("form"),
            F.col("cents").alias("total_points"),
            F.col("clicks").alias("event_points"),
            round_half_away(ratio(F.col("cents"), F.col("n")), 2).alias("points_per_game"),
            F.col("k").alias("minutes"),
            F.col("signups").alias("clean_sheets"),
            F.col("purchases").alias("goals_scored"),
            F.col("views").alias("assists"),
            (F.col("clicks") / F.lit(2.0)).alias("expected_goals"),
            (F.col("signups") / F.lit(4.0)).alias("expected_assists"),
            status.alias("status"),
            F.nullif(F.col("n") % 6 * 25, F.lit(125)).alias("chance_of_playing_next_round"),
            F.col("n").alias("chance_of_playing_this_round"),
            F.when(F.col("errors") > 0, F.concat(F.lit("errors: "), F.col("errors").cast("string"))).alias("news"),
            F.lit(None).cast("timestamp_ntz").alias("news_added"),
            (F.col("errors") >= 3).alias("removed"),
        )

    def snapshot_dates(self) -> DataFrame:
        """The dates of the player snapshots, from a scan of one column."""
        return self.events.select(F.to_date("ts").alias("load_date"))

    def positions(self, players: DataFrame) -> DataFrame:
        names = F.create_map(*[F.lit(x) for pair in POSITION_NAMES.items() for x in pair])
        return players.select("position_id").distinct().withColumn("position_short_name", names[F.col("position_id")])

    def teams(self) -> DataFrame:
        """Nations as the team dimension."""
        return self.nation.select(
            F.col("n_nationkey").alias("team_id"),
            F.col("n_name").alias("team_name"),
            F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("team_short_name"),
            (F.col("n_nationkey") + 900).alias("team_code"),
        )

    def season_players(self, players: DataFrame | None = None) -> DataFrame:
        """Season totals of the other source: one row per user and year."""
        players = self.players() if players is None else players
        clicks, errors, signups = F.sum("event_points"), F.sum("transfers_out_event"), F.sum("clean_sheets")
        totals = players.groupBy("season", "player_id").agg(
            F.sum("minutes").alias("minutes"),
            F.sum("goals_scored").alias("goals"),
            (clicks / F.lit(2.0)).alias("npxg"),
            (clicks / F.lit(2.0) + errors / F.lit(4.0)).alias("xg"),
            (signups / F.lit(4.0)).alias("xa"),
        )
        user = F.col("player_id")
        return totals.select(
            "season",
            (user + 500000).alias("player_ud_id"),
            F.concat(F.lit("User "), user.cast("string")).alias("player_name"),
            F.concat(F.lit("Team "), (user % 25).cast("string")).alias("team_name"),
            "minutes",
            "goals",
            "npxg",
            "xg",
            "xa",
        )

    def player_map(self, players: DataFrame) -> DataFrame:
        """Users both sources list, under the ids of each."""
        listed = players.select("player_id", "player_code").distinct()
        return listed.withColumn("player_ud_id", F.col("player_id") + 500000)

    # Two-sided results: one row per order.

    def fixtures(self) -> DataFrame:
        """Orders as fixtures: the customer's nation at home to the lowest supplier nation."""
        supplied = self.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(
            self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
        )
        per_order = supplied.groupBy("l_orderkey").agg(
            F.min("s_nationkey").alias("away_team_id"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.count("*").alias("lines"),
        )
        orders = self.orders.select(
            "o_orderkey",
            "o_custkey",
            F.to_date("o_orderdate").alias("day"),
            (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("dated"),
            (F.col("o_orderstatus") != "O").alias("finished"),
        ).join(
            self.customer.select("c_custkey", F.col("c_nationkey").alias("home_team_id")),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        return (
            orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
            .filter("home_team_id <> away_team_id")
            .select(
                F.trunc("day", "year").alias("load_date"),
                F.year("day").alias("season"),
                F.col("o_orderkey").alias("fixture_id"),
                F.month("day").alias("gameweek"),
                "home_team_id",
                "away_team_id",
                (F.col("quantity") % 5).alias("home_score"),
                (F.col("lines") % 5).alias("away_score"),
                (F.col("lines") % 5 + 1).alias("home_difficulty"),
                (F.col("quantity") % 5 + 1).alias("away_difficulty"),
                F.when(F.col("dated"), F.col("day")).alias("kickoff_time"),
                "finished",
            )
        )

    def ease_of_snapshots(self, players: DataFrame, ease: DataFrame) -> DataFrame:
        """Fixture signal of one of the fixture years for every snapshot date and team."""
        ordered = F.year("o_orderdate")
        first, count = (self.orders.agg(e).scalar() for e in (F.min(ordered), F.max(ordered) - F.min(ordered) + 1))
        year = F.dayofmonth("load_date") % count + first
        wanted = players.select("load_date", "team_id").distinct().withColumn(
            "_year", F.make_date(year, F.lit(1), F.lit(1))
        )
        return wanted.join(ease.withColumnRenamed("load_date", "_year"), ["_year", "team_id"]).drop("_year")


# The same derivations in SQL.

#: First day of the fixture year that stands for a snapshot date.
FIXTURE_YEAR = """make_date(cast((select min(year(o_orderdate)) from orders) + day(load_date) %
    (select max(year(o_orderdate)) - min(year(o_orderdate)) + 1 from orders) as integer), 1, 1)"""

TEAMS = """teams as (
  select cast(n_nationkey as bigint) as team_id, n_name as team_name, 'N' || n_nationkey as team_short_name,
    cast(n_nationkey + 900 as bigint) as team_code
  from nation)"""

DAILY = """daily as (
  select cast(ts as date) as load_date, user_id, count(*) as n,
    count(*) filter (event_type = 'view') as views,
    count(*) filter (event_type = 'click') as clicks,
    count(*) filter (event_type = 'signup') as signups,
    count(*) filter (event_type = 'purchase') as purchases,
    count(*) filter (event_type = 'error') as errors,
    cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents,
    cast(coalesce(sum(cast(round(value * 100) as bigint)) filter (event_type = 'purchase'), 0) as bigint)
      as purchase_cents,
    cast(sum(cast(props ->> '$.k' as bigint)) as bigint) as k
  from events group by 1, 2)"""

PLAYERS = DAILY + """,
players as (
  select load_date, year(load_date) as season, user_id as player_id, user_id + 100000 as player_code,
    'User ' || user_id as web_name, user_id % 25 as team_id,
    user_id % 4 + 1 as position_id, n + 40 as now_cost,
    round(cast(100.0 as double) * views / n, 1) as selected_by_percent,
    purchases as transfers_in_event, errors as transfers_out_event,
    cast(purchase_cents as double) / nullif(purchases, 0) as form, cents as total_points,
    clicks as event_points, round(cast(cents as double) / n, 2) as points_per_game, k as minutes,
    signups as clean_sheets, purchases as goals_scored, views as assists,
    clicks / cast(2.0 as double) as expected_goals, signups / cast(4.0 as double) as expected_assists,
    ['a', 'd', 'i', 's', 'n'][(user_id + day(load_date)) % 5 + 1] as status,
    nullif(n % 6 * 25, 125) as chance_of_playing_next_round, n as chance_of_playing_this_round,
    case when errors > 0 then 'errors: ' || errors end as news, errors >= 3 as removed
  from daily),
positions as (
  select distinct position_id,
    case position_id when 1 then 'GKP' when 2 then 'DEF' when 3 then 'MID' else 'FWD' end as position_short_name
  from players),
season_players as (
  select year(load_date) as season, user_id + 500000 as player_ud_id, 'User ' || user_id as player_name,
    'Team ' || (user_id % 25) as team_name, cast(sum(k) as bigint) as minutes,
    cast(sum(purchases) as bigint) as goals, sum(clicks) / cast(2.0 as double) as npxg,
    sum(clicks) / cast(2.0 as double) + sum(errors) / cast(4.0 as double) as xg,
    sum(signups) / cast(4.0 as double) as xa
  from daily group by year(load_date), user_id),
player_map as (
  select distinct player_id, player_code, player_id + 500000 as player_ud_id from players)"""

FIXTURES = """per_order as (
  select l_orderkey, cast(min(s_nationkey) as bigint) as away_team_id, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity,
    count(*) as lines
  from lineitem join supplier on l_suppkey = s_suppkey group by 1),
fixtures as (
  select cast(date_trunc('year', o_orderdate) as date) as load_date, year(o_orderdate) as season,
    o_orderkey as fixture_id, month(o_orderdate) as gameweek, cast(c_nationkey as bigint) as home_team_id, away_team_id,
    quantity % 5 as home_score, lines % 5 as away_score, lines % 5 + 1 as home_difficulty,
    quantity % 5 + 1 as away_difficulty,
    case when o_orderpriority <> '4-NOT SPECIFIED' then cast(o_orderdate as date) end as kickoff_time,
    o_orderstatus <> 'O' as finished
  from orders join customer on o_custkey = c_custkey join per_order on o_orderkey = l_orderkey
  where c_nationkey <> away_team_id),
sides as (
  select load_date, season, fixture_id, gameweek, kickoff_time, finished, home_team_id as team_id,
    away_team_id as opponent_team_id, home_difficulty as difficulty, home_score as goals_for,
    away_score as goals_against, true as is_home
  from fixtures
  union all
  select load_date, season, fixture_id, gameweek, kickoff_time, finished, away_team_id, home_team_id,
    away_difficulty, away_score, home_score, false
  from fixtures)"""
