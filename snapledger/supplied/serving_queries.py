"""Serving queries over the decision tables and squads of the supplied data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.fields import pick
from snapledger.functions.numbers import round_half_away
from snapledger.operators import fixtures as fixture_ops
from snapledger.operators.replacement import best_affordable
from snapledger.plans import serving
from snapledger.session import settle
from snapledger.supplied.registry import query
from snapledger.supplied.snapshot_queries import DECISION, OUTLOOK, Stored
from snapledger.supplied.tables import DAILY, FIXTURES, PLAYERS, TEAMS, Tables

LATEST = f"""{DECISION},
latest as (
  select *, case recommendation when 'transfer_in' then 'Buy' when 'hold' then 'Hold' when 'monitor' then 'Monitor'
      else 'Sell' end as verdict
  from decision where load_date = (select max(load_date) from decision))"""
LATEST_OUTLOOK = LATEST + OUTLOOK[len(DECISION):] + """,
newest_outlook as (select * from outlook where load_date = (select max(load_date) from outlook))"""


def _latest(stored: Tables | Stored) -> DataFrame:
    """Newest decisions, stored: the serving queries read a finished table."""
    stored = Stored(stored) if isinstance(stored, Tables) else stored
    return serving.latest_decisions(stored.mart("decision"), stored.players, stored.t.teams())


PICK = ("player_id", "web_name", "team_name", "team_code", "player_code", "price_m", "transfer_score")
PICK_SQL = ", ".join(PICK)


@query(f"""with {LATEST}
select * exclude (prev_recommendation) replace (cast(load_date as varchar) as load_date), prev_recommendation,
  case prev_recommendation when 'transfer_in' then 'Buy' when 'hold' then 'Hold' when 'monitor' then 'Monitor'
    when 'drop' then 'Sell' end as prev_verdict
from latest""")
def latest_decisions(t):
    return _latest(t)


@query(f"with {LATEST} select {PICK_SQL} from latest order by transfer_score desc, player_id limit 1")
def top_pick(t):
    return serving.top_pick(_latest(t)).select(*PICK)


@query(f"""with {LATEST}
select {PICK_SQL}, recommendation_trend, selected_by_percent from (
  select *, row_number() over (partition by recommendation_trend order by selected_by_percent desc, player_id) as rn
  from latest where recommendation_trend in ('upgraded', 'downgraded') and selected_by_percent >= 5)
where rn <= 5""")
def movers(t):
    return serving.movers(_latest(t)).select(*PICK, "recommendation_trend", "selected_by_percent")


@query(f"""with {LATEST}
select {PICK_SQL}, row_number() over (order by transfer_score desc, player_id) as page_position from latest""")
def decision_order(t):
    """Every newest decision with its place in page order."""
    return serving.positioned(_latest(t)).select(*PICK, "page_position")


@query(f"""with {LATEST}
select {PICK_SQL}, position_short_name from (
  select *, row_number() over (partition by position_short_name order by transfer_score desc, player_id) as rn
  from latest where price_m <= 4.3)
where rn <= 3""")
def budget_picks(t):
    return serving.budget_picks(_latest(t), cap=4.3).select(*PICK, "position_short_name")


@query(f"""with {LATEST}
select {PICK_SQL}, selected_by_percent from latest where selected_by_percent <= 5
order by transfer_score desc, player_id limit 5""")
def differentials(t):
    return serving.differentials(_latest(t)).select(*PICK, "selected_by_percent")


@query(f"""with {LATEST_OUTLOOK},
leaders as (
  select team_id, defensive_outlook_score from newest_outlook order by defensive_outlook_score desc, team_id limit 4)
select {PICK_SQL}, team_id, position_short_name, defensive_outlook_score from (
  select *, row_number() over (partition by team_id, position_short_name order by transfer_score desc, player_id) as rn
  from latest join leaders using (team_id) where position_short_name in ('GKP', 'DEF'))
where rn = 1""")
def clean_sheet_picks(t):
    stored = Stored(t)
    return serving.clean_sheet_picks(_latest(stored), stored.mart("outlook")).select(
        *PICK, "team_id", "position_short_name", "defensive_outlook_score"
    )


@query(f"""with {LATEST_OUTLOOK}
select newest_outlook.team_name, defensive_outlook_score, played, team_code
from newest_outlook join teams using (team_id) order by defensive_outlook_score desc, team_id limit 1""")
def best_defence(t):
    return serving.best_defence(Stored(t).mart("outlook"), t.teams())


@query(f"""with {LATEST_OUTLOOK}
select coalesce(bool_or(fixture_pctl is not null), false) as published from newest_outlook""")
def ease_published(t):
    return serving.ease_published(Stored(t).mart("outlook"))


@query(f"""with {LATEST},
following as (
  select r.team_id, b.team_name as opponent_name, is_home, difficulty
  from runs r left join teams b on b.team_id = r.opponent_team_id
  where upcoming_fixture_number = 1 and load_date = (select max(load_date) from sides))
select {PICK_SQL}, opponent_name, is_home, difficulty
from (select * from latest order by transfer_score desc, player_id limit 5) left join following using (team_id)""")
def captain_picks(t):
    stored = Stored(t)
    difficulty = fixture_ops.fixture_difficulty(stored.fixtures, t.teams(), stored.runs)
    return serving.captain_picks(_latest(stored), difficulty).select(
        *PICK, "opponent_name", "is_home", "difficulty"
    )


@query(f"""with {LATEST}
select {PICK_SQL}, position_short_name from (
  select *, row_number() over (partition by position_short_name order by transfer_score desc, player_id) as rn
  from latest) where rn = 1""")
def top_pick_by_position(t):
    return serving.top_by_position(_latest(t)).select(*PICK, "position_short_name")


@query(f"""with {LATEST}
select {PICK_SQL}, position_short_name, verdict from latest
where position_short_name in ('DEF', 'MID') and verdict in ('Hold', 'Monitor')
  and (regexp_matches(web_name, '(?i)user 1|7$') or coalesce(regexp_matches(team_name, '(?i)user 1|7$'), false))""")
def search_filter(t):
    found = serving.search(_latest(t), ["DEF", "MID"], ["Hold", "Monitor"], "user 1|7$")
    return found.select(*PICK, "position_short_name", "verdict")


@query(f"""with {LATEST}
select player_id, unnest(['Value (30%)', 'Form (25%)', 'Underlying xG (20%)', 'Fixtures (15%)', 'Momentum (10%)'])
    as signal,
  unnest([coalesce(value_pctl, 0.5), coalesce(form_pctl, 0.5), coalesce(underlying_pctl, 0.5),
    coalesce(fixture_pctl, 0.5), coalesce(momentum_pctl, 0.5)]) as pctl
from latest""")
def signal_breakdown(t):
    return serving.signal_breakdown(_latest(t))


# Squads: every customer is a manager, every order one of the customer's picks.

SQUADS = f"""{LATEST},
picks as (
  select o_custkey as manager_id, o_orderkey % (select max(user_id) + 1 from events) as element, min(o_orderkey % 15 + 1) as position
  from orders group by 1, 2),
squad as (
  select p.*, p.position = 1 as is_captain, l.* exclude (position_id),
    case when p.position = 1 then 'captain' when p.position = 2 then 'vice' else '' end as role,
    case when p.position <= 11 then 'starting' else 'bench' end as squad_slot
  from picks p left join latest l on l.player_id = p.element)"""


def _squads(t: Tables, latest: DataFrame) -> DataFrame:
    slot, users = F.col("o_orderkey") % 15 + 1, t.events.agg(F.max("user_id") + 1).scalar()
    picks = t.orders.groupBy(F.col("o_custkey").alias("manager_id"), (F.col("o_orderkey") % users).alias("element")).agg(
        F.min(slot).alias("position")
    )
    flagged = picks.withColumns({"is_captain": F.col("position") == 1, "is_vice_captain": F.col("position") == 2})
    return serving.squads(flagged, latest)


@query(f"""with {SQUADS}
select manager_id, element, position, role, squad_slot, player_id, transfer_score, recommendation from squad""")
def squad_signals(t):
    return _squads(t, _latest(t)).select(
        "manager_id", "element", "position", "role", "squad_slot", "player_id", "transfer_score", "recommendation"
    )


@query(f"""with {SQUADS}
select manager_id, count(*) filter (player_id is null) as unresolved from squad group by 1""")
def squad_unresolved(t):
    return serving.unresolved(_squads(t, _latest(t)))


@query(f"""with {SQUADS},
starters as (select * from squad where squad_slot = 'starting' and player_id is not null),
best as (
  select * from (select *, row_number() over (partition by manager_id order by transfer_score desc, player_id) as rn
    from starters where availability_risk <> 'high_risk') where rn = 1),
captains as (
  select * from (select *, row_number() over (partition by manager_id order by position, player_id) as rn
    from starters where is_captain) where rn = 1)
select m.manager_id, b.player_id as best_player_id, b.web_name as best_web_name, b.transfer_score as best_score,
  c.player_id as captain_player_id, c.web_name as captain_web_name, c.transfer_score as captain_score,
  case when b.player_id is null then 'no_fit_starter' when c.player_id is null then 'no_captain'
    when b.player_id = c.player_id then 'keep' else 'change' end as outcome
from (select distinct manager_id from starters) m left join best b using (manager_id)
left join captains c using (manager_id)""")
def captain_suggestion(t):
    return serving.captain_suggestion(_squads(t, _latest(t)))


@query(f"""with {SQUADS},
weak as (
  select manager_id, player_id, web_name, position_short_name, recommendation,
    cast(round(price_m * 10) as bigint) + cast(floor(c_acctbal / 1000) as bigint) as budget
  from squad join customer on manager_id = c_custkey
  where recommendation in ('drop', 'monitor') and player_id is not null),
affordable as (
  select w.manager_id, w.player_id, l.player_id as item, l.transfer_score as score,
    row_number() over (partition by w.manager_id, w.player_id order by l.transfer_score desc, l.player_id) as rn
  from weak w join latest l on l.position_short_name = w.position_short_name
    and cast(round(l.price_m * 10) as bigint) <= w.budget and l.availability_risk <> 'high_risk'
  where not exists (select 1 from picks p where p.manager_id = w.manager_id and p.element = l.player_id))
select w.*, item, score from weak w left join (select * from affordable where rn = 1) using (manager_id, player_id)""")
def weak_links(t):
    latest = settle(_latest(t), "latest")
    bank = F.floor(F.col("c_acctbal") / 1000)
    banks = t.customer.select(F.col("c_custkey").alias("manager_id"), bank.alias("bank"))
    squad = _squads(t, latest).select(
        "manager_id", "element", "player_id", "web_name", "position_short_name", "recommendation", "price_m"
    )
    found = serving.weak_links(settle(squad, "squads"), banks, latest)
    return found.select(
        "manager_id", "player_id", "web_name", "position_short_name", "recommendation", "budget",
        F.col("item").cast("bigint").alias("item"), "score",
    )


@query("""with owned as (select distinct l_suppkey as owner, l_partkey as item from lineitem),
returned as (select distinct l_suppkey as owner, l_partkey as part from lineitem where l_returnflag = 'R'),
wanted as (
  select owner, part, p_type, cast(round(p_retailprice * 100) as bigint) + cast(floor(s_acctbal) as bigint) as budget
  from returned join part on part = p_partkey join supplier on owner = s_suppkey),
best as (
  select owner, part, p_partkey as item, cast(p_size as double) as score,
    row_number() over (partition by owner, part order by p_size desc, p_partkey) as rn
  from wanted w join part p on p.p_type = w.p_type and cast(round(p.p_retailprice * 100) as bigint) <= budget
  anti join owned o on o.owner = w.owner and o.item = p.p_partkey)
select w.*, item, score from wanted w left join (select * from best where rn = 1) using (owner, part)""")
def weak_link_replacement(t):
    """For every returned part of a supplier the largest part of its type it could pay and lacks."""
    cents = round_half_away(F.col("p_retailprice") * 100).cast("bigint")
    lines = t.lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item"), "l_returnflag")
    parts = t.part.select(
        "p_type", F.col("p_partkey").alias("item"), cents.alias("price"), F.col("p_size").cast("double").alias("score")
    )
    banks = t.supplier.select(F.col("s_suppkey").alias("owner"), F.floor("s_acctbal").alias("bank"))
    returned = lines.filter("l_returnflag = 'R'").select("owner", "item").distinct()
    wanted = (
        returned.join(parts.drop("score").hint("merge"), "item")
        .join(banks, "owner")
        .select("owner", F.col("item").alias("part"), "p_type", (F.col("price") + F.col("bank")).alias("budget"))
    )
    return best_affordable(settle(wanted, "wanted"), parts, lines.drop("l_returnflag"), "p_type", "owner")


# Season statistics


@query(f"""with {PLAYERS}
select player_name, team_name, goals, xg, goals - xg as delta, season from season_players
where season = (select max(season) from season_players) and minutes >= 900
order by abs(goals - xg) desc, player_ud_id limit 1""")
def xg_gap_top(t):
    return serving.goal_gap(t.season_players())


@query(f"""with {PLAYERS},
finishers as (
  select player_ud_id, player_name, team_name, goals, xg, round(goals - xg, 1) as finishing_delta
  from season_players where minutes >= 900)
select * from (select * from finishers order by finishing_delta desc, player_ud_id limit 8)
union all
select * from (select * from finishers order by finishing_delta, player_ud_id limit 8)""")
def finishing_extremes(t):
    return serving.finishing_extremes(t.season_players()).select(
        "player_ud_id", "player_name", "team_name", "goals", "xg", "finishing_delta"
    )


XG_TABLE = f"""{FIXTURES},
team_matches as (
  select season, 'Team ' || team_id as team_name, goals_against as goals_conceded,
    case when goals_for > goals_against then 3 when goals_for = goals_against then 1 else 0 end as points,
    difficulty / cast(4.0 as double) as expected_points, goals_for / cast(2.0 as double) as xg,
    goals_against / cast(2.0 as double) as xga, (goals_for - goals_against) / cast(2.0 as double) as npxgd,
    (goals_for + 8) / cast(4.0 as double) as ppda
  from sides where finished),
xg_table as (
  select season, team_name, count(*) as played, cast(sum(points) as bigint) as points,
    round(sum(expected_points), 1) as expected_points,
    round(sum(points) - sum(expected_points), 1) as points_minus_xpts, round(sum(xg), 1) as xg,
    round(sum(xga), 1) as xga, cast(sum(goals_conceded) as bigint) as goals_conceded, round(sum(npxgd), 1) as npxgd,
    round(avg(ppda), 1) as ppda
  from team_matches group by season, team_name)"""


def _team_matches(t: Tables) -> DataFrame:
    """Finished results with halves and quarters as expected values, which sum without error."""
    fixtures = t.fixtures().filter("finished")
    sides = fixture_ops.two_sided_unpivot(
        fixtures,
        ["season"],
        {"team_id": "home_team_id", "scored": "home_score", "conceded": "away_score", "difficulty": "home_difficulty"},
        {"team_id": "away_team_id", "scored": "away_score", "conceded": "home_score", "difficulty": "away_difficulty"},
    )
    scored, conceded = F.col("scored"), F.col("conceded")
    return sides.select(
        "season",
        F.concat(F.lit("Team "), F.col("team_id").cast("string")).alias("team_name"),
        conceded.alias("goals_conceded"),
        F.when(scored > conceded, 3).when(scored == conceded, 1).otherwise(0).alias("points"),
        (F.col("difficulty") / F.lit(4.0)).alias("expected_points"),
        (scored / F.lit(2.0)).alias("xg"),
        (conceded / F.lit(2.0)).alias("xga"),
        ((scored - conceded) / F.lit(2.0)).alias("npxgd"),
        ((scored + 8) / F.lit(4.0)).alias("ppda"),
    )


@query(f"with {XG_TABLE} select * from xg_table")
def xg_team_table(t):
    return serving.team_xg_table(_team_matches(t))


@query(f"with {XG_TABLE} select * from xg_table where season = (select max(year(o_orderdate)) - 1 from orders)")
def xg_season_table(t):
    """The table of one season, chosen by its parameter."""
    season = t.orders.agg(F.max(F.year("o_orderdate")) - 1).first()[0]
    _team_matches(t).createOrReplaceTempView("team_matches")
    return serving.season_xg_table(t.spark, "team_matches", season)


@query(f"""with {LATEST}
select player_id, case when player_code is not null then 'https://img.example/p' || player_code || '.png' end as photo,
  case when team_code is not null then 'https://img.example/t' || team_code || '.png' end as badge from latest""")
def picture_links(t):
    """Newest decisions with links filled in from templates."""
    stored = Stored(t)
    templates = {"photo_template": "https://img.example/p%d.png", "badge_template": "https://img.example/t%d.png"}
    shown = serving.latest_decisions(stored.mart("decision"), stored.players, t.teams(), **templates)
    return shown.select("player_id", "photo", "badge")


@query(f"with {XG_TABLE} select *, round(xga - goals_conceded, 1) as defensive_delta from xg_table")
def defence_delta(t):
    return serving.defence_delta(serving.team_xg_table(_team_matches(t)))


@query(f"""with {XG_TABLE}
select * from xg_table order by abs(points_minus_xpts) desc, season, team_name limit 5""")
def points_outliers(t):
    table = serving.team_xg_table(_team_matches(t)).withColumn("tie", F.struct("season", "team_name"))
    return serving.largest_absolute(table, "points_minus_xpts", "tie").drop("tie")


@query(f"""with {XG_TABLE}
select least(min(points), min(expected_points)) - 4 as axis_min,
  greatest(max(points), max(expected_points)) + 4 as axis_max from xg_table""")
def points_range(t):
    return serving.points_range(serving.team_xg_table(_team_matches(t)))


@query("select distinct year(o_orderdate) as season from orders")
def seasons_list(t):
    return serving.seasons(t.orders.select(F.year("o_orderdate").alias("season")))


STATS = f"""{PLAYERS}, {TEAMS},
stats as (
  select p.*, team_name, team_code, position_short_name
  from players p left join teams using (team_id) left join positions using (position_id)
  where load_date = (select max(load_date) from players))"""


def _stats(t: Tables) -> DataFrame:
    players = t.players()
    return serving.season_stats(players, t.teams(), t.positions(players), t.snapshot_dates())


@query(f"""with {STATS}
select cast(load_date as varchar) as load_date, player_id, web_name, player_code, team_name, team_code,
  position_short_name, season, goals_scored, assists, expected_goals, expected_assists, minutes, total_points,
  clean_sheets
from stats""")
def season_stats(t):
    return _stats(t)


@query(f"with {STATS} select player_id, web_name, team_name, assists from stats order by assists desc, player_id limit 10")
def season_leaders(t):
    return serving.leaders(_stats(t), "assists").select("player_id", "web_name", "team_name", "assists")


@query(f"""with {STATS}
select player_id, web_name, position_short_name, round(goals_scored - expected_goals, 2) as xg_delta from stats
where minutes >= 50 and expected_goals > 0 and position_short_name in ('DEF', 'MID', 'FWD')""")
def shooters(t):
    kept = serving.shooters(_stats(t), 50, ["DEF", "MID", "FWD"])
    return kept.select("player_id", "web_name", "position_short_name", "xg_delta")


@query(f"""with {STATS}
select player_id, round(goals_scored - expected_goals, 2) as xg_delta from stats
where minutes >= 50 and expected_goals > 0 order by abs(round(goals_scored - expected_goals, 2)) desc, player_id limit 5""")
def shooter_outliers(t):
    kept = serving.shooters(_stats(t), 50).select("player_id", "xg_delta")
    return serving.largest_absolute(kept, "xg_delta", "player_id")


@query(f"with {STATS} select distinct web_name from stats where expected_goals > 0")
def shooter_names(t):
    return serving.shooter_names(_stats(t))


# Live payloads and private groups


@query(f"""with {DAILY}
select cast(load_date as varchar) as load_date, user_id as player_id, k as minutes, purchases as goals_scored,
  clicks as assists, signups as clean_sheets, errors as bonus, cents as total_points, 'User ' || user_id as web_name
from (select *, row_number() over (partition by load_date order by cents desc, user_id) as rn from daily where k > 0)
where rn <= 15""")
def live_top(t):
    stats = F.struct(
        F.col("k").alias("minutes"), F.col("purchases").alias("goals_scored"), F.col("clicks").alias("assists"),
        F.col("signups").alias("clean_sheets"), F.col("errors").alias("bonus"), F.col("cents").alias("total_points"),
    )
    element = F.struct(F.col("user_id").alias("id"), stats.alias("stats"))
    payload = F.parse_json(F.to_json(F.struct(F.array(element).alias("elements"))))
    payloads = t.daily().select("load_date", pick(payload, "elements", "array<variant>").alias("elements"))
    users = t.events.select("user_id").distinct()
    meta = users.select(
        F.col("user_id").alias("player_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("web_name")
    )
    return serving.live_top(serving.live_stats(payloads, ["load_date"]), meta, group=["load_date"])


LEAGUES = """memberships as (
  select c_custkey as entry, cast(c_nationkey as bigint) as league_id, 'Nation ' || c_nationkey as league_name,
    case when c_acctbal >= 0 then 'x' else 's' end as league_type from customer
  union all
  select c_custkey, 1000 + length(c_mktsegment), c_mktsegment,
    case when c_mktsegment = 'BUILDING' then 'x' else 's' end from customer)"""


def _leagues(t: Tables) -> DataFrame:
    def league(key: Column, name: Column, private: Column) -> Column:
        kind = F.when(private, "x").otherwise("s")
        return F.struct(key.cast("bigint").alias("id"), name.alias("name"), kind.alias("league_type"))

    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    listed = F.array(
        league(nation, F.concat(F.lit("Nation "), nation.cast("string")), F.col("c_acctbal") >= 0),
        league(F.length(segment) + 1000, segment, segment == "BUILDING"),
    )
    payload = F.parse_json(F.to_json(F.struct(listed.alias("classic"))))
    entries = t.customer.select(
        F.col("c_custkey").alias("entry"), pick(payload, "classic", "array<variant>").alias("leagues")
    )
    return serving.private_leagues(entries)


@query(f"with {LEAGUES} select entry, league_id, league_name from memberships where league_type = 'x'")
def private_groups(t):
    return _leagues(t)


@query(f"""with {LEAGUES},
standings as (
  select cast(c_nationkey as bigint) as league_id, c_custkey as entry, count(*) as total
  from orders join customer on o_custkey = c_custkey group by 1, 2)
select entry, league_id, league_name, total from memberships join standings using (entry, league_id)
where league_type = 'x'""")
def own_standings(t):
    standings = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("bigint").alias("league_id"), F.col("c_custkey").alias("entry"))
        .agg(F.count("*").alias("total"))
    )
    return serving.own_standings(_leagues(t), standings)


@query("""with viewers as (
  select c_nationkey, max(c_custkey) as viewer from customer where (c_nationkey, c_acctbal) in
    (select (c_nationkey, max(c_acctbal)) from customer group by c_nationkey) group by c_nationkey)
select cast(c_nationkey as bigint) as league_id, c_custkey as entry, c_acctbal, c_custkey = viewer as you
from customer join viewers using (c_nationkey)""")
def league_views(t):
    """Every league's standings as its richest member sees them."""
    standings = t.customer.select(
        F.col("c_nationkey").alias("league_id"), F.col("c_custkey").alias("entry"), "c_acctbal"
    )
    viewers = standings.groupBy("league_id").agg(F.max_by("entry", F.struct("c_acctbal", "entry")).alias("viewer"))
    return serving.league_views(standings, viewers)
