"""Nested payloads, JSON fields and landing over documents, events, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.fields import fields, pick, typed
from snapledger.functions.numbers import round_half_away
from snapledger.functions.text import required, score_side, season_from_title
from snapledger.operators import snapshots
from snapledger.plans import serving
from snapledger.plans.registry import Context
from snapledger.plans.silver import exported_events, match_headers
from snapledger.session import new_folder
from snapledger.sources.catalog import listed_files, read_seed
from snapledger.sources.landing import (
    land_folder,
    land_league_payloads,
    load_raw,
    payload_season,
    raw_loads,
    read_raw,
    split_league_payload,
    write_raw,
)
from snapledger.streaming.landing import land_new_files
from snapledger.supplied.registry import query
from snapledger.supplied.tables import FIXTURES, Tables

LINES = """lines as (
  select doc_id, lang, source, unnest(parts) as line, generate_subscripts(parts, 1) - 1 as line_no
  from (select doc_id, lang, source, string_split(text, chr(10)) as parts from documents))"""


def _payload(*columns: Column) -> Column:
    """The columns as one VARIANT payload, as the JSON reader would deliver it."""
    return F.to_variant_object(F.struct(*columns))


def _line_elements(element) -> Column:
    return F.transform(F.split("text", "\n"), element)


def _snapshot_payloads(t: Tables) -> DataFrame:
    """Every document as a payload that nests its lines."""
    elements = _line_elements(lambda line, i: F.struct(i.alias("id"), line.alias("line"), F.length(line).alias("size")))
    payload = _payload("doc_id", elements.alias("elements"))
    return t.documents.select("doc_id", "lang", pick(payload, "elements", "array<variant>").alias("elements"))


@query(f"with {LINES} select doc_id, lang, line_no, md5(line) as line_hash, length(line) as size from lines")
def unnest_snapshot(t):
    spec = [*fields("bigint", ("id", "line_no")), *fields("string", "line"), *fields("bigint", "size")]
    lines = snapshots.unnest_snapshot(_snapshot_payloads(t), "elements", spec, ["doc_id", "lang"])
    return lines.withColumn("line_hash", F.md5("line")).drop("line")


@query("""select event_id, cast(props ->> '$.k' as bigint) as k, cast(props ->> '$.k' as double) as k_double,
  cast(props ->> '$.none' as varchar) as missing, (props ->> '$.k') = '9' as is_nine
from events""")
def json_fields(t):
    props = F.try_parse_json("props")
    return t.events.select(
        "event_id",
        pick(props, "k", "bigint").alias("k"),
        pick(props, "k", "double").alias("k_double"),
        pick(props, "none").alias("missing"),
        (pick(props, "k") == "9").alias("is_nine"),
    )


@query("""select user_id, name, k from (
  select user_id, event_type as name, cast(props ->> '$.k' as bigint) as k,
    row_number() over (partition by user_id order by event_id desc) as rn
  from events) where rn = 1""")
def latest_dimension(t):
    """Newest nested definition of every user."""
    element = _payload(F.col("user_id").alias("id"), F.col("event_type").alias("name"), "props")
    raw = t.events.select(F.array(element).alias("elements"), F.col("event_id").alias("load_date"))
    spec = [*fields("bigint", ("id", "user_id")), *fields("string", "name", "props")]
    newest = snapshots.latest_dimension(raw, "elements", spec, ["user_id"])
    return newest.select("user_id", "name", pick(F.parse_json("props"), "k", "bigint").alias("k"))


@query("""select block, entity_id, label from (
  select 'season_players' as block, o_custkey as entity_id, o_orderpriority as label from orders
  union all select 'season_matches', o_orderkey, o_orderstatus from orders
  union all select 'season_teams', unnest([year(o_orderdate), month(o_orderdate)]), unnest(['year', 'month'])
    from orders)""")
def payload_split(t):
    """Every order as a payload of three blocks, split into one row per entity of each."""
    date = F.col("o_orderdate")
    payload = _payload(
        F.array(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"))).alias("players"),
        F.array(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))).alias("dates"),
        F.struct(
            F.struct(F.year(date).alias("id"), F.lit("year").alias("label")).alias("83"),
            F.struct(F.month(date).alias("id"), F.lit("month").alias("label")).alias("87"),
        ).alias("teams"),
    )
    blocks = {"players": "array<variant>", "dates": "array<variant>", "teams": "map<string,variant>"}
    payloads = t.orders.select(F.year(date).alias("season"), payload.alias("payload")).select(
        "season", *[pick(F.col("payload"), block, kind).alias(block) for block, kind in blocks.items()]
    )
    spec = [*fields("bigint", ("id", "entity_id")), *fields("string", "label")]
    whole = None
    for name, records in split_league_payload(payloads, ("season",)).items():
        rows = records.select(F.lit(name).alias("block"), *typed(F.col("record"), spec))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def _match_payloads(t: Tables) -> DataFrame:
    """Every order as a match payload with a score text and a file name."""
    fixtures = t.fixtures()
    side = "struct<teamId:variant,name:string>"

    def team(column: str) -> Column:
        block = F.struct(F.col(column).alias("teamId"), F.concat(F.lit("Team "), F.col(column).cast("string")).alias("name"))
        return F.from_json(F.to_json(block), side)

    return fixtures.select(
        F.concat(F.lit("matches/"), F.col("fixture_id").cast("string"), F.lit(".json")).alias("filename"),
        F.concat(F.coalesce("kickoff_time", "load_date").cast("string"), F.lit("T00:00:00")).alias("startDate"),
        team("home_team_id").alias("home"),
        team("away_team_id").alias("away"),
        F.concat_ws(" : ", F.col("home_score").cast("string"), F.col("away_score").cast("string")).alias("ftScore"),
        F.col("gameweek").alias("attendance"),
        F.lit(None).cast("string").alias("venueName"),
        "load_date",
    )


@query(f"""with {FIXTURES},
dated as (select *, coalesce(kickoff_time, load_date) as match_date from fixtures)
select fixture_id as match_id, cast(match_date as varchar) as match_date,
  case when month(match_date) >= 7 then year(match_date) else year(match_date) - 1 end as season_start_year,
  home_team_id as home_team_ws_id, 'Team ' || home_team_id as home_team_name,
  away_team_id as away_team_ws_id, 'Team ' || away_team_id as away_team_name,
  home_score as home_goals, away_score as away_goals, gameweek as attendance
from dated""")
def match_header(t):
    return match_headers(_match_payloads(t)).drop("venue_name", "load_date")


@query(f"""with {LINES}
select doc_id as match_id, line_no as event_ws_id, length(line) as minute, lang as event_type,
  case when line <> '' then source = 'src1' end as is_successful, line = '' as is_touch,
  length(line) / cast(2.0 as double) as x, md5(line) as qualifier
from lines""")
def match_events(t):
    """Every line of every document as an event element of its payload."""

    def element(line, i):
        outcome = F.when(F.col("source") == "src1", "Successful").otherwise("Unsuccessful")
        return F.struct(
            i.alias("id"),
            F.length(line).alias("minute"),
            F.struct(F.col("lang").alias("displayName")).alias("type"),
            F.when(line != "", F.struct(outcome.alias("displayName"))).alias("outcomeType"),
            (line == "").alias("isTouch"),
            (F.length(line) / F.lit(2.0)).alias("x"),
            F.array(F.struct(line.alias("value"))).alias("qualifiers"),
        )

    payload = _payload(_line_elements(element).alias("events"))
    payloads = t.documents.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("filename"),
        F.lit(None).cast("date").alias("load_date"),
        pick(payload, "events", "array<variant>").alias("events"),
    )
    return exported_events(payloads).select(
        "match_id", "event_ws_id", "minute", "event_type", "is_successful", "is_touch", "x",
        F.md5(pick(F.col("qualifiers"), "[0].value")).alias("qualifier"),
    )


@query("""select lang, count(*) as pages from (
  select regexp_extract(html, '<html lang="(\\w+)"', 1) as lang from pages) group by 1""")
def season_from_text(t):
    """Label named in each page; a page without one would fail the job."""
    label = season_from_title(F.col("html"), r'<html lang="(\w+)"')
    return t.pages.groupBy(label.alias("lang")).agg(F.count("*").alias("pages"))


@query("""select substr(cast(cast(o_orderdate as date) as varchar), 1, 4) as season, count(*) as payloads
from orders group by 1""")
def season_from_payload(t):
    """Season label of every payload: the year of its first deadline."""
    events = F.array(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deadline_time")))
    payload = _payload(events.alias("events"))
    labelled = t.orders.select(payload_season(pick(payload, "events", "array<variant>")).alias("season"))
    return labelled.groupBy("season").agg(F.count("*").alias("payloads"))


PERIOD = """listed as (
  select year(o_orderdate) as season, cast(o_orderdate as date) as load_date, o_orderkey as id,
    o_orderstatus = 'P' as is_current, o_orderpriority = '1-URGENT' as is_next, o_orderstatus <> 'O' as finished
  from orders),
periods as (
  select season, load_date, coalesce(min(id) filter (is_current), max(id) filter (finished)) as period,
    bool_or(is_next) as has_next
  from listed group by 1, 2)"""


@query(f"""with {PERIOD}
select p.season, cast(p.load_date as varchar) as load_date, period, l.finished,
  l.finished and not has_next as is_offseason
from periods p left join listed l on l.id = period""")
def current_period(t):
    """Current entry of every day's list, the last finished one where none is current."""
    event = F.struct(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "P").alias("is_current"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_next"),
        (F.col("o_orderstatus") != "O").alias("finished"),
    )
    raw = t.orders.select(
        F.year("o_orderdate").alias("season"),
        F.to_date("o_orderdate").alias("load_date"),
        pick(_payload(F.array(event).alias("events")), "events", "array<variant>").alias("events"),
    )
    return serving.current_period(raw).drop("average_entry_score", "highest_score")


# Landing: the payload files are written from the tables, then landed and read like a source.


def _write_event_files(events: DataFrame, folder: str) -> None:
    """Events as JSON payload files under season=/load_date= folders; errors lack the `props` key."""
    stamped = events.select(
        "event_id",
        "user_id",
        "event_type",
        F.col("value").cast("string").alias("value"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("props"),
        F.year("ts").alias("season"),
        F.to_date("ts").alias("load_date"),
    )
    stamped.write.mode("overwrite").partitionBy("season", "load_date").json(f"{folder}/events")


EVENT_SCHEMA = (
    "event_id variant, user_id variant, event_type variant, value variant, props variant, season int, load_date date"
)
EVENT_FIELDS = [
    *fields("bigint", "event_id", "user_id"),
    *fields("string", "event_type"),
    *fields("double", "value"),
    *fields("string", "props"),
]

LANDED = """select year(ts) as season, cast(cast(ts as date) as varchar) as load_date, event_type, count(*) as n,
  cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents, count(distinct user_id) as users,
  count(*) filter (event_type <> 'error') as with_props, true as has_file
from events group by 1, 2, 3"""


def _landed_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("season", "load_date", "event_type").agg(
        F.count("*").alias("n"),
        F.sum(round_half_away(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.count_distinct("user_id").alias("users"),
        F.count("props").alias("with_props"),
        F.bool_and(F.col("filename").endswith(".json")).alias("has_file"),
    )


@query(LANDED)
def snapshot_landing(t):
    """Payload files to a typed raw table, landed twice: the second run replaces the first."""
    folder = new_folder(t.spark, "incoming")
    _write_event_files(t.events, folder)
    read = t.spark.read.schema(EVENT_SCHEMA).option("basePath", f"{folder}/events")
    files = read.json(f"{folder}/events/season=*/load_date=*")
    raw = files.select(
        *[pick(F.col(f.path), "$", f.type).alias(f.name) for f in EVENT_FIELDS],
        "season",
        "load_date",
        F.col("_metadata.file_path").alias("filename"),
    )
    table = f"{folder}/raw"
    write_raw(raw, table)
    write_raw(raw, table)
    return _landed_summary(t.spark.read.parquet(table))


@query(LANDED)
def incremental_landing(t):
    """The same table from the file stream: every day lands with wrong values, then again with the right ones.

    A third run finds nothing new.
    """
    folder = new_folder(t.spark, "incoming")

    def opened(reader) -> DataFrame:
        files = reader.schema(EVENT_SCHEMA).option("basePath", f"{folder}/events")
        loaded = files.json(f"{folder}/events/season=*/load_date=*")
        return loaded.select(
            *[pick(F.col(f.path), "$", f.type).alias(f.name) for f in EVENT_FIELDS],
            "season",
            "load_date",
            F.col("_metadata.file_path").alias("filename"),
        )

    def files(spark) -> DataFrame:
        return listed_files(spark, f"{folder}/events/season=*/load_date=*", f"{folder}/events")

    table, mark = f"{folder}/raw", f"{folder}/checkpoint"
    for events in (t.events.withColumn("value", F.col("value") + 1), t.events, None):
        if events is not None:
            _write_event_files(events, folder)
        land_new_files(opened(t.spark.readStream), lambda spark: opened(spark.read), files, table, mark)
    return _landed_summary(t.spark.read.parquet(table))


@query("""select year(o_orderdate) as season, cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as load_date,
  count(*) as events, cast(sum(o_orderkey) as bigint) as event_ids, cast(count(*) % 7 as bigint) as home_score,
  cast(max(o_custkey) as bigint) as home_team, true as has_file
from orders group by 1, 2""")
def raw_payloads(t):
    """Payload files of a month's orders, landed by a full refresh, replayed, and read back as the raw table."""
    root, event = new_folder(t.spark, "payloads"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    stamped = _in_files(t.orders.withColumns({"season": F.year("o_orderdate"), "load_date": month}), ["season", "load_date"])
    payloads = stamped.groupBy("season", "load_date", "_file").agg(
        F.struct(F.max("o_custkey").alias("teamId"), F.lit("home").alias("name")).alias("home"),
        F.concat((F.count("*") % 7).cast("string"), F.lit(" : 1")).alias("ftScore"),
        F.collect_list(event).alias("events"),
    )
    _write_objects(payloads.drop("_file"), ["season", "load_date"], f"{root}/matchcentre/events")
    for _ in range(2):
        load_raw(t.spark, root, "match_payloads", root)
    raw = read_raw(t.spark, root, "match_payloads")
    ids = F.transform("events", lambda e: pick(e, "id", "bigint"))
    total = F.aggregate(ids, F.lit(0).cast("bigint"), lambda total, i: total + i)
    # each file scores its own rest of seven, which add up to that of the month
    return raw.groupBy("season", "load_date").agg(
        F.sum(F.size("events")).alias("events"),
        F.sum(total).alias("event_ids"),
        (F.sum(score_side(F.col("ftScore"), 1).cast("bigint")) % 7).alias("home_score"),
        F.max(pick(F.col("home.teamId"), "$", "bigint")).alias("home_team"),
        F.bool_and(F.col("filename").endswith(".json")).alias("has_file"),
    )


#: Orders in one payload file, about.
PER_FILE = 5_000


def _in_files(orders: DataFrame, group: list[str]) -> DataFrame:
    """Orders with `_file`: the payload file of their group they belong to, of a bounded size however large the group is."""
    sizes = orders.groupBy(*group).agg(F.ceil(F.count("*") / PER_FILE).alias("_files"))
    return orders.join(sizes, group).withColumn("_file", F.pmod(F.xxhash64("o_orderkey"), F.col("_files"))).drop("_files")


def _write_objects(payloads: DataFrame, folders: list[str], path: str) -> None:
    """One object per file, as sources deliver them."""
    payloads.write.option("maxRecordsPerFile", 1).partitionBy(*folders).json(path)


def _raw_context(t: Tables, warehouse: str) -> Context:
    """Models over landed raw tables, whose partitions are known from their listing."""
    spark = t.spark
    return Context(spark, lambda name: read_raw(spark, warehouse, name), warehouse, loads=lambda name: raw_loads(spark, warehouse, name))


@query("""with months as (
  select *, year(o_orderdate) as season, cast(date_trunc('month', o_orderdate) as date) as load_date from orders),
kept as (
  select * from months where (season, load_date) in (select (season, max(load_date)) from months group by season)),
rows as (
  select 'season_players' as block, season, load_date, o_orderkey as id, o_orderpriority || '''s' as label,
    o_custkey / cast(2.0 as double) as value from kept
  union all select 'season_matches', season, load_date, o_orderkey, o_orderstatus, o_custkey / cast(4.0 as double) from kept
  union all select 'season_team_matches', season, load_date, o_custkey, 'T' || o_custkey,
    case when o_orderkey % 3 <> 0 then o_custkey / cast(o_orderkey % 3 as double) end from kept)
select block, season, cast(load_date as varchar) as load_date, id, label, value from rows""")
def season_refresh(t):
    """Every order as a league payload of its month, landed in one call; the refresh models keep each year's newest month."""
    ctx = _raw_context(t, _landed_league(t))
    columns = {
        "season_players": ("player_ud_id", "player_name", "xg"),
        "season_matches": ("match_ud_id", "home_team_name", "home_xg"),
        "season_team_matches": ("team_ud_id", "team_name", "ppda"),
    }
    whole = None
    for model, df in ctx.build(*columns).items():
        named = [F.col(c).alias(out) for c, out in zip(columns[model], ("id", "label", "value"))]
        rows = df.select(F.lit(model).alias("block"), "season", "load_date", *named)
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def _landed_league(t: Tables) -> str:
    """The warehouse in which every order is landed as a league payload of its month."""
    key, customer, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")

    def text(column: Column, name: str) -> Column:
        return column.cast("string").alias(name)

    name = F.concat("o_orderpriority", F.lit("&#039;s")).alias("player_name")
    player = F.struct(text(key, "id"), name, text(customer / 2.0, "xG"))
    home = F.struct(text(customer, "id"), F.col("o_orderstatus").alias("title"))
    match = F.struct(text(key, "id"), home.alias("h"), F.struct(text(customer / 4.0, "h")).alias("xG"))
    pressing = F.struct(customer.alias("att"), (key % 3).alias("def"))
    team = F.struct(
        text(customer, "id"),
        F.concat(F.lit("T"), customer.cast("string")).alias("title"),
        F.array(F.struct(text(F.to_date(date), "date"), pressing.alias("ppda"))).alias("history"),
    )
    payload = _payload(F.array(player).alias("players"), F.array(match).alias("dates"), F.struct(team.alias("1")).alias("teams"))
    stamp = [F.year(date).alias("season"), F.to_date(F.date_trunc("month", date)).alias("load_date")]
    blocks = {"players": "array<variant>", "dates": "array<variant>", "teams": "map<string,variant>"}
    payloads = t.orders.select(*stamp, payload.alias("payload")).select(
        "season", "load_date", *[pick(F.col("payload"), block, kind).alias(block) for block, kind in blocks.items()]
    )
    warehouse = new_folder(t.spark, "league")
    land_league_payloads(payloads, warehouse)
    return warehouse


@query("""with months as (
  select *, year(o_orderdate) as season, cast(date_trunc('month', o_orderdate) as date) as load_date from orders)
select cast(season as bigint) as season, cast(load_date as varchar) as load_date, count(*) as n, cast(sum(o_orderkey) as bigint) as ids
from months where (season, load_date) in (select (season, max(load_date)) from months group by season) group by 1, 2""")
def published_views(t):
    """Published models read by their names in another session: a view over landed rows, of each year's newest month."""
    warehouse = _landed_league(t)
    _raw_context(t, warehouse).publish("season_players")
    other = t.spark.newSession()
    return other.sql("""select cast(season as bigint) as season, load_date, count(*) as n, sum(player_ud_id) as ids
        from silver.season_players group by season, load_date""")


@query("""select year(o_orderdate) as season, cast(cast(o_orderdate as date) as varchar) as load_date, o_orderkey, o_orderstatus
from orders where (year(o_orderdate), cast(date_trunc('month', o_orderdate) as date)) in
  (select (year(o_orderdate), max(cast(date_trunc('month', o_orderdate) as date))) from orders group by year(o_orderdate))""")
def newest_load_of_year(t):
    """Orders landed by month; the newest month of each year, found from the listing and read as its folders only."""
    warehouse = new_folder(t.spark, "loads")
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    dated = t.orders.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), month.alias("load_date"))
    write_raw(dated, f"{warehouse}/raw/orders")
    newest = snapshots.newest_loads(read_raw(t.spark, warehouse, "orders"), raw_loads(t.spark, warehouse, "orders"), ["season"])
    return newest.select("season", F.col("day").alias("load_date"), "o_orderkey", "o_orderstatus")


@query("""select year(ts) as season, cast(cast(ts as date) as varchar) as load_date, count(*) as n,
  cast(sum(event_id) as bigint) as ids, count(*) filter (day(ts) % 2 = 1 and props is not null) as with_props,
  cast(sum(case when day(ts) % 2 = 1 then length(event_type) end) as bigint) as letters
from events group by 1, 2""")
def schema_growth(t):
    """Events of even days, then of odd days with two more keys and a wider id: the table has the columns of both."""
    warehouse = new_folder(t.spark, "growth")
    stamped = t.events.withColumns({"season": F.year("ts"), "load_date": F.to_date("ts")})
    odd = F.dayofmonth("ts") % 2 == 1
    path = f"{warehouse}/raw/events"
    write_raw(stamped.filter(~odd).select(F.col("event_id").cast("int").alias("event_id"), "season", "load_date"), path)
    write_raw(stamped.filter(odd).select("props", F.col("event_id").cast("bigint").alias("event_id"), "event_type", "season", "load_date"), path)
    raw = read_raw(t.spark, warehouse, "events")
    return raw.groupBy("season", "load_date").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count("props").alias("with_props"),
        F.sum(F.length("event_type")).alias("letters"),
    )


@query("""select year(o_orderdate) as season, '2025-09-01' as load_date, count(*) as elements,
  cast(sum(o_orderkey) as bigint) as ids from orders group by 1
union all select 2099, '2025-09-02', count(*), cast(sum(o_orderkey) as bigint) from orders""")
def folder_landing(t):
    """A folder of payload files, landed twice as one day with the payloads' own seasons, then as another under a given one."""
    folder, warehouse = new_folder(t.spark, "folder"), new_folder(t.spark, "landed")
    deadline = F.date_format(F.min("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deadline_time")
    stamped = _in_files(t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["month"])
    payloads = stamped.groupBy("month", "_file").agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("id"))).alias("elements"),
        F.array(F.struct(deadline)).alias("events"),
    )
    _write_objects(payloads.drop("_file"), ["month"], folder)
    for day, season in (("2025-09-01", None), ("2025-09-01", None), ("2025-09-02", "2099")):
        land_folder(t.spark, folder, "bootstrap", warehouse, day, season)
    listed = read_raw(t.spark, warehouse, "bootstrap").select("season", "load_date", F.explode("elements").alias("e"))
    return listed.groupBy("season", "load_date").agg(
        F.count("*").alias("elements"), F.sum(pick(F.col("e"), "id", "bigint")).alias("ids")
    )


@query("select c_custkey, cast(c_nationkey as bigint) as c_nationkey, c_name, c_acctbal from customer")
def seed_scan(t):
    """Customers through a CSV file with declared types."""
    folder = new_folder(t.spark, "seed")
    t.customer.select("c_custkey", "c_nationkey", "c_name", "c_acctbal").write.option("header", True).csv(folder)
    return read_seed(t.spark, folder, "c_custkey bigint, c_nationkey int, c_name string, c_acctbal double").select(
        "c_custkey", "c_nationkey", "c_name", "c_acctbal"
    )


@query("""select o_orderpriority as label, count(*) as orders from orders group by 1""")
def required_label(t):
    """A label that must be present on every payload."""
    label = required(F.col("o_orderpriority"), "payload has no label")
    return t.orders.groupBy(label.alias("label")).agg(F.count("*").alias("orders"))
