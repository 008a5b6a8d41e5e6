import json

import pytest
from pyspark.sql import functions as F

from snapledger import session
from snapledger.operators import snapshots
from snapledger.plans.registry import Context
from snapledger.sources import catalog, landing
from snapledger.streaming.landing import land_new_files, stream_source
from tests import tree


@pytest.mark.parametrize("name", list(catalog.SOURCES))
def test_globs_keep_their_partitions(name):
    pattern = catalog.source(name).glob("root")
    assert "season=" in pattern and "load_date=" in pattern


def test_unknown_source_fails_first(spark):
    with pytest.raises(KeyError):
        catalog.read_source(spark, "/no/such/folder", "not_a_source")


def test_read_source(spark, landed):
    fixtures = catalog.read_source(spark, landed, "fixtures")
    assert fixtures.count() == 20
    types = dict(fixtures.dtypes)
    assert types["season"] == "int" and types["load_date"] == "date"
    assert fixtures.filter(F.col("load_date") == tree.DAY2).count() == 10
    assert catalog.read_source(spark, landed, "match_calendar").count() == 1


def test_partition_filter_prunes_files(spark, landed):
    pruned = catalog.read_source(spark, landed, "fixtures").filter(F.col("load_date") == tree.DAY2)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in plan


def test_load_raw_round_trip(spark, landed, tmp_path):
    path = landing.load_raw(spark, landed, "bootstrap", str(tmp_path))
    landing.load_raw(spark, landed, "bootstrap", str(tmp_path))
    stored = landing.read_raw(spark, str(tmp_path), "bootstrap")
    assert stored.inputFiles()[0].startswith("file://" + path)
    assert stored.count() == 2
    assert stored.select(F.explode("elements")).count() == 25


def test_land_folder_is_idempotent(spark, tmp_path):
    folder = tmp_path / "incoming"
    tree.dump(folder / "snapshot.json", tree.bootstrap(tree.DAY1))
    for day in (tree.DAY1, tree.DAY2, tree.DAY2):
        path = landing.land_folder(spark, str(folder), "bootstrap", str(tmp_path / "w"), day)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and {r.season for r in stored.select("season").collect()} == {2025}
    path = landing.land_folder(spark, str(folder), "bootstrap", str(tmp_path / "w"), tree.DAY1, season="2030")
    assert {r.season for r in spark.read.parquet(path).select("season").collect()} == {2025, 2030}
    path = landing.land_folder(spark, str(folder), "bootstrap", str(tmp_path / "today"))
    assert spark.read.parquet(path).filter("load_date >= date '2025-01-01'").count() == 1


def test_land_folder_without_a_season(spark, tmp_path):
    tree.dump(tmp_path / "in" / "1.json", tree.MATCHES[501])
    with pytest.raises(ValueError):
        landing.land_folder(spark, str(tmp_path / "in"), "match_payloads", str(tmp_path), tree.DAY1)
    empty = {**tree.bootstrap(tree.DAY1), "events": []}
    tree.dump(tmp_path / "empty" / "1.json", empty)
    with pytest.raises(Exception, match="deadline"):
        landing.land_folder(spark, str(tmp_path / "empty"), "bootstrap", str(tmp_path), tree.DAY1)


PAYLOAD = "players array<variant>, dates array<variant>, teams map<string,variant>, season int, load_date date"


def payloads(spark, tmp_path, *records):
    path = tmp_path / "league.json"
    path.write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")
    return spark.read.schema(PAYLOAD).json(str(path))


def test_split_league_payload(spark, tmp_path):
    stamp = {"load_date": tree.DAY2}
    df = payloads(spark, tmp_path, {**tree.LEAGUE, **stamp, "season": 2024}, {**tree.LEAGUE, **stamp, "season": 2025})
    split = landing.split_league_payload(df)
    assert {name: d.count() for name, d in split.items()} == {
        "season_players": 16, "season_matches": 4, "season_teams": 4,
    }
    paths = landing.land_league_payloads(df, str(tmp_path / "w"))
    stored = spark.read.parquet(paths["season_teams"])
    assert {r.season for r in stored.select("season").distinct().collect()} == {2024, 2025}
    assert stored.filter("season = 2025").select(F.explode("history")).count() == 2
    direct = spark.read.parquet(paths["season_players"]).filter("id = '204'").first()
    assert direct.npxG == "6.5" and direct.time == "1800"


def test_missing_block_fails(spark, tmp_path):
    df = payloads(spark, tmp_path, {"players": [], "teams": {}, "season": 2025, "load_date": tree.DAY1})
    with pytest.raises(Exception, match="dates"):
        landing.split_league_payload(df)["season_matches"].collect()
    with pytest.raises(Exception, match="dates"):
        landing.land_league_payloads(df, str(tmp_path / "w"))
    assert not (tmp_path / "w").exists()
    with pytest.raises(KeyError):
        landing.require_blocks(df.drop("dates"), "players", "dates")


def test_incremental_landing_equals_batch(spark, tmp_path):
    root, table, mark = tmp_path / "tree", str(tmp_path / "table"), str(tmp_path / "mark")

    def read(session):
        return catalog.read_source(session, str(root), "bootstrap")

    def files(session):
        return catalog.source_files(session, str(root), "bootstrap")

    def land(**options):
        land_new_files(stream_source(spark, str(root), "bootstrap", **options), read, files, table, mark)

    def dump(day, **changes):
        base = root / "game" / "season=2025" / f"load_date={day}"
        tree.dump(base / "bootstrap_static.json", {**tree.bootstrap(day), **changes})

    def same():
        flat = [F.col("load_date"), F.col("season"), F.to_json("elements").alias("e"), "filename"]
        stored = spark.read.parquet(table).select(*flat).collect()
        assert sorted(stored) == sorted(read(spark).select(*flat).collect())
        return stored

    for day in (tree.DAY1, tree.DAY2):
        dump(day)
        land()
    land(files_per_batch=1)
    assert len(same()) == 2
    dump(tree.DAY1, elements=[{"id": 1}])
    land()
    assert '[{"id":1}]' in [r.e for r in same()]
    # a batch may write to the same table
    landing.write_raw(read(spark).filter(F.col("load_date") == tree.DAY2), table)
    assert len(same()) == 2
    before = sorted(f for f in spark.read.parquet(table).inputFiles())
    land()
    assert sorted(spark.read.parquet(table).inputFiles()) == before


def test_listing_opens_no_file(spark, tmp_path):
    for day in (tree.DAY1, tree.DAY2):
        broken = tmp_path / f"game/season=2025/load_date={day}/fixtures.json"
        broken.parent.mkdir(parents=True)
        broken.write_text("[{ no json", encoding="utf-8")
    listed = catalog.source_files(spark, str(tmp_path), "fixtures")
    assert [str(r.load_date) for r in listed.orderBy("load_date").collect()] == [tree.DAY1, tree.DAY2]
    assert "json" not in listed._jdf.queryExecution().executedPlan().toString().split("Location")[0].lower()


def test_newest_loads_scan_their_folders_only(spark, tmp_path):
    rows = [(2024, "2024-05-01", 1), (2024, "2024-06-01", 2), (2025, "2025-01-01", 3), (2025, "2025-02-01", 4), (2025, "2025-02-01", 5)]
    df = spark.createDataFrame(rows, "season int, d string, id int").withColumn("load_date", F.to_date("d")).drop("d")
    landing.write_raw(df, f"{tmp_path}/raw/things")
    raw = landing.read_raw(spark, str(tmp_path), "things")
    newest = snapshots.newest_loads(raw, landing.raw_loads(spark, str(tmp_path), "things"), ["season"])
    assert sorted(r.id for r in newest.collect()) == [2, 4, 5]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "PartitionFilters: [concat_ws" in plan and "Join" not in plan
    assert newest.select(F.input_file_name()).distinct().count() <= 3
    assert snapshots.newest_loads(raw, landing.raw_loads(spark, str(tmp_path), "things").limit(0), ["season"]).count() == 0


def test_partitions_without_a_value(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (4, 3)], "season int, id int")
    chosen = df.filter("id < 3").select("season").collect()
    assert sorted(r.id for r in df.filter(snapshots.of_partitions(chosen)).collect()) == [1, 2]


def test_schema_grows_with_what_is_landed(spark, tmp_path):
    path = f"{tmp_path}/raw/grown"
    day = lambda d: F.to_date(F.lit(d)).alias("load_date")
    season = F.lit(2025).alias("season")
    landing.write_raw(spark.range(2).select(F.col("id").cast("int").alias("id"), season, day("2025-01-01")), path)
    assert landing.read_raw(spark, str(tmp_path), "grown").columns == ["id", "season", "load_date"]
    landing.write_raw(spark.range(5, 7).select("id", F.lit("x").alias("note"), season, day("2025-01-02")), path)
    landing.write_raw(spark.range(9, 10).select(F.col("id").cast("int").alias("id"), season, day("2025-01-03")), path)
    read = landing.read_raw(spark, str(tmp_path), "grown")
    assert dict(read.dtypes) == {"id": "bigint", "note": "string", "season": "int", "load_date": "date"}
    assert sorted((r.id, r.note) for r in read.collect()) == [(0, None), (1, None), (5, "x"), (6, "x"), (9, None)]
    with pytest.raises(ValueError, match="column note is string"):
        landing.write_raw(spark.range(1).select("id", F.lit(1.5).alias("note"), season, day("2025-01-04")), path)
    assert landing.read_raw(spark, str(tmp_path), "grown").count() == 5
    landing.write_raw(spark.range(1).select("id", season, day("2025-01-04")), path, "static")
    assert landing.read_raw(spark, str(tmp_path), "grown").columns == ["id", "season", "load_date"]


def test_malformed_file_fails(spark, tmp_path):
    tree.dump(tmp_path / "game/season=2025/load_date=2025-09-01/fixtures.json", tree.fixture_list())
    broken = tmp_path / "game/season=2025/load_date=2025-09-02/fixtures.json"
    broken.parent.mkdir(parents=True)
    broken.write_text('[{"id": 1, "cod', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        catalog.read_source(spark, str(tmp_path), "fixtures").collect()


def test_models_read_raw_tables(spark, ctx, landed, tmp_path):
    warehouse = str(tmp_path)
    for name in ("bootstrap", "fixtures", "match_payloads", "season_players", "season_teams"):
        landing.load_raw(spark, landed, name, warehouse)
    raw = Context(
        spark, lambda name: landing.read_raw(spark, warehouse, name), loads=lambda name: landing.raw_loads(spark, warehouse, name)
    )
    for name in ("players", "league_table", "matches", "match_players", "season_players", "season_team_matches"):
        assert sorted(map(str, raw.ref(name).collect())) == sorted(map(str, ctx.ref(name).collect()))
    assert raw.ref("match_events").count() == ctx.ref("match_events").count()


def test_feeds_rename_folders(spark, tmp_path):
    tree.dump(tmp_path / "other/season=2025/load_date=2025-09-01/fixtures.json", tree.fixture_list())
    assert catalog.read_source(spark, str(tmp_path), "fixtures", {"game": "other"}).count() == 10


def test_scratch_is_shared_and_clearable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_dir", lambda _: str(tmp_path))
    kept = session.settle(spark.range(5), "numbers")
    assert kept.count() == 5 and kept.inputFiles()[0].startswith(f"file://{tmp_path}/snapledger/")
    session.clear_scratch(spark)
    assert list((tmp_path / "snapledger").iterdir()) == []


def test_scratch_follows_the_cluster_setting(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if setting:
        assert session.scratch_dir(spark) == setting


def test_land_calendar_pages(spark, tmp_path):
    tree.dump(tmp_path / "in" / "page.json", {"any": {"2025": [1, 2]}})
    path = landing.land_folder(spark, str(tmp_path / "in"), "match_calendar", str(tmp_path), tree.DAY1, season="2025")
    page = spark.read.parquet(path).select(F.try_variant_get("payload", "$.any.2025[1]", "int").alias("v"), "season")
    assert [tuple(r) for r in page.collect()] == [(2, 2025)]
