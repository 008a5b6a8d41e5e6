"""The landed JSON sources: where they lie, how they are typed, how they are read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the landed files and of the blocks inside them. Nested blocks whose
# keys vary stay VARIANT, so no read infers a schema and none widens with the data.
PARTITIONS = "season int, load_date date"
TREE = "season=*/load_date=*"


class Source(NamedTuple):
    """A raw table: the feed folder it lies in, its file pattern and its read schema."""

    feed: str
    files: str
    schema: str

    def glob(self, root: str, feeds: dict[str, str] | None = None) -> str:
        return f"{self.base(root, feeds)}/{TREE}/{self.files}"

    def base(self, root: str, feeds: dict[str, str] | None = None) -> str:
        return f"{root}/{(feeds or {}).get(self.feed, self.feed)}"


SOURCES = {
    "bootstrap": Source(
        "game",
        "bootstrap_static.json",
        "elements array<variant>, teams array<variant>, element_types array<variant>, events array<variant>",
    ),
    "fixtures": Source(
        "game",
        "fixtures.json",
        "id variant, code variant, event variant, team_h variant, team_a variant, team_h_score variant, "
        "team_a_score variant, team_h_difficulty variant, team_a_difficulty variant, kickoff_time variant, "
        "started variant, finished variant, minutes variant",
    ),
    "match_payloads": Source(
        "matchcentre/events",
        "*.json",
        "startDate string, home struct<teamId:variant,name:string>, away struct<teamId:variant,name:string>, "
        "ftScore string, attendance int, venueName string, events array<variant>, "
        "playerIdNameDictionary map<string,string>",
    ),
    "match_calendar": Source("matchcentre/matches", "*.json", "payload variant"),
    "season_players": Source(
        "seasonstats",
        "players.json",
        "id string, player_name string, team_title string, position string, games string, time string, "
        "goals string, npg string, assists string, shots string, key_passes string, xG string, npxG string, "
        "xA string, xGChain string, xGBuildup string, yellow_cards string, red_cards string",
    ),
    "season_matches": Source(
        "seasonstats",
        "matches.json",
        "id string, datetime string, isResult boolean, h struct<id:string,title:string>, "
        "a struct<id:string,title:string>, goals struct<h:string,a:string>, xG struct<h:string,a:string>",
    ),
    "season_teams": Source("seasonstats", "teams.json", "id string, title string, history array<variant>"),
}

# Sources whose whole file is kept as one VARIANT.
WHOLE_FILE = ("match_calendar",)


def source(name: str) -> Source:
    """Registered source; an unknown name fails here, before any read."""
    return SOURCES[name]


def configured(reader, name: str, partitioned: bool = True):
    """Reader (batch or streaming) with a source's format, options and schema.

    One JSON file holds one object or one top-level array; an array yields one row per element.
    A malformed file fails the read instead of turning into NULLs.
    """
    columns = "value string" if name in WHOLE_FILE else source(name).schema
    reader = reader.schema(f"{columns}, {PARTITIONS}" if partitioned else columns)
    if name in WHOLE_FILE:
        return reader.format("text").options(wholetext="true")
    return reader.format("json").options(multiLine="true", mode="FAILFAST")


def finished(df: DataFrame, name: str) -> DataFrame:
    """Columns every source has besides its own: the partitions and `filename`."""
    df = df.withColumn("filename", F.col("_metadata.file_path"))
    if name in WHOLE_FILE:
        df = df.withColumn("payload", F.parse_json("value")).drop("value")
    return df


def read_source(spark: SparkSession, root: str, name: str, feeds: dict[str, str] | None = None) -> DataFrame:
    """All landed snapshots of a source, with `filename`, `season` and `load_date`.

    Missing keys read as NULL, so files of different age merge by name. `feeds` renames feed
    folders of an existing tree.
    """
    entry = source(name)
    reader = configured(spark.read, name).option("basePath", entry.base(root, feeds))
    return finished(reader.load(entry.glob(root, feeds)), name)


def listed_files(spark: SparkSession, glob: str, base: str) -> DataFrame:
    """`filename`, `modified` and the partition columns of the files of a tree, from its listing: no file is opened."""
    files = spark.read.format("binaryFile").option("basePath", base).load(glob)
    names = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select(F.col("path").alias("filename"), F.col("modificationTime").alias("modified"), *names)


def source_files(spark: SparkSession, root: str, name: str, feeds: dict[str, str] | None = None) -> DataFrame:
    """The landed files of a source, from their listing."""
    entry = source(name)
    return listed_files(spark, entry.glob(root, feeds), entry.base(root, feeds))


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small CSV table with declared column types."""
    return spark.read.schema(schema).option("header", True).csv(path)


# Fixed value: column types of the override seed.
OVERRIDES_SCHEMA = "player_ud_id int, player_code int, note string"
