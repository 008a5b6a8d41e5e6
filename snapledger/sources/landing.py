"""Landing: payloads to partitioned raw tables, with season labels and payload splits."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from snapledger.functions.fields import pick
from snapledger.functions.text import required, season_from_deadline
from snapledger.session import settle
from snapledger.sources.catalog import configured, finished, listed_files, read_source, source

PARTITION_COLUMNS = ("season", "load_date")
# Blocks of a league payload.
LEAGUE_BLOCKS = ("players", "dates", "teams")


def require_blocks(payloads: DataFrame, *blocks: str) -> DataFrame:
    """Fail where a payload block is missing: at once for the column, in the job for a NULL."""
    absent = [b for b in blocks if b not in payloads.columns]
    if absent:
        raise KeyError(f"payload has no block {absent[0]!r}")
    checked = {
        b: F.when(F.col(b).isNotNull(), F.col(b)).otherwise(
            F.raise_error(F.lit(f"payload has no block {b!r}"))
        )
        for b in blocks
    }
    return payloads.withColumns(checked)


def split_league_payload(payloads: DataFrame, keep: tuple[str, ...] = PARTITION_COLUMNS) -> dict[str, DataFrame]:
    """One payload with `players`, `dates` and a `teams` map as three tables, one row per entity.

    The map of team ids flattens to its values, so a new id never adds a column.
    """
    whole = require_blocks(payloads, *LEAGUE_BLOCKS)
    return {
        "season_players": whole.select(*keep, F.explode("players").alias("record")),
        "season_matches": whole.select(*keep, F.explode("dates").alias("record")),
        "season_teams": whole.select(*keep, F.explode(F.map_values("teams")).alias("record")),
    }


def typed_records(records: DataFrame, name: str, keep: tuple[str, ...] = PARTITION_COLUMNS) -> DataFrame:
    """Columns of a source's read schema from `record` VARIANT rows."""
    spec = StructType.fromDDL(source(name).schema)
    columns = [
        F.try_variant_get("record", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in spec
    ]
    return records.select(*columns, *keep)


def payload_season(events: Column, override: str | None = None) -> Column:
    """Season of a payload: the explicit override, or the year of its first event's deadline."""
    return season_from_deadline(pick(F.get(events, F.lit(0)), "deadline_time"), override)


def write_raw(df: DataFrame, path: str, overwrite: str = "dynamic") -> None:
    """Write or replace the partitions present in `df`; "static" replaces the whole table.

    Landing the same day twice gives the same table. The rebalance step merges small files and
    cuts a large partition into several. The table's schema grows with what is landed; see `table_schema`.
    """
    spark = df.sparkSession
    known = None if overwrite == "static" else table_schema(spark, path)
    grown = df.schema if known is None else widened(known, df.schema)
    write_partitions(df.hint("rebalance", *PARTITION_COLUMNS), path, overwrite)
    if grown != known:
        # a record of its own for each growth: landings at the same time keep each other's columns
        line = spark.createDataFrame([(grown.json(),)], "value string").coalesce(1)
        line.write.mode("append").text(f"{path}/{SCHEMAS}")


#: Folder beside a table's partitions that records its schemas; readers pass over names with an underscore.
SCHEMAS = "_schemas"
# Column types and those that hold all their values.
WIDER = {
    ("tinyint", "smallint"), ("tinyint", "int"), ("smallint", "int"), ("tinyint", "bigint"), ("smallint", "bigint"),
    ("int", "bigint"), ("int", "double"), ("float", "double"), ("date", "timestamp_ntz"),
}


def widened(known: StructType, new: StructType) -> StructType:
    """All columns of both schemas, those of the first one before others, in the wider type of the two."""
    out = {f.name: f.dataType for f in known}
    for field in new:
        mine = out.setdefault(field.name, field.dataType)
        if mine != field.dataType and (mine.simpleString(), field.dataType.simpleString()) in WIDER:
            out[field.name] = field.dataType
        elif mine != field.dataType and (field.dataType.simpleString(), mine.simpleString()) not in WIDER:
            raise ValueError(f"column {field.name} is {mine.simpleString()}, landed as {field.dataType.simpleString()}")
    return StructType([StructField(name, kind) for name, kind in out.items()])


def table_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema of a raw table: the union of all that was landed in it; None for a table without a record."""
    records = f"{path}/{SCHEMAS}"
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(records)
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        return None
    # one line for each growth
    lines = sorted((r["value"] for r in spark.read.text(records).collect()), key=len)
    return reduce(widened, (StructType.fromJson(json.loads(line)) for line in lines))


def write_partitions(df: DataFrame, path: str, overwrite: str = "dynamic") -> None:
    """Replace the partitions present in `df`, or with "static" the whole table, by files as `df` deals them."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", overwrite)
    writer.partitionBy(*PARTITION_COLUMNS).parquet(path)


def load_raw(
    spark: SparkSession, root: str, name: str, warehouse: str, feeds: dict[str, str] | None = None
) -> str:
    """Full refresh of one raw table from everything landed for it. Returns the table's path."""
    path = f"{warehouse}/raw/{name}"
    write_raw(read_source(spark, root, name, feeds), path, "static")
    return path


def read_raw(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """A landed raw table; its VARIANT columns are already parsed.

    Rows landed before a column was first seen have NULL there, and those landed with a narrower type are widened.
    """
    path = f"{warehouse}/raw/{name}"
    schema = table_schema(spark, path)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def raw_loads(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """The partitions a raw table has, from its listing."""
    path = f"{warehouse}/raw/{name}"
    return listed_files(spark, f"{path}/season=*/load_date=*", path).select(*PARTITION_COLUMNS).distinct()


def land_folder(
    spark: SparkSession,
    folder: str,
    name: str,
    warehouse: str,
    load_date: str | None = None,
    season: str | None = None,
) -> str:
    """Land a folder of payload files as one partition of a raw table.

    The season is the override, else it is read from the payload (snapshots that list events);
    the load date is the override, else today.
    """
    payloads = finished(configured(spark.read, name, partitioned=False).load(folder), name)
    if season is None and "elements" not in payloads.columns:
        raise ValueError(f"{name} names no season; pass one")
    label = payload_season(F.col("events"), season) if season is None else F.lit(season)
    stamped = payloads.withColumns(
        {
            "season": required(label, "no season").cast("int"),
            "load_date": F.to_date(F.lit(load_date)) if load_date else F.current_date(),
        }
    )
    path = f"{warehouse}/raw/{name}"
    write_raw(stamped, path)
    return path


def land_league_payloads(payloads: DataFrame, warehouse: str) -> dict[str, str]:
    """Land split payloads of any number of seasons in one call. Returns the tables' paths.

    The parsed payloads are stored first, as each of the three tables reads them. That step sees
    every block, so a missing one fails before any table changes.
    """
    paths = {}
    whole = settle(require_blocks(payloads, *LEAGUE_BLOCKS), "payloads")
    for name, records in split_league_payload(whole).items():
        paths[name] = f"{warehouse}/raw/{name}"
        write_raw(typed_records(records, name), paths[name])
    return paths
