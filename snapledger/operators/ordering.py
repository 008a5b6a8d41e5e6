"""Ranks, row numbers and row frames inside groups of any size.

A Spark window puts a whole group into one task. Here rows are range partitioned by (group, order) and stored, so that
a large group is cut into ordered slices of about equal size while small groups share one. Every slice is worked on alone. Only a group
that lies on the edge between two slices is in more than one, so what slices must know of each other is a
small table, at most two rows for each slice:

* row numbers and running sums are shifted by the rows and sums of the slices before;
* ranks are too, and a value that runs on from the slice before keeps the rank it has there;
* row frames reach into neighbouring slices through copies of the few rows beside the edge.

There is one plan for every group size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from snapledger.session import settle

#: Spark keeps only the first rows of a group in every task up to this many (spark.sql.optimizer.windowGroupLimitThreshold).
MOST_PER_GROUP = 1000


class Key(NamedTuple):
    """Order key on a column; NULLs come last in both directions."""

    name: str
    descending: bool = False

    @property
    def sort(self) -> Column:
        column = F.col(self.name)
        return column.desc_nulls_last() if self.descending else column.asc_nulls_last()

    @property
    def reverse(self) -> Column:
        column = F.col(self.name)
        return column.asc_nulls_first() if self.descending else column.desc_nulls_first()


def up(name: str) -> Key:
    return Key(name)


def down(name: str) -> Key:
    return Key(name, True)


def sorts(order: Sequence[Key]) -> list[Column]:
    return [key.sort for key in order]


def ordered(group: Sequence[str], order: Sequence[Key]) -> WindowSpec:
    return Window.partitionBy(*group).orderBy(*sorts(order))


def null_safe(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equality of columns on two aliases, where NULL equals NULL."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def _sliced(df: DataFrame, group: Sequence[str], order: Sequence[Key]) -> DataFrame:
    """`df` with `_slice`: ordered slices, frozen on shared storage. `order` must be unique for a group to be cut anywhere."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *[F.col(g) for g in group], *sorts(order))
    return settle(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def _portions(sliced: DataFrame, group: Sequence[str]) -> DataFrame:
    """The slices of groups that lie in several: rows here (`_n`), before (`_start`) and in all (`_size`), and the
    number of the slice in its group (`_nth`). At most two rows for each slice: its first and its last group.
    """
    sizes = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    along = whole.orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumns(
        {
            "_nth": F.row_number().over(along),
            "_start": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_size": F.sum("_n").over(whole),
        }
    )
    return placed.filter(F.col("_size") > F.col("_n"))


def _beside(sliced: DataFrame, portions: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "left") -> DataFrame:
    """`sliced` with `columns` of the portions, which are few enough to broadcast."""
    joined = sliced.alias("s").join(F.broadcast(portions).alias("t"), null_safe("s", "t", keys), how)
    return joined.select("s.*", *[f"t.{c}" for c in columns])


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Key], out: str) -> DataFrame:
    """1, 2, … inside each group. `order` must be unique within a group."""
    sliced = _sliced(df, group, order)
    placed = _beside(sliced, _portions(sliced, group), [*group, "_slice"], ["_start"])
    local = F.row_number().over(ordered([*group, "_slice"], order))
    return placed.withColumn(out, (F.coalesce("_start", F.lit(0)) + local).cast("bigint")).drop("_slice", "_start")


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Key], value: str, out: str) -> DataFrame:
    """Sum of `value`, whole numbers, over the rows of the group before this one. Rows equal in `order` follow each other."""
    sliced = _sliced(df, group, order)
    here = [*group, "_slice"]
    sums = sliced.groupBy(*here).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    along = Window.partitionBy(*group).orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumns({"_nth": F.row_number().over(along), "_start": F.coalesce(F.sum("_sum").over(before), F.lit(0))})
    # all but a group's first slice: at most one row for each slice
    placed = _beside(sliced, starts.filter(F.col("_nth") > 1), here, ["_start"])
    inside = ordered(here, order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return placed.withColumn(out, (F.coalesce("_start", F.lit(0)) + local).cast("bigint")).drop("_slice", "_start")


def running_min(df: DataFrame, group: Sequence[str], order: Sequence[Key], value: str, out: str) -> DataFrame:
    """Smallest `value` of the rows of the group up to this one, NULLs aside. `order` must be unique within a group."""
    sliced = _sliced(df, group, order)
    here = [*group, "_slice"]
    least = sliced.groupBy(*here).agg(F.min(value).alias("_least"))
    along = Window.partitionBy(*group).orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = least.withColumns({"_nth": F.row_number().over(along), "_start": F.min("_least").over(before)})
    # all but a group's first slice: at most one row for each slice
    placed = _beside(sliced, starts.filter(F.col("_nth") > 1), here, ["_start"])
    inside = ordered(here, order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(out, F.least("_start", F.min(value).over(inside))).drop("_slice", "_start")


def ranks(
    df: DataFrame,
    group: Sequence[str],
    signals: dict[str, Key],
    kind: str = "percent_rank",
    eligible: Mapping[str, Column] | None = None,
    by: str | None = None,
) -> DataFrame:
    """Add one rank column per entry of `signals` (output name -> order key).

    `kind` is "rank" (1 + rows that come strictly before) or "percent_rank" (that, minus 1,
    over the group size minus 1; 0 in a group of one). `eligible` may name the rows that take part in a signal; others
    have NULL there. All signals are ranked in one pass: a row has an entry for each. With several signals the entries hold
    nothing else, and the stored rows meet their ranks once; they do so partitioned by the column `by`, if given, for a
    window over it that follows. With one signal its entry carries the other columns.
    """
    keys = [f"_k{i}" for i in range(len(signals))]
    order = [Key(k, key.descending) for k, key in zip(keys, signals.values())]
    types = {f.name: f.dataType for f in df.schema}
    single = len(signals) == 1
    entries = []
    for i, (out, key) in enumerate(signals.items()):
        counted = F.coalesce((eligible or {}).get(out, F.lit(True)), F.lit(False))
        values = [
            (F.col(key.name) if i == j else F.lit(None).cast(types[other.name])).alias(keys[j])
            for j, other in enumerate(signals.values())
        ]
        rest = [F.struct(*[F.col(c) for c in df.columns]).alias("_rest")] if single else []
        entry = F.struct(F.lit(i).alias("_signal"), counted.alias("_counted"), *values, *rest)
        entries.append(entry if single else F.when(counted, entry))
    # ids are given before rows are listed several times
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    if not single:
        rows = settle(rows, "ranked")
    spread = [] if by is None or by in group else [by]
    listed = rows.select(*group, *spread, "_row", F.explode(F.array_compact(F.array(*entries))).alias("_e"))
    apart = [*group, "_signal", "_counted"]
    sliced = _sliced(listed.select(*group, *spread, "_row", "_e.*"), apart, [*order, up("_row")])
    here = [*apart, "_slice"]
    local, among = F.rank().over(ordered(here, order)), F.count("*").over(Window.partitionBy(*here))
    edges = _edges(sliced, apart, order)
    placed = _beside(sliced, edges, here, ["_start", "_size", "_first"]).withColumns({"_local": local, "_among": among})
    rank = F.when(F.col("_local") == 1, F.coalesce("_first", F.lit(1))).otherwise(F.coalesce("_start", F.lit(0)) + F.col("_local"))
    if kind == "rank":
        value = rank.cast("bigint")
    else:
        size = F.coalesce("_size", "_among")
        value = F.when(size > 1, (rank - 1) / (size - 1)).otherwise(F.lit(0.0))
    value = F.when(F.col("_counted"), value)
    if single:
        return placed.select("_rest.*", value.alias(next(iter(signals))))
    whole = ["_row"] if by is None else [by, "_row"]
    valued = placed.select(*whole, "_signal", value.alias("_value"))
    rest = rows.select(*whole, F.struct(*[F.col(c) for c in df.columns]).alias("_rest"))
    met = rest.unionByName(valued, allowMissingColumns=True)
    met = met if by is None else met.repartition(by)
    found = [F.max(F.when(F.col("_signal") == i, F.col("_value"))).alias(out) for i, out in enumerate(signals)]
    told = met.groupBy(*whole).agg(F.first("_rest", ignorenulls=True).alias("_rest"), *found)
    # the grouped column itself, which tells Spark how the rows lie
    return told.select(*[F.col(c) if c == by else F.col("_rest")[c].alias(c) for c in df.columns], *signals)


def _edges(sliced: DataFrame, group: Sequence[str], order: Sequence[Key]) -> DataFrame:
    """The portions with `_first`: the rank of a slice's first value, which may run on from slices before."""
    here = [*group, "_slice"]
    spanning = _beside(sliced, _portions(sliced, group), here, ["_start", "_size"], "inner")
    ranked = spanning.withColumn("_local", F.rank().over(ordered(here, order)))
    value = F.struct(*[F.col(key.name) for key in order])
    ends = ranked.groupBy(*here, "_start", "_size").agg(
        F.min_by(value, "_local").alias("_head"), F.max_by(value, "_local").alias("_tail"), F.max("_local").alias("_last")
    )
    along = Window.partitionBy(*group).orderBy("_slice")
    ends = ends.withColumn("_runs_on", F.coalesce(F.col("_head") == F.lag("_tail").over(along), F.lit(False)))
    # the rank of the last value, unless it is the only one and runs on
    own = F.when((F.col("_last") > 1) | ~F.col("_runs_on"), F.col("_start") + F.col("_last"))
    ends = ends.withColumn("_tail_rank", F.last(own, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("_runs_on"), F.lag("_tail_rank").over(along)).otherwise(F.col("_start") + 1)
    return ends.withColumn("_first", first).select(*here, "_start", "_size", "_first")


def over_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Key],
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    number: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add window columns that look at most `before` rows back and `after` rows ahead.

    `columns` receives the ordered window; `order` must be unique within a group. A slice also receives copies of the rows of its
    neighbours that its frames reach, which are dropped afterwards. `bounded` states that the grain already bounds the
    group (one row per entity and date), so that it needs no slices.
    """
    if bounded:
        window = ordered(group, order)
        added = dict(columns(window))
        if number:
            added[number] = F.row_number().over(window).cast("bigint")
        return df.withColumns(added)
    sliced = _sliced(df, group, order)
    here = [*group, "_slice"]
    portions = settle(_portions(sliced, group), "portions")
    own = _beside(sliced, portions, here, ["_start"]).withColumn("_home", F.lit(True))
    edge = _beside(sliced, portions, here, ["_nth", "_start", "_n"], "inner")
    for reach, ahead in ((before, False), (after, True)):
        if reach:
            own = own.unionByName(_copies(edge, portions, group, order, reach, ahead).select(own.columns))
    window = ordered(here, order)
    added = dict(columns(window))
    if number:
        nth = F.count_if("_home").over(window.rowsBetween(Window.unboundedPreceding, 0))
        added[number] = (F.coalesce("_start", F.lit(0)) + nth).cast("bigint")
    return own.withColumns(added).filter("_home").drop("_slice", "_start", "_home")


def _copies(
    edge: DataFrame, portions: DataFrame, group: Sequence[str], order: Sequence[Key], reach: int, ahead: bool
) -> DataFrame:
    """Copies of rows for other slices of their group: the first rows of a slice for those before it, to be looked
    at `ahead`, or the last ones for those after it. A slice may be shorter than the reach, so a copy may go further
    than to the next one.
    """
    side = [key.sort if ahead else key.reverse for key in order]
    place = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*side))
    near = edge.withColumn("_place", place).filter(F.col("_place") <= reach)
    # rows of the group up to this one, itself included
    upto = F.col("_start") + (F.col("_place") if ahead else F.col("_n") - F.col("_place") + 1)
    near = near.withColumns({"_upto": upto, "_step": F.explode(F.sequence(F.lit(1), F.lit(reach)))})
    near = near.withColumn("_nth", F.col("_nth") + F.col("_step") * F.lit(-1 if ahead else 1))
    targets = portions.select(*group, "_nth", F.col("_slice").alias("_to"), F.col("_start").alias("_from"), F.col("_n").alias("_rows"))
    met = near.alias("s").join(F.broadcast(targets).alias("t"), null_safe("s", "t", [*group, "_nth"]))
    gap = F.col("_upto") - F.col("_from") - F.col("_rows") if ahead else F.col("_from") - F.col("_upto") + 1
    kept = met.filter(gap <= reach).select("s.*", "t._to")
    return kept.drop("_slice").withColumnsRenamed({"_to": "_slice"}).withColumn("_home", F.lit(False))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Key], k: int = 1) -> DataFrame:
    """First `k` rows of each group; `order` must be unique within a group.

    Every task keeps `k` rows per group before the shuffle, which Spark does for lists up to MOST_PER_GROUP.
    Number the rows with `row_numbers` for longer ones.
    """
    if k > MOST_PER_GROUP:
        raise ValueError(f"lists per group have at most {MOST_PER_GROUP} rows, not {k}")
    place = F.row_number().over(ordered(group, order))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def top(df: DataFrame, order: Sequence[Key], k: int = 1) -> DataFrame:
    """First `k` rows overall."""
    return df.orderBy(*sorts(order)).limit(k)
