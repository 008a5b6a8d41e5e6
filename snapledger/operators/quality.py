"""Data-quality checks. Each returns the rows that break a rule; an empty result passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class TableChecks(NamedTuple):
    """All checks of one table that need no other: rows, keys and balances, each by its name."""

    rows: Mapping[str, Column]  # what a broken row fulfils
    keys: Mapping[str, Sequence[str]]  # columns that must be unique together; a null in one takes a row out if it is the only one
    balances: Mapping[str, tuple[Sequence[str], str, str]]  # group, and two measures that must cancel out


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def grain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def unique(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values held by more than one row."""
    return grain(df.filter(F.col(column).isNotNull()), [column])


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list; NULL passes."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    keys = parent.select(F.col(parent_column).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def balance(df: DataFrame, group: Sequence[str], plus: str, minus: str) -> DataFrame:
    """Groups in which two measures that must cancel out do not."""
    totals = df.groupBy(*group).agg(F.sum(plus).alias("total_plus"), F.sum(minus).alias("total_minus"))
    return totals.filter("total_plus != total_minus")


def totals_agree(left: DataFrame, left_total: Column, right: DataFrame, right_total: Column) -> DataFrame:
    """One row when two totals of one source differ. Both are single-row aggregates."""
    total = right.agg(right_total.alias("right_total")).scalar()
    both = left.agg(left_total.alias("left_total")).withColumn("right_total", total)
    return both.filter("left_total != right_total")


def groups_agree(
    left: DataFrame, left_total: Column, right: DataFrame, right_total: Column, keys: Sequence[str]
) -> DataFrame:
    """Groups both sides cover whose totals differ."""
    first = left.groupBy(*keys).agg(left_total.alias("left_total"))
    second = right.groupBy(*keys).agg(right_total.alias("right_total"))
    return first.join(second, list(keys)).filter("left_total != right_total")


def violations(name: str, broken: DataFrame) -> DataFrame:
    """A check as one row: its name and the number of rows that break it."""
    return broken.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def counted(broken: Column) -> Column:
    return F.count_if(F.coalesce(broken, F.lit(False)))


def _named(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """One row for each aggregate: its name and value."""
    rows = F.array(*[F.struct(F.lit(name).alias("check"), value.cast("bigint").alias("violations")) for name, value in counts.items()])
    return df.agg(F.explode(rows).alias("row")).select("row.*")


def run_checks(df: DataFrame, checks: TableChecks) -> DataFrame:
    """All checks of a table: its name and the number of violations each, from one scan and one job.

    Every row is listed once for all row checks together, once for each key and once for each balance; one grouping, combined before the
    shuffle, serves all of them. Row checks count broken rows, keys the values held by several rows, balances the groups
    that do not cancel out.
    """
    def same(values: Sequence[str]) -> Column:
        return F.to_json(F.struct(*[F.col(c) for c in values]), {"ignoreNullFields": "false"})

    broken = F.filter(
        F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in checks.rows.items()] or [F.lit(None).cast("string")]),
        lambda name: name.isNotNull(),
    )
    nothing = F.lit(0).cast("decimal(38,6)")
    zero = F.lit(0).cast("bigint")
    entries = [
        F.transform(broken, lambda name: F.struct(name.alias("check"), F.lit("").alias("value"), nothing.alias("more"))),
    ]
    for name, columns in checks.keys.items():
        known = F.col(columns[0]).isNotNull() if len(columns) == 1 else F.lit(True)
        entry = F.struct(F.lit(name).alias("check"), same(columns).alias("value"), nothing.alias("more"))
        entries.append(F.when(known, F.array(entry)).otherwise(F.array().cast("array<struct<check:string,value:string,more:decimal(38,6)>>")))
    for name, (group, plus, minus) in checks.balances.items():
        more = (F.coalesce(plus, zero) - F.coalesce(minus, zero)).cast("decimal(38,6)")
        entries.append(F.array(F.struct(F.lit(name).alias("check"), same(group).alias("value"), more.alias("more"))))
    listed = df.select(F.explode(F.concat(*entries)).alias("e")).select("e.*")
    groups = listed.groupBy("check", "value").agg(F.count("*").alias("n"), F.sum("more").alias("more"))

    def named(names) -> Column:
        return F.col("check").isin(*names) if names else F.lit(False)

    bad = F.when(named(checks.rows), F.col("n")).when(named(checks.keys), (F.col("n") > 1).cast("bigint")).otherwise(
        (F.col("more") != 0).cast("bigint")
    )
    names = [*checks.rows, *checks.keys, *checks.balances]
    # a check without a row to look at has no violations
    return _named(groups, {name: F.coalesce(F.sum(F.when(F.col("check") == name, bad)), zero) for name in names})


def observed(df: DataFrame, checks: TableChecks) -> tuple[DataFrame, Observation]:
    """The table, and an observation of its row checks that is filled while whatever uses the table runs once."""
    seen = Observation()
    return df.observe(seen, *[counted(rule).alias(name) for name, rule in checks.rows.items()]), seen
