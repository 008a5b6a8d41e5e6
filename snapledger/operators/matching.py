"""Deterministic matching of entities that share no identifier."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.session import settle


class Rung(NamedTuple):
    """One exact rule: the key column on each side and the label its pairs carry.

    `takes_ambiguous` removes ids from the later rungs whose key exists on both sides but not
    once on each. Without it such ids go on to the next rung.
    """

    label: str
    left_key: str
    right_key: str
    takes_ambiguous: bool = False


def common_value(df: DataFrame, key: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key, the lowest one on a tie, over pre-aggregated counts."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(*key).agg(best.alias("_best")).select(*key, F.col("_best.v").alias(out))


def entity_names(raw: DataFrame, map_col: str, payload_id: str, id_type: str = "int") -> DataFrame:
    """Entities named in an id -> name map on each payload: usual name, number of payloads."""
    entries = raw.select(payload_id, F.explode(map_col).alias("_id", "_name")).select(
        payload_id, F.col("_id").try_cast(id_type).alias("entity_id"), F.col("_name").alias("name")
    )
    named = common_value(entries, ["entity_id"], "name", "entity_name")
    seen = entries.groupBy("entity_id").agg(F.count_distinct(payload_id).alias("appearances"))
    return seen.join(named, "entity_id", "left").select("entity_id", "entity_name", "appearances")


def _key_groups(side: DataFrame, key: str, id_col: str, prefix: str) -> DataFrame:
    """Per key value: how many ids hold it and the one id that matters when it is a single one."""
    return (
        side.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.count("*").alias(f"{prefix}_n"), F.min(id_col).alias(f"{prefix}_id"))
    )


def _meet(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rung: Rung) -> DataFrame:
    """Key values present on both sides. Counted before the join, so a shared name stays one row."""
    return _key_groups(left, rung.left_key, left_id, "l").join(
        _key_groups(right, rung.right_key, right_id, "r"), "_key"
    )


def ambiguous_keys(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rung: Rung) -> DataFrame:
    """Key values a rung refuses to pair, with the number of ids that hold them."""
    shared = _meet(left, right, left_id, right_id, rung).filter((F.col("l_n") > 1) | (F.col("r_n") > 1))
    return shared.select(
        F.lit(rung.label).alias("match_rule"),
        F.col("_key").alias("name_key"),
        F.col("l_n").alias("n_left"),
        F.col("r_n").alias("n_right"),
    )


def match_ladder(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, rungs: Sequence[Rung]
) -> DataFrame:
    """Pairs (left id, right id, match_rule) from an ordered list of exact rules.

    Each rung sees only ids the rungs above left unmatched, and pairs a key only when exactly
    one remaining id holds it on either side. Both sides must have one row per id. The keys are
    computed once and stored, as every rung reads them; each rung's pairs are stored before the
    next, so the plan of a rung does not contain the others.
    """
    left = settle(left.select(left_id, *dict.fromkeys(r.left_key for r in rungs)), "ladder-left")
    right = settle(right.select(right_id, *dict.fromkeys(r.right_key for r in rungs)), "ladder-right")
    pairs: list[DataFrame] = []
    for position, rung in enumerate(rungs):
        met = _meet(left, right, left_id, right_id, rung)
        single = (F.col("l_n") == 1) & (F.col("r_n") == 1)
        matched = met.filter(single).select(
            F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), F.lit(rung.label).alias("match_rule")
        )
        last = position == len(rungs) - 1
        if not last:
            matched = settle(matched, f"rung-{rung.label}")
            if rung.takes_ambiguous:
                taken = settle(met.filter(~single).select("_key"), f"taken-{rung.label}")
                left = left.join(
                    taken.withColumnRenamed("_key", rung.left_key), rung.left_key, "left_anti"
                )
                right = right.join(
                    taken.withColumnRenamed("_key", rung.right_key), rung.right_key, "left_anti"
                )
            left = left.join(matched, left_id, "left_anti")
            right = right.join(matched, right_id, "left_anti")
        pairs.append(matched)
    return reduce(DataFrame.unionByName, pairs)


def apply_overrides(
    ladder: DataFrame,
    overrides: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    stable_key: str,
    label: str = "manual",
) -> DataFrame:
    """Hand-verified pairs win over ladder pairs on either id; the stable key is attached.

    Overrides are keyed by the stable key; those it no longer resolves are left out.
    """
    codes = right.select(right_id, stable_key)
    resolved = overrides.join(codes, stable_key).select(
        left_id, right_id, F.lit(label).alias("match_rule")
    )
    kept = ladder.join(resolved, left_id, "left_anti").join(resolved, right_id, "left_anti")
    return resolved.unionByName(kept).join(codes, right_id).select(
        left_id, right_id, stable_key, "match_rule"
    )


def match_coverage(side: DataFrame, mapping: DataFrame, id_col: str) -> DataFrame:
    """Entities per match rule, and those without a match."""
    rule = F.coalesce("match_rule", F.lit("unmatched"))
    return (
        side.select(id_col)
        .join(mapping.select(id_col, "match_rule"), id_col, "left")
        .groupBy(rule.alias("match_rule"))
        .agg(F.count("*").alias("entities"))
    )
