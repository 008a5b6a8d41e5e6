"""Best affordable replacement without comparing every row with every candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.operators.ordering import down, row_numbers, running_min, up
from snapledger.session import settle


def _rows(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is never broadcast: Spark takes its size from compressed files and before rows are exploded."""
    return df.hint("merge")


def _intervals(price: Column, levels: int) -> Column:
    """All price intervals [node * 2^level, (node + 1) * 2^level) that hold a price."""
    return F.array(
        *[F.struct(F.lit(level).alias("level"), F.shiftright(price, level).alias("node")) for level in range(levels)]
    )


def _cover(budget: Column, levels: int) -> Column:
    """The intervals that make up all prices up to a budget: one for each set bit of budget + 1."""
    end = budget + 1
    parts = [
        F.when(
            F.shiftright(end, level).bitwiseAND(F.lit(1)) == 1,
            F.struct(F.lit(level).alias("level"), (F.shiftright(end, level) - 1).alias("node")),
        )
        for level in range(levels)
    ]
    return F.array_compact(F.array(*parts))


def _asked_places(asked: DataFrame, held: DataFrame, candidates: DataFrame, group: str, owner: str) -> DataFrame:
    """Candidates an owner may get from an interval: its best ones, one more than the owner holds there.

    `asked` has distinct (owner, group, level, node), `held` the same for every candidate an owner holds. The intervals of
    a level are disjoint, so an owner's lists have as many rows, over all intervals of a level, as it holds
    candidates and asks for intervals: one heavy owner makes nobody else's lists longer.
    """
    at = [group, "level", "node"]
    own = held.join(_rows(asked), [owner, *at], "left_semi").groupBy(owner, *at).agg(F.count("*").alias("n"))
    wanted = asked.join(_rows(own), [owner, *at], "left").withColumn("length", F.coalesce("n", F.lit(0)) + 1).drop("n")
    longest = wanted.groupBy(*at).agg(F.max("length").alias("longest"))
    # only asked intervals are listed, each as far as anyone needs it
    listed = row_numbers(candidates.join(_rows(longest), at), at, [down("score"), up("item")], "place")
    listed = listed.filter(F.col("place") <= F.col("longest")).drop("longest", "price")
    each = wanted.select(owner, *at, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("length"))).alias("place"))
    return each.join(_rows(listed), [*at, "place"]).drop("place")


def _place() -> Column:
    """Sorts candidates, best first; an unknown score comes after every known one."""
    return F.struct(F.col("score").isNull().alias("unknown"), (-F.col("score")).alias("less"), F.col("item").alias("item"))


def _best_of_all(cases: DataFrame, candidates: DataFrame, group: str, owner: str) -> DataFrame:
    """The cases with `best`, the best candidate of the group within the cap whoever owns it; none where nothing is affordable."""
    steps = candidates.groupBy(group, F.col("price").alias("_cap")).agg(F.min(_place()).alias("_offer"))
    lined = steps.withColumn("_case", F.lit(0)).unionByName(cases.withColumn("_case", F.lit(1)), allowMissingColumns=True)
    best = running_min(lined, [group], [up("_cap"), up("_case"), up(owner)], "_offer", "best")
    return best.filter((F.col("_case") == 1) & F.col("best").isNotNull()).select(owner, group, "_cap", "best")


def _best_lacking(
    cases: DataFrame, candidates: DataFrame, mine: DataFrame, group: str, owner: str, levels: int
) -> DataFrame:
    """The cases with `best`, the best candidate of the group within the cap that the owner lacks; none where it lacks none.

    The prices up to a cap are at most log2(price) intervals; the best candidate an owner lacks is found once for each
    interval it asks for, and a case of owner, group and cap takes the best of its intervals.
    """
    placed = candidates.withColumn("_at", F.explode(_intervals(F.col("price"), levels))).select(
        group, "item", "price", "score", "_at.level", "_at.node"
    )
    probes = cases.withColumn("_at", F.explode(_cover(F.col("_cap"), levels))).select(
        owner, group, "_cap", "_at.level", "_at.node"
    )
    at = [owner, group, "level", "node"]
    # only what the owners of these cases hold in the groups they ask for
    held = mine.join(_rows(cases.select(owner)), owner, "left_semi").join(
        _rows(candidates.select(group, "item", "price")), "item"
    )
    held = held.join(_rows(cases.select(owner, group)), [owner, group], "left_semi")
    held = held.withColumn("_at", F.explode(_intervals(F.col("price"), levels))).select(
        owner, group, "_at.level", "_at.node"
    )
    offers = _asked_places(probes.select(*at).distinct(), held, placed, group, owner)
    lacking = offers.join(_rows(mine), [owner, "item"], "left_anti")
    best = lacking.groupBy(*at).agg(F.min(_place()).alias("best"))
    return probes.join(_rows(best), at).groupBy(owner, group, "_cap").agg(F.min("best").alias("best"))


def best_affordable(
    wanted: DataFrame, candidates: DataFrame, owned: DataFrame, group: str, owner: str
) -> DataFrame:
    """For each wanted row the best candidate of its group within budget that its owner lacks.

    `wanted` has `group`, `owner` and `budget`; `candidates` has `group`, `item`, `price` (a whole
    number from 0 on) and `score`; `owned` has `owner` and `item`. Ties go to the lowest item. The
    result adds `item` and `score`, NULL where nothing is affordable.

    No row meets a whole group. Cases of owner, group and budget are put in order with the candidates by price, where a
    running minimum gives each the best of all. Only the cases whose owner holds that one need others, which are looked
    for by intervals of prices.
    """
    lowest, highest = candidates.agg(F.min("price"), F.max("price")).first()
    if highest is None:
        return wanted.withColumns({"item": F.lit(None).cast("bigint"), "score": F.lit(None).cast("double")})
    if lowest < 0:
        raise ValueError(f"prices count from 0, found {lowest}")
    levels = int(highest + 1).bit_length()
    price = F.col("price").cast("bigint")
    # a candidate without a price is within no budget
    candidates = candidates.select(group, "item", price.alias("price"), "score").filter(F.col("price").isNotNull())
    mine = owned.select(owner, "item").distinct()
    budget = F.least(F.col("budget").cast("bigint"), F.lit(int(highest)))
    asked = wanted.withColumn("_cap", budget)
    cases = asked.filter("_cap >= 0").select(owner, group, "_cap").distinct()
    first = _best_of_all(cases, candidates, group, owner).withColumn("item", F.col("best.item"))
    first = settle(first.join(_rows(mine.withColumn("_held", F.lit(True))), [owner, "item"], "left").drop("item"), "first")
    again = settle(first.filter("_held").select(owner, group, "_cap"), "again")
    lacking = _best_lacking(again, candidates, mine, group, owner, levels)
    best = first.filter(F.col("_held").isNull()).drop("_held").unionByName(lacking)
    chosen = best.select(owner, group, "_cap", F.col("best.item").alias("item"), (-F.col("best.less")).alias("score"))
    joined = asked.join(_rows(chosen), [owner, group, "_cap"], "left")
    return joined.select(*wanted.columns, "item", "score")
