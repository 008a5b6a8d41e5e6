"""Mixing sources to target weights by a low-discrepancy schedule.

The words of every source, documents in shuffled order, form one stream that is cut into blocks of
equally many words and repeats from its start when it ends. The mix is a schedule of slots, as many as its size takes.
Slot t belongs to the source in whose interval of cumulative weight the van der Corput point of t falls (the
bits of t reversed behind the point), so every stretch of the schedule holds the sources close to their weights. The
slots of a source, ranked, take its blocks in order, round after round. The join of slots with blocks is the mix: which
words of which document stand in which slot. How often a document is taken follows from that.

Points in an interval have neighbouring bit-reversed numbers, so a source finds its slots by itself: nothing compares slots with
all sources, of which there may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import settle, word_count
from snapledger.operators.ordering import row_numbers, running_sums, up

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK_WORDS = 2048
#: A small source gets smaller blocks, so that it has at least about this many, if it has the words.
LEAST_BLOCKS = 1024
#: Points of one source that one row stands for before they are listed.
POINTS_PER_ROW = 1 << 16


def source_key(source: Column) -> Column:
    """Never null, and apart for null and every text."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """`sizes` (name, size) with `target`: the words wanted of each source.

    Weights go round in order of code point, null last. Shares of all words by weight; a source that would exceed MOST_REPEATS
    times its size stops there and the excess goes to the others by weight, until none is above. Sources are ranked and
    shares found by sums over all of them; a few numbers reach the driver in each of the rounds.
    """
    # a null source is named n, all others begin with s; strings order by their bytes, which is by code point
    placed = sizes.withColumns({"_none": F.col("name") == "n", "_all": F.lit(0)})
    placed = row_numbers(placed, ["_all"], [up("_none"), up("name")], "_nth").drop("_none", "_all")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.col("_nth") - 1) % len(WEIGHTS)).cast("int"))
    placed = placed.withColumn("weight", weight).drop("_nth")
    most = F.col("size").cast("double") * MOST_REPEATS
    each, full_before = None, -1
    while True:
        full = F.lit(False) if each is None else most < F.col("weight") * each
        total, capped, free, count = placed.agg(
            F.sum("size"), F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if not free or count == full_before:
            break
        each, full_before = (total - capped) / free, count
    return placed.withColumn("target", F.least(most, F.col("weight") * F.lit(each or 0.0))).drop("weight")


def plan(sizes: DataFrame) -> DataFrame:
    """`targets` with `block_words` and `blocks` of a round, and `slots`: how many of the schedule should be the source's."""
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("size") / LEAST_BLOCKS))).cast("bigint")
    cut = targets(sizes).withColumn("block_words", block).withColumn("blocks", F.ceil(F.col("size") / F.col("block_words")))
    slots = F.when(F.col("size") > 0, F.col("target") * F.col("blocks") / F.col("size")).otherwise(F.lit(0.0))
    return settle(cut.withColumn("slots", slots), "mix-plan")


def reversed_bits(number: Column, bits: int) -> Column:
    """The last `bits` bits of a number in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("bigint")


def schedule(planned: DataFrame) -> DataFrame:
    """slot, name, block and round of every slot of the mix.

    The schedule ends at the slot at which the sources have their targets together. A source that has been taken
    MOST_REPEATS times leaves its further slots empty.
    """
    total = planned.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0]
    length = round(total)
    bits = max(1, length.bit_length())
    points = 1 << bits
    # weights as whole numbers of points, so that neighbouring intervals meet exactly
    share = F.round(F.col("slots") / F.lit(max(total, 1e-9)) * points).cast("bigint")
    weighted = planned.withColumns({"_share": share, "_all": F.lit(0), "_spread": F.xxhash64("name")})
    weighted = running_sums(weighted, ["_all"], [up("_spread"), up("name")], "_share", "_low")
    last = F.least(F.lit(points), F.col("_low") + F.col("_share")) - 1
    # a row for each stretch of points first, so that a large source is listed by many tasks
    stretches = weighted.filter(F.col("_low") <= last).select(
        "name", "blocks", last.alias("last"), F.explode(F.sequence("_low", last, F.lit(POINTS_PER_ROW).cast("bigint"))).alias("first")
    )
    listed = stretches.repartition(F.xxhash64("name", "first")).select(
        "name", "blocks", F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + POINTS_PER_ROW - 1))).alias("point")
    )
    slots = listed.select("name", "blocks", reversed_bits(F.col("point"), bits).alias("slot")).filter(F.col("slot") < length)
    ranked = row_numbers(slots, ["name"], [up("slot")], "rank").withColumn("rank", F.col("rank") - 1)
    used = ranked.filter(F.col("rank") < F.col("blocks") * MOST_REPEATS)
    return used.select("slot", "name", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("round"))


def laid_out(docs: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with size and place in their source's stream, and the plan of the sources."""
    rows = docs.select(
        "doc_id", *carried, source_key(F.col("source")).alias("name"), word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("_spread"),
    )
    rows = settle(rows, "mix-sizes")
    planned = plan(rows.groupBy("name").agg(F.sum("size").alias("size")))
    placed = running_sums(rows, ["name"], [up("_spread"), up("doc_id"), up("size"), *map(up, carried)], "size", "begin")
    return settle(placed.drop("_spread").withColumn("_place", F.monotonically_increasing_id()), "mix-placed"), planned


def filled(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """_place, slot, low, high: the words of a document (by its place) that stand in a slot of the mix."""
    full = placed.filter("size > 0").join(planned.select("name", "block_words"), "name")
    last = F.floor((F.col("begin") + F.col("size") - 1) / F.col("block_words"))
    pieces = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / F.col("block_words")), last)))
    low = F.greatest("begin", F.col("block") * F.col("block_words")) - F.col("begin")
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.col("begin")
    return pieces.select("name", "block", "_place", low.alias("low"), high.alias("high")).join(schedule(planned), ["name", "block"])


def mixed_slots(docs: DataFrame) -> DataFrame:
    """The mix itself: slot, doc_id, low, high, in which words low .. high - 1 of a document stand in a slot.

    Sorted by slot and low it is the mixed sequence. See `mix` for odd rows.
    """
    placed, planned = laid_out(docs)
    return filled(placed, planned).join(placed.select("_place", "doc_id"), "_place").select("slot", "doc_id", "low", "high")


def mix(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `carried`, size, source_size, target, taken of every row of `docs` (doc_id, text, source).

    Equal reruns: the shuffle follows hashes of (doc_id, text). A null text has size 0 and is never
    taken; a null source is a source of its own, last in order; null and repeated ids are rows like
    others. An empty table gives no rows.
    """
    placed, planned = laid_out(docs, carried)
    taken = filled(placed, planned).groupBy("_place").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    facts = planned.select("name", F.col("size").alias("source_size"), "target")
    return placed.join(taken, "_place", "left").join(facts, "name").select(
        "doc_id", *carried, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes their words, to the nearest whole number.

    Texts stay whole: a source's last round ends within a block, so the few documents there are kept if at least half of them is taken.
    Documents that the mix does not take are gone. Rows meet their counts by a stored row key, so null and repeated ids are rows like others.
    """
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    counts = mix(rows, ("_row",)).select("_row", F.round(F.try_divide("taken", "size")).cast("int").alias("_times"))
    each = rows.join(counts.filter("_times > 0"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times")))
    return each.select(*docs.columns)
