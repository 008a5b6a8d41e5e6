"""I-Match fingerprints with many randomised lexicon subsets. Only DataFrame operations.

The lexicon holds the terms whose document frequency lies in a band, given as shares of all documents:
very common terms say nothing and rare ones are typing errors and names that an edit removes. At
level j the lexicon falls into CELLS * 4**j pseudo-random subsets, and every term belongs to one of them. The number of lexicon terms
of a document chooses its level, so that short and long texts both have a few terms per subset. Its distinct
lexicon terms are sorted, and those of each subset hashed together; the hashes are the fingerprint, and each lexicon
term of the text is in one of them. The hash of a subset is the sum of its terms' hashes, so that the hashes of four
subsets of a level give that of the one they form at the level above. The likeness of two fingerprints is the
share of equal hashes among the subsets that either has, at the coarser of their levels.

The lexicon travels to the tasks as one value. Its size is bounded whatever the corpus: a term in at least
LEAST_SHARE of all documents takes that share of all (document, term) pairs, so there are at most
(mean distinct terms per document) / LEAST_SHARE of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import settle

CELL_BITS = 4
CELLS = 1 << CELL_BITS
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
SEED = 71
#: Deepest level; a text with more terms than fit it has more of them per subset.
DEEPEST = 8
#: A hash of a fingerprint has PRINT_BITS: the subset, and in what is left the sum of its terms.
PRINT_BITS = 32
#: Level of the one hash that stands for a text without lexicon terms.
BARE = 31
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: lower-case runs of letters and digits (and of anything outside ASCII)."""
    words = F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w, F.lit(SEED))))


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """The terms whose share of the rows of `texts` (text) lies in the band; at least two rows must hold a term."""
    total = texts.count()
    seen = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    low, high = max(2.0, least * total), most * total
    return settle(seen.filter((F.col("rows") >= low) & (F.col("rows") <= max(high, low))).select("term"), "lexicon")


def placed(lexicon: DataFrame) -> Column:
    """The whole lexicon as one value: an array of lists, in which a term's hash names its list.

    There are as many lists as terms, so that looking up a term takes a step or two.
    """
    lists = max(1, lexicon.count())
    held = lexicon.groupBy(F.pmod("term", F.lit(lists)).alias("id")).agg(F.collect_list("term").alias("terms"))
    every = lexicon.sparkSession.range(lists).join(held, "id", "left")
    entry = F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    return every.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["terms"]).alias("lexicon")).scalar()


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once, although `use` asks for it in loops."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def level(count: Column) -> Column:
    """The level at which `count` terms put one to four into each subset."""
    raw = F.floor(F.log(4.0, F.greatest(F.lit(1.0), count / CELLS)))
    return F.least(F.greatest(F.lit(0), raw), F.lit(DEEPEST)).cast("int")


def cell_bits(level: Column) -> Column:
    return F.lit(CELL_BITS) + 2 * level


def runs(items: Column, of, make) -> Column:
    """`make(items, first, number of items, value)` for every run of neighbouring items with the same value of `of`."""

    def found(items):
        begins = F.filter(
            F.transform(items, lambda x, i: F.when(~of(x).eqNullSafe(of(F.get(items, i - 1))), i)), lambda i: i.isNotNull()
        )

        def made(starts):
            end = lambda nth: F.coalesce(F.get(starts, nth + 1), F.size(items))
            return F.transform(starts, lambda first, nth: make(items, first, end(nth) - first, of(F.get(items, first))))

        return let(begins, made)

    return let(items, found)


def total(items: Column, first: Column, count: Column, bits: Column) -> Column:
    """Sum of some neighbouring items, of which the last `bits` bits count."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    added = F.aggregate(F.slice(items, first + 1, count), F.lit(0).cast("bigint"), lambda sum_, x: (sum_ + x.bitwiseAND(mask)).bitwiseAND(mask))
    return added


def hashes(kept: Column, level: Column) -> Column:
    """One number per used subset at a level: the subset and below it the sum of its terms' hashes.

    The first bits of a term's hash choose its subset, so the terms of one are neighbours in `kept`, which is sorted as unsigned.
    """
    width = cell_bits(level)
    rest = F.lit(PRINT_BITS) - width
    cell = lambda t: F.call_function("shiftrightunsigned", t, F.lit(64) - width)

    def hashed(items, first, count, subset):
        return F.call_function("shiftleft", subset, rest) + total(items, first, count, rest)

    return runs(kept, cell, hashed)


def coarser(prints: Column, own: Column, to: Column, bits: Column) -> Column:
    """A print of level `own` at level `to`, of whose sums the last `bits` bits count."""
    rest = F.lit(PRINT_BITS) - cell_bits(own)
    cell = lambda p: F.call_function("shiftright", p, rest + 2 * (own - to))

    def merged(items, first, count, subset):
        return F.call_function("shiftleft", subset, F.lit(PRINT_BITS)) + total(items, first, count, bits)

    return runs(prints, cell, merged)


def fingerprint(text: Column, lexicon: Column) -> Column:
    """`level` and `print` (an array) of a text, given the lexicon as `placed`.

    Every distinct term of the text meets the lexicon, and each one found there enters a subset.
    """
    # sorted as unsigned numbers, so that the subsets of one of a level above are neighbours too
    flip = lambda t: t.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))

    def known(found):
        held = lambda t: F.array_contains(F.get(lexicon, F.pmod(t, F.size(lexicon)).cast("int")), t)
        kept = F.transform(F.sort_array(F.transform(F.filter(found, held), flip)), flip)
        return F.struct(kept.alias("kept"), F.xxhash64(F.sort_array(found)).alias("whole"))

    def prints(kept, whole):
        bare = F.array(whole.bitwiseAND(F.lit((1 << PRINT_BITS) - 1).cast("bigint")))
        at = lambda own: F.struct(own.alias("level"), hashes(kept, own).alias("print"))
        return F.when(F.size(kept) == 0, F.struct(F.lit(BARE).alias("level"), bare.alias("print"))).otherwise(let(level(F.size(kept)), at))

    return let(let(terms(text), known), lambda k: let(k["kept"], lambda kept: prints(kept, k["whole"])))


def likeness(one: Column, one_level: Column, two: Column, two_level: Column) -> Column:
    """Share of equal hashes among the subsets that either print has, at the coarser level of the two."""
    def shared(one, two, rest):
        cells = lambda p: F.transform(p, lambda h: F.call_function("shiftright", h, rest))
        return F.size(F.array_intersect(one, two)).cast("double") / F.size(F.array_union(cells(one), cells(two)))

    def compared(pair):
        one, two = pair["one"], pair["two"]
        to, deeper = F.least(one_level, two_level), F.greatest(one_level, two_level)
        bits = F.lit(PRINT_BITS) - cell_bits(deeper)
        both = F.struct(coarser(one, one_level, to, bits).alias("one"), coarser(two, two_level, to, bits).alias("two"))
        return (
            F.when((one_level == two_level) & (one == two), F.lit(1.0))
            .when((one_level == BARE) | (two_level == BARE), F.lit(0.0))
            .when(one_level == two_level, shared(one, two, F.lit(PRINT_BITS) - cell_bits(one_level)))
            .otherwise(let(both, lambda folded: shared(folded["one"], folded["two"], F.lit(PRINT_BITS))))
        )

    return let(F.struct(one.alias("one"), two.alias("two")), compared)


def written(level: Column, prints: Column) -> Column:
    return F.concat(F.hex(level), F.lit("."), F.array_join(F.transform(prints, F.hex), "."))


def packed(prints: Column) -> Column:
    """Four bytes for a hash."""
    return F.transform(prints, lambda p: (p - (1 << (PRINT_BITS - 1))).cast("int"))


def unpacked(prints: Column) -> Column:
    return F.transform(prints, lambda p: p.cast("bigint") + (1 << (PRINT_BITS - 1)))


def neighbours(keys: DataFrame) -> DataFrame:
    """Each row of `keys` (doc_id, k1, k2, chars) with the row after it and the one before it, in a ring.

    The order is descending doc_id, null last, then k1, k2. Ids are range partitioned and stored; each slice is
    linked alone and the ends of slices, one row per slice, are linked apart.
    """
    slices = keys.repartitionByRange(F.col("doc_id").desc_nulls_last()).withColumn("slice", F.spark_partition_id())
    slices = settle(slices, "fingerprint-order")
    order = [F.col("doc_id").desc_nulls_last(), "k1", "k2"]
    row = F.struct("k1", "k2", "chars")
    inside = Window.partitionBy("slice").orderBy(*order)
    linked = slices.withColumn("after", F.lead(row).over(inside)).withColumn("before", F.lag(row).over(inside))
    place = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("less"), "k1", "k2")
    ends = slices.groupBy("slice").agg(F.min_by(row, place).alias("head"), F.max_by(row, place).alias("tail"))
    along = Window.orderBy("slice")
    ring = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "slice",
        F.coalesce(F.lead("head").over(along), F.first("head").over(ring)).alias("next_head"),
        F.coalesce(F.lag("tail").over(along), F.last("tail").over(ring)).alias("last_tail"),
    )
    joined = linked.join(ends, "slice")
    return joined.select(
        "k1", "k2", F.coalesce("after", "next_head").alias("after"), F.coalesce("before", "last_tail").alias("before")
    )


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of `docs` (doc_id, text) and of its edited text, and how alike they are.

    The edited text replaces the last third by the first characters of the next document (descending doc_id, null
    last, then round to the first). Null texts are empty ones. Rows that repeat an id and a text are one document
    in that order and get equal results each; an empty table gives no rows.

    Only a text's own print is stored and sent to its neighbour; the edited text's is made where both texts' parts meet, and
    ends in the result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text.alias("text"), F.length(text).alias("chars"),
        F.xxhash64("doc_id", text).alias("k1"), F.hash("doc_id", text).alias("k2"),
    )
    words = lexicon(rows.select("text"))
    key = ["k1", "k2"]
    # the lexicon is asked for once, so that rows refer to it and do not carry it
    known = placed(words)
    own = rows.withColumn("_lexicon", known).withColumn("_f", fingerprint(F.col("text"), F.col("_lexicon")))
    own = own.select("doc_id", *key, "chars", F.col("_f.level").alias("level"), packed(F.col("_f.print")).alias("print"))
    own = settle(own.groupBy("doc_id", *key, "chars", "level").agg(F.first("print").alias("print")), "fingerprint-prints")
    ring = settle(neighbours(own.select("doc_id", *key, "chars")), "fingerprint-ring")
    following = own.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("level").alias("next_level"), F.col("print").alias("next_print"))
    beside = ring.join(own, key).join(
        following, (F.col("after.k1") == F.col("n1")) & (F.col("after.k2") == F.col("n2"))
    )
    mine, next_ = unpacked(F.col("print")), unpacked(F.col("next_print"))
    beside = beside.select(*key, "doc_id", "chars", "before", "level", "print", likeness(mine, F.col("level"), next_, F.col("next_level")).alias("near_next"))
    # the texts travel once: both uses below ask for the same columns, so they share one exchange
    met = rows.select(*key, "text").join(settle(beside, "fingerprint-beside"), key)
    third = F.floor(F.col("before.chars") / 3).cast("int")
    heads = met.select(F.col("before.k1").alias("k1"), F.col("before.k2").alias("k2"), F.left("text", third).alias("head"))
    heads = heads.groupBy(*key).agg(F.first("head").alias("head"))
    kept = F.col("chars") - F.floor(F.col("chars") / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), kept), F.col("head"))
    both = met.join(heads, key).select("doc_id", "chars", "level", "print", "near_next", edited.alias("edited"))
    both = both.withColumn("_lexicon", known).withColumn("_f", fingerprint(F.col("edited"), F.col("_lexicon"))).drop("_lexicon")
    mine = unpacked(F.col("print"))
    return both.select(
        "doc_id", F.col("chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("level"), mine).alias("fingerprint"), written(F.col("_f.level"), F.col("_f.print")).alias("edited_fingerprint"),
        likeness(mine, F.col("level"), F.col("_f.print"), F.col("_f.level")).alias("near_edited"), "near_next",
    )
