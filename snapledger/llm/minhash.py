"""Near duplicates by MinHash, banding, verification and connected components.

A document is the set of its five-word shingles; documents are linked if their sets have a Jaccard
similarity of at least 0.75. Equal sets become one class first. Each class gets 128 minima of universal
hash functions, in 32 bands of four. Two classes with similarity s agree on some band with probability
1 - (1 - s**4)**32, which is 0.999995 at 0.75.

Links are sought bucket by bucket (classes that agree on a band), never by listing a bucket's pairs:

1. The centre of a bucket is the class that shares most buckets with others. Every other member is compared
   with it: first by signature, then on full sets. Components of the confirmed links follow.
2. Buckets whose members then lie in one component are finished: more links cannot change the result. In the
   others, members of different components are compared, tile against tile of about TILE members: by signature
   first, and pairs that pass on full sets, inside the task, which returns links only.

So no link between different texts is lost other than by the band probability above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import Words, chunks, mix, settle
from snapledger.llm.components import connected

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SIMILAR = 75  # per cent
#: Least number of equal minima for a pair to be confirmed on full sets: five standard deviations below the 96
#: expected at 0.75, so that about one in two million pairs at the very threshold is passed over, and fewer above it.
LEAST_EQUAL = 72
TILE = 256

_random = np.random.Generator(np.random.PCG64(20240607))
MULTIPLY = _random.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
ADD = _random.integers(0, 1 << 64, HASHES, dtype=np.uint64)

SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
    ("bands", pa.list_(pa.int64())),
])
SIGNED_SQL = "doc_id bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>"


def distinct_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by both."""
    doc, value = Words(texts, lower=True).shingles(SHINGLE)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, two independent hashes and the bands of every text's set."""
    for batch in chunks(batches, "text"):
        doc, value = distinct_shingles(batch.column("text"))
        size = np.bincount(doc, minlength=batch.num_rows).astype(np.int64)
        some = np.flatnonzero(size)
        starts = np.concatenate([[0], np.cumsum(size)])[some].astype(np.int64)
        low, high = np.zeros((2, batch.num_rows), np.uint64)
        minima = np.empty((len(some), HASHES), np.uint16)
        if len(some):
            low[some] = np.add.reduceat(value, starts)
            high[some] = np.add.reduceat(mix(value ^ np.uint64(0xA0761D6478BD642F)), starts)
            for k in range(HASHES):
                least = np.minimum.reduceat(value * MULTIPLY[k] + ADD[k], starts)
                minima[:, k] = mix(least) >> np.uint64(48)
        bands = np.ascontiguousarray(minima).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))], schema=SIGNED,
        )


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures, side by side in `one` and `two`, agree often enough."""
    for batch in batches:
        one, two = (minima(batch.column(c)) for c in ("one", "two"))
        keep = pa.array((one == two).sum(1) >= LEAST_EQUAL)
        yield batch.select(["a", "b"]).filter(keep)


def minima(column: pa.Array) -> np.ndarray:
    """The 16-bit minima behind lists of bands."""
    return column.flatten().to_numpy().view(np.uint16).reshape(-1, HASHES)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts `one` and `two` have similar full sets."""
    for batch in chunks(batches, "one"):
        for part in chunks(iter([batch]), "two"):
            (d1, v1), (d2, v2) = (distinct_shingles(part.column(c)) for c in ("one", "two"))
            n = part.num_rows
            both = np.concatenate([mix(v1 ^ mix(d1.astype(np.uint64))), mix(v2 ^ mix(d2.astype(np.uint64)))])
            owner = np.concatenate([d1, d2])
            order = np.argsort(both, kind="stable")
            same = both[order][1:] == both[order][:-1]
            shared = np.bincount(owner[order][1:][same], minlength=n)
            union = np.bincount(d1, minlength=n) + np.bincount(d2, minlength=n) - shared
            yield part.select(["a", "b"]).filter(pa.array((100 * shared >= SIMILAR * union) & (union > 0)))


class Links:
    """Finds confirmed links between classes; holds the stored tables the steps share."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.classes = classes
        band = classes.select(F.col("node"), F.posexplode("bands").alias("band", "value"))
        keyed = band.select("node", "band", F.xxhash64("band", "value").alias("bucket"))
        sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        members = settle(keyed.join(sizes, "bucket"), "minhash-buckets")
        degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
        self.members = settle(members.select("bucket", "band", "node").join(degree, "node"), "minhash-members")
        texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text")
        self.texts = settle(texts.join(degree.select("node"), "node", "left_semi"), "minhash-texts")

    def signed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures agree."""
        one = self.classes.select(F.col("node").alias("a"), F.col("bands").alias("one"))
        two = self.classes.select(F.col("node").alias("b"), F.col("bands").alias("two"))
        return pairs.join(one, "a").join(two, "b").mapInArrow(agreeing, "a bigint, b bigint")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links, by the full sets of both texts."""
        pairs = settle(pairs, "minhash-candidates")
        one = self.texts.select(F.col("node").alias("a"), F.col("text").alias("one"))
        two = self.texts.select(F.col("node").alias("b"), F.col("text").alias("two"))
        return settle(pairs.join(one, "a").join(two, "b").mapInArrow(confirmed, "a bigint, b bigint"), "minhash-links")

    def placed(self, components: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        known = self.members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        return settle(known.join(mixed.select("bucket"), "bucket", "left_semi"), "minhash-mixed")

    def stars(self) -> DataFrame:
        """Pairs of each bucket's centre with its other members."""
        centre = self.members.groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre"))
        pairs = self.members.join(centre, "bucket").filter("node != centre")
        return pairs.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()

    def across(self, members: DataFrame) -> DataFrame:
        """Links between different components of one bucket, tile against tile.

        A component with many members in the bucket has tiles of its own, small ones share tiles, so no pair
        of tiles is met that holds one component only. Rows are dealt to tiles by hash, about TILE to each.
        """
        share = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        share = share.withColumn("home", F.when(F.col("n") * 2 >= TILE, F.col("component")))
        homes = share.groupBy("bucket", "home").agg(F.sum("n").alias("rows")).select(
            F.col("bucket").alias("_bucket"), F.col("home").alias("_home"), F.ceil(F.col("rows") / TILE).alias("parts")
        )
        share = share.join(homes, (F.col("bucket") == F.col("_bucket")) & F.col("home").eqNullSafe(F.col("_home")))
        placed = members.join(share.select("bucket", "component", "home", "parts"), ["bucket", "component"])
        tile = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts")))
        placed = settle(placed.select("bucket", "band", "component", "node", tile.alias("tile")), "minhash-tiles")
        tiles = placed.groupBy("bucket", "tile").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        left, right = tiles.alias("l"), tiles.alias("r")
        mixed = left.join(right, F.col("l.bucket") == F.col("r.bucket")).filter(
            (F.col("l.tile") <= F.col("r.tile")) & (F.least("l.x", "r.x") < F.greatest("l.y", "r.y"))
        )
        pair = mixed.select(F.col("l.bucket").alias("bucket"), F.col("l.tile").alias("one"), F.col("r.tile").alias("two"))
        sides = pair.select("bucket", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("tile"))
        full = placed.join(self.classes.select("node", "bands"), "node").join(self.texts, "node")
        rows = sides.join(full, ["bucket", "tile"]).select("bucket", "one", "two", "band", "node", "component", "bands", "text")
        links = rows.groupBy("bucket", "one", "two").applyInArrow(compared, "a bigint, b bigint")
        return settle(links.distinct(), "minhash-links")


def compared(table: pa.Table) -> pa.Table:
    """Confirmed links across components among at most two tiles.

    A pair that agrees on several bands meets in several buckets and is compared in that of the first such band.
    """
    table = table.combine_chunks()
    node, component, band = (table.column(c).to_numpy() for c in ("node", "component", "band"))
    lists = pa.concat_arrays(table.column("bands").chunks)
    sign, bands = minima(lists), lists.flatten().to_numpy().reshape(-1, BANDS)
    doc, value = distinct_shingles(pa.concat_arrays(table.column("text").chunks))
    kinds, shingle = np.unique(value, return_inverse=True)
    size = np.bincount(doc, minlength=len(node))
    end = np.cumsum(size)
    mark, found = np.zeros(len(kinds), bool), []
    for i in range(len(node)):
        same = bands == bands[i]
        near = same.any(1) & (same.argmax(1) == band[i]) & (component > component[i])
        near &= (100 * np.minimum(size, size[i]) >= SIMILAR * np.maximum(size, size[i])) & (size > 0)
        near = np.flatnonzero(near)
        near = near[(sign[near] == sign[i]).sum(1) >= LEAST_EQUAL]
        if not len(near):
            continue
        own = shingle[end[i] - size[i] : end[i]]
        mark[own] = True
        shared = np.array([mark[shingle[end[j] - size[j] : end[j]]].sum() for j in near])
        mark[own] = False
        for j in near[100 * shared >= SIMILAR * (size[near] + size[i] - shared)]:
            found.append((max(node[i], node[j]), min(node[i], node[j])))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text).

    Texts without words, and null texts, have no shingles and are linked with nothing; texts with fewer
    than five words are one shingle. Rows with equal sets are linked. Rows that repeat an id count as one
    document; rows without an id are in no component and are not kept. An empty table gives no rows.
    """
    rows = settle(docs.select("doc_id", "text").mapInArrow(signatures, SIGNED_SQL), "minhash-signatures")
    same = ["n_shingles", "low", "high"]
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands")
    )
    classes = settle(classes, "minhash-classes")
    links = Links(docs, classes)
    # ids that stand in several classes (repeated ids) need no special care: they are one node
    found = links.confirmed(links.signed(links.stars()))
    components = settle(connected(found), "minhash-components")
    members = links.placed(components)
    if not members.isEmpty():
        more = links.across(members)
        if not more.isEmpty():
            stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
            components = settle(connected(stars.unionByName(more)), "minhash-components")
    node = classes.select(*same, "node")
    joined = rows.filter("n_shingles > 0 and doc_id is not null").join(node, same)
    labelled = joined.join(components, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    both = labelled.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_near(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are the first of their component, with all their columns.

    Components are of rows, whatever their ids: a stored row key stands for each. The first row is that of the
    smallest doc_id, null last; rows without words are alone, and so stay.
    """
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    found = near_components(rows.select(F.col("_row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = found.groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)
