"""Exact duplicates by merging sorted runs of text digests in a tree.

Only DataFrame operations. Every row gets a digest and belongs to one of 2**k runs. A run keeps one
entry per digest: how many rows it stands for and the best row among them. In each round FAN_IN runs
whose numbers share the higher bits are merged, sorted by digest, until one run is left; the best row
of every group is then known and travels the same tree back down. A group that holds a third of all
rows is thus never one join key: at each level it is at most FAN_IN entries per run.

An entry is identified by SHA-256, a second independent hash and the length of the normalised text;
entries merge only if all three agree, at every level, which verifies each merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import settle

ROWS_PER_RUN = 16_384
FAN_IN_BITS = 2
KEY = ["sha", "check", "size"]


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_rows(docs: DataFrame) -> DataFrame:
    """One small row per document, stored so that its row number cannot change on a retry."""
    plain = docs.select("doc_id", F.col("text").alias("_text"), normalised(F.col("text")).alias("_normal"))
    rows = plain.select(
        "doc_id",
        F.coalesce(F.length("_text"), F.lit(0)).cast("bigint").alias("chars"),
        F.unhex(F.sha2("_normal", 256)).alias("sha"),
        F.xxhash64("_normal").alias("check"),
        F.octet_length("_normal").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    return settle(rows, "exact-digests")


def merged(runs: DataFrame) -> DataFrame:
    """One entry per digest of every run: rows it stands for, and the row that stays."""
    return runs.groupBy(*KEY, "run").agg(F.sum("rows").alias("rows"), F.min("best").alias("best"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs` (doc_id, text).

    Of rows with equal text apart from white space the one with most code points stays, then the
    smallest doc_id (null last), then an arbitrary but fixed one of fully equal rows. Null texts are
    empty texts and form a group like any other. An empty table gives no rows.
    """
    rows = digest_rows(docs)
    levels, room = 0, ROWS_PER_RUN
    total = rows.count()
    while room < total:
        levels, room = levels + 1, room << FAN_IN_BITS
    run = F.pmod(F.xxhash64("row"), F.lit(1 << (levels * FAN_IN_BITS))).cast("int")
    rows = rows.withColumn("run", run)
    # the smallest of these structs is the row that stays
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    tree = [merged(rows.select(*KEY, "run", F.lit(1).cast("bigint").alias("rows"), best.alias("best")))]
    for level in range(levels):
        tree[-1] = settle(tree[-1], f"exact-runs-{level}")
        tree.append(merged(tree[-1].withColumn("run", F.shiftright("run", FAN_IN_BITS))))
    answer = tree.pop()
    while tree:
        lower = tree.pop().select(*KEY, F.col("run").alias("low"), F.shiftright("run", FAN_IN_BITS).alias("run"))
        answer = lower.join(answer, [*KEY, "run"]).select(*KEY, F.col("low").alias("run"), "rows", "best")
    return rows.join(answer, [*KEY, "run"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    stay = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    mine = docs.withColumn("_own", F.unhex(F.sha2(normalised(F.col("text")), 256)))
    joined = mine.join(stay, mine["doc_id"].eqNullSafe(stay["_id"]) & (mine["_own"] == stay["_sha"]), "left_semi")
    # rows that repeat an id and a text are told apart here; the join has already brought them together
    first = Window.partitionBy("doc_id", "_own").orderBy(F.length("text").desc_nulls_last())
    return joined.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth", "_own")
