"""Repeated passages: words inside a run of 50 that also stands in a document with a smaller id.

1. Documents whose words are all equal form a class; the smallest id stands for it from here on.
2. Every window of 50 words has an anchor, its run of 16 words with the smallest hash. Anchors that only one
   class has cannot lie in a shared window. The stretches of text whose windows have shared anchors are
   cut out as regions; all later steps work on these.
3. Windows whose hash only one document has are left out. What is left of a region falls into pieces, each the words of
   neighbouring windows with one anchor. Equal windows have equal anchors, so pieces that share a window have the
   same anchor. Equal pieces are kept once, with the smallest document that has them.
4. Pieces are put into shards by their anchor (those of an anchor with very many windows by window too). For each
   shard a compressed index (`fmindex.WordIndex`) of its pieces is built, and all of them are streamed through it: backward search
   gives the stretches of at least 50 words for which the index holds a smaller document.
5. The reported stretches are taken out of the documents.

A piece thus only meets the shard that can hold its windows, and work grows with the repeated text. Which words go, and
on account of which documents, is decided by the index alone; the hashes before it only leave out what cannot repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import Words, chunks, mix, runs, settle, sums
from snapledger.llm.fmindex import WordIndex

WINDOW = 50
ANCHOR = 16
WORDS_PER_SHARD = 400_000
#: Windows of one anchor that go to one shard together.
WINDOWS_PER_PART = 4_096


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row; rows that repeat both id and text share it, and so their result."""
    return F.xxhash64(doc_id, text)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbouring values, by doubling."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


class Windows:
    """Start, text and anchor of all windows of several texts."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.prefix = sums(words.hash)
        at = np.arange(max(0, n - WINDOW + 1))
        inside = words.doc[at] == words.doc[at + WINDOW - 1] if len(at) else at.astype(bool)
        self.at = at[inside]
        self.doc = words.doc[self.at]
        if len(at):
            first = np.arange(n - ANCHOR + 1)
            least = sliding_least(mix(runs(self.prefix, first, first + ANCHOR)), WINDOW - ANCHOR + 1)
            self.anchor = least[: len(at)][inside]
        else:
            self.anchor = np.empty(0, np.uint64)

    def hashes(self) -> np.ndarray:
        return mix(runs(self.prefix, self.at, self.at + WINDOW))


HELD = "anchor bigint, key bigint, doc_id bigint, same bigint"
REGIONS = "key bigint, doc_id bigint, whole boolean, first bigint, text string"


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, key, doc_id, same) once per anchor and text, and once with a null anchor per text of 50 words or more.

    `same` is a hash of all words in order.
    """
    for batch in chunks(batches, "text"):
        words = Words(batch.column("text"))
        windows = Windows(words)
        order = np.lexsort((windows.anchor, windows.doc))
        doc, anchor = windows.doc[order], windows.anchor[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
        doc, anchor = doc[new], anchor[new].view(np.int64)
        same = mix(runs(windows.prefix, words.first[:-1], words.first[1:]) + words.count.astype(np.uint64)).view(np.int64)
        once = np.unique(doc)
        take = pa.array(np.concatenate([doc, once]))
        anchor = pa.array(np.concatenate([anchor, np.zeros(len(once), np.int64)]), mask=np.arange(len(take)) >= len(anchor))
        yield pa.RecordBatch.from_arrays(
            [anchor, batch.column("key").take(take), batch.column("doc_id").take(take), pa.array(same).take(take)],
            ["anchor", "key", "doc_id", "same"],
        )


def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each text whose windows have an anchor of `shared`, and the whole text if it has copies."""
    for batch in chunks(batches, "text"):
        words = Words(batch.column("text"))
        windows = Windows(words)
        shared = batch.column("shared")
        listed = shared.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        lengths = pc.list_value_length(shared).fill_null(0).to_numpy(zero_copy_only=False)
        # (text, anchor) pairs as one number each; a chance collision only makes a region longer
        mine = mix(windows.anchor ^ mix(windows.doc.astype(np.uint64)))
        wanted = mix(listed ^ mix(np.repeat(np.arange(len(lengths)), lengths).astype(np.uint64)))
        at = windows.at[np.isin(mine, wanted)]
        if len(at):
            # windows that overlap or touch belong to one region
            cut = np.flatnonzero((np.diff(at) > WINDOW) | (np.diff(words.doc[at]) != 0)) + 1
            first = at[np.concatenate([[0], cut])]
            last = at[np.concatenate([cut - 1, [len(at) - 1]])] + WINDOW
        else:
            first = last = np.empty(0, np.int64)
        copied = np.flatnonzero(batch.column("copied").to_numpy(zero_copy_only=False).astype(bool))
        whole = np.arange(len(first) + len(copied)) >= len(first)
        first = np.concatenate([first, words.first[:-1][copied]]).astype(np.int64)
        last = np.concatenate([last, words.first[1:][copied]]).astype(np.int64)
        doc = words.doc[first]
        raw = words.bytes.tobytes()
        texts = [raw[words.start[a] : words.end[b - 1]].decode("utf-8") for a, b in zip(first, last)]
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(take), batch.column("doc_id").take(take), pa.array(whole),
             pa.array(first - words.first[doc]), pa.array(texts, pa.string())], ["key", "doc_id", "whole", "first", "text"],
        )


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, anchor, doc_id, region, at) of every window of the regions; `at` counts from the region's start."""
    for batch in chunks(batches, "text"):
        words = Words(batch.column("text"))
        windows = Windows(words)
        take = pa.array(windows.doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(windows.hashes().view(np.int64)), pa.array(windows.anchor.view(np.int64)), batch.column("doc_id").take(take),
             batch.column("region").take(take), pa.array((windows.at - words.first[windows.doc]).astype(np.int32))],
            ["window", "anchor", "doc_id", "region", "at"],
        )


def piece_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the pieces out of their region: its words from `start` to `stop`."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "start", "stop")))
        texts = [b" ".join(text.encode().split()[start:stop]).decode() for text, start, stop in rows]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "doc_id", "anchor", "part")), pc.add(batch.column("first"), batch.column("start")),
             pa.array(texts, pa.string())], ["key", "doc_id", "anchor", "part", "start", "text"],
        )


def searched(shard: pa.Table) -> pa.Table:
    """Stretches (piece, later, low, high) of one shard's pieces (piece, text, least, last, whole) that a smaller document holds.

    A piece is asked for twice: as the smallest document that has it, and, `later`, as the others. A whole text is
    asked for as the others only: its pieces are asked for by themselves.
    """
    out = pa.schema([("piece", pa.int64()), ("later", pa.bool_()), ("low", pa.int64()), ("high", pa.int64())])
    shard = shard.combine_chunks()
    words = Words(pa.concat_arrays(shard.column("text").chunks))
    least, last = (shard.column(c).to_numpy() for c in ("least", "last"))
    whole = shard.column("whole").to_numpy(zero_copy_only=False).astype(bool)
    index = WordIndex(words.hash, words.count, least)
    asked = np.concatenate([np.flatnonzero(~whole), np.flatnonzero(last > least)])
    later = np.arange(len(asked)) >= (~whole).sum()
    count = words.count[asked]
    place = np.repeat(words.first[asked] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    query, low, high = index.matches(words.hash[place], count, np.where(later, last[asked], least[asked]), WINDOW)
    pieces = shard.column("piece").take(pa.array(asked[query]))
    return pa.table([pieces, pa.array(later[query]), pa.array(low), pa.array(high)], schema=out)


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """key, low, high: words of the rows of `docs` (key, doc_id, text) that a smaller document holds in runs of 50."""
    named = docs.filter("doc_id is not null and text is not null")
    held = settle(named.mapInArrow(anchors, HELD), "substring-anchors")
    listed = held.filter("anchor is null").select("key", "doc_id", "same")
    classes = listed.groupBy("same").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.max("doc_id").alias("last"))
    classes = settle(classes.select("same", "last", F.col("rep.doc_id").alias("least"), F.col("rep.key").alias("key"),
                                    (F.col("rep.doc_id") < F.col("last")).alias("copied")), "substring-classes")
    shared = held.filter("anchor is not null").groupBy("anchor").agg(F.min("same").alias("x"), F.max("same").alias("y"))
    shared = shared.filter("x < y").select("anchor")
    lists = held.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("shared"))
    wanted = classes.join(lists, "key", "left").filter("copied or shared is not null").select("key", "copied", "shared")
    found = named.join(wanted, "key").select("key", "doc_id", "text", "copied", "shared").mapInArrow(regions, REGIONS)
    found = settle(found.withColumn("region", F.monotonically_increasing_id()), "substring-regions")
    parts = found.filter("not whole")
    windows = parts.select("doc_id", "region", "text").mapInArrow(
        window_rows, "window bigint, anchor bigint, doc_id bigint, region bigint, at int"
    )
    repeated = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
    # stored, so that the join below reads plain shuffles, of which Spark splits one with a hot window
    repeated = settle(repeated.filter("x < y").select("anchor", "window"), "substring-windows")
    # an anchor with more windows than a shard holds is cut by window
    loads = repeated.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / WINDOWS_PER_PART).alias("parts"))
    split = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("window"), F.col("parts"))).otherwise(F.lit(0).cast("bigint"))
    repeated = repeated.join(loads, "anchor").select("anchor", "window", split.alias("part"))
    met = windows.join(repeated, ["anchor", "window"]).select("region", "anchor", "part", "at")
    # neighbouring windows with one anchor are one piece; a partition is at most one document long
    nth = F.dense_rank().over(Window.partitionBy("region", "anchor", "part").orderBy("at"))
    pieces = met.withColumn("island", F.col("at") - nth).groupBy("region", "anchor", "part", "island").agg(
        F.min("at").alias("start"), (F.max("at") + WINDOW).alias("stop")
    )
    texts = pieces.join(parts.select("region", "key", "doc_id", "first", "text"), "region")
    texts = texts.select("key", "doc_id", "anchor", "part", "start", "stop", "first", "text").mapInArrow(
        piece_texts, "key bigint, doc_id bigint, anchor bigint, part bigint, start bigint, text string"
    )
    texts = settle(texts.withColumn("piece", F.xxhash64("anchor", "part", "text")), "substring-pieces")
    known = texts.groupBy("anchor", "part", "piece").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.first("text").alias("text"), F.lit(False).alias("whole")
    )
    copied = classes.filter("copied").select("key", "least", "last")
    whole = found.filter("whole").select("key", "text").join(copied, "key").select(
        F.xxhash64("text").alias("anchor"), F.lit(0).cast("bigint").alias("part"), F.xxhash64("text").alias("piece"),
        "least", "last", "text", F.lit(True).alias("whole"),
    )
    every = settle(known.unionByName(whole), "substring-known")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    work = every.agg(F.coalesce(F.sum(words), F.lit(0)).alias("n")).first()["n"]
    shard = F.pmod(F.xxhash64("anchor", "part"), F.lit(max(1, -(-work // WORDS_PER_SHARD))))
    hits = every.select(shard.alias("shard"), "piece", "text", "least", "last", "whole").groupBy("shard").applyInArrow(
        searched, "piece bigint, later boolean, low bigint, high bigint"
    )
    hits = settle(hits, "substring-hits")
    least = every.filter("not whole").select("piece", "least")
    own = texts.join(least, "piece").select("key", "piece", (F.col("doc_id") > F.col("least")).alias("later"), "start")
    copies = listed.join(classes.filter("copied").select("same", "least", F.col("key").alias("rep")), "same").filter("doc_id > least")
    named_whole = found.filter("whole").select(F.col("key").alias("rep"), F.xxhash64("text").alias("piece"))
    copies = copies.join(named_whole, "rep").select("key", "piece", F.lit(True).alias("later"), F.lit(0).cast("bigint").alias("start"))
    back = own.unionByName(copies).join(hits, ["piece", "later"])
    return back.select("key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def cut_out(text: str | None, stretches: list[dict] | None) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside the stretches."""
    words = (text or "").encode("utf-8", "replace").split()
    kept, reached = [], 0
    for s in sorted(stretches or (), key=lambda s: s["low"]):
        if s["low"] > reached:
            kept += words[reached : s["low"]]
        reached = max(reached, s["high"])
    return len(words), kept + words[reached:]


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of `docs` (doc_id, text).

    Null texts have no words. Rows without an id take no part: nothing is removed from them or on their account. Rows that
    repeat an id do not count as repeating each other. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).select("key", "doc_id", "text")
    stretches = repeated_stretches(rows).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("stretches"))

    def cut(batches):
        for batch in batches:
            done = [cut_out(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(k) for n, k in done], pa.int64()),
                 pa.array([b" ".join(k).decode() for _, k in done], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    whole = rows.join(stretches, "key", "left").select("doc_id", "text", "stretches")
    return whole.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def substring_digest(docs: DataFrame) -> DataFrame:
    kept = drop_repeats(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
