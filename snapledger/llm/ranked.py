"""Ranked lexical search over hashed max-sketches, with exact scores.

The impact of a term in a document grows with its number of occurrences there. The sketch of a document folds its terms
into cells by a hash and keeps the largest number of occurrences of each cell (sparse, since most cells are empty), so that a cell
gives the largest impact of any term in it. A query looks up the cells of its terms: the weighted sum of their impacts is never below the
document's score. A search over a batch of queries takes:

1. A pass over the sketches: the documents with the highest bounds of each query. Their texts are scored exactly, which gives a
   first threshold: the score of the kth best.
2. A second pass: all documents whose bound reaches the threshold.
3. Of these, by descending bound, some at a time, texts are scored and thresholds raised, until no bound is left above them.

Nothing else can be among the best k, so the result is exact. Equal texts are scored once, and of each only the k smallest
ids can be among the best k. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import Words, chunks, settle

RANKS = 20
#: Cells of a sketch: 2**16, and more for a document with so many terms that less than LEAST_ROOM cells would fall to each.
CELL_BITS, LEAST_ROOM = 16, 16
#: Occurrences a cell can count; the highest stands for any number.
MOST_COUNTED = 255
#: Terms of the queries that are searched together (one query may have more), and (query, text) pairs scored in one step: the bounds
#: of what is broadcast.
TERMS_PER_BATCH = 1 << 18
PAIRS_PER_STEP = 1 << 17
#: The first step scores so many times k documents of each query.
FIRST = 2
#: Bounds in memory at a time, and terms a task counts before it lets go of them.
BOUNDS_AT_ONCE = 1 << 20
TERMS_HELD = 1 << 18

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes between terms.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False

SKETCHES = "digest binary, doc_id bigint, n bigint, bits int, cells binary, tops binary, terms array<bigint>, holders array<bigint>"
SKETCH_KINDS = pa.schema([
    ("digest", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("bits", pa.int32()), ("cells", pa.binary()),
    ("tops", pa.binary()), ("terms", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())),
])
FOUND = "query int, digest binary, doc_id bigint, bound bigint"


class Index(NamedTuple):
    """What a search needs; independent of the queries."""

    sketches: DataFrame  # digest of the text, doc_id, n, bits, cells, tops
    counts: DataFrame  # terms, holders: in how many documents each term stands, in parts that add up
    texts: DataFrame  # doc_id, text, digest
    documents: int  # with a term
    terms: int  # of all documents, with repeats


def tallied(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of each distinct pair, in order of document and term."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


def merged(terms: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, which = np.unique(terms, return_inverse=True)
    return terms, np.bincount(which, holders, len(terms)).astype(np.int64)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of each text, and rows that count the documents of each term."""
    terms, holders = np.empty(0, np.uint64), np.empty(0, np.int64)

    def counted():
        return pa.RecordBatch.from_pylist([{"terms": terms.view(np.int64), "holders": holders}], SKETCH_KINDS)

    for batch in chunks(batches, "text"):
        words = Words(batch.column("text"), lower=True, apart=APART)
        doc, term, times = tallied(words.doc, words.hash)
        distinct = np.bincount(doc, minlength=batch.num_rows)
        bits = np.maximum(CELL_BITS, np.ceil(np.log2(np.maximum(1, distinct * LEAST_ROOM)))).astype(np.int64)
        cell = term >> (64 - bits[doc]).astype(np.uint64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])
        first = np.flatnonzero(new)
        top = np.minimum(np.maximum.reduceat(times, first), MOST_COUNTED).astype(np.uint8) if len(first) else times.astype(np.uint8)
        ends = np.searchsorted(doc[first], np.arange(batch.num_rows + 1))
        cell = cell[first].astype("<u4")
        parts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), bits.tolist()))
        none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("digest"), batch.column("doc_id"), pa.array(words.count), pa.array(bits, pa.int32()),
                pa.array([(cell[a:b].astype("<u2") if w == 16 else cell[a:b]).tobytes() for a, b, w in parts], pa.binary()),
                pa.array([top[a:b].tobytes() for a, b, _ in parts], pa.binary()), none, none,
            ],
            schema=SKETCH_KINDS,
        )
        terms, holders = merged(np.concatenate([terms, term]), np.concatenate([holders, np.ones(len(term), np.int64)]))
        if len(terms) > TERMS_HELD:
            yield counted()
            terms, holders = terms[:0], holders[:0]
    if len(terms):
        yield counted()


def build_index(docs: DataFrame) -> Index:
    """Sketches and term counts of `docs` (doc_id, text), from one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    stored = settle(texts.mapInArrow(sketched, SKETCHES), "ranked-index")
    sketches = stored.filter("digest is not null").drop("terms", "holders")
    total = sketches.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(sketches, stored.filter("terms is not null").select("terms", "holders"), texts, total[0], total[1])


class Queries(NamedTuple):
    """A batch of queries: their terms, and the weight of each term in each query."""

    terms: np.ndarray  # distinct, in order of hash
    term: np.ndarray  # of each entry
    weight: np.ndarray
    start: np.ndarray  # first entry of each query
    documents: int
    length: int

    def scores(self, times: np.ndarray, n: int) -> np.ndarray:
        """Score of each query for a document of `n` terms, from the occurrences of each term."""
        held = np.flatnonzero(times)
        seen = times[held].astype(np.int64)
        norm = 100 - 25 + 25 * n * self.documents // self.length
        impact = np.zeros(len(self.terms), np.int64)
        impact[held] = 1_000_000_000 * seen // (1000 * seen + 12 * norm)
        return np.add.reduceat(impact[self.term] * self.weight, self.start)


class Lookup:
    """Upper bounds of a batch of queries for sketches."""

    def __init__(self, queries: Queries):
        self.queries, self.places, self.cells = queries, {}, {}

    def bounds(self, n: int, bits: int, cells: bytes, tops: bytes) -> np.ndarray:
        if bits not in self.places:
            self.places[bits] = (self.queries.terms >> np.uint64(64 - bits)).astype(np.int64)
            self.cells[bits] = np.zeros(1 << bits, np.uint8)
        at, table = np.frombuffer(cells, "<u2" if bits == 16 else "<u4"), self.cells[bits]
        table[at] = np.frombuffer(tops, np.uint8)
        times = table[self.places[bits]].astype(np.int64)
        table[at] = 0
        # so often that the impact is at its limit, whatever the length
        times[times == MOST_COUNTED] = 1 << 31
        return self.queries.scores(times, n)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Sketches and their bounds: one row for each sketch, one column for each query."""
        rows = max(1, BOUNDS_AT_ONCE // len(self.queries.start))
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                each = zip(*(part.column(c).to_pylist() for c in ("n", "bits", "cells", "tops")))
                yield part, np.stack([self.bounds(*row) for row in each])


def found_rows(part: pa.RecordBatch, row: np.ndarray, query: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int32()), part.column("digest").take(take), part.column("doc_id").take(take), pa.array(bound, pa.int64())],
        ["query", "digest", "doc_id", "bound"],
    )


def highest(sketches: DataFrame, queries: Queries, rows: int) -> DataFrame:
    """The `rows` documents with the highest bounds above 0 of each query and task, as FOUND."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, len(queries.start)), np.int64)
        held = None  # rows that may be among the best
        for part, bounds in Lookup(queries).blocks(batches):
            bounds = np.concatenate([best, bounds])
            names = part.select(["digest", "doc_id"])
            table = pa.Table.from_batches([names] if held is None else [*held.to_batches(), names]).combine_chunks()
            # keep whole rows that are among the best of any query
            cut = min(rows, len(bounds))
            top = np.argpartition(-bounds, cut - 1, axis=0)[:cut]
            keep = np.unique(top)
            best, held = bounds[keep], table.take(pa.array(keep))
        if held is not None:
            top = np.argpartition(-best, min(rows, len(best)) - 1, axis=0)[: min(rows, len(best))]
            query = np.broadcast_to(np.arange(best.shape[1]), top.shape)
            bound = np.take_along_axis(best, top, axis=0)
            above = bound > 0
            yield found_rows(held.combine_chunks().to_batches()[0], top[above], query[above], bound[above])

    return sketches.mapInArrow(kept, FOUND)


def reaching(sketches: DataFrame, queries: Queries, least: np.ndarray, ids: np.ndarray) -> DataFrame:
    """Documents whose bound reaches the threshold of a query: score `least` at id `ids`, both above 0, as FOUND."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in Lookup(queries).blocks(batches):
            row, query = np.nonzero((bounds >= least) & (bounds > 0))
            bound = bounds[row, query]
            own = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)[row]
            good = (bound > least[query]) | (own <= ids[query])
            yield found_rows(part, row[good], query[good], bound[good])

    return sketches.mapInArrow(kept, FOUND)


#: Place of a missing id among others: the last.
NO_ID = (1 << 63) - 1


def scored(index: Index, queries: Queries, pairs: DataFrame) -> DataFrame:
    """query, digest, score for `pairs` (query, digest, doc_id), of which there are at most PAIRS_PER_STEP.

    `doc_id` names one of the documents with the text, so that copies are not scored again.
    """
    named = pairs.groupBy("digest").agg(F.min("doc_id").alias("_id"), F.collect_list("query").alias("queries"))
    named = named.withColumnRenamed("digest", "_digest")
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = index.texts.join(F.broadcast(named), same).select("digest", "text", "queries")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text"), lower=True, apart=APART)
            place = np.minimum(np.searchsorted(queries.terms, words.hash), len(queries.terms) - 1)
            known = queries.terms[place] == words.hash
            doc, term, times = tallied(words.doc[known], place[known])
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            asked, digests, scores = batch.column("queries").to_pylist(), [], []
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                seen = np.zeros(len(queries.terms), np.int64)
                seen[term[ends[i] : ends[i + 1]]] = times[ends[i] : ends[i + 1]]
                scores.append(queries.scores(seen, int(words.count[i]))[asked[i]])
                digests += [digest] * len(asked[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for a in asked for q in a], pa.int32()), pa.array(digests, pa.binary()), pa.array(np.concatenate(scores))],
                ["query", "digest", "score"],
            )

    rows = texts.mapInArrow(score, "query int, digest binary, score bigint")
    return settle(rows.groupBy("query", "digest").agg(F.max("score").alias("score")), "ranked-scores")


def by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def best(found: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """query, doc_id, score, rank of the k best of each query above 0."""
    rows = found.select("query", "digest", "doc_id").join(scores, ["query", "digest"]).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(*by_score()))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k).select("query", "doc_id", "score", "rank")


def thresholds(found: DataFrame, scores: DataFrame, k: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and id of the kth best of each query; score 0 where there are fewer."""
    least, ids = np.zeros(count, np.int64), np.full(count, -NO_ID - 1)
    for row in best(found, scores, k).filter(F.col("rank") == k).collect():  # one row for each query at most
        least[row["query"]], ids[row["query"]] = row["score"], NO_ID if row["doc_id"] is None else row["doc_id"]
    return least, ids


def best_of_batch(index: Index, queries: Queries, k: int) -> DataFrame:
    spark, count = index.sketches.sparkSession, len(queries.start)
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), F.col("doc_id").asc_nulls_last(), "digest")
    first = highest(index.sketches, queries, FIRST * k).withColumn("_place", F.row_number().over(by_bound))
    first = settle(first.filter(F.col("_place") <= FIRST * k).drop("_place"), "ranked-first")
    known = [scored(index, queries, first)]
    least, ids = thresholds(first, known[0], k, count)
    # of equal texts, the k smallest ids can be among the best
    copies = Window.partitionBy("query", "digest").orderBy(F.col("doc_id").asc_nulls_last())
    found = reaching(index.sketches, queries, least, ids).withColumn("_place", F.row_number().over(copies))
    found = settle(found.filter(F.col("_place") <= k).drop("_place"), "ranked-found")
    step = max(1, min(1000, PAIRS_PER_STEP // count))
    while True:
        scores = reduce(DataFrame.unionByName, known)
        least, ids = thresholds(found, scores, k, count)
        limit = spark.createDataFrame(
            list(zip(range(count), least.tolist(), ids.tolist())), "query int, least bigint, last bigint"
        )  # one row for each query of the batch
        open_ = found.join(F.broadcast(limit), "query").filter(
            (F.col("bound") > F.col("least")) | (F.col("bound") == F.col("least")) & (F.coalesce("doc_id", F.lit(NO_ID)) <= F.col("last"))
        )
        texts = open_.groupBy("query", "digest").agg(F.max("bound").alias("bound"), F.min("doc_id").alias("doc_id"))
        texts = texts.join(scores.select("query", "digest"), ["query", "digest"], "left_anti")
        texts = settle(texts.withColumn("_place", F.row_number().over(by_bound)).filter(F.col("_place") <= step).drop("_place"), "ranked-step")
        if texts.isEmpty():
            return best(found, scores, k)
        known.append(scored(index, queries, texts))


def batched(index: Index, items: pa.Table) -> tuple[Queries, list]:
    """A batch of queries with their weights, and the item of each; items without terms are left out."""
    words = Words(items.column("text").combine_chunks(), lower=True, apart=APART)
    item, term, times = tallied(words.doc, words.hash)
    terms, place = np.unique(term, return_inverse=True)
    asked = items_frame(index, terms)
    holders = index.counts.select(F.explode(F.arrays_zip("terms", "holders")).alias("c")).select("c.terms", "c.holders")
    # the terms of one batch
    held = holders.join(F.broadcast(asked), holders["terms"] == asked["term"]).groupBy("nth").agg(F.sum("holders").alias("n")).collect()
    documents = dict(held)
    weight = [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * documents.get(i, 0) + 1))) for i in range(len(terms))]
    used, start = np.unique(item, return_index=True)
    weight = np.array(weight, np.int64)[place] * times if len(terms) else np.empty(0, np.int64)
    return Queries(terms, place, weight, start, index.documents, index.terms), items.column("item_id").take(pa.array(used)).to_pylist()


def items_frame(index: Index, terms: np.ndarray) -> DataFrame:
    rows = pa.table({"term": terms.view(np.int64), "nth": np.arange(len(terms), dtype=np.int64)})
    return index.sketches.sparkSession.createDataFrame(rows)


def search(index: Index, queries: DataFrame, k: int = RANKS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents above 0 of each row of `queries` (item_id, text).

    Rows that repeat an item_id are queries of their own; null and empty texts find nothing. Documents without an id come
    after others of the same score; documents that repeat an id each have a place. Empty tables give no rows.
    """
    spark = queries.sparkSession
    kind = dict(queries.dtypes)["item_id"]
    items = queries.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.withColumn("terms", F.regexp_count("text", F.lit(TERM)))
    total = items.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    answers = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")]
    batches = -(-total // TERMS_PER_BATCH) if index.terms else 0
    for b in range(batches):
        mine = items.filter((F.col("terms") > 0) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b))
        part, names = batched(index, mine.select("item_id", "text").toArrow())
        if names:
            named = spark.createDataFrame(list(enumerate(names)), f"query int, item_id {kind}")
            rows = best_of_batch(index, part, k).join(F.broadcast(named), "query")  # one row for each query of the batch
            answers.append(rows.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, answers)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = RANKS) -> DataFrame:
    """`search` in all of `docs` (doc_id, text); a null text has no terms."""
    return search(build_index(docs), queries, k)
