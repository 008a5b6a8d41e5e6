"""Length buckets with the least padding, and token-budget batches inside each bucket.

Batches pad every text to the limit of its bucket. The global histogram of lengths decides the limits:
dynamic programming finds the boundaries for which the padding of all rows together is least. The histogram is the only thing
that reaches the driver: k different lengths take k * k / 2 tokens at least, so there are at most as many as the
root of twice the corpus, some millions for 10**13 tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import settle, word_count
from snapledger.operators.ordering import running_sums, up

BUCKETS = 16
TOKENS_PER_BATCH = 32_768


def best_limits(lengths: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Limits of at most `buckets` buckets of the sorted lengths with the least total padding.

    cost(i, j) = lengths[j] * rows in i..j; the sum of all lengths is the same for every choice. The best
    start of the last bucket never moves left as j grows, which lets each layer be solved by halving.
    """
    n = len(lengths)
    if not n:
        return []
    seen = np.concatenate([[0.0], np.cumsum(rows, dtype=float)])
    cost = lengths * seen[1:]  # one bucket for lengths 0..j
    choice = []
    for _ in range(min(buckets, n) - 1):
        new, start = np.empty(n), np.empty(n, np.int64)
        before = np.concatenate([[0.0], cost[:-1]])
        # spans of ends j with the starts to choose from; all spans of one depth are halved together
        low, high, first, last = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(low):
            mid = (low + high) // 2
            count = np.minimum(last, mid) - first + 1
            offset = np.cumsum(count) - count
            begin = np.repeat(first - offset, count) + np.arange(count.sum())
            end = np.repeat(mid, count)
            total = before[begin] + lengths[end] * (seen[end + 1] - seen[begin])
            least = np.minimum.reduceat(total, offset)
            found = np.flatnonzero(total == np.repeat(least, count))
            best = begin[found[np.searchsorted(found, offset)]]
            new[mid], start[mid] = least, best
            left, right = low < mid, mid < high
            low, high, first, last = (
                np.concatenate(x)
                for x in ((low[left], mid[right] + 1), (mid[left] - 1, high[right]), (first[left], best[right]), (best[left], last[right]))
            )
        cost = new
        choice.append(start)
    limits, j = [], n - 1
    for start in reversed(choice):
        if j < 0:
            break
        limits.append(int(lengths[j]))
        j = int(start[j]) - 1
    if j >= 0:
        limits.append(int(lengths[j]))
    return limits[::-1]


def length_histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).toArrow().sort_by("n_tokens")
    return table.column("n_tokens").to_numpy().astype(float), table.column("rows").to_numpy()


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKENS_PER_BATCH) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_limit, batch, slot of every row of `docs` (doc_id, text).

    A token is a word; pass other counts to `pack_lengths`. A null or empty text has no tokens and lies in the
    lowest bucket. Rows with null or repeated ids are packed like others; an empty table gives no rows.
    """
    return pack_lengths(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), buckets, budget)


def pack_lengths(lengths: DataFrame, buckets: int = BUCKETS, budget: int = TOKENS_PER_BATCH) -> DataFrame:
    """Buckets and batches for rows (doc_id, n_tokens).

    bucket counts from 0; batch counts from 0 within its bucket, slot within its batch. A batch holds
    budget // bucket_limit rows, at least one, and only the last one of a bucket may hold fewer.
    """
    lengths = settle(lengths, "pack-lengths")
    limits = best_limits(*length_histogram(lengths), buckets)
    table = F.array(*[F.lit(x).cast("bigint") for x in limits])
    bucket = F.size(F.filter(table, lambda x: x < F.col("n_tokens")))
    rows = lengths.withColumn("bucket", bucket).withColumn("bucket_limit", F.get(table, F.col("bucket")))
    rows = rows.withColumns({"_one": F.lit(1).cast("bigint"), "_spread": F.xxhash64("doc_id", "n_tokens")})
    rows = running_sums(rows, ["bucket"], [up("_spread"), up("doc_id"), up("n_tokens")], "_one", "nth")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_limit"))))
    return rows.select(
        "doc_id", "n_tokens", F.col("bucket").cast("bigint").alias("bucket"), "bucket_limit",
        F.floor(F.col("nth") / each).alias("batch"), (F.col("nth") % each).alias("slot"),
    )
