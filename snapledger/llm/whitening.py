"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Step j multiplies the centred rows X by a vector (Xv) and the result by X again (X'u), in one pass: a task has the
slice of u that belongs to its rows and sends back sums over them, a few numbers for each dimension. Every left vector is
X times a vector of the length of a row, so the left vectors are never stored; their inner products with the new one, which
full reorthogonalisation needs, are sums of the same pass. Right vectors are kept on the driver, one number for each
dimension and step, and reorthogonalised twice. Where a direction is exhausted the walk starts anew from a random vector
orthogonal to all before. The singular value decomposition of the small bidiagonal matrix gives deviations and components.

As many steps as dimensions are exact, also for equal deviations. For wide embeddings `tolerance` ends the walk as soon as the
leading components have settled to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import settle

COMPONENTS = 8
#: Entries are read as whole numbers floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Directions whose deviation is below this share of the largest one count as constant.
LEAST_SHARE = 1e-12
SEED = 29
MOST_LONG = (1 << 63) - 1
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"


class Fit(NamedTuple):
    """What whitening needs of the fit list; its size depends on the number of dimensions only."""

    n: int
    sums: list[int]
    reach: int  # largest minus smallest entry
    components: np.ndarray  # one column for each, by falling variance
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vector: Column) -> Column:
    """Entries as longs; null if the vector is null or an entry is null, not finite or too large for a long."""
    entries = vector.cast("array<double>")
    fits = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 2.0**52), F.lit(False))
    return F.when(F.forall(entries, fits), F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The column `x` of a batch, one row each."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> np.ndarray:
    """Sum of `part`, `width` numbers, over all rows: each task adds up its own, and Spark those of the tasks."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                values = part(matrix(batch))
                total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["place", "value"])

    sums = rows.select("x").mapInArrow(added, f"place bigint, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    found = sorted(sums.collect())  # `width` rows
    return np.array([value for _, value in found])


def exact_sums(rows: DataFrame, width: int) -> list[int]:
    """Sums of each entry, apart by upper and lower bits so that they cannot overflow."""
    both = summed(rows, lambda x: np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), 2 * width, "bigint")
    return [(int(high) << 32) + int(low) for high, low in zip(both[:width], both[width:])]


def products(rows: DataFrame, mean: np.ndarray, p: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """X'u, u'u and the inner products of u with the `earlier` left vectors, for u = Xp."""
    width = len(mean)

    def part(x):
        centred = x - mean
        u = centred @ p
        return np.concatenate([u @ centred, [u @ u], u @ (centred @ earlier)])

    total = summed(rows, part, width + 1 + earlier.shape[1])
    return total[:width], float(total[width]), total[width + 1 :]


def orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """The part of the vector outside the basis; the second time takes away what rounding left."""
    for _ in range(2 if basis else 0):
        held = np.array(basis)
        vector = vector - (held @ vector) @ held
    return vector


def bidiagonalised(
    rows: DataFrame, mean: np.ndarray, size: float, leading: int, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred rows by falling size, and their right vectors as columns.

    `size` is the root of the sum of all squared centred entries.
    """
    width, random = len(mean), np.random.default_rng(SEED)
    right: list[np.ndarray] = []
    lefts = np.zeros((width, 0))  # left vector i is X times column i, or zero
    images = np.zeros((width, 0))  # X' times left vector i
    diagonal, above = [], []
    v, link = None, 0.0
    while len(right) < width:
        if v is None:
            v = orthogonal(random.standard_normal(width), right)
            v, link = v / np.linalg.norm(v), 0.0
        previous = lefts[:, -1] if lefts.shape[1] else np.zeros(width)
        p = v - link * previous
        p = p - lefts @ (images.T @ p)  # what rounding has left of the earlier left vectors
        image, square, inner = products(rows, mean, p, lefts)
        p, image = p - lefts @ inner, image - images @ inner
        alpha = np.sqrt(max(0.0, square - float(inner @ inner)))
        right.append(v)
        if len(diagonal):
            above.append(link)
        if alpha <= LEAST_SHARE * size:  # v is a direction without deviation
            diagonal.append(0.0)
            lefts, images = np.column_stack([lefts, np.zeros(width)]), np.column_stack([images, np.zeros(width)])
            v = None
            continue
        diagonal.append(alpha)
        lefts, images = np.column_stack([lefts, p / alpha]), np.column_stack([images, image / alpha])
        rest = orthogonal(image / alpha - alpha * v, right)
        link = float(np.linalg.norm(rest))
        v = rest / link if link > LEAST_SHARE * size else None
        if tolerance and v is not None and len(right) > leading:
            small, _, _ = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
            if np.all(link * np.abs(small[-1, :leading]) <= tolerance * size):
                break
    _, values, turned = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
    return values, np.array(right).T @ turned.T


def fit(rows: DataFrame, width: int, n: int, components: int = COMPONENTS, tolerance: float = 0.0) -> Fit:
    """The leading components of stored rows (x: arrays of `width` longs), of which there are `n`."""
    sums = exact_sums(rows, width)
    mean = np.array([s / n for s in sums])
    ends = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    squares = summed(rows, lambda x: np.array([float(np.square(x - mean).sum())]), 1)[0]
    values, vectors = bidiagonalised(rows, mean, float(np.sqrt(squares)), components, tolerance)
    kept = [i for i in range(min(components, len(values))) if values[i] > LEAST_SHARE * values[0]]
    chosen = vectors[:, kept]
    # either sign is right; the largest entry of each is made positive so that reruns agree
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(0), np.arange(len(kept))])
    return Fit(n, sums, ends[1] - ends[0], chosen, np.square(values[kept]) / n, squares / n)


def whitened(x: np.ndarray, fitted: Fit) -> np.ndarray:
    return (x - fitted.mean) @ fitted.components / np.sqrt(fitted.variances)


def identity_error(rows: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from a pass over all rows."""
    k = len(fitted.variances)
    mean = summed(rows, lambda x: whitened(x, fitted).sum(0), k) / fitted.n

    def spread(x):
        w = whitened(x, fitted) - mean
        return (w.T @ w).ravel()

    spread = summed(rows, spread, k * k) / fitted.n
    return float(np.abs(spread.reshape(k, k) - np.eye(k)).max())


def deviations(x: np.ndarray, fitted: Fit) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; None where it exceeds a long."""
    most = max(1, fitted.n * max(fitted.reach, 1))
    if len(fitted.sums) * most * most <= MOST_LONG and fitted.n * (int(np.abs(x).max(initial=0)) + 1) <= MOST_LONG:
        return np.square(fitted.n * x - np.array(fitted.sums)).sum(1).tolist()
    sums = [sum((fitted.n * int(c) - s) ** 2 for c, s in zip(row, fitted.sums)) for row in x.tolist()]
    return [s if s <= MOST_LONG else None for s in sums]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, tolerance: float = 0.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for the rows of (vec_id, embedding).

    Rows whose vector is null, empty or holds a null or non-finite entry (or one of 2**52 and more) are left out, and so
    are those of another length than most rows have (of equally frequent lengths the longest counts). Null and repeated ids are rows like
    others. There are fewer than `components` rows for a vector if fewer directions deviate, none if all vectors are
    equal, and none for an empty table. `deviation` is null where it exceeds a long.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole(F.col("embedding")).alias("x"))
    rows = settle(rows.filter(F.size("x") > 0), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    nothing = spark.createDataFrame([], f"{WHITENED}, identity_error double")
    if common is None:
        return nothing
    rows = rows.filter(F.size("x") == common["width"])
    fitted = fit(rows, common["width"], common["n"], components, tolerance)
    k = len(fitted.variances)
    if not k:
        return nothing
    explained = fitted.variances / fitted.trace

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            take = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(take), fitted.n)), pa.array(deviations(x, fitted), pa.int64()).take(take),
                    pa.array(whitened(x, fitted).ravel()), pa.array(np.tile(explained, len(x))),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    error = F.lit(identity_error(rows, fitted))
    return rows.mapInArrow(written, WHITENED).withColumn("identity_error", error)
