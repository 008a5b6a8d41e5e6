"""What several corpus operators share: stored steps, and words as hashes.

Text rules used throughout: a word is a run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger import session

__all__ = ["settle", "WORD", "word_count", "documents", "Words", "chunks", "mix", "held_out"]

#: One word, as a regular expression; the class is every character but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back; see `session.settle`."""
    return session.settle(df, f"corpus-{label}")


def documents(spark, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


# ---- words as 64-bit hashes, a whole batch of texts at a time ----

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E6C63D0876A9A47
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64, kept and grown by doubling."""
    have = _powers[base]
    while len(have) < count:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
        _powers[base] = have
    return have[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray) -> np.ndarray:
    """Weighted prefix sums: the hash of any run follows from two of them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def runs(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, from their prefix sums."""
    return (prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start]


class Words:
    """The words of several texts: byte range, hash and text of each, in order. `apart` marks the bytes between words."""

    def __init__(self, texts: pa.Array, lower: bool = False, apart: np.ndarray = SPACE):
        texts = texts.cast(pa.large_string()).fill_null("")
        buffers = texts.buffers()
        bounds = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(buffers[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        self.bounds, self.bytes = bounds - bounds[0], raw
        data = LOWER[raw] if lower else raw
        solid = ~apart[data]
        first = np.zeros(len(data) + 1, bool)
        first[self.bounds] = True
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | first[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | first[1:-1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        prefix = sums(data.astype(np.uint64) + np.uint64(1))
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix(runs(prefix, self.start, self.end) + length * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of `size` words; a shorter text with words gives one run of all."""
        prefix, n = sums(self.hash), len(self.hash)
        at = np.arange(max(0, n - size + 1))
        at = at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at
        short = np.flatnonzero((self.count > 0) & (self.count < size))
        start = np.concatenate([at, self.first[short]]).astype(np.int64)
        width = np.concatenate([np.full(len(at), size), self.count[short]]).astype(np.int64)
        doc = np.concatenate([self.doc[at], short]).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        start, width, doc = start[order], width[order], doc[order]
        return doc, mix(runs(prefix, start, start + width) + width.astype(np.uint64))


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to about CHUNK_BYTES; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
