"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A run of three letters is the product (binding) of
its letters' vectors, rotated by their position (permutation). A text is the sum (bundle) of its
3-letter runs, a language prototype the sum over the training texts of that language, and a text gets
the language whose prototype has the largest cosine with it. Any character outside the letters counts as one
boundary symbol between words. Letter vectors follow from the code point alone, so tasks agree on them
and every script works.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import chunks, held_out

DIMENSIONS = 1024
GRAM = 3
BOUNDARY = 32
#: Turns differences between cosines into a share of confidence.
SHARPNESS = 25.0
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """One bound vector per row of code points."""
    codes, index = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(c)) for c in codes]).astype(np.float32)
    index = index.reshape(grams.shape)
    out = np.roll(table, GRAM - 1, axis=1)[index[:, 0]]
    for place in range(1, GRAM):
        out *= np.roll(table, GRAM - 1 - place, axis=1)[index[:, place]]
    return out


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one boundary between and around words."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letter_table()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a word stands for the boundary
    kept = np.where(letter, code, BOUNDARY)[keep]
    return np.concatenate([[BOUNDARY], kept, [BOUNDARY]]).astype(np.int64) if len(kept) else np.empty(0, np.int64)


class Grams:
    """The letter runs of several texts: which text holds which run how often."""

    def __init__(self, texts: list[str | None]):
        rows = [letters_of(text or "") for text in texts]
        sizes = np.array([max(0, len(r) - GRAM + 1) for r in rows])
        self.texts, self.has = len(rows), sizes > 0
        flat = np.concatenate([*rows, np.empty(0, np.int64)])
        present = np.bincount(flat.astype(np.int64), minlength=1) > 0
        self.codes = np.flatnonzero(present)
        dense = (np.cumsum(present) - 1)[flat.astype(np.int64)]
        self.width = max(1, len(self.codes))
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        inside = np.ones(len(flat), bool)  # positions where a run starts: all but the last two of a text
        for back in range(1, GRAM):
            ends = starts[1:][np.diff(starts) > 0] - back
            inside[ends] = False
        at = np.flatnonzero(inside)
        key = np.zeros(len(at), np.int64)
        for place in range(GRAM):
            key = key * self.width + dense[at + place]
        self.owner = np.repeat(np.arange(self.texts), sizes)
        if self.width ** GRAM <= 1 << 24:  # few letters: number the runs by counting instead of sorting
            used = np.bincount(key, minlength=1) > 0
            self.grams, self.gram = np.flatnonzero(used), (np.cumsum(used) - 1)[key]
        else:
            self.grams, self.gram = np.unique(key, return_inverse=True)

    def spelled(self) -> np.ndarray:
        """The code points of each different run."""
        if not len(self.grams):
            return np.empty((0, GRAM), np.int64)
        return np.stack([self.codes[(self.grams // self.width ** (GRAM - 1 - p)) % self.width] for p in range(GRAM)], axis=1)

    def bundled(self, owner: np.ndarray, owners: int) -> np.ndarray:
        """Sum of the run vectors of each owner, a few thousand different runs at a time."""
        out, spelled = np.zeros((owners, DIMENSIONS), np.float32), self.spelled()
        for low in range(0, len(self.grams), 4096):
            part = (self.gram >= low) & (self.gram < low + 4096)
            size = min(4096, len(self.grams) - low)
            counts = np.bincount(owner[part] * size + self.gram[part] - low, minlength=owners * size)
            out += counts.reshape(owners, size).astype(np.float32) @ gram_vectors(spelled[low : low + size])
        return out


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of every text, and whether it has a letter."""
    grams = Grams(texts)
    return grams.bundled(grams.owner, grams.texts), grams.has


def bundle_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the text vectors of each language within one task."""
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches, "text"):
        grams = Grams(batch.column("text").to_pylist())
        names, lang = np.unique(np.array(batch.column("lang").to_pylist(), dtype=str), return_inverse=True)
        for name, vector in zip(names.tolist(), grams.bundled(lang[grams.owner], len(names))):
            if vector.any():
                total[name] = total.get(name, 0.0) + vector.astype(float)
    names = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "v"]
    )


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and their unit vectors, from rows (text, lang); DIMENSIONS numbers a language reach the driver."""
    parts = docs.filter("lang is not null").select("text", "lang").mapInArrow(bundle_languages, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    table = sums.orderBy("lang", "i").toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    vectors = table.column("x").to_numpy().reshape(len(names), DIMENSIONS) if names else np.zeros((0, DIMENSIONS))
    return names, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score and cosine of every row of `docs` (doc_id, text), learned from `train` (text, lang).

    A null text or one without a letter is `und` with score 0, as is every text if nothing was learned.
    The score is the winner's share of exp(SHARPNESS * cosine). Equal cosines go to the first name.
    """
    names, unit = prototypes(train)
    known = docs.sparkSession.sparkContext.broadcast((names, unit.astype(np.float32)))

    def predicted(batches):
        names, unit = known.value
        for batch in chunks(batches, "text"):
            vectors, has = bundles(batch.column("text").to_pylist())
            pred, score, cosine = [UNKNOWN] * len(has), np.zeros(len(has)), np.zeros(len(has))
            if names and has.any():
                cos = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                share = np.exp(SHARPNESS * (cos - cos.max(1, keepdims=True)))
                best = cos.argmax(1)
                pred = [names[b] if h else UNKNOWN for b, h in zip(best, has)]
                score = np.where(has, 1 / share.sum(1), 0.0)
                cosine = np.where(has, cos.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(cosine, pa.float64())], ["doc_id", "lang_pred", "score", "cosine"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang_pred string, score double, cosine double"
    return docs.select("doc_id", "text").mapInArrow(predicted, schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """Predictions for all rows, learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 5, 0)
    found = identify(docs, docs.filter(~out).withColumn("lang", F.col("lang").cast("string")))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cosine")
