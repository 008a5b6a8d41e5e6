"""Token ids in binary shards, with a minimal perfect hash index from document keys to their places.

A shard holds the ids of consecutive documents, an end id after each, as plain little-endian integers, and then the
offsets of its documents, so that the nth document of a shard is found in one step:

    ids       uint16 if every id of the vocabulary fits, else uint32
    offsets   uint64, one more than documents, counted in ids
    tail      8 bytes magic, uint32 bytes of an id, uint32 0, uint64 documents, uint64 ids

The index is cut by a hash of the key into files of about KEYS_PER_INDEX keys. Each holds a minimal perfect hash
function: keys are hashed into a bit vector; those that meet no other key there are placed, the rest go on to the next,
smaller vector. The number of set bits before a key's bit is its slot. A slot stores a fingerprint of the key, since
a key that was never written reaches some slot too, and its places: shard, first document, number of documents
(a repeated key may lie in several shards).

    header    8 bytes magic, uint32 levels, uint32 keys, uint32 places, uint32 0
    levels    uint64 words of bits of each level, then the words themselves
    slots     uint32 fingerprint, uint32 number of the first place
    places    uint32 shard, uint32 first document, uint32 documents

Files are written by tasks under names of their own; a task returns the names, and only files in the stored lists
are read, so what a lost or repeated task leaves behind does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import chunks, mix, settle
from snapledger.llm.encoder import Encoder
from snapledger.llm.warc import opened
from snapledger.session import new_folder

SHARD_MAGIC, INDEX_MAGIC = b"TOKSHARD", b"TOKINDEX"
#: Characters of text in a shard, about.
SHARD_CHARS = 16 << 20
KEYS_PER_INDEX = 1 << 16
END = 0
#: Bits of a level for each key that reaches it.
BITS_PER_KEY = 2
#: Documents that one read takes, at most.
STRETCH = 512
IDS_PER_TASK = 4 << 20
IDS_PER_BATCH = 1 << 20
FINGERPRINT = np.uint64(0x5851F42D4C957F2D)
NO_KEY = np.uint64(0x14057B7EF767814F)
RUNS = "file string, doc_id bigint, first bigint, documents bigint, ids bigint"


class Archive(NamedTuple):
    """Lists of the files: shards (file, shard, ids, start), index (file, part), and how many parts the index has."""

    shards: DataFrame
    index: DataFrame
    parts: int


# ---- minimal perfect hashing ----


def key_hash(keys: pa.Array) -> np.ndarray:
    """A hash of each key; distinct for distinct keys but for the null key, which may meet one other."""
    values = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    missing = keys.is_null().to_numpy(zero_copy_only=False)
    return np.where(missing, NO_KEY, mix(values + np.uint64(0x9E3779B97F4A7C15)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ FINGERPRINT) >> np.uint64(32)).astype(np.uint32)


def place(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Slots 0 .. keys - 1 for distinct hashes; -1 for most hashes that are not among them."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # words of 64 bits
        counts = [np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]) for w in levels]
        self.before, base = [], 0
        for c in counts:
            self.before.append(c[:-1] + base)
            base += int(c[-1])
        self.keys = base

    @classmethod
    def built(cls, hashes: np.ndarray) -> PerfectHash:
        levels, rest = [], hashes
        while len(rest):
            words = -(-len(rest) * BITS_PER_KEY // 64)
            at = place(rest, len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            at = place(hashes[open_], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


class Index:
    """One file of the index."""

    def __init__(self, hashing: PerfectHash, prints: np.ndarray, first: np.ndarray, places: np.ndarray):
        self.hashing, self.prints, self.first, self.places = hashing, prints, first, places

    @classmethod
    def built(cls, hashes: np.ndarray, places: np.ndarray) -> Index:
        """From one hash and one place (shard, first, documents) for each run; equal hashes are one key."""
        keys, which = np.unique(hashes, return_inverse=True)
        hashing = PerfectHash.built(keys)
        slot = hashing.slots(keys)
        prints = np.empty(len(keys), np.uint32)
        prints[slot] = fingerprints(keys)
        order = np.lexsort((places[:, 1], places[:, 0], slot[which]))
        counts = np.bincount(slot[which], minlength=len(keys))
        return cls(hashing, prints, (np.cumsum(counts) - counts).astype(np.uint32), places[order].astype(np.uint32))

    def written(self) -> bytes:
        levels = self.hashing.levels
        head = INDEX_MAGIC + struct.pack("<4I", len(levels), len(self.prints), len(self.places), 0)
        parts = [head, struct.pack(f"<{len(levels)}Q", *map(len, levels)), *(w.astype("<u8").tobytes() for w in levels)]
        return b"".join([*parts, *(x.astype("<u4").tobytes() for x in (self.prints, self.first, self.places))])

    @classmethod
    def read(cls, data: bytes) -> Index:
        if data[:8] != INDEX_MAGIC:
            raise ValueError("not an index file")
        n_levels, keys, places, _ = struct.unpack_from("<4I", data, 8)
        sizes, at = struct.unpack_from(f"<{n_levels}Q", data, 24), 24 + 8 * n_levels
        levels = []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        rest = np.frombuffer(data, "<u4", 2 * keys + 3 * places, at)
        return cls(PerfectHash(levels), rest[:keys], rest[keys : 2 * keys], rest[2 * keys :].reshape(-1, 3))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked hash, place) for every place of every asked key that was written."""
        slot = self.hashing.slots(hashes)
        known = np.flatnonzero(slot >= 0)
        known = known[self.prints[slot[known]] == fingerprints(hashes[known])]
        ends = np.append(self.first[1:], len(self.places)).astype(np.int64)
        first, n = self.first[slot[known]].astype(np.int64), ends[slot[known]] - self.first[slot[known]]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(known, n), self.places[np.repeat(first, n) + nth].astype(np.int64)


# ---- shards ----


class ShardWriter:
    """Writes one shard; documents are added in order."""

    def __init__(self, folder: str, id_bytes: int):
        self.path, self.id_bytes = f"{folder}/shard-{uuid.uuid4().hex}.ids", id_bytes
        store, inner = opened(self.path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.file, self.offsets = store.open_output_stream(inner), [0]

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add documents, given their ids, end ids included, and their number of each."""
        self.file.write(ids.tobytes())
        self.offsets.extend((self.offsets[-1] + np.cumsum(counts)).tolist())

    def close(self) -> None:
        self.file.write(np.array(self.offsets, "<u8").tobytes())
        self.file.write(SHARD_MAGIC + struct.pack("<2I2Q", self.id_bytes, 0, len(self.offsets) - 1, self.offsets[-1]))
        self.file.close()


TAIL = len(SHARD_MAGIC) + 24


class Shard:
    """Reads documents of one shard by their number."""

    def __init__(self, path: str):
        store, inner = opened(path)
        self.file = store.open_input_file(inner)
        tail = self.at(self.file.size() - TAIL, TAIL)
        if tail[:8] != SHARD_MAGIC:
            raise ValueError(f"not a shard: {path}")
        self.id_bytes, _, self.documents, self.ids = struct.unpack_from("<2I2Q", tail, 8)

    def at(self, place: int, size: int) -> bytes:
        return self.file.read_at(size, place)

    def offsets(self, first: int, documents: int) -> np.ndarray:
        return np.frombuffer(self.at(self.ids * self.id_bytes + 8 * first, 8 * (documents + 1)), "<u8").astype(np.int64)

    def read(self, first: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of neighbouring documents."""
        offsets = self.offsets(first, documents)
        data = self.at(int(offsets[0]) * self.id_bytes, int(offsets[-1] - offsets[0]) * self.id_bytes)
        return offsets, np.frombuffer(data, f"<u{self.id_bytes}")

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> Archive:
    """Write the ids of every text of `docs` (doc_id, text) in ascending doc_id order, and the index of the keys.

    Null ids come last and are one key; rows with equal ids follow each other in the order of their texts' hashes. Equal ids may be
    spread over shards, so no task holds a whole key. A null text is empty: it has the end id only. An empty table gives no files.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_at")]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(max(1, -(-chars // SHARD_CHARS)), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.loaded(tokenizer, end)
        writer, run = None, None
        for batch in chunks(batches, "text"):
            writer = writer or ShardWriter(folder, encoder.id_bytes)
            done, nth = [], len(writer.offsets) - 1
            ids, counts = encoder.encoded(batch.column("text"))
            writer.add(ids, counts)
            for key, size in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                if run is not None and run["doc_id"] == key:
                    run["documents"] += 1
                    run["ids"] += size
                else:
                    done += [run] if run is not None else []
                    run = {"file": writer.path, "doc_id": key, "first": nth, "documents": 1, "ids": size}
                nth += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, KINDS)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([run], KINDS)

    runs = placed.select("doc_id", "text").mapInArrow(write, RUNS)
    runs = settle(runs, "token-runs")
    # shards in the order of their keys; a key that several shards share has its rows in them in any order
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    last = F.max(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    shards = runs.groupBy("file").agg(first.alias("low"), last.alias("high"), F.sum("ids").alias("ids"))
    along = Window.orderBy("low", "high", "file")  # one row for each shard
    before = F.coalesce(F.sum("ids").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = settle(shards.select("file", (F.row_number().over(along) - 1).alias("shard"), "ids", before.alias("start")), "token-shards")
    keys = runs.select("doc_id").distinct().count()
    parts = max(1, -(-keys // KEYS_PER_INDEX))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        places = np.stack([table.column(c).to_numpy() for c in ("shard", "first", "documents")], axis=1)
        path = f"{folder}/index-{uuid.uuid4().hex}.mph"
        store, inner = opened(path)
        with store.open_output_stream(inner) as file:
            file.write(Index.built(key_hash(table.column("doc_id").combine_chunks()), places).written())
        return pa.table([table.column("part")[:1].cast(pa.int64()), pa.array([path])], ["part", "file"])

    entries = runs.join(shards.select("file", "shard"), "file").select(part_of(parts).alias("part"), "doc_id", "shard", "first", "documents")
    index = settle(entries.groupBy("part").applyInArrow(build, "part bigint, file string"), "token-index")
    return Archive(shards, index, parts)


KINDS = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("first", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])


def part_of(parts: int) -> Column:
    """Index file of a key."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("bigint")


def look_up(archive: Archive, keys: DataFrame) -> DataFrame:
    """doc_id, shard, first, documents for every place of the asked keys (doc_id); keys that were not written have none.

    A key that is asked for repeatedly is answered once. Each index file is opened once for many keys.
    """
    asked = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("part", part_of(archive.parts))
    asked = asked.join(archive.index.withColumnRenamed("file", "index_file"), "part").select("index_file", "doc_id")

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        store, inner = opened(table.column("index_file")[0].as_py())
        with store.open_input_stream(inner) as file:
            index = Index.read(file.read())
        ids = table.column("doc_id").combine_chunks()
        which, places = index.find(key_hash(ids))
        return pa.table([ids.take(pa.array(which)), *(pa.array(places[:, i]) for i in range(3))], ["doc_id", "shard", "first", "documents"])

    return asked.groupBy("index_file").applyInArrow(find, "doc_id bigint, shard bigint, first bigint, documents bigint")


def neighbouring(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows (file, first, documents) that follow each other in one shard, up to STRETCH of them, to be read at once."""
    part: list[dict] = []
    for row in rows:
        last = part[-1] if part else None
        if last and (row["file"] != last["file"] or row["first"] != last["first"] + last["documents"] or len(part) == STRETCH):
            yield part
            part = []
        part.append(row)
    if part:
        yield part


def read_tokens(archive: Archive, keys: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document of the asked keys (doc_id), end ids included.

    `start` counts the ids of all documents before it. With `digest`, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) stands for the ids. Places are dealt by shard and stretch of documents, so that many tasks read one large shard.
    """
    places = look_up(archive, keys).join(archive.shards.select("file", "shard", "start"), "shard")
    # long runs of one key are dealt in stretches
    step = F.lit(STRETCH)
    nth = F.explode(F.sequence(F.lit(0), F.floor((F.col("documents") - 1) / step).cast("int")))
    places = places.select("file", "start", "doc_id", "first", "documents", nth.alias("nth")).select(
        "file", "start", "doc_id", (F.col("first") + F.col("nth") * step).alias("first"),
        F.least(step, F.col("documents") - F.col("nth") * step).cast("bigint").alias("documents"),
    )
    # a number given here keeps the places apart: their rows are tiny, but each stands for much reading
    ids = archive.shards.agg(F.coalesce(F.sum("ids"), F.lit(0))).first()[0]
    tasks = max(1, -(-ids // IDS_PER_TASK))
    places = places.repartition(tasks, "file", F.floor(F.col("first") / STRETCH)).sortWithinPartitions("file", "first")
    value = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), value])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, path = None, None
        for batch in batches:
            out, held = [], 0
            for stretch in neighbouring(batch.to_pylist()):
                if stretch[0]["file"] != path:
                    if shard is not None:
                        shard.close()
                    path, shard = stretch[0]["file"], Shard(stretch[0]["file"])
                offsets, data = shard.read(stretch[0]["first"], sum(r["documents"] for r in stretch))
                keys = [r["doc_id"] for r in stretch for _ in range(r["documents"])]
                for key, low, high in zip(keys, offsets.tolist(), offsets[1:].tolist()):
                    ids = data[low - offsets[0] : high - offsets[0]]
                    found = zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)
                    out.append({"doc_id": key, "start": stretch[0]["start"] + low, "n_tokens": len(ids), kinds[3].name: found})
                    held += 1 if digest else len(ids)
                    if held > IDS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, kinds)
        if shard is not None:
            shard.close()

    return places.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digest else 'ids array<int>'}")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of `docs`, read back from the files by key."""
    archive = write_tokens(docs, new_folder(docs.sparkSession, "corpus-tokens"), tokenizer)
    return read_tokens(archive, docs, digest=True)
