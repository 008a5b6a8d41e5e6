"""Token files against plain encoding, the index against a dictionary, and odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from snapledger.llm import encoder, tokenfiles
from snapledger.session import new_folder
from tests.llm.conftest import FOLDER

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(tokenizer, texts):
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_query(spark, corpus, tokenizer):
    rows = corpus.orderBy("doc_id").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["op12_token_files"](spark, FOLDER).collect()}
    start, expected = 0, {}
    for r, ids in zip(rows, plain(tokenizer, [r["text"] for r in rows])):
        expected[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == expected


PARTS = list(" \n\t\r  \n ab c'stdrelvm.,!?_-#12é×— ") + [
    "'s", "'ll", "<|endoftext|>", " the", "The", ".\n", "中", "\U0001f600", "ß", "÷", "ʼ", "　", "\x85", "\xa0", "\x1c", "ȿ", "ɀ",
]


@pytest.mark.parametrize("kept", [300, 1_000_000])
def test_pieces_give_the_ids_of_whole_texts(tokenizer, monkeypatch, kept):
    monkeypatch.setattr(encoder, "MOST_KEPT", kept)
    choose, mine = random.Random(3), encoder.Encoder(PATH, 0)
    texts = ["".join(choose.choice(PARTS) for _ in range(choose.randint(0, 30))) for _ in range(6000)] + [None, "", "ab" * 40000]
    for k in range(0, len(texts), 500):
        ids, counts = mine.encoded(pa.array(texts[k : k + 500], pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain(tokenizer, texts[k : k + 500])
    assert len(mine.hash) < kept + 5000


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine = encoder.Encoder(path, 7)
    assert not mine.by_piece
    ids, counts = mine.encoded(pa.array(["Hello  World", None]))
    expected = Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids
    assert ids.tolist() == [*expected, 7, 7] and counts.tolist() == [len(expected) + 1, 1]


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        hashing = tokenfiles.PerfectHash.built(keys)
        assert sorted(hashing.slots(keys).tolist()) == list(range(len(keys)))
    places = np.stack([rng.integers(0, 9, 8000), np.arange(8000), np.ones(8000, int)], axis=1)
    hashes = keys[rng.integers(0, len(keys), 8000)]
    index = tokenfiles.Index.read(tokenfiles.Index.built(hashes, places).written())
    which, found = index.find(keys)
    expected = sorted((int(h), *p) for h, p in zip(hashes, places.tolist()))
    assert sorted((int(keys[i]), *p) for i, p in zip(which, found.tolist())) == expected
    # keys that were never written are told apart by their fingerprints
    strange = np.setdiff1d(rng.integers(0, 1 << 63, 20000).astype(np.uint64), keys)
    assert (index.hashing.slots(strange) >= 0).sum() > 1000 and len(index.find(strange)[0]) == 0


def test_keyed_access(spark, tokenizer, monkeypatch):
    """Repeated and missing ids, empty texts, keys that were not written, small shards and index files."""
    monkeypatch.setattr(tokenfiles, "SHARD_CHARS", 300)
    monkeypatch.setattr(tokenfiles, "KEYS_PER_INDEX", 5)
    monkeypatch.setattr(tokenfiles, "STRETCH", 3)
    rows = [(k, f"text number {k} " * (k % 4)) for k in range(40)] + [(7, f"again {k}") for k in range(30)]
    rows += [(None, "no id"), (None, None), (-5, "first"), (9, "text number 9 ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    archive = tokenfiles.write_tokens(docs, new_folder(spark, "corpus-tokens"), PATH)
    assert archive.shards.count() > 3 and archive.index.count() > 3
    asked = docs.select("doc_id").union(spark.createDataFrame([(999,), (-1,)], "doc_id bigint"))
    found = tokenfiles.read_tokens(archive, asked).collect()
    expected = sorted(((i, ids) for (i, _), ids in zip(rows, plain(tokenizer, [t for _, t in rows]))), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in found), key=repr) == expected
    ordered = sorted(found, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
    only = tokenfiles.read_tokens(archive, spark.createDataFrame([(3,), (3,), (1000,)], "doc_id bigint")).collect()
    assert [r["doc_id"] for r in only] == [3]


def test_odd_rows(odd, no_rows):
    found = tokenfiles.token_digest(odd, PATH).collect()
    assert sorted(r["doc_id"] or 0 for r in found) == sorted(r["doc_id"] or 0 for r in odd.collect())
    assert {r["n_tokens"] for r in found if r["doc_id"] in (3, 4)} == {1}
    assert tokenfiles.token_digest(no_rows, PATH).count() == 0
