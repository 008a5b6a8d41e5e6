"""Ranked search against its SQL, against all documents scored one by one, and on odd tables."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from snapledger.llm import ranked
from tests import oracle
from tests.llm.conftest import FOLDER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """Every document scored for every item; rows (place of the item, rank, doc_id, score)."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    full = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    holders = collections.Counter(t for _, c in counts for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        rows = []
        for i, c in counts:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * full + 2) / (2 * holders[t] + 1)))
                    score += weight * (1000000000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * full // length)))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(place, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return out


def test_sql(spark):
    found = entry.queries()["op11_ranked_search"](spark, FOLDER)
    problem, count = oracle.differences(found, oracle.connect(FOLDER), entry.oracle_sql()["op11_ranked_search"])
    assert not problem and count > 0


WORDS = [f"w{i}" for i in range(60)] + ["Été", "straße", "x9"]


@pytest.fixture(scope="module")
def small(spark):
    """Few words, so that scores tie; a third of the rows are copies of one text, some without an id or with the same one."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 30))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[3]) for k in range(30)] + [(None, texts[5]), (None, None), (7, texts[5])]
    items = [(k, " ".join(rng.choice(WORDS, 6))) for k in range(12)] + [(3, "w1 W1 w2"), (50, None), (51, " .,; "), (52, "unknown"), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    return docs, rows, spark.createDataFrame(items, "item_id bigint, text string"), items


@pytest.mark.parametrize(("bits", "step", "batch"), [(16, 1 << 17, 1 << 18), (2, 40, 1 << 18), (2, 1 << 17, 10)])
def test_against_all_documents(small, monkeypatch, bits, step, batch):
    """Also with sketches so small that terms share cells, with many steps, and with many batches of queries."""
    docs, rows, queries, items = small
    monkeypatch.setattr(ranked, "CELL_BITS", bits)
    monkeypatch.setattr(ranked, "LEAST_ROOM", 0.1 if bits == 2 else 16)
    monkeypatch.setattr(ranked, "PAIRS_PER_STEP", step)
    monkeypatch.setattr(ranked, "TERMS_PER_BATCH", batch)
    found = [tuple(r) for r in ranked.ranked_search(docs, queries, 7).collect()]
    expected = [(items[p][0], rank, i, score) for p, rank, i, score in plain(rows, items, 7)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_bounds_are_never_below_scores(small, monkeypatch):
    monkeypatch.setattr(ranked, "CELL_BITS", 3)
    monkeypatch.setattr(ranked, "LEAST_ROOM", 0.1)
    docs, rows, _, _ = small
    index = ranked.build_index(docs)
    items = pa.table({"item_id": pa.array([0, 1]), "text": pa.array(["w1 w2 w3", "w4 w5 w4"])})
    queries, _ = ranked.batched(index, items)
    lookup = ranked.Lookup(queries)
    scores = {(p, i): s for p, _, i, s in plain([(k, t) for k, (_, t) in enumerate(rows)], list(zip([0, 1], items.column("text").to_pylist())), 999)}
    texts = {}
    for k, (_, t) in enumerate(rows):
        texts.setdefault(t or "", k)
    digests = {r["digest"]: texts[r["text"]] for r in index.texts.collect()}
    for r in index.sketches.collect():
        bounds = lookup.bounds(r["n"], r["bits"], bytes(r["cells"]), bytes(r["tops"]))
        assert all(bounds[p] >= scores.get((p, digests[r["digest"]]), 0) for p in (0, 1))


def test_odd_rows(spark, odd, no_rows):
    items = spark.createDataFrame([(1, "one two lorem"), (2, None), (None, "x")], "item_id bigint, text string")
    found = ranked.ranked_search(odd, items).collect()
    assert {r["item_id"] for r in found} == {1, None}
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["item_id"] is None] == [9]
    assert ranked.ranked_search(no_rows, items).count() == 0
    assert ranked.ranked_search(odd, items.limit(0)).count() == 0
    assert ranked.ranked_search(odd.filter("text is null"), items).count() == 0
