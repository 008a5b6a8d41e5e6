"""Whitening against a direct eigen decomposition, and odd tables."""

import numpy as np
import pytest

import __spark_entry__ as entry
from snapledger.llm import whitening
from tests.llm.conftest import FOLDER


def direct(vectors):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    return centred @ components / np.sqrt(np.abs(values)), values / values.sum(), ((n * x - sums) ** 2).sum(1)


def compare(rows, ids, vectors, components):
    white, explained, deviation = direct(vectors)
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(found) == len(rows) == len(ids) * components
    for k in range(components):
        mine = np.array([found[i, k + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, k])
        assert np.abs(mine - sign * white[:, k]).max() < 1e-9
        assert [found[i, k + 1]["explained"] for i in ids] == pytest.approx([explained[k]] * len(ids), rel=1e-9)
        assert [found[i, k + 1]["deviation"] for i in ids] == deviation.tolist()
    assert {r["n"] for r in rows} == {len(ids)} and max(r["identity_error"] for r in rows) < 1e-9


@pytest.mark.parametrize("tolerance", [0.0, 1e-13])
def test_against_eigenvectors(spark, tolerance):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = entry.queries()["op13_whitening"](spark, FOLDER) if not tolerance else whitening.whiten(table, tolerance=tolerance)
    held = table.collect()
    compare(rows.collect(), [r["vec_id"] for r in held], [r["embedding"] for r in held], 8)


SCHEMA = "vec_id bigint, embedding array<float>, x string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(k, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((30, 5)).astype(np.float32))]
    bad = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [float("nan")] * 5), (54, [float("inf")] * 5), (55, [1.0, 2.0])]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    compare(rows, [i for i, _ in good], [v for _, v in good], 5)
    again = whitening.whiten(frame(spark, [*good, (None, good[0][1]), (3, good[3][1])])).collect()
    assert len(again) == 32 * 5 and sum(r["vec_id"] is None for r in again) == 5
    for nothing in ([], bad[:2], [(1, [1.0, 2.0])], [(k, [3.0, 4.0]) for k in range(9)]):
        assert whitening.whiten(frame(spark, nothing)).count() == 0


def test_equal_deviations_and_constant_directions(spark):
    """Two directions of equal deviation, and one that does not deviate."""
    rows = [(0, [1.0, 0.0, 7.0]), (1, [-1.0, 0.0, 7.0]), (2, [0.0, 1.0, 7.0]), (3, [0.0, -1.0, 7.0])] * 5
    found = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in found} == {1, 2}
    assert all(r["explained"] == pytest.approx(0.5) and r["identity_error"] < 1e-12 for r in found)


def test_deviations_beyond_a_long(spark):
    rows = [(0, [2.0**50, 0.0]), (1, [0.0, 1.0])]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert [r["deviation"] for r in found] == [None, None]
