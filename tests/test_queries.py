"""Every registered query must give what its SQL gives on the smallest supplied tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from snapledger.session import settle
from snapledger.supplied import QUERIES
from snapledger.supplied.snapshot_queries import Stored
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.fixture(scope="module")
def built_once():
    """Let the serving queries share one decision table and one outlook; both are tested on their own."""
    kept, whole = {}, {name: getattr(Stored, name) for name in ("decision", "outlook")}

    def once(name):
        def build(self):
            if name not in kept:
                kept[name] = settle(whole[name](self), f"shared-{name}")
            return kept[name]

        return build

    with pytest.MonkeyPatch.context() as patch:
        for name in whole:
            patch.setattr(Stored, name, once(name))
        yield


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "load_date", "player_id", "position_id", "points_per_million", "points_change", "value_pctl"
    ]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, built_once, name):
    problem, _ = oracle.differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert not problem


@pytest.mark.parametrize(
    "name", ["value_rank", "percentile_signals", "next_n_run", "standings", "bridge_join", "fixture_difficulty"]
)
def test_many_slices(spark, con, name):
    """The same queries when every group is cut into many slices."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 31)
    try:
        problem, _ = oracle.differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not problem
