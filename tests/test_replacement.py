import random

import pytest

from snapledger.operators import replacement
from snapledger.operators.replacement import best_affordable


def brute(wanted, candidates, owned):
    answer = {}
    for row, group, owner, budget in wanted:
        fits = [
            (-score, item) for g, item, price, score in candidates
            if g == group and price <= budget and (owner, item) not in owned
        ]
        best = min(fits, default=None)
        answer[row] = (best[1], -best[0]) if best else (None, None)
    return answer


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    candidates = [("abc"[i % 3], i, rng.randint(0, 140), float(rng.randint(0, 30))) for i in range(150)]
    owned = {(o, rng.randrange(150)) for o in range(12) for _ in range(10)}
    # One owner holds the best third of all items.
    owned |= {(0, c[1]) for c in sorted(candidates, key=lambda c: -c[3])[:50]}
    wanted = [(i, rng.choice("abcd"), rng.randrange(12) if i % 3 else 0, rng.randint(-5, 200)) for i in range(120)]
    got = best_affordable(
        spark.createDataFrame(wanted, "row int, g string, owner int, budget int"),
        spark.createDataFrame(candidates, "g string, item int, price int, score double"),
        spark.createDataFrame(sorted(owned), "owner int, item int"),
        "g", "owner",
    )
    assert {r.row: (r.item, r.score) for r in got.collect()} == brute(wanted, candidates, owned)


def test_one_heavy_owner_does_not_lengthen_the_lists_of_others(spark):
    """3000 candidates, 400 cases; one owner of 1500 items adds rows of its own only."""
    rng = random.Random(7)
    candidates = [("a", i, rng.randint(0, 1000), float(rng.randint(0, 99))) for i in range(3000)]
    wanted = [(i, "a", i % 40, rng.randint(0, 1000)) for i in range(400)]
    light = {(o, rng.randrange(3000)) for o in range(1, 40) for _ in range(2)}
    heavy = {(0, i) for i in rng.sample(range(3000), 1500)}
    frames = lambda owned: (
        spark.createDataFrame(wanted, CASE[0]), spark.createDataFrame(candidates, CASE[1]), spark.createDataFrame(sorted(owned), CASE[2]),
    )
    lengths = {}
    kept = replacement._asked_places
    for name, owned in (("light", light), ("heavy", light | heavy)):
        def counted(*args):
            offers = kept(*args)
            lengths[name] = offers.count()  # noqa: B023
            return offers

        replacement._asked_places = counted
        try:
            got = best_affordable(*frames(owned), "g", "owner")
        finally:
            replacement._asked_places = kept
        assert {r.row: (r.item, r.score) for r in got.collect()} == brute(wanted, candidates, owned)
    # at most what the heavy owner holds, once for each of the ten levels of a price
    assert lengths["heavy"] - lengths["light"] <= 1500 * 10


def test_no_candidates(spark):
    got = best_affordable(
        spark.createDataFrame([(1, "a", 1, 5)], "row int, g string, owner int, budget int"),
        spark.createDataFrame([], "g string, item int, price int, score double"),
        spark.createDataFrame([], "owner int, item int"),
        "g", "owner",
    )
    assert [(r.row, r.item) for r in got.collect()] == [(1, None)]


CASE = ("row int, g string, owner int, budget int", "g string, item int, price int, score double", "owner int, item int")


def test_unknown_score_comes_last(spark):
    wanted, candidates, owned = CASE
    got = best_affordable(
        spark.createDataFrame([(1, "a", 1, 5), (2, "a", 2, 5)], wanted),
        spark.createDataFrame([("a", 1, 2, None), ("a", 2, 3, 9.0)], candidates),
        spark.createDataFrame([(2, 2)], owned),
        "g", "owner",
    )
    assert {r.row: r.item for r in got.collect()} == {1: 2, 2: 1}


def test_negative_price_is_refused(spark):
    wanted, candidates, owned = (spark.createDataFrame([], c) for c in CASE)
    with pytest.raises(ValueError, match="prices"):
        best_affordable(wanted, spark.createDataFrame([("a", 1, -1, 1.0)], CASE[1]), owned, "g", "owner")


def test_no_table_of_rows_is_broadcast(spark):
    """Estimates come from compressed files and before rows are exploded, so however small they are they decide nothing."""
    wanted = [(i, "ab"[i % 2], i % 5, 10 + i) for i in range(20)]
    candidates = [("ab"[i % 2], i, i, float(i)) for i in range(40)]
    frames = [
        spark.createDataFrame(rows, schema) for rows, schema in zip((wanted, candidates, [(i % 5, i) for i in range(40)]), CASE)
    ]
    plan = best_affordable(*frames, "g", "owner")._jdf.queryExecution().executedPlan().toString()
    # the one left is of `row_numbers`: at most two rows for each slice
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") >= 8


def test_only_cases_whose_owner_holds_the_best_ask_for_intervals(spark):
    wanted, candidates = [(i, "a", i, 50) for i in range(30)], [("a", i, i, float(i)) for i in range(60)]
    owned, asked, kept = {(3, 50), (3, 49), (4, 7)}, [], replacement._best_lacking
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip((wanted, candidates, sorted(owned)), CASE)]

    def seen(cases, *args):
        asked.extend(tuple(r) for r in cases.collect())
        return kept(cases, *args)

    replacement._best_lacking = seen
    try:
        got = best_affordable(*frames, "g", "owner")
    finally:
        replacement._best_lacking = kept
    assert {r.row: (r.item, r.score) for r in got.collect()} == brute(wanted, candidates, owned)
    assert asked == [(3, "a", 50)]
