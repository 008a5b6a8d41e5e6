"""Groups that are cut into slices must give what one window over the whole group gives."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapledger.operators import ordering
from snapledger.operators.fixtures import form_guide, next_n_run
from snapledger.operators.ordering import down, ordered, over_rows, ranks, row_numbers, top_per_group, up


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        group = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = rng.choice([None, 1.0, 1.0, 1.0, rng.random() * 5])
        rows.append((i, group, value, rng.random() < 0.4))
    return spark.createDataFrame(rows, "id int, g string, v double, done boolean").repartition(4)


@pytest.fixture(params=[3, 29])
def slices(spark, request):
    """A few slices, or so many that they are shorter than frames and equal values fill several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def same(left, right):
    key = lambda r: str(r)
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns
    assert sorted(left.select(columns).collect(), key=key) == sorted(right.select(columns).collect(), key=key)


@pytest.mark.parametrize("kind", ["rank", "percent_rank"])
@pytest.mark.parametrize("direction", [up, down])
def test_ranks(skewed, slices, kind, direction):
    signals = {"r": direction("v"), "s": up("id"), "d": down("done")}
    window = {"rank": F.rank, "percent_rank": F.percent_rank}[kind]
    expected = {out: window().over(ordered(["g"], [key])) for out, key in signals.items()}
    if kind == "rank":
        expected = {out: column.cast("bigint") for out, column in expected.items()}
    same(ranks(skewed, ["g"], signals, kind), skewed.withColumns(expected))
    same(ranks(skewed, ["g"], {"r": signals["r"]}, kind), skewed.withColumn("r", expected["r"]))


@pytest.mark.parametrize("names", [["r"], ["r", "s"]])
def test_eligible_rows(skewed, slices, names):
    signals = {name: {"r": up("v"), "s": down("id")}[name] for name in names}
    chosen = {"r": F.col("done"), "s": F.when(F.col("id") % 7 > 0, True)}
    got = ranks(skewed, ["g"], signals, eligible={name: chosen[name] for name in names})
    assert got.columns == [*skewed.columns, *names]
    expected = skewed.withColumns({f"_{name}": F.coalesce(chosen[name], F.lit(False)) for name in names})
    for name in names:
        among = F.percent_rank().over(ordered(["g", f"_{name}"], [signals[name]]))
        expected = expected.withColumn(name, F.when(F.col(f"_{name}"), among))
    same(got, expected.select(got.columns))


def test_one_value_fills_several_slices(spark, slices):
    df = spark.range(300).select("id", F.when(F.col("id") < 20, F.lit(1)).when(F.col("id") < 280, F.lit(2)).otherwise(F.lit(3)).alias("v"), F.lit("x").alias("g"))
    got = ranks(df, ["g"], {"r": up("v")}, "rank").select("v", "r").distinct().collect()
    assert {(r.v, r.r) for r in got} == {(1, 1), (2, 21), (3, 281)}


def test_null_ranks_last(spark, slices):
    df = spark.createDataFrame([(1, 2.0), (1, None), (1, 1.0)], "g int, v double")
    for direction in (up, down):
        got = {r.v: r.p for r in ranks(df, ["g"], {"p": direction("v")}).collect()}
        assert got[None] == 1.0


def test_single_member_ranks_zero(spark, slices):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 1.5)], "g int, v double")
    assert {r.p for r in ranks(df, ["g"], {"p": up("v")}).filter("g = 1").collect()} == {0.0}


def test_empty_table(skewed):
    none = skewed.limit(0)
    assert ranks(none, ["g"], {"p": up("v"), "q": up("id")}).count() == row_numbers(none, ["g"], [up("id")], "n").count() == 0
    assert over_rows(none, ["g"], [up("id")], lambda w: {"x": F.lag("v").over(w)}, before=1, number="n").count() == 0


def test_row_numbers(skewed, slices):
    order = [down("v"), up("id")]
    expected = skewed.withColumn("n", F.row_number().over(ordered(["g"], order)).cast("bigint"))
    same(row_numbers(skewed, ["g"], order, "n"), expected)


def test_running_sums(skewed, slices):
    order = [down("v"), up("id")]
    before = ordered(["g"], order).rowsBetween(Window.unboundedPreceding, -1)
    expected = skewed.withColumn("n", F.coalesce(F.sum("id").over(before), F.lit(0)).cast("bigint"))
    same(ordering.running_sums(skewed, ["g"], order, "id", "n"), expected)


def test_ranks_leave_rows_by_a_column(skewed, slices):
    signals = {"a": up("v"), "b": down("id")}
    got = ordering.ranks(skewed, ["g"], signals, by="id")
    same(got, ordering.ranks(skewed, ["g"], signals))
    numbered = got.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("v")))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("REPARTITION_BY_COL")]
    assert after.count("Exchange") == 1  # that one: none for the grouping, none for the window


def test_running_min(skewed, slices):
    order = [up("v"), up("id")]
    kept = skewed.withColumn("x", F.when(F.col("id") % 3 == 0, F.struct((F.col("id") * 7919 % 1009).alias("a"), "id")))
    inside = ordered(["g"], order).rowsBetween(Window.unboundedPreceding, 0)
    same(ordering.running_min(kept, ["g"], order, "x", "n"), kept.withColumn("n", F.min("x").over(inside)))


@pytest.mark.parametrize("number", [None, "n"])
def test_frames(skewed, slices, number):
    def columns(w):
        return {
            "ahead": F.avg("id").over(w.rowsBetween(0, 24)),
            "last": F.lag("id").over(w),
            "tenth": F.lag("id", 10).over(w),
        }

    order = [up("v"), up("id")]
    got = over_rows(skewed, ["g"], order, columns, before=10, after=24, number=number)
    same(got, over_rows(skewed, ["g"], order, columns, before=10, after=24, number=number, bounded=True))


def test_next_n_run(skewed, slices):
    order = [up("v"), up("id")]
    window = ordered(["g"], order).rowsBetween(0, 4)
    expected = skewed.filter("not done").withColumns({
        "n": F.row_number().over(ordered(["g"], order)).cast("bigint"), "a": F.round(F.avg("id").over(window), 2)
    })
    got = next_n_run(skewed, ["g"], order, "id", 5, "not done", "n", "a")
    same(got.filter("not done"), expected)
    assert got.filter("done and n is null and a is null").count() == skewed.filter("done").count()


def test_top_per_group_limits_before_the_shuffle(skewed):
    best = top_per_group(skewed, ["g"], [down("v"), up("id")], 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    window = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "id")
    expected = skewed.withColumn("n", F.row_number().over(window)).filter("n <= 3").drop("n")
    same(best, expected)


def test_long_lists_are_refused(skewed):
    with pytest.raises(ValueError, match="1000"):
        top_per_group(skewed, ["g"], [up("id")], 1001)


def test_form_guide(spark):
    rows = [(1, d, d % 3, 1) for d in range(8)] + [(2, 0, 4, 0)]
    df = spark.createDataFrame(rows, "g int, d int, goals_for int, goals_against int")
    got = {r.g: r.form_last_5 for r in form_guide(df, ["g"], [down("d")]).collect()}
    assert got == {1: "L D W L D", 2: "W"}


def test_hot_group_spreads_over_slices(skewed):
    sliced = ordering._sliced(skewed, ["g"], [up("v"), up("id")])
    shares = [r["count"] for r in sliced.filter("g = 'hot'").groupBy("_slice").count().collect()]
    assert len(shares) >= 3 and max(shares) < 300


def test_form_guide_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 1, 0)], "g int, d int, goals_for int, goals_against int")
    plan = form_guide(df, ["g"], [down("d")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
