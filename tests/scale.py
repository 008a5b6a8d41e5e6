"""Time the ordered operators on one hot group, and check them against one window over the whole group.

    python -m tests.scale [rows]
"""

import sys
import time

from pyspark.sql import functions as F

from snapledger.operators.ordering import down, ordered, over_rows, ranks, row_numbers, up
from snapledger.operators.snapshots import snapshot_delta
from snapledger.session import build_session, settle


def main(rows=3_000_000):
    spark = build_session("scale", "local[8]", **{
        "spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    noise = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    # A third of the rows are one group, and a third of those share one value.
    df = settle(spark.range(int(rows)).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(noise % 500).alias("g"),
        F.when(noise % 3 == 0, F.lit(7)).otherwise(noise).alias("v"),
        (noise % 10 < 3).alias("done"),
        (noise % 5 + 1).alias("difficulty"),
    ), "scale")

    def digest(result):
        total = F.sum(F.xxhash64(*sorted(result.columns)).cast("decimal(38,0)"))
        return result.agg(F.count("*"), total).first()

    def whole(out, column):
        return lambda: df.withColumns(dict(zip(out, column)))

    number, run, lag = [down("v"), up("id")], [up("v"), up("id")], ["g"]
    shapes = {
        "percent_rank": (
            lambda: ranks(df, ["g"], {"p": up("v"), "q": down("difficulty")}),
            whole("pq", [F.percent_rank().over(ordered(["g"], [k])) for k in (up("v"), down("difficulty"))]),
        ),
        "row_number": (
            lambda: row_numbers(df, ["g"], number, "n"),
            whole("n", [F.row_number().over(ordered(["g"], number)).cast("bigint")]),
        ),
        "next_5": (
            lambda: over_rows(df, ["g"], run, lambda w: {"a": F.avg("difficulty").over(w.rowsBetween(0, 4))}, after=4),
            whole("a", [F.avg("difficulty").over(ordered(["g"], run).rowsBetween(0, 4))]),
        ),
        "delta": (
            lambda: snapshot_delta(df, lag, run, {"v": "prev"}, bounded=False),
            lambda: df.withColumn("prev", F.lag("v").over(ordered(lag, run))),
        ),
    }
    for name, (sliced, one_window) in shapes.items():
        answers = []
        for label, shape in (("one window", one_window), ("slices", sliced)):
            start = time.time()
            answers.append(digest(shape()))
            print(f"{name:14} {label:12} {time.time() - start:6.1f}s {answers[-1][0]} rows", flush=True)
        assert answers[0] == answers[1], name
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
