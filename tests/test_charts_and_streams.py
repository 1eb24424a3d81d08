"""Label places against the loop, scripts, and metrics that follow a stream."""

import random

from pyspark.sql import functions as F

from trendweave.operators import charts
from trendweave.plans import catalog
from trendweave.streaming import incremental


def test_labels_equal_the_loop(spark):
    rng = random.Random(2)
    rows = [(c, i, rng.uniform(0, 300)) for c in range(40) for i in range(rng.randrange(1, 12))] + [(99, 0, None), (99, 1, 5.0)]
    got = {(r["chart"], r["i"]): r["label_y"] for r in charts.placed_labels(spark.createDataFrame(rows, "chart int, i int, y double"), ["chart"], "y", 200.0, ["i"]).collect()}
    assert got.pop((99, 0)) is None and got.pop((99, 1)) == 5.0
    for c in range(40):
        own = sorted((y, i) for d, i, y in rows if d == c)
        ys = [y for y, _ in own]
        for k in range(1, len(ys)):
            ys[k] = max(ys[k], ys[k - 1] + 13)
        for k in reversed(range(len(ys))):
            ys[k] = min(ys[k], 200.0 - 6 if k == len(ys) - 1 else ys[k + 1] - 13)
        assert all(abs(got[c, i] - y) < 1e-9 for (_, i), y in zip(own, ys, strict=True))


def test_scripts(spark):
    latin = [(0x21, 0x7E), (0xA1, 0x24F)]
    texts = ["plain text", "Ünï code", "привіт", "abc ก", "\U0001f600 smile", None, "", "שלום", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", charts.script_support(F.col("t"), latin, [*latin, (0x400, 0x52F)]).alias("s")).orderBy("i").collect()
    assert [r["s"]["choice"] for r in rows] == ["base", "base", "fallback", "none", "none", "base", "base", "none", "base"]
    assert rows[2]["s"]["offending"] == sorted(set("привіт")) and rows[4]["s"]["offending"] == ["\U0001f600"] and rows[1]["s"]["offending"] == []
    assert spark.createDataFrame([("привіт",)], "t string").select(charts.script_support(F.col("t"), latin)["choice"]).first()[0] == "none"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    day = lambda: f"20{rng.randrange(20, 24)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d} 10:00:00"
    parts = [[(rng.choice(keys), day()) for _ in range(200)] for keys in ("abc", "bcd", ["d", "e", None])]
    schema = "k string, ts timestamp"
    frame = lambda rows: spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts"))

    def compute(months):
        return months.groupBy("k").agg(F.count("*").alias("n"), F.sum("views").alias("views"), F.max_by("views", "month").alias("last"))

    for i, rows in enumerate(parts):
        frame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.follow(events, ["k"], f"{tmp_path}/out", compute).awaitTermination()
        written = {r["k"] for r in spark.read.parquet(f"{tmp_path}/out/metrics/batch={i}").collect()}
        assert written == {k for k, _ in rows}  # only the series of the batch
    every = frame([r for rows in parts for r in rows])
    want = compute(every.groupBy("k", (F.year("ts") * 12 + F.month("ts") - 1).alias("month")).agg(F.count("*").alias("views")))
    got = incremental.current(spark.read.parquet(f"{tmp_path}/out/metrics"), ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    incremental.upsert(frame(parts[1]), 1, ["k"], f"{tmp_path}/out", compute)  # a batch that runs again
    again = incremental.current(spark.read.parquet(f"{tmp_path}/out/metrics"), ["k"])
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))


def test_what_offends_is_looked_for_once(spark, small):
    plan = catalog.script_choices(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "&&" not in plan


def test_ranges_without_others():
    assert charts._without([(5, 9), (1, 3), (4, 4), (20, 30)], [(2, 2), (25, 40)]) == [(1, 1), (3, 9), (20, 24)]
