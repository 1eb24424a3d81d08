import datetime
import json
import time

from trendweave.streaming import monthly


def test_late_rows_of_a_stream(spark, tmp_path):
    day = lambda d: f"2024-01-{d:02d}T12:00:00.000Z"
    batches = [[("a", day(1)), ("a", day(1)), ("b", day(10))], [("a", day(9)), ("a", day(20))], [("a", day(1)), ("b", day(28))]]
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):  # taken in the order of their times
        (source / f"{k}.json").write_text("\n".join(json.dumps({"topic": t, "ts": ts}) for t, ts in rows))
        time.sleep(1.1)
    stream = spark.readStream.schema("topic string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    query = monthly.monthly_views(stream, ["topic"]).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["topic"], r["day"].date(), r["views"]) for r in spark.table("days").collect()}
    jan = lambda d: datetime.date(2024, 1, d)
    assert ("a", jan(1), 2) in got and ("a", jan(9), 1) in got and ("b", jan(10), 1) in got  # the row of day 1 that came last is too late, that of day 9 is not
    assert monthly.to_months(spark.table("days"), ["topic"]).where("topic = 'a' and views >= 3").count() == 1
