import json

from pyspark.sql import functions as F

from trendweave.operators import evaluation, periods, resolve, series, transcripts


def _lines(spark):
    said = [
        ("user", "Do it"),
        ("assistant", [{"type": "text", "text": "first"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "make  it\n--x"}}]),
        ("user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "bad\nthing"}]),
        ("assistant", [{"type": "tool_use", "id": "t2", "input": {"q": 1}}]),
        ("user", [{"type": "tool_result", "tool_use_id": "t2", "content": [{"type": "text", "text": "{}"}]}]),
        ("assistant", [{"type": "text", "text": "the end"}]),
    ]
    rows = [("r", i, kind, json.dumps({"model": "m", "content": c})) for i, (kind, c) in enumerate(said)] + [("r", 9, "notice", json.dumps({})), ("none", 0, "user", None)]
    return spark.createDataFrame(rows, "run string, line int, type string, message string")


def test_transcripts(spark):
    rows = transcripts.blocks(_lines(spark))
    calls = [(r["call"], r["tool"], r["input"], r["error"]) for r in transcripts.tool_calls(rows).orderBy("call").collect()]
    assert calls == [(1, "Bash", "make it --x", "bad thing"), (2, "?", '{"q":1}', None)]
    assert [r.asDict() for r in transcripts.summary(rows).collect()] == [{"run": "r", "models": ["m"], "final_chars": 7, "tool_calls": 2, "failed_calls": 1}]
    assert [(r["id"], r["result"]) for r in transcripts.results(rows, "make").collect()] == [("t1", "bad\nthing")]


def test_turns(spark):
    rows = [("c", 0, "system", "x"), ("c", 1, "user", " "), ("c", 2, "user", "start"), ("c", 3, "user", "notice"), ("c", 4, "user", "Follow-up message from the same user: more"), ("c", 5, "assistant", "Follow-up message from the same user"), ("c", 6, None, None)]
    d = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert [r["segment"] for r in evaluation.turns(d).orderBy("turn").collect()] == [0, 0, 1, 1, 2, 2, 2]


def test_places(spark):
    d = spark.createDataFrame([("b", "x", 5), ("a", "x", 5), ("c", "x", 9), ("a", "w", 5), ("d", "x", -3)], "topic string, lang string, score long")
    assert [(r["topic"], r["lang"]) for r in series.places(d).orderBy("place").collect()] == [("c", "x"), ("a", "w"), ("a", "x"), ("b", "x"), ("d", "x")]


def test_periods(spark):
    rows = [("2024-03-15", None, None, None), ("2024-03-31", 3, None, "2024-01-31"), ("2024-03-01", 135, "2010-01-01", None), ("2024-03-15", 0, None, None), ("2024-03-15", None, "soon", None), ("2024-03-15", None, "2024-05-01", None), ("2024-03-15", 1, None, "2024-01-31")]
    d = spark.createDataFrame(rows, "t string, months int, a string, b string")
    got = [r["p"] for r in d.select(periods.period(F.col("t").cast("date"), F.col("months"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert [(r["start"], r["end"]) for r in got] == [("20220301", "20240229"), ("20231201", "20240131"), ("20150701", "20240229"), (None, None), (None, None), (None, None), (None, None)]
    assert [r["problem"] for r in got[3:]] == ["bad number of months", "bad day", "start not before end", "start not before end"]


def test_unknown_pins(spark):
    pins = spark.createDataFrame([("t", "en", "A"), ("t", "xx", "B"), ("t", None, "C")], "topic string, lang string, title string")
    assert {r["title"] for r in resolve.unknown_pins(pins, ["en", "de"]).collect()} == {"B", "C"}
