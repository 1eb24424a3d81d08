"""Turns of sessions by value, results of any shape, and a benchmark from files."""

import json

import pytest

from trendweave.operators import evaluation, transcripts
from trendweave.sources import readers


def _lines(spark, said):
    rows = [("r", i, kind, json.dumps({"model": model, "content": content})) for i, (kind, model, content) in enumerate(said)]
    return transcripts.blocks(spark.createDataFrame(rows, "run string, line int, type string, message string").repartition(3))


def _use(id_, **given):
    return {"type": "tool_use", "id": id_, "name": given.pop("name", "Bash"), "input": given}


def _result(id_, content):
    return {"type": "tool_result", "tool_use_id": id_, "content": content}


def test_turns_of_a_session(spark):
    said = [
        ("user", None, [_result("t0", '"analysis": "early/analysis.json"')]),
        ("assistant", "m2", [{"type": "text", "text": "too early"}]),
        ("user", None, "  "),
        ("user", None, "First question"),
        ("assistant", "m1", [_use("t1", command="run report --x"), {"type": "text", "text": "looking"}, {"type": "text", "text": "ignored"}]),
        ("user", None, [_result("t1", [{"type": "text", "text": 'done {"ok": true, '}, {"type": "image"}, {"type": "text", "text": '"pages": 2, "problems": ["p"], "analysis": "a/analysis.json"} '}])]),
        ("user", None, "a notice"),
        ("assistant", "m1", [_use("t2", name="SubagentHandback", message="handed"), _use("t3", command="run report again")]),
        ("user", None, [{"type": "text", "text": "Follow-up message from the same user:"}, {"type": "text", "text": "and now?"}, _result("t3", "no json"), _result("t9", '{"analysis": "b/analysis.json"} {"analysis":"a/analysis.json"}')]),
        ("assistant", "m3", [_use("t4", name="SubagentHandback"), {"type": "text", "text": "late text"}]),
    ]
    one, two = transcripts.turn_rollup(_lines(spark, said), "report").orderBy("turn").collect()
    assert (one["prompt"], one["answer"], one["tool_calls"], one["analyses"], one["known"]) == ("First question", "handed", 3, ["a/analysis.json"], ["a/analysis.json"])
    assert [r.asDict() for r in one["reports"]] == [{"command": "run report --x", "ok": True, "pages": 2, "lang": None, "pdf": None, "problems": ["p"]}]
    assert two["prompt"].endswith("same user:\nand now?") and (two["answer"], two["tool_calls"], two["analyses"]) == ("late text", 1, ["b/analysis.json", "a/analysis.json"])
    assert two["known"] == ["a/analysis.json", "b/analysis.json"] and [(r["command"], r["ok"]) for r in two["reports"]] == [("run report again", None)]
    assert transcripts.summary(_lines(spark, said)).first()["models"] == ["m2", "m1", "m3"]
    assert [(r["id"], r["result"]) for r in transcripts.results(_lines(spark, said), "report").orderBy("id").collect()] == [("t1", 'done {"ok": true, "pages": 2, "problems": ["p"], "analysis": "a/analysis.json"} '), ("t3", "no json")]


def test_empty_session(spark):
    assert transcripts.turn_rollup(_lines(spark, [("user", None, " "), ("assistant", "m", "x")]), "report").count() == 0


def test_benchmark_from_files(spark, tmp_path):
    def write(eval_, config, rate, passed, total, timing=None):
        folder = tmp_path / eval_ / config
        folder.mkdir(parents=True)
        (folder / "grading.json").write_text(json.dumps({"summary": {"pass_rate": rate, "passed": passed, "total": total}}, indent=1))
        if timing is not None:
            (folder / "timing.json").write_text(json.dumps(timing))

    write("eval-1", "with", 0.9, 1, 2, {"duration_ms": 4000, "total_tokens": 10, "tool_calls": 3})
    write("eval-1", "without", 0.5, 1, 2, {"duration_ms": 1000, "total_tokens": 30, "tool_calls": 1})
    write("eval-2", "with", 1.0, 3, 3, {"turns": [{"duration_ms": 1000, "total_tokens": 7, "tool_calls": 1}, {"duration_ms": 2500, "total_tokens": 9}]})
    write("eval-2", "without", 0.25, 1, 4)
    write("eval-3", "with", 0.0, 0, 5, {"duration_ms": 100, "total_tokens": 1, "tool_calls": 1})
    runs = evaluation.runs_of_files(readers.gradings(spark, f"{tmp_path}/*/*/grading.json"), readers.timings(spark, f"{tmp_path}/*/*/timing.json"))
    got = {(r["eval"], r["config"]): (r["pass_rate"], r["turns"], r["seconds"], r["tokens"], r["calls"]) for r in runs.collect()}
    assert got == {("eval-1", "with"): (0.9, 1, 4.0, 10.0, 3.0), ("eval-1", "without"): (0.5, 1, 1.0, 30.0, 1.0), ("eval-2", "with"): (1.0, 2, 3.5, 9.0, None), ("eval-2", "without"): (0.25, 1, None, None, None), ("eval-3", "with"): (0.0, 1, 0.1, 1.0, 1.0)}
    row = evaluation.benchmark(runs).first()
    assert (row["assertions"], row["base_assertions"], row["pass_rate_mean"], row["base_pass_rate_mean"], row["pass_rate_delta"]) == ("4/5", "2/6", 0.95, 0.38, 0.57)
    assert row["seconds_delta"] == pytest.approx(2.75) and row["calls_delta"] == 2.0
    by = {r["eval"]: r for r in evaluation.per_eval(runs, "with", "without").collect()}
    assert len(by) == 3 and by["eval-3"]["base_pass_rate"] is None and by["eval-1"]["base_seconds"] == 1.0
    every = evaluation.summary(runs.where("config = 'with'"), ["config"]).first()
    assert (every["assertions"], every["runs"], every["pass_rate_mean"]) == ("4/10", 3, 0.63)


def test_run_summary(spark):
    d = spark.createDataFrame([("a", 1, 2, 3.0, 1.0, 5.0), ("a", 2, 2, 4.0, None, 9.0)], "k string, passed int, total int, seconds double, calls double, tokens double")
    assert [tuple(r) for r in evaluation.run_summary(d, ["k"]).collect()] == [("a", "3/4", 7.0, None, 9.0)]
