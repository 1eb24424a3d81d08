"""Transcripts of agent runs: blocks of messages, tool calls with their errors and results, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import FOLLOW_UP

BLOCK = "struct<type:string,name:string,id:string,tool_use_id:string,is_error:boolean,text:string,input:string,content:string>"
SHOWN = ["command", "file_path", "path", "pattern", "url"]  # fixed values: what of a call's input is shown, in this order


def blocks(lines: DataFrame, run: str = "run", line: str = "line") -> DataFrame:
    """One row per block: run, line, at, kind (type of the line), model, and the block's fields.

    lines: run, line, type, message (JSON).  A message whose content is a text is one text block; a line without
    content has none.
    """
    content = F.get_json_object("message", "$.content")
    listed = F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, f"array<{BLOCK}>"))
    one = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), BLOCK))
    rows = lines.where(content.isNotNull()).select(run, line, F.col("type").alias("kind"), F.get_json_object("message", "$.model").alias("model"), F.posexplode(F.coalesce(listed, one)).alias("at", "b"))
    return rows.select(run, line, "at", "kind", "model", "b.*")


def _short(text, length: int):
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, length)


def tool_calls(rows: DataFrame, run: str = "run", line: str = "line") -> DataFrame:
    """One row per call: run, call (from 1), tool, id, input (short), error of the results that came before the next call (the last one)."""
    order = Window.partitionBy(run).orderBy(line, "at")
    kept = rows.where("kind = 'assistant' and type = 'tool_use' or kind = 'user' and type = 'tool_result' and is_error")
    numbered = kept.withColumn("call", F.sum((F.col("type") == "tool_use").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("call > 0")
    shown = F.coalesce(*[F.get_json_object("input", f"$.{k}") for k in SHOWN], F.col("input"), F.lit("{}"))
    use = F.col("type") == "tool_use"
    found = numbered.groupBy(run, "call").agg(
        F.max(F.when(use, F.coalesce("name", F.lit("?")))).alias("tool"),
        F.max(F.when(use, F.col("id"))).alias("id"),
        F.max(F.when(use, _short(shown, 400))).alias("input"),
        F.max_by(F.when(~use, _short(F.coalesce("content", F.lit("")), 300)), F.when(~use, F.struct(line, "at"))).alias("error"),
    )
    return found


def summary(rows: DataFrame, run: str = "run", line: str = "line") -> DataFrame:
    """Per run: models in the order in which they first spoke, number of tool calls, how many failed, length of the last text."""
    calls = tool_calls(rows, run, line).groupBy(run).agg(F.count("*").alias("tool_calls"), F.count("error").alias("failed_calls"))
    own = F.col("kind") == "assistant"
    last = F.max_by(F.when(own & (F.col("type") == "text") & (F.col("text") != ""), F.col("text")), F.when(own & (F.col("type") == "text") & (F.col("text") != ""), F.struct(line, "at")))
    firsts = rows.where(own & F.col("model").isNotNull()).groupBy(run, "model").agg(F.min(F.struct(line, "at")).alias("_at"))
    named = firsts.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "model"))), lambda m: m["model"]).alias("models"))
    seen = rows.groupBy(run).agg(F.coalesce(F.length(last), F.lit(0)).alias("final_chars")).join(named, run, "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))
    return seen.select(run, "models", "final_chars").join(calls, run, "left").fillna(0, ["tool_calls", "failed_calls"])


def result_text(content: Column) -> Column:
    """Text of a tool result: as it is, or of a list of blocks their texts in a row; empty for anything else."""
    listed = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(listed, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.when(F.ltrim(content).startswith("["), F.coalesce(joined, F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def results(rows: DataFrame, called: str, run: str = "run") -> DataFrame:
    """Calls whose command holds ``called``, with the text of their result: run, id, command, result; null where none came."""
    calls = rows.where((F.col("type") == "tool_use") & F.contains(F.get_json_object("input", "$.command"), F.lit(called))).select(run, "id", _short(F.get_json_object("input", "$.command"), 600).alias("command"))
    got = rows.where("type = 'tool_result'").groupBy(run, F.col("tool_use_id").alias("id")).agg(F.min(result_text(F.col("content"))).alias("result"))
    return calls.join(got, [run, "id"], "left")


REPORT = "struct<ok:boolean,pages:int,lang:string,pdf:string,problems:array<string>>"
ANALYSIS_FILE = r'"analysis":\s*"([^"]+analysis\.json)"'  # fixed value: how a result names the analysis it wrote
HANDBACK = "SubagentHandback"  # fixed value: the tool whose message is an answer


def turn_rollup(rows: DataFrame, called: str, run: str = "run", line: str = "line", marker: str = FOLLOW_UP) -> DataFrame:
    """One row per turn of each run: turn (from 1), prompt, answer, tool_calls, analyses, known, reports.

    A turn begins at the first user message that is not blank and at every later one that holds the marker.  analyses:
    files that results of the turn name, in order; known: those of all turns so far.  answer: what a handback says, or the
    first text after an empty answer.  reports: command, ok, pages, lang, pdf and problems of the calls whose command
    holds ``called`` and whose result came in the turn, read from the JSON that ends the result (null where there is none).
    Blocks before the first turn do not count.  Every turn is gathered by itself, and what is carried along a run is
    the list of its analyses, so a run may have any number of blocks.
    """
    user, text = F.col("kind") == "user", F.col("type") == "text"
    said = rows.where(user & text).groupBy(run, line).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("t")))), lambda b: b["t"]), "\n").alias("_said"))
    order = Window.partitionBy(run).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    spoken = said.where(F.trim("_said") != "").withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(line)))
    opened = spoken.where((F.col("_n") == 1) | F.contains("_said", F.lit(marker))).select(run, line, F.substring("_said", 1, 400).alias("_prompt"), F.lit(1).alias("_opens"))
    lines = rows.select(run, line).distinct().join(opened, [run, line], "left").withColumn("turn", F.sum(F.coalesce("_opens", F.lit(0))).over(order)).where("turn > 0")
    of = rows.join(lines, [run, line])
    command = F.coalesce(F.get_json_object("input", "$.command"), F.lit(""))
    pending = rows.where((F.col("kind") == "assistant") & (F.col("type") == "tool_use") & F.contains(command, F.lit(called))).groupBy(run, F.col("id").alias("tool_use_id")).agg(F.max_by(F.struct(line, "at", F.substring(command, 1, 600).alias("command")), F.struct(line, "at")).alias("_call"))
    of = of.join(pending.withColumn("_result", F.lit("tool_result")), (of[run] == pending[run]) & (of["tool_use_id"] == pending["tool_use_id"]) & (of["type"] == F.lit("tool_result")), "left").select(of["*"], "_call")
    result = F.when(user & (F.col("type") == "tool_result"), result_text(F.col("content")))
    called_now = result.isNotNull() & F.col("_call").isNotNull() & (F.struct(F.col(f"_call.{line}"), F.col("_call.at")) < F.struct(line, "at"))
    tail_ = F.expr("substring(_text, instr(_text, '{'))")
    report = F.when(F.contains("_text", F.lit("{")) & F.endswith(F.rtrim("_text"), F.lit("}")), F.from_json(tail_, REPORT))
    of = of.withColumn("_text", result).withColumns({"_files": F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(ANALYSIS_FILE), F.lit(1)), "_report": F.when(called_now, F.struct(F.col("_call.command").alias("command"), report.alias("r")))})
    own = F.col("kind") == "assistant"
    use = own & (F.col("type") == "tool_use")
    event = F.when(use & (F.col("name") == HANDBACK), F.struct(line, "at", F.lit(True).alias("over"), F.coalesce(F.get_json_object("input", "$.message"), F.lit("")).alias("t"))).when(own & text & (F.col("text") != ""), F.struct(line, "at", F.lit(False).alias("over"), F.col("text").alias("t")))
    events = F.sort_array(F.collect_list(event))
    answer = F.aggregate(events, F.lit(""), lambda a, e: F.when(e["over"] | (a == ""), e["t"]).otherwise(a))
    in_order = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(line, "at", F.col(c).alias("x")))), lambda a, b: F.when(F.struct(a[line], a["at"]) < F.struct(b[line], b["at"]), -1).otherwise(1)), lambda x: x["x"])
    turns_ = of.groupBy(run, "turn").agg(
        F.max("_prompt").alias("prompt"), answer.alias("answer"), F.count(F.when(use, 1)).alias("tool_calls"),
        F.array_distinct(F.flatten(in_order("_files", F.size("_files") > 0))).alias("analyses"), in_order("_report", F.col("_report").isNotNull()).alias("_reports"),
    )
    so_far = Window.partitionBy(run).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    reports = F.transform("_reports", lambda x: F.struct(x["command"].alias("command"), *[x["r"][k].alias(k) for k in ("ok", "pages", "lang", "pdf", "problems")]))
    return turns_.select(run, "turn", "prompt", "answer", "tool_calls", "analyses", F.array_distinct(F.flatten(F.collect_list("analyses").over(so_far))).alias("known"), reports.alias("reports"))
