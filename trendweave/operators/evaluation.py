"""Roll-ups of evaluation runs and turns of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up


def stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, population deviation (two decimals) and count per key; null and NaN values do not count."""
    x = F.col(value).cast("double")
    kept = rows.withColumn("_x", F.when(~F.isnan(x), x))
    return kept.groupBy(*keys).agg(round_half_up(F.avg("_x"), 2).alias("mean"), round_half_up(F.stddev_pop("_x"), 2).alias("stddev"), F.count("_x").alias("n"))


def run_summary(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: passed/total, seconds and calls summed, the most tokens of a turn; a missing value of a turn makes the run's null."""
    whole = lambda c, f: F.when(F.count(c) == F.count("*"), f(c))
    return turns.groupBy(*keys).agg(
        F.concat_ws("/", F.sum("passed").cast("string"), F.sum("total").cast("string")).alias("passed"),
        whole("seconds", F.sum).alias("seconds"), whole("calls", F.sum).alias("calls"), whole("tokens", F.max).alias("tokens"),
    )


def delta(stats_: DataFrame, keys: list[str], config: str = "config", with_: str = "with", without: str = "without") -> DataFrame:
    """Difference of the means of two configurations, for keys that have both."""
    a = stats_.where(F.col(config) == with_).select(*keys, F.col("mean").alias("_a"))
    b = stats_.where(F.col(config) == without).select(*keys, F.col("mean").alias("_b"))
    return a.join(b, keys).select(*keys, round_half_up(F.col("_a") - F.col("_b"), 2).alias("delta"))


def summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per configuration: passed/total of all runs, and mean and deviation of pass rate, seconds, tokens and calls.

    runs: the keys, passed, total, seconds, tokens, calls, and pass_rate where gradings state it (else it is passed of
    total); a run without a figure does not count for it.
    """
    rate = F.col("pass_rate") if "pass_rate" in runs.columns else F.col("passed") / F.nullif(F.col("total"), F.lit(0))
    figures = {"pass_rate": rate, "seconds": F.col("seconds"), "tokens": F.col("tokens"), "calls": F.col("calls")}
    x = {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in figures.items()}
    each = [f(c).alias(f"{n}_{k}") for n, c in x.items() for k, f in (("mean", lambda c: round_half_up(F.avg(c), 2)), ("stddev", lambda c: round_half_up(F.stddev_pop(c), 2)))]
    return runs.groupBy(*keys).agg(F.concat_ws("/", F.sum("passed").cast("string"), F.sum("total").cast("string")).alias("assertions"), F.count("*").alias("runs"), *each)


def benchmark(runs: DataFrame, eval_: str = "eval", config: str = "config", with_: str = "with", without: str = "without") -> DataFrame:
    """One row: the summary of the paired runs with, of the runs without, and the differences of their means.

    Runs with count for the pair only if the same eval has a run without.
    """
    base = runs.where(F.col(config) == without)
    paired = runs.where(F.col(config) == with_).join(base.select(eval_).distinct(), eval_, "left_semi")
    a, b = (summary(r.withColumn("_one", F.lit(1)), ["_one"]) for r in (paired, base))
    names = [c for c in a.columns if c != "_one"]
    both = a.join(b.select("_one", *[F.col(c).alias(f"base_{c}") for c in names]), "_one")
    delta_ = [round_half_up(F.col(c) - F.col(f"base_{c}"), 2).alias(c.replace("_mean", "_delta")) for c in names if c.endswith("_mean")]
    return both.select(*names, *[f"base_{c}" for c in names], *delta_)


RUN_FILE = r"/(eval-[^/]+)/([^/]+)/[^/]+$"  # fixed value: eval and configuration of a file


def runs_of_files(gradings: DataFrame, timings: DataFrame) -> DataFrame:
    """One row per graded run: eval, config, pass_rate, passed, total, turns, seconds, tokens, calls.

    gradings: file, pass_rate, passed, total; timings: file, turn, duration_ms, total_tokens, tool_calls.  Eval and
    configuration are folders of the path.  Durations and calls of the turns add up, tokens are the most of any turn;
    where a turn lacks a figure, or the run has no timing, it is null.
    """
    key = lambda i: F.regexp_extract("file", RUN_FILE, i)
    placed = lambda t: t.withColumns({"eval": key(1), "config": key(2)}).where("eval <> ''")
    whole = lambda c, f: F.when(F.count(c) == F.count("*"), f(c))
    timed = placed(timings).groupBy("eval", "config").agg(F.count("*").alias("turns"), (whole("duration_ms", F.sum) / 1000).alias("seconds"), whole("total_tokens", F.max).alias("tokens"), whole("tool_calls", F.sum).alias("calls"))
    graded = placed(gradings).select("eval", "config", "pass_rate", "passed", "total")
    return graded.join(timed, ["eval", "config"], "left").fillna(1, ["turns"])


def per_eval(runs: DataFrame, with_: str, without: str) -> DataFrame:
    """Every eval that has a run with, its figures, and those of its run without (null where there is none)."""
    figures = ["pass_rate", "passed", "total", "turns", "seconds", "tokens", "calls"]
    base = runs.where(F.col("config") == without).select("eval", *[F.col(c).alias(f"base_{c}") for c in figures])
    return runs.where(F.col("config") == with_).select("eval", *figures).join(base, "eval", "left")


FOLLOW_UP = "Follow-up message from the same user"  # fixed value: what marks a follow-up


def turns(messages: DataFrame, conv: str = "conv_id", line: str = "turn", role: str = "role", text: str = "text", marker: str = FOLLOW_UP) -> DataFrame:
    """Adds ``segment``: 0 before the first non-empty user message, 1 from it on, and one more at each later user message with the marker.

    Lines that tie are taken in the order of their texts; rows without a conversation are one conversation.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    user = F.coalesce(F.col(role) == "user", F.lit(False))
    w = Window.partitionBy(conv).orderBy(line, text).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.sum((user & (F.trim(said) != "")).cast("int")).over(w)
    rows = messages.withColumn("_filled", filled)
    opens = F.col("_filled") == 1
    first = user & (F.trim(said) != "") & opens
    later = user & (F.col("_filled") > 1) & F.contains(said, F.lit(marker))
    return rows.withColumn("segment", F.sum((first | later).cast("int")).over(w)).drop("_filled")
