"""The rules of the metrics on series made from short rules."""

import pytest

from trendweave.operators import series

START = 2024 * 12
CASES = {
    "exponential": [1000 * 1.05**i for i in range(24)],
    "flat": [1000] * 24,
    "viral": [1000] * 12 + [900] * 11 + [40000],
    "short": [10, 12, 11, 13],
    "alternating": [3000, 100] * 12,
    "step": [5] * 12 + [4000] * 12,
    "down": [1182] * 12 + [437] * 12,
}


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [(k, "en", START + i, int(v)) for k, vs in CASES.items() for i, v in enumerate(vs)]
    user = spark.createDataFrame(rows, "topic string, lang string, month int, views long")
    bots = user.where("topic = 'flat'")
    totals = spark.createDataFrame([("en", START + i, 10**6) for i in range(24)], "lang string, month int, views long")
    return {r["topic"]: r for r in series.series_metrics(user, bots, totals).collect()}


def test_growth_and_trend(metrics):
    e = metrics["exponential"]
    assert e["verdict"] == "growing" and e["r2"] == 1.0
    assert abs(e["trend_annual"] - (1.05**12 - 1) * 100) < 0.5
    assert metrics["flat"]["verdict"] == "flat" and metrics["flat"]["r2"] == 0.0
    assert metrics["down"]["verdict"] == "declining"


def test_spikes_do_not_count_as_growth(metrics):
    v = metrics["viral"]
    assert v["yoy"] > 10 and v["robust_growth"] < 0 and v["spikes"] == ["2025-12"] and "spikeDriven" in v["note_keys"]
    assert v["peak_month"] == "2025-12" and v["peak_views"] == 40000


def test_short_series_and_shift(metrics):
    s = metrics["short"]
    assert s["verdict"] == "insufficient-data" and s["yoy"] is None and s["trend_annual"] is None and "months6" in s["note_keys"]
    shift = metrics["step"]["level_shift"]
    assert (shift["month"], shift["from"], shift["to"]) == ("2025-01", 5, 4000) and metrics["step"]["verdict"] == "insufficient-data"


def test_bots(metrics):
    assert metrics["flat"]["bot_share"] == 0.5 and "bots40" in metrics["flat"]["note_keys"]
    assert metrics["viral"]["bot_share"] is None


def test_gaps_and_duplicates(spark):
    user = spark.createDataFrame([("a", "en", START, 5), ("a", "en", START, 7), ("a", "en", START + 3, 1), ("a", "en", None, 9)], "topic string, lang string, month int, views long")
    row = series.densify(user, end=START + 4).first()
    assert row["views"] == [7.0, 0.0, 0.0, 1.0, 0.0] and row["observed"] == 3


def test_empty(spark):
    user = spark.createDataFrame([], "topic string, lang string, month int, views long")
    assert series.ranking(series.series_metrics(user)).count() == 0
