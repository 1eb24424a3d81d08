"""Drafts against their own analyses: each reason alone, and numbers that only another draft may state."""

import random

import pytest
from pyspark.sql import functions as F

from trendweave.operators import drafts, ordering, text_checks

VERDICTS = [("a", "de", "flat", "share of edition views fell"), ("a", "pl", "growing", "raw"), ("b", "tr", "declining", "raw"), ("c", "de", "growing", "raw")]
KNOWN = [("a", False, 4321.0), ("b", False, 777.0), ("b", True, 55.0), ("a", True, 80.0)]
CASES = {
    "own number": ("Readers came to 4321.", "a", []),
    "number of another's analysis": ("Readers came to 777.", "a", ["unverified"]),
    "number of either of two": ("Readers came to 777 and 4321.", "ab", []),
    "sign": ("It moved -55 % over the year.", "b", ["unverified"]),
    "constant": ("The band is 10% and volume counts from 300.", "", []),
    "nothing cited": ("Readers came to 4321.", "", ["unverified"]),
    "ratio": ("It is 6x the rest.", "a", ["ratios"]),
    "trust": ("We hold trust high (80%).", "a", ["n_trust"]),
    "excuse": ("The loss is due to the whole edition.", "a", ["n_excuse"]),
    "excuse without shares": ("The loss is due to the whole edition.", "b", []),
    "contradiction": ("German readers keep increasing.", "a", ["n_contradiction"]),
    "agreement": ("Polish readers keep increasing.", "a", []),
    "not analysed": ("Turkish readers keep increasing.", "a", []),
    "other analysis": ("Turkish readers keep increasing.", "ab", ["n_contradiction"]),
    "language twice": ("German readers keep increasing.", "ac", []),
    "language": ("Das Interesse ist flat.", "a", ["language"]),
    "proper name": ("Das Thema Flat Earth bleibt.", "b", []),
}


def test_each_reason_alone(spark):
    docs = spark.createDataFrame([(name, text, "de" if "Das" in text else "en") for name, (text, _, _) in CASES.items()] + [("null", None, "uk"), ("no language", "flat", None)], "id string, text string, lang string")
    cited = spark.createDataFrame([(name, a) for name, (_, own, _) in CASES.items() for a in own] + [("null", "a")] * 2, "id string, analysis string")
    names = spark.createDataFrame([("b", "flat earth"), ("b", None)], "analysis string, name string")
    known = spark.createDataFrame(KNOWN, "analysis string, percent boolean, known double")
    verdicts = spark.createDataFrame(VERDICTS, "analysis string, lang string, label string, basis string")
    got = {r["id"]: r for r in drafts.draft_verdicts(docs, cited, known, verdicts, names, "id").collect()}
    assert len(got) == len(CASES) + 2
    for name, (_, _, wrong) in {**CASES, "null": (None, "", []), "no language": (None, "", [])}.items():
        r = got[name]
        assert [c for c in ("unverified", "ratios", "n_trust", "n_excuse", "n_contradiction", "language") if r[c]] == wrong, name
        assert r["ok"] == (not wrong)


@pytest.mark.parametrize("n", [1, 7])
def test_nearest_in_ranges(spark, n):
    """One crowded key over many ranges, others small; against all pairs, without a pair list."""
    rng = random.Random(n)
    asked = [(rng.choice("xxxxxyz"), float(rng.randrange(3000)), i) for i in range(2000)] + [(None, 3.0, -1), ("q", 5.0, -2)]
    points = [(rng.choice("xxxxxyzw"), float(rng.randrange(3000))) for _ in range(700)]
    a = spark.createDataFrame(asked, "k string, v double, i int").repartition(5)
    p = spark.createDataFrame(points, "k string, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n * 3))
    try:
        got = {r["i"]: (r["below"], r["above"]) for r in ordering.nearest(a, p, ["k"], "v").collect()}
        ordered = ordering.numbered(a.where("k is not null"), [F.col("k").desc(), F.col("v"), F.col("i").desc()]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {i: (max((w for q, w in points if q == k and w <= v), default=None), min((w for q, w in points if q == k and w >= v), default=None)) for k, v, i in asked}
    want = sorted((r for r in asked if r[0] is not None), key=lambda r: (-ord(r[0]), r[1], -r[2]))
    assert sorted((r["place"], r["i"]) for r in ordered) == list(enumerate((i for _, _, i in want), 1))


def test_verified_at_random(spark):
    rng = random.Random(9)
    number = lambda: rng.choice([0.0, 0.05, 9.99, 10.0, 99.9, 100.0, 97.5]) if rng.random() < 0.1 else round(rng.choice([-1, 1]) * 10 ** rng.uniform(-2, 4), 2)
    known = {(rng.choice("ab"), rng.random() < 0.5, number()) for _ in range(60)}
    stated = {(rng.choice("ab"), number(), rng.random() < 0.5, rng.random() < 0.5) for _ in range(900)}
    limit = lambda x, p: abs(x) * 0.025 if abs(x) >= 100 else 0.55 if p or abs(x) >= 10 else max(0.05, abs(x) * 0.02)
    want = {(a, v, s, p) for a, v, s, p in stated if any(b == a and q == p and abs(abs(v) - abs(x)) <= limit(x, p) and not (s and v and x and (v > 0) != (x > 0)) for b, q, x in known)}
    c = spark.createDataFrame([(*r, False) for r in stated], "analysis string, value double, signed boolean, percent boolean, ratio boolean")
    k = spark.createDataFrame(list(known), "analysis string, percent boolean, known double")
    assert {tuple(r) for r in text_checks.verified(c, k, ["analysis"]).collect()} == want and 50 < len(want) < 850
