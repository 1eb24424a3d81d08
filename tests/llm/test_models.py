"""Held-out figures of the trained operators: quality trees and the secret network."""

import math
import zlib

import numpy as np
import pytest

from trendweave.llm import quality_model, queries
from trendweave.llm import secret_scan as S


def test_trees_are_walked_as_one_by_one():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = quality_model.fit_forest(x, y, trees=15, depth=3)

    def walk(row):
        margin = forest.bias
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(forest.score(x), [walk(r) for r in x]) and ((forest.score(x) >= 0.5) == y).mean() > 0.95


def test_quality_ranks_held_out_documents(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    rows = [r for r in queries.QUERIES["op4_quality_model"](spark, sf).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    good = np.array([r["score"] for r in rows if labels[r["doc_id"]] == 1])
    bad = np.array([r["score"] for r in rows if labels[r["doc_id"]] == 0])
    assert len(bad) >= 5 and ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.97
    assert (good >= 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.8


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _keys(rng):
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    return [
        "ghp_" + pick(LETTERS, 36), "sk_live_" + pick(LETTERS, 24), "xoxb-" + pick("0123456789", 12) + "-" + pick(LETTERS, 24), pick(LETTERS + "/+", 40),
        "eyJ" + pick(LETTERS, 30) + ".eyJ" + pick(LETTERS, 40) + "." + pick(LETTERS, 43), pick("0123456789ABCDEF", 40), "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
    ]


@pytest.mark.parametrize("share", [0.01, 0.04])
def test_secrets_that_no_pattern_describes(spark, small, share):
    """However many of them the corpus holds, they are found, and other documents gain few spans."""
    rng = np.random.default_rng(int(1000 * share))
    rows, planted = [], {}
    for r in spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").collect():
        i, t = r["doc_id"], r["text"] or ""
        at = t.find(" ", len(t) // 2)
        if at > 0 and rng.random() < share:
            planted[i] = _keys(rng)[rng.integers(7)]
            t = t[:at] + ["", " the key is", ' auth "', " use"][rng.integers(4)] + " " + planted[i] + t[at:]
        rows.append((i, t))
    texts = dict(rows)
    got = {r["doc_id"]: [(f["start"], f["end"]) for f in r["findings"] if f["kind"] == "model"] for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    places = {i: texts[i].index(key) for i, key in planted.items()}
    found = [any(a < places[i] + len(key) and places[i] < b for a, b in got[i]) for i, key in planted.items()]
    assert np.mean(found) >= 0.9
    assert sum(map(len, (f for i, f in got.items() if i not in planted))) <= 0.08 * len(rows)


def test_ordinary_words_are_no_secrets(spark, small):
    """Of the documents as they are, at most two in a thousand gain a span."""
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").repartition(4)
    found = S.find_secrets(docs).collect()
    assert sum(any(f["kind"] == "model" for f in r["findings"]) for r in found) <= 0.002 * len(found)
