"""Language ID: code lengths against plain dictionaries, odd rows by value, held-out accuracy."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trendweave.llm import language_id as L
from trendweave.llm import queries

TEXTS = {"de": ["Der Hund läuft über die Straße.", "Die Katze schläft und der Vogel singt, ach ja!"], "en": ["The dog runs across the street.", "The cat sleeps while the bird sings", "and so on and so on"]}


def _plain(texts, text, order):
    """Method C with exclusion, one symbol at a time."""
    seen = {}
    for t in texts:
        b = b"\n" * order + t.encode().lower()
        for i in range(order, len(b)):
            for j in range(order + 1):
                at = seen.setdefault(b[i - j : i], {})
                at[b[i]] = at.get(b[i], 0) + 1
    b, bits = b"\n" * order + text.encode().lower(), 0.0
    for i in range(order, len(b)):
        gone = set()
        for j in range(order, -2, -1):
            if j < 0:
                bits += math.log2(256 - len(gone))
                break
            at = {k: n for k, n in seen.get(b[i - j : i], {}).items() if k not in gone}
            if not at:
                continue
            n = sum(at.values()) + len(at)
            if b[i] in at:
                bits -= math.log2(at[b[i]] / n)
                break
            bits -= math.log2(len(at) / n)
            gone |= set(at)
    return bits


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_code_lengths(order):
    trees = []
    for lang in sorted(TEXTS):
        keys = [L.windows(np.frombuffer(b"\n" * order + t.encode().lower(), np.uint8), order) for t in TEXTS[lang]]
        trees.append(L.Tree.of(*np.unique(np.concatenate(keys), return_counts=True), order))
    model = L.Model(sorted(TEXTS), np.zeros(2), trees)
    asked = ["the hound über alles", "", "ZZZ 123 \x00ß", "Straße street " * 90]
    raw, offsets = L.buffers(pa.array(asked))
    for piece, most in ((1 << 20, 1 << 25), (64, 1 << 12)):
        got = L.code_lengths(L.Memory(model, order, most), raw, offsets, order, piece)
        assert np.allclose(got, [[_plain(TEXTS[lang], t, order) for lang in sorted(TEXTS)] for t in asked])


def test_every_known_byte_costs_what_its_share_is():
    """The probabilities of all 256 bytes after any context come to at most one."""
    keys = [L.windows(np.frombuffer(b"\n\n" + t.encode(), np.uint8), 2) for t in TEXTS["en"]]
    tree = L.Tree.of(*np.unique(np.concatenate(keys), return_counts=True), 2)
    for before in (b"th", b"qq", b"e ", b"\n\n"):
        asked = np.array([before[0] | before[1] << 8 | k << 16 for k in range(256)], np.uint64)
        assert np.exp2(-tree.bits(asked)).sum() == pytest.approx(1.0)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, _id string, _text string, _lang string, _n int, _spoken int"
    rows = [(i, t, lang) for lang, ts in TEXTS.items() for i, t in enumerate(ts * 8)]
    odd = [(1, None, "en"), (2, "", "de"), (3, "123 !? \U0001f600", "de"), (None, "der Hund und die Katze", None), (4, "the dog " * 60000, None), (4, "the dog " * 60000, None), (6, "only taught", None), (7, "the bird", "")]
    docs = spark.createDataFrame([(*r, "s", "a", "b", "c", 1, 2) for r in rows + odd], schema).repartition(3)
    got = {}
    for r in L.predict_languages(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows + odd)
    told = {i: [r["lang_pred"] for r in v] for i, v in got.items()}
    assert told[None] == ["de"] and told[4].count("en") >= 2 and "und" in told[1] and "und" in told[2] and "und" in told[3]
    assert all(r["score"] == 0 if r["lang_pred"] == "und" else 0 < r["score"] <= 1 for v in got.values() for r in v)
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, v in got.items() for r in v)
    assert L.predict_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.predict_languages(docs.where("lang is null")).collect()} == {"und"}


def test_learning_takes_nothing_of_held_out_rows(spark):
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, L.predict_languages(docs).collect())) == sorted(map(tuple, L.predict_languages(other).collect()))


def test_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.QUERIES["op11_language_id"](spark, sf).collect() if r["held_out"]]
    assert len(rows) > 150 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.98


def test_sample_is_bounded(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    bounded = L.learn(docs, max_bytes=1 << 17)
    assert 1 << 14 < sum(np.exp2(t.counts[0]).sum() for t in bounded.trees) < 1 << 18
    rows = [r for r in L.predict_languages(docs, bounded).join(docs.select("doc_id", "lang"), "doc_id").collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
