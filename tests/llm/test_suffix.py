"""Repeated strings where ids repeat or lack and chunks are small, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from trendweave.llm import suffix_dedup


def _brute(rows, n):
    seen = {}
    order = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in order:
        for k in range(len(b) - n + 1):
            seen[b[k : k + n]] = min(i, seen.get(b[k : k + n], i))
    out = []
    for (i, b), (own, _) in zip(order, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] < i:
                gone[k : k + n] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        out.append((-1 if own is None else own, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def _got(spark, rows, threshold, chunk_bytes):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, lengths long")
    done = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, threshold=threshold, chunk_bytes=chunk_bytes))
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in done.collect())


@pytest.mark.parametrize(("threshold", "chunk_bytes", "seed"), [(50, 1500, 1), (50, 1 << 20, 2), (20, 700, 3), (7, 400, 4)])
def test_brute_force(spark, threshold, chunk_bytes, seed):
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(threshold // 2, 3 * threshold))) for _ in range(12)] + ["a" * 2 * threshold, "ab" * threshold]
    ids = [None, None, *range(12)]
    rows = [(rng.choice(ids), "".join(rng.choice(blocks) + "".join(rng.choice("xyzuvw") for _ in range(rng.randrange(threshold))) for _ in range(rng.randrange(4)))) for _ in range(120)]
    rows += [(3, None), (None, ""), (4, rows[0][1]), (4, rows[0][1])]
    assert _got(spark, rows, threshold, chunk_bytes) == _brute(rows, threshold)


def test_many_rows_without_id(spark):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(60))
    rows = [(None, f"{k:05d} {text}") for k in range(10000)] + [(1, text)]
    got = _got(spark, rows, 50, 1 << 16)
    assert {r[2] for r in got if r[0] == -1} == {60} and [r[2] for r in got if r[0] == 1] == [0]
