"""Hard negatives against all inner products: small parts, copies, ties, odd rows; bounds of nodes; summaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendweave.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, _rid long, _part int, _label string"


def _table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(parts)


def _plain(rows):
    """By id, as sorted tuples; equal rows may stand for each other."""
    good = [(i if i is not None else H.NO_ID, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(good):
        if i % 100 or i == H.NO_ID:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), j, m, b) for b, (j, m, w) in enumerate(good) if b != a)
        for p, j, _, _ in [s for s in scored if s[2] == lab][:5]:
            fit = [(n, s) for n, s, m, _ in scored if m != lab and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(i, j, k, s, -p, -n) for k, (n, s) in enumerate(fit, 1)]
    told = lambda x: None if x == H.NO_ID else x
    return sorted([(told(a), told(b), k, told(c), p, n) for a, b, k, c, p, n in out], key=str)


def _got(spark, rows, **options):
    out = H.mine_negatives(_table(spark, rows), F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def _clustered(n, seed, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(6, size=n)] + rng.normal(scale=0.3, size=(n, d))
    x[: n // 3] = x[0]  # a third of all rows are one vector
    return [(i * 5, [float(v) for v in np.float32(x[i])], int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("most_part,least_part", [(40, 8), (65536, 1024)])
def test_all_products(spark, most_part, least_part):
    rows = _clustered(900, most_part)
    got = _got(spark, rows, most_part=most_part, least_part=least_part)
    assert got == _plain(rows) and len(got) > 500


def test_blocks_go_everywhere_without_summaries(spark, monkeypatch):
    rows = _clustered(300, 3)
    monkeypatch.setattr(H, "MOST_SUMMARIES", 0)
    assert _got(spark, rows, most_part=20, least_part=4) == _plain(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    vec = lambda: [float(x) for x in rng.integers(-3, 4, 3)]
    rows = [(i, vec(), int(rng.integers(2))) for i in range(0, 400, 4)]
    rows += [(100, vec(), 1), (100, vec(), 0), (None, vec(), 0), (None, vec(), 1), (8, None, 1), (9, [1.0, None, 2.0], 1), (10, [float("nan"), 1.0, 1.0], 0), (11, [float("inf"), 1.0, 1.0], 0), (12, vec(), None), (13, [2.0], 0), (14, [], 1), (200, [1.0, 1.0], 1), (15, [1e30, 1.0, 1.0], 1), (16, [-1e30, 0.5, 1.0], 0)]
    rows += [rows[5]] * 3
    got = _got(spark, [r for r in rows if r[0] not in (15, 16)])
    assert got == _plain([r for r in rows if r[0] not in (15, 16)]) and any(r[3] is None for r in got)
    assert len(_got(spark, rows)) > 0
    assert _got(spark, []) == [] and _got(spark, rows[-8:-7]) == [] and _got(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []


def test_bounds_hold_for_every_pair_of_nodes():
    rng = np.random.default_rng(5)
    one, two = (H.Tree(np.floor(256 * rng.normal(size=(n, 5))), rng.integers(3, size=n), 8) for n in (60, 200))
    for a in range(len(one.start)):
        for c in range(len(two.start)):
            score = one.vectors[one.order[one.start[a] : one.end[a]]] @ two.vectors[two.order[two.start[c] : two.end[c]]].T
            low, high = H.intervals(*[x[[a]] for x in (one.low, one.high, one.centre, one.radius)], *[x[[c]] for x in (two.low, two.high, two.centre, two.radius)])
            assert low[0] <= score.min() and score.max() <= high[0]


def test_node_pairs_are_dropped_whole(monkeypatch):
    """Far clusters are never scored: fewer products than rows times anchors."""
    rng = np.random.default_rng(6)
    centre = np.eye(16) * 100
    x = np.floor(256 * (np.repeat(centre, 500, axis=0) + rng.normal(size=(8000, 16))))
    label = np.repeat(np.arange(16), 500)
    one, two = H.Tree(x[::20], label[::20], H.ANCHOR_LEAF), H.Tree(x, label, H.LEAF)
    seen, plain = [0], H.products
    monkeypatch.setattr(H, "products", lambda p, q: (seen.__setitem__(0, seen[0] + len(p) * len(q)), plain(p, q))[1])
    ids = np.arange(len(x))
    need = np.full((400, 1), -H.FAR)
    H.search(one, two, need, np.full((400, 1), H.FAR), 5, True, ids[::20], ids, ids)
    assert seen[0] <= 400 * 8000 / 8 and (need > 0).all()


def test_exact_beyond_doubles():
    big = np.array([[2.0**40, 3.0], [2.0**31, 1.0]])
    assert H.products(big, np.array([[2.0**18, 1.0]])).tolist() == [[2**58 + 3], [2**49 + 1]]
    assert H.products(big, big)[0, 0] == H.LIMIT
