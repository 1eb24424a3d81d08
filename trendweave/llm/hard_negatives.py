"""Hard-negative mining: a dual-tree search for rows of another label that score a little below an anchor's positives.

Scores are inner products of vectors whose components are floor(scale * x).  Rows are dealt to cells by a tree over a bounded
sample (by label, then by the coordinate that varies most), and every cell to parts of at most ``part_rows`` rows, so one
part holds neighbours and no part grows with the input or with the number of equal vectors.  In a part, a tree over all
its rows and trees over its anchors (blocks of at most ``BLOCK``) know of every node the box, the ball and the range of
labels.  For a pair of nodes these give an interval of the inner product; pairs whose interval misses what every
anchor of the node can still use are dropped with all their rows.  Pairs of leaves that are left are scored exactly.

1. At home: each block meets its own part; the fifth best row of the same label there is a floor for what follows.
2. Positives: blocks go to all parts whose summary can hold a row above the floors; best rows by anchor.
3. Negatives: blocks go, with the bands that the positives set, to the most promising parts that can hold a row of another
   label in a band, as many as the square root of their number; the last of the best rows found there is a floor, and
   with it they go to the other parts; best rows by anchor and positive.  So an anchor's hits grow with the square root
   of the parts, not with the parts.

Each meeting is one shuffle of the rows by part, beside copies of the blocks; a task holds one part and one batch of
blocks.  Summaries are broadcast while there are at most ``MOST_SUMMARIES`` parts (about 1.5 KB each); with more,
blocks go to every part and are dropped at its root.  Anchors are a stated query set; nothing pairs rows with rows.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; shorter
vectors count as filled up with zeros; scores are exact up to 2**59 and held there beyond; equal scores go by
smaller id, null ids last, then by row; a repeated row is a row of its own; an anchor without positives, or
without rows in a band, has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R

LEAF, ANCHOR_LEAF, BLOCK = 256, 32, 256
SAMPLE_ROWS, MOST_CELLS, MOST_SUMMARIES = 16384, 4096, 16384
LEAST_PART, MOST_PART = 1024, 65536
FAR, LIMIT, NO_ID = 1 << 62, 1 << 59, (1 << 63) - 1
ROW_DDL = "_rid long, _id long, _label long, _anchor boolean, _vec binary, _cell int"
BLOCK_DDL = "_part int, _block long, _rids array<long>, _ids array<long>, _labels array<long>, _vecs binary, _floor array<long>, _low array<long>, _high array<long>, _pids array<long>, _pscores array<long>, _bounds array<double>"
MEET_DDL = "_part int, _block long, _rids array<long>, _ids array<long>, _labels array<long>, _vecs binary, _floor array<long>, _low array<long>, _high array<long>, _pids array<long>, _pscores array<long>"
HIT_DDL = "_block long, _a int, _slot int, anchor_id long, positive_id long, positive_score long, _score long, _id long, _rid long"


def _cut(vectors: np.ndarray, labels: np.ndarray) -> tuple[int, float] | None:
    """Feature (-1: the label) and threshold that part the rows about evenly; None where all are equal."""
    feature, values = -1, labels
    if labels.min() == labels.max():
        feature = int(vectors.var(axis=0).argmax())
        values = vectors[:, feature]
    ordered = np.sort(values)
    if ordered[0] == ordered[-1]:
        return None
    at = ordered[(len(ordered) - 1) // 2]
    return feature, float(at if at < ordered[-1] else ordered[np.searchsorted(ordered, at) - 1])


def _left(vectors: np.ndarray, labels: np.ndarray, feature: int, threshold: float) -> np.ndarray:
    return (labels if feature < 0 else vectors[:, feature]) <= threshold


@dataclass
class Router:
    """Top tree: inner nodes with feature, threshold and children; leaves with a cell number."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    cell: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, labels: np.ndarray, cells: int) -> Router:
        feature, threshold, child = [-1], [0.0], [0]
        rows = {0: np.arange(len(labels))}
        heap = [(-len(labels), 0)] if len(labels) else []
        leaves = 1
        while heap and leaves < cells:
            _, node = heapq.heappop(heap)
            own = rows.pop(node)
            cut = _cut(vectors[own], labels[own])
            if cut is None:
                continue
            feature[node], threshold[node], child[node] = *cut, len(child)
            left = _left(vectors[own], labels[own], *cut)
            for part in (own[left], own[~left]):
                rows[len(child)] = part
                heapq.heappush(heap, (-len(part), len(child)))
                feature.append(-1), threshold.append(0.0), child.append(0)
            leaves += 1
        ends = np.array(child) == 0
        return cls(np.array(feature), np.array(threshold), np.array(child), np.cumsum(ends) - 1)

    def __call__(self, vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(labels), np.int64), np.arange(len(labels))
        while len(rows):
            rows = rows[self.child[node[rows]] > 0]
            f = self.feature[node[rows]]
            value = np.where(f < 0, labels[rows], vectors[rows, np.maximum(f, 0)])
            node[rows] = self.child[node[rows]] + (value > self.threshold[node[rows]])
        return self.cell[node]


class Tree:
    """Nodes over rows: each a run of ``order`` with the box, ball and range of labels of its rows; child 0: a leaf."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, leaf: int):
        self.vectors, self.labels = vectors, labels
        self.order = np.arange(len(labels))
        start, end, child, at = [0], [len(labels)], [0], 0
        while at < len(start):
            a, b = start[at], end[at]
            own = self.order[a:b]
            mixed = b - a > leaf // 8 and labels[own].min() < labels[own].max()  # few labels in a leaf rule out more pairs than few rows
            cut = _cut(vectors[own], labels[own]) if b - a > leaf or mixed else None
            if cut is not None:
                left = _left(vectors[own], labels[own], *cut)
                self.order[a:b] = np.concatenate([own[left], own[~left]])
                child[at], mid = len(start), a + int(left.sum())
                start += [a, mid]
                end += [mid, b]
                child += [0, 0]
            at += 1
        self.start, self.end, self.child = np.array(start), np.array(end), np.array(child)
        nodes, d = len(start), vectors.shape[1]
        self.low, self.high, self.centre, self.radius, self.norm = np.zeros((nodes, d)), np.zeros((nodes, d)), np.zeros((nodes, d)), np.zeros(nodes), np.zeros(nodes)
        self.first, self.last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for k in range(nodes) if len(labels) else ():
            own = self.order[start[k] : end[k]]
            x, y = vectors[own], labels[own]
            self.low[k], self.high[k], self.centre[k] = x.min(axis=0), x.max(axis=0), x.mean(axis=0)
            self.radius[k] = np.sqrt(((x - self.centre[k]) ** 2).sum(axis=1).max())
            self.first[k], self.last[k] = y.min(), y.max()
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def root(self) -> list[float]:
        """Summary of all rows: low, high, centre, then radius and the range of labels."""
        return [*self.low[0], *self.high[0], *self.centre[0], self.radius[0], float(self.first[0]), float(self.last[0])]


def intervals(low1, high1, centre1, radius1, low2, high2, centre2, radius2) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of two boxes that are balls as well, a row for each pair."""
    a, b, c, d = low1 * low2, low1 * high2, high1 * low2, high1 * high2
    least, most = np.minimum(np.minimum(a, b), np.minimum(c, d)).sum(axis=1), np.maximum(np.maximum(a, b), np.maximum(c, d)).sum(axis=1)
    middle = (centre1 * centre2).sum(axis=1)
    n1, n2 = np.sqrt((centre1**2).sum(axis=1)), np.sqrt((centre2**2).sum(axis=1))
    reach = n1 * radius2 + n2 * radius1 + radius1 * radius2
    slack = 1 + 1e-9 * (n1 + radius1) * (n2 + radius2)
    return np.maximum(least, middle - reach) - slack, np.minimum(most, middle + reach) + slack


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held within LIMIT."""
    most = np.abs(one).max(initial=0) * np.abs(two).max(initial=0) * max(1, one.shape[1])
    if most < 2**53:
        return (one @ two.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(one) @ whole(two).T, -LIMIT, LIMIT).astype(np.int64)


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def _split(pair_a, pair_c, one: Tree, two: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves, and of the others their children: those of the larger node, or of the one that has any."""
    inner_a, inner_c = one.child[pair_a] > 0, two.child[pair_c] > 0
    size_a, size_c = one.end[pair_a] - one.start[pair_a], two.end[pair_c] - two.start[pair_c]
    by_a = inner_a & (~inner_c | (size_a * (LEAF // ANCHOR_LEAF) > size_c))
    by_c = inner_c & ~by_a
    a = np.concatenate([one.child[pair_a[by_a]], one.child[pair_a[by_a]] + 1, pair_a[by_c], pair_a[by_c]])
    c = np.concatenate([pair_c[by_a], pair_c[by_a], two.child[pair_c[by_c]], two.child[pair_c[by_c]] + 1])
    return ~(by_a | by_c), a, c


def search(one: Tree, two: Tree, need: np.ndarray, high: np.ndarray, k: int, same: bool, rids1: np.ndarray, rids2: np.ndarray, ids2: np.ndarray) -> list[np.ndarray]:
    """For each row of ``one`` and slot, the k best rows of ``two`` scoring from ``need`` to ``high`` (rows x slots): row, slot, score, row of ``two``.

    same: rows of the same label other than itself, else rows of other labels.  ``need`` rises to the k-th best on the way.
    """
    slots = need.shape[1]
    pair_a, pair_c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple] = []
    while len(pair_a):
        useful = np.array([need[one.order[s:e]].min() for s, e in zip(one.start, one.end, strict=True)])
        useless = np.array([high[one.order[s:e]].max() for s, e in zip(one.start, one.end, strict=True)])
        least, most = (np.zeros(len(pair_a)) for _ in range(2))
        for i in range(0, len(pair_a), 2048):
            p, q = pair_a[i : i + 2048], pair_c[i : i + 2048]
            least[i : i + 2048], most[i : i + 2048] = intervals(one.low[p], one.high[p], one.centre[p], one.radius[p], two.low[q], two.high[q], two.centre[q], two.radius[q])
        on = (most >= useful[pair_a]) & (least <= useless[pair_a])
        if same:
            on &= (one.first[pair_a] <= two.last[pair_c]) & (two.first[pair_c] <= one.last[pair_a])
        else:
            on &= ~((one.first[pair_a] == one.last[pair_a]) & (two.first[pair_c] == two.last[pair_c]) & (one.first[pair_a] == two.first[pair_c]))
        pair_a, pair_c, least, most = pair_a[on], pair_c[on], least[on], most[on]
        ends, a, c = _split(pair_a, pair_c, one, two)
        leaves += zip(pair_a[ends], pair_c[ends], least[ends], most[ends], strict=True)
        pair_a, pair_c = a, c
    found: list[tuple] = []
    by: dict[int, list] = {}
    for a, c, lo, hi in leaves:
        by.setdefault(int(a), []).append((-hi, lo, int(c)))
    for a, nodes in by.items():
        rows = one.order[one.start[a] : one.end[a]]
        kept = [np.zeros(0, np.int64)] * 3
        nodes.sort()
        for i in range(0, len(nodes), 4):
            floor, ceiling = need[rows].min(), high[rows].max()
            own = [c for hi, lo, c in nodes[i : i + 4] if -hi >= floor and lo <= ceiling]
            if not own:
                continue
            cols = np.concatenate([two.order[two.start[c] : two.end[c]] for c in own])
            score = products(one.vectors[rows], two.vectors[cols])
            alike = one.labels[rows][:, None] == two.labels[cols]
            fit = alike & (rids1[rows][:, None] != rids2[cols]) if same else ~alike
            hits = [np.nonzero(fit & (score >= need[rows, s][:, None]) & (score <= high[rows, s][:, None])) for s in range(slots)]
            if not any(len(r) for r, _ in hits):
                continue
            key = np.concatenate([kept[0], *[r * slots + s for s, (r, _) in enumerate(hits)]])
            value = np.concatenate([kept[1], *[score[h] for h in hits]])
            other = np.concatenate([kept[2], *[cols[c] for _, c in hits]])
            order = np.lexsort((rids2[other], ids2[other], -value, key))
            key, value, other = key[order], value[order], other[order]
            rank = np.arange(len(key)) - np.searchsorted(key, key)
            kept = [x[rank < k] for x in (key, value, other)]
            full = rank == k - 1
            need[rows[key[full] // slots], key[full] % slots] = value[full]
        if len(kept[0]):
            found.append((rows[kept[0] // slots], kept[0] % slots, kept[1], kept[2]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def _stack(column) -> np.ndarray:
    """Vectors of a binary column of doubles, shorter ones filled up with zeros."""
    rows = [np.frombuffer(v, np.float64) for v in column.to_pylist()]
    d = max([1, *map(len, rows)])
    return np.stack([np.pad(r, (0, d - len(r))) if len(r) < d else r for r in rows]) if rows else np.zeros((0, d))


def _ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _quantised(column: pa.ListArray, scale: float) -> list[np.ndarray]:
    flat, ends = np.floor(scale * _ints(column.flatten()).astype(np.float64)), np.concatenate([[0], np.cumsum(_ints(column.value_lengths()))]).astype(np.int64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _dealt(router: Router, scale: float, d: int):
    """Quantised rows with their cells."""

    def dealt(batches):
        for batch in batches:
            rows = _quantised(batch.column("_x"), scale)
            vectors = np.stack([np.pad(r[:d], (0, d - min(d, len(r)))) for r in rows]) if rows else np.zeros((0, d))
            cell = router(vectors, _ints(batch.column("_label")))
            columns = [batch.column(c) for c in ("_rid", "_id", "_label", "_anchor")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(cell.astype(np.int32))], ["_rid", "_id", "_label", "_anchor", "_vec", "_cell"])

    return dealt


def _at_home(n_positives: int):
    """A summary row (block -1) of each part, and its anchors in blocks with what they have found there."""

    def at_home(key, table):
        part = key[0].as_py()
        vectors, labels, rids, ids = _stack(table.column("_vec")), _ints(table.column("_label")), _ints(table.column("_rid")), _ints(table.column("_id"))
        tree = Tree(vectors, labels, LEAF)
        rows = [{"_part": part, "_block": -1, "_bounds": tree.root()}]
        chosen = np.flatnonzero(_ints(table.column("_anchor")))
        if len(chosen):
            chosen = chosen[Tree(vectors[chosen], labels[chosen], ANCHOR_LEAF).order]
        for i in range(0, len(chosen), BLOCK):
            own = chosen[i : i + BLOCK]
            anchors = Tree(vectors[own], labels[own], ANCHOR_LEAF)
            need = np.full((len(own), 1), -FAR, np.int64)
            search(anchors, tree, need, np.full((len(own), 1), FAR, np.int64), n_positives, True, rids[own], rids, ids)
            rows.append({"_part": part, "_block": (part << 20) + i // BLOCK, "_rids": rids[own], "_ids": ids[own], "_labels": labels[own], "_vecs": vectors[own].tobytes(), "_floor": need[:, 0], "_bounds": anchors.root()})
        return pa.Table.from_pylist(rows, schema=HOME)

    return at_home


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


HOME, MEET, HIT = _arrow(BLOCK_DDL), _arrow(MEET_DDL), _arrow(HIT_DDL)


def _unpack(bounds: np.ndarray) -> tuple:
    """Low, high, centre, radius, first and last label of rows of summaries."""
    d = (bounds.shape[1] - 3) // 3
    return bounds[:, :d], bounds[:, d : 2 * d], bounds[:, 2 * d : 3 * d], bounds[:, -3], bounds[:, -2], bounds[:, -1]


def _sent(parts: np.ndarray, summaries: np.ndarray | None, same: bool, wave: int | None):
    """Each block once for every part whose summary does not rule it out; wave 0: of the most promising parts only, 1: of the others.

    Which parts are promising follows from their summaries and labels alone, so both waves agree on it whatever the floors.
    """

    def sent(batches):
        for batch in batches:
            for r in batch.to_pylist():
                allowed, on, most = np.ones(len(parts), bool), np.ones(len(parts), bool), np.roll(np.arange(float(len(parts))), r["_block"] % max(1, len(parts)))
                if summaries is not None:
                    own = np.array([r["_bounds"]])
                    d = max((own.shape[1] - 3) // 3, (summaries.shape[1] - 3) // 3)
                    low, high, centre, radius, first, last = ((_wide(x, d) if x.ndim == 2 else x) for x in _unpack(own))
                    low2, high2, centre2, radius2, first2, last2 = ((_wide(x, d) if x.ndim == 2 else x) for x in _unpack(summaries))
                    least, most = intervals(low, high, centre, radius, low2, high2, centre2, radius2)
                    need, top = (min(r["_floor"]), FAR) if same else (min(r["_low"], default=FAR), max(r["_high"], default=-FAR))
                    on = (most >= need) & (least <= top)
                    allowed = ((first <= last2) & (first2 <= last)) if same else ~((first == last) & (first2 == last2) & (first == first2))
                if wave is not None:
                    chosen = np.zeros(len(parts), bool)
                    ranked = np.flatnonzero(allowed)[np.argsort(-most[allowed], kind="stable")]
                    chosen[ranked[: int(np.ceil(np.sqrt(len(ranked))))]] = True
                    allowed &= chosen == (wave == 0)
                to = parts[on & allowed]
                if len(to):
                    row = {k: r[k] for k in MEET.names}
                    yield from (pa.RecordBatch.from_pylist([row | {"_part": int(p)} for p in to[i : i + 64]], schema=MEET) for i in range(0, len(to), 64))

    return sent


def _meet(k: int, same: bool):
    """A stream of parts, each with its rows first and then the blocks that come to it: the best rows of each block there."""

    def meet(batches):
        part, held, tree, rids, ids = None, [], None, None, None
        for batch in batches:
            at, block = _ints(batch.column("_part")), batch.column("_block")
            is_row = np.array([b is None for b in block.to_pylist()])
            edges = np.flatnonzero(np.diff(at) | np.diff(is_row.astype(np.int8))) + 1
            for a, b in zip([0, *edges], [*edges, len(at)], strict=True):
                if at[a] != part:
                    part, held, tree = at[a], [], None
                if is_row[a]:
                    held.append(batch.slice(a, b - a).select(["_rid", "_id", "_label", "_vec"]))
                    continue
                if tree is None and held:
                    table = pa.Table.from_batches(held)
                    held = []
                    rids, ids = _ints(table.column("_rid")), _ints(table.column("_id"))
                    tree = Tree(_stack(table.column("_vec")), _ints(table.column("_label")), LEAF)
                out = [_best(r, tree, rids, ids, k, same) for r in batch.slice(a, b - a).to_pylist()] if tree is not None else []
                out = [t for t in out if t.num_rows]
                if out:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()

    return meet


def _best(r: dict, tree: Tree, rids: np.ndarray, ids: np.ndarray, k: int, same: bool) -> pa.Table:
    n = len(r["_rids"])
    vectors = np.frombuffer(r["_vecs"], np.float64).reshape(n, -1)
    d = max(vectors.shape[1], tree.vectors.shape[1])
    if tree.vectors.shape[1] < d:
        tree = Tree(_wide(tree.vectors, d), tree.labels, LEAF)
    own = Tree(_wide(vectors, d), np.array(r["_labels"]), ANCHOR_LEAF)
    need, high = (np.array(r["_floor"]).reshape(n, 1), np.full((n, 1), FAR)) if same else (np.array(r["_low"]).reshape(n, -1), np.array(r["_high"]).reshape(n, -1))
    a, slot, score, other = search(own, tree, need, high, k, same, np.array(r["_rids"]), rids, ids)
    at = a * need.shape[1] + slot
    none = np.zeros(len(a), np.int64)
    pids, pscores = (none, none) if same else (np.array(r["_pids"])[at], np.array(r["_pscores"])[at])
    columns = [np.full(len(a), r["_block"]), a.astype(np.int32), slot.astype(np.int32), np.array(r["_ids"])[a], pids, pscores, score, ids[other], rids[other]]
    return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, HIT.types, strict=True)], schema=HIT)


def _banded(n_positives: int, low: int, high: int, of: int):
    """Blocks with their positives' bands, in ``n_positives`` slots each; those without any positive go."""

    def banded(blocks, positives):
        rows = []
        for r in blocks.to_pylist():
            n = len(r["_rids"])
            pids, scores, lows, highs = (np.full((n, n_positives), x, np.int64) for x in (0, 0, FAR, -FAR))
            a, slot, score = _ints(positives.column("_a")), _ints(positives.column("_rank")) - 1, _ints(positives.column("_score"))
            pids[a, slot], scores[a, slot] = _ints(positives.column("_id")), score
            lows[a, slot], highs[a, slot] = [-(-low * int(s) // of) for s in score], [high * int(s) // of for s in score]
            if len(a):
                rows.append(r | {"_low": lows.ravel(), "_high": highs.ravel(), "_pids": pids.ravel(), "_pscores": scores.ravel()})
        return pa.Table.from_pylist(rows, schema=HOME)

    return banded


def _raised(blocks, floors):
    """Blocks whose bands begin at the last of the best rows found so far."""
    rows = []
    for r in blocks.to_pylist():
        low = np.array(r["_low"], np.int64)
        at = _ints(floors.column("_a")).astype(np.int64) * (len(low) // len(r["_rids"])) + _ints(floors.column("_slot"))
        low[at] = np.maximum(low[at], _ints(floors.column("_score")))
        rows.append(r | {"_low": low})
    return pa.Table.from_pylist(rows, schema=HOME)


def _met(rows: DataFrame, blocks: DataFrame, parts: np.ndarray, summaries: np.ndarray | None, k: int, same: bool, wave: int | None = None) -> DataFrame:
    """The best rows of each block, anchor and slot in each part it is sent to."""
    sent = blocks.mapInArrow(_sent(parts, summaries, same, wave), MEET_DDL)
    both = rows.select("_part", "_rid", "_id", "_label", "_vec").unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition(max(1, min(2 * len(parts), 4096)), "_part").sortWithinPartitions("_part", F.col("_block").asc_nulls_first())
    return R.materialize(dealt.mapInArrow(_meet(k, same), HIT_DDL), "negatives-met")


def mine_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 10, band: tuple[int, int, int] = (30, 90, 100), most_part: int = MOST_PART, least_part: int = LEAST_PART
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors.  A negative of a positive scores from band[0] to band[1] band[2]-ths of it; labels are whole numbers.
    """
    spark = vectors.sparkSession
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    given = valid.select(F.monotonically_increasing_id().alias("_rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(label_col).cast("long").alias("_label"), F.coalesce(anchor, F.lit(False)).alias("_anchor"), F.col(vector_col).cast("array<double>").alias("_x"))
    n = given.count()
    drawn = int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 30))
    sample = given.where(F.pmod(F.xxhash64("_rid"), F.lit(1 << 30)) < drawn).select("_label", "_x").toArrow()
    points = _quantised(sample.column("_x").combine_chunks(), scale) if sample.num_rows else []
    d = max([1, *map(len, points)])
    room = min(most_part, max(least_part, n // 64))
    router = Router.of(np.stack([np.pad(p, (0, d - len(p))) for p in points]) if points else np.zeros((0, d)), _ints(sample.column("_label")), min(MOST_CELLS, max(1, 2 * n // room)))
    rows = R.materialize(given.mapInArrow(_dealt(router, scale, d), ROW_DDL), "negatives-rows")
    sizes = {r["_cell"]: r["count"] for r in rows.groupBy("_cell").count().collect()}
    pieces = [-(-sizes.get(c, 0) // room) for c in range(int(router.cell.max()) + 1)]
    starts = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    listed = lambda x: F.get(F.from_json(F.lit(json.dumps(x)), "array<int>"), F.col("_cell"))
    placed = rows.withColumn("_part", (listed(starts) + F.pmod(F.xxhash64("_rid"), listed(pieces))).cast("int"))
    with R.setting(spark, R.BATCH_ROWS, "128"):
        home = R.materialize(placed.groupBy("_part").applyInArrow(_at_home(n_positives), BLOCK_DDL), "negatives-home", block_bytes=1 << 24)
        parts, summaries = np.arange(starts[-1], dtype=np.int64), None
        if starts[-1] <= MOST_SUMMARIES:
            found = home.where("_block < 0").select("_part", "_bounds").toArrow().to_pylist()
            wide = max([6, *(len(r["_bounds"]) for r in found)])
            parts, summaries = np.array([r["_part"] for r in found], np.int64), np.zeros((len(found), wide))
            for k, r in enumerate(found):
                low, high, centre, *rest = _unpack(np.array([r["_bounds"]]))
                summaries[k] = np.concatenate([*[_wide(x, (wide - 3) // 3)[0] for x in (low, high, centre)], *rest])
        blocks = home.where("_block >= 0")
        first = Window.partitionBy("_block", "_a").orderBy(F.desc("_score"), "_id", "_rid")
        met = _met(placed, blocks, parts, summaries, n_positives, True)
        positives = met.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n_positives).select("_block", "_a", "_rank", "_id", "_score")
        banded = R.materialize(blocks.groupBy("_block").cogroup(positives.groupBy("_block")).applyInArrow(_banded(n_positives, *band), BLOCK_DDL), "negatives-banded", block_bytes=1 << 24)
        best = Window.partitionBy("_block", "_a", "_slot").orderBy(F.desc("_score"), "_id", "_rid")
        near = _met(placed, banded, parts, summaries, n_negatives, False, 0)
        last = near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == n_negatives).select("_block", "_a", "_slot", "_score")
        raised = R.materialize(banded.groupBy("_block").cogroup(last.groupBy("_block")).applyInArrow(_raised, BLOCK_DDL), "negatives-raised", block_bytes=1 << 24)
        hits = near.unionByName(_met(placed, raised, parts, summaries, n_negatives, False, 1))
    R.drop_tables(rows, home, met, banded, raised)
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    told = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return ranked.select(told("anchor_id").alias("anchor_id"), told("positive_id").alias("positive_id"), "rank", told("_id").alias("negative_id"), "positive_score", F.col("_score").alias("negative_score"))
