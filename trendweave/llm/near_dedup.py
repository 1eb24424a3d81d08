"""Near dedup by circulant MinHash with exact verification.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased, words split at ASCII white
space); a shorter document is one shingle, one without words has the empty set and no links.  Two
permutations of a universe of 2**20 cells make every signature coordinate: the first scatters the shingles,
the second, shifted circularly by k, gives coordinate k.  Coordinates go into bands; documents that share a
band key are candidates.  Documents with equal sets (128-bit digest over the whole set and its size) form a
class first, and only a class's representative is banded.

Candidates become links in three steps, none of which lists the pairs of a bucket:

1. Twice, every member of a bucket is compared, on full sets, with the bucket's pivot (its member with most
   copies, then the one with most links so far); links join components, and buckets of one component are closed.
2. Of what is still open, the shingles are counted.  A shingle of x that no other open document has is in no
   overlap, so with m others a link of x and y needs ``percent * (|x| + |y|) <= (100 + percent) * m``.  Most
   documents that only share a template with others can then link with nobody and leave.
3. The rest of a bucket meets by size: the larger document of a link looks for sizes between the threshold and
   the bound of step 2, in cells of a grid that are part of the join key; a parity bitmap of the shingles (the
   bits in which two bitmaps differ are at most the shingles in which the sets differ) rules out almost all
   pairs that are no links.  What remains is compared on full sets.  Hot buckets are dealt to lanes.

Every bound is exact: no candidate is capped or dropped that could be a link.  With 25 bands of 5 coordinates
a pair at similarity 0.85 meets in at least one band with probability 1 - 4e-7, one at 0.8 with 1 - 5e-5.
Sets are compared by 64-bit shingle hashes (a false match of two shingles: about n * m / 2**64).

Defined results: null and empty texts link with nothing; rows with a repeated id are rows of their own, and of
a component the row with the smallest id (null last), then the first of repeated ones, is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from .textops import LOWER, STEP, buffers, hash_spans, mix64, shingle_hashes, slices, words_of

UNIVERSE = 1 << 20
BITS = 16  # longs of a parity bitmap
LANE_PAIRS = 256
LANE = 4096  # members of a bucket in one lane


@cache
def circulant(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all shifts of the second one as overlapping rows: row x holds pi[x], pi[x+1], ..."""
    rng = np.random.Generator(np.random.PCG64(85))
    scatter = rng.permutation(UNIVERSE).astype(np.int32)
    pi = rng.permutation(UNIVERSE).astype(np.uint32)
    ring = np.concatenate([pi, pi[:coordinates]])
    return scatter, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    scatter, ring = circulant(coordinates)
    cells = scatter[(shingles >> np.uint64(44)).astype(np.int64)]
    out = np.full(coordinates, UNIVERSE, np.uint32)
    for k in range(0, len(cells), 2048):
        np.minimum(out, ring[cells[k : k + 2048]].min(axis=0), out=out)
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    low = LOWER[raw]
    starts, ends, first = words_of(low, offsets)
    h, doc = shingle_hashes(hash_spans(low, starts, ends), first, width, whole_short=True)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    n_long = np.maximum(np.diff(first) - width + 1, 0)
    at = np.cumsum(n_long) - n_long
    extra = int(n_long.sum())
    out = []
    for i, (n, c) in enumerate(zip(n_long, counts, strict=True)):
        if n:
            own = np.sort(h[at[i] : at[i] + n])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif c:
            out.append(h[extra : extra + 1])
            extra += 1
        else:
            out.append(h[:0])
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit b is set if an odd number of shingles fall on it."""
    count = np.bincount((shingles & np.uint64(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _sign(width: int, bands: int, rows: int):
    weights = mix64(np.arange(1, rows + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def signed(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            n = len(batch)
            size, d1, d2, keys, bits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [], np.zeros((n, BITS), np.int64)
            for a, b in slices(np.diff(offsets), 1 << 22):
                for i, own in enumerate(shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width), a):
                    size[i] = len(own)
                    if len(own):
                        bits[i] = parity(own)
                        d1[i] = own.sum(dtype=np.uint64).view(np.int64)
                        d2[i] = mix64(own ^ STEP).sum(dtype=np.uint64).view(np.int64)
                        parts = signature(own, bands * rows).reshape(bands, rows).astype(np.uint64)
                        keys.append(mix64((parts * weights).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array(size), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BITS), pa.array(bits.reshape(-1)))], ["_rid", "_n", "_d1", "_d2", "_bands", "_bits"])

    return signed


def _streamed(batches, width: int, visit):
    """Texts sorted by (pivot, salt, role): holds one pivot's set, calls visit(rows, x, pivot, set of x, set of the pivot)."""
    place, held = None, None
    for batch in batches:
        raw, offsets = buffers(batch.column("_text"))
        pivot, salt, role, rid = (batch.column(c).to_pylist() for c in ("_pivot", "_salt", "_role", "_rid"))
        rows: list[tuple] = []
        for a, b in slices(np.diff(offsets), 1 << 22):
            for i, own in enumerate(shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width), a):
                if role[i] == 0:
                    place, held = (pivot[i], salt[i]), own
                elif place != (pivot[i], salt[i]):
                    raise ValueError("a pivot's text is missing")
                else:
                    visit(rows, rid[i], pivot[i], own, held)
        yield rows


def _in(own: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(own), bool)
    at = np.searchsorted(held, own)
    at[at == len(held)] = 0
    return held[at] == own


def _compare(width: int):
    """Shared and united counts of each member with its pivot."""

    def visit(rows, x, pivot, own, held):
        both = int(_in(own, held).sum())
        rows.append((x, pivot, both, len(held) + len(own) - both))

    def compared(batches):
        for rows in _streamed(batches, width, visit):
            cols = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["_x", "_pivot", "_both", "_all"])

    return compared


def _listed(width: int):
    """All shingles of each text."""

    def listed(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            x = batch.column("_rid").to_numpy()
            for a, b in slices(np.diff(offsets), 1 << 22):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                keys = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(x[a:b], [len(s) for s in sets]))], ["_shingle", "_x"])

    return listed


def _lanes(pairs: DataFrame) -> DataFrame:
    """The pairs dealt by _salt: a lane of a pivot has about LANE_PAIRS of its pairs, or their square root where that is more.

    So a pivot's text is written once for each lane, no more than the square root of its pairs, and no lane has more pairs.
    """
    fame = R.materialize(pairs.groupBy("_pivot").agg(F.count("*").alias("_n")), "near-fame")
    lanes = F.expr(f"cast(1 + _n / greatest({LANE_PAIRS}, sqrt(_n)) as int)")
    counted = R.attach(pairs, fame, ["_pivot"], "_n", pairs.count(), "_x")
    dealt = R.materialize(counted.select("_x", "_pivot", F.pmod(F.hash("_x"), lanes).alias("_salt")), "near-lanes")
    R.drop_tables(fame)
    return dealt


def _verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Exact overlap of each written pair (_x, _pivot), in lanes of the pivot with its own text once in each."""
    dealt = _lanes(pairs)
    members = dealt.select(F.col("_x").alias("_rid"), "_pivot", "_salt", F.lit(1).alias("_role"))
    pivots = dealt.select(F.col("_pivot").alias("_rid"), "_pivot", "_salt", F.lit(0).alias("_role")).distinct()
    rows = members.unionByName(pivots).join(texts, "_rid").repartition("_pivot", "_salt").sortWithinPartitions("_pivot", "_salt", "_role", "_rid")
    done = R.materialize(rows.mapInArrow(_compare(width), "_x long, _pivot long, _both long, _all long"), "near-verified")
    R.drop_tables(dealt)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (a, b): the smallest node of its connected component.

    Each round points every node at its smallest neighbour, follows the pointers to their roots and contracts;
    a round at least halves the nodes that still have edges.
    """
    edges = R.materialize(edges.select("a", "b").where("a <> b"), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = R.materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "cc-up")
        moved = True
        while moved:
            over = up.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
            jumped = R.materialize(up.drop("_moved").join(over, "comp").selectExpr("node", "_next as comp", "_next <> comp as _moved"), "cc-jump")
            R.drop_tables(up)
            up, moved = jumped, not jumped.where("_moved").isEmpty()
        x, y = up.selectExpr("node as a", "comp as _a"), up.selectExpr("node as b", "comp as _b")
        left = R.materialize(edges.join(x, "a").join(y, "b").where("_a <> _b").selectExpr("_a as a", "_b as b").distinct(), "cc-edges")
        if labels is None:
            before, labels = (edges,), up
        else:
            before = (edges, labels, up)
            roots = up.selectExpr("node as comp", "comp as _root")
            labels = R.materialize(labels.join(roots, "comp", "left").selectExpr("node", "coalesce(_root, comp) as comp"), "cc-labels")
        R.drop_tables(*before)
        edges = left
    return labels if labels is not None else edges.selectExpr("a as node", "b as comp")


def _open(rows: DataFrame, total: int) -> DataFrame:
    """The rows (_key, _x, _n, _copies, _comp, _rank, _tried) of buckets with several components, with the bucket's _size and its pivot."""
    first = F.max(F.struct("_rank", "_copies", (-F.col("_x")).alias("least"), "_n", "_comp")).alias("_p")
    buckets = rows.groupBy("_key").agg(F.count("*").alias("_size"), F.min("_comp").alias("_low"), F.max("_comp").alias("_high"), first).where("_low <> _high")
    buckets = R.materialize(buckets.select("_key", "_size", (-F.col("_p.least")).alias("_pivot"), F.col("_p._n").alias("_n_pivot"), F.col("_p._comp").alias("_comp_pivot")), "near-buckets")
    held = R.materialize(R.members_of(rows.drop("_rank"), buckets, ["_key"], "_size", total), "near-open")
    R.drop_tables(buckets)
    return held


def _relabelled(rows: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with the components of the links so far; the rank of a document is the number of its links."""
    fame = links.selectExpr("explode(array(_x, _pivot)) as _x").groupBy("_x").agg(F.count("*").alias("_rank"))
    known = labels.selectExpr("node as _x", "comp as _label").join(fame, "_x", "left")
    named = rows.select("_key", "_x", "_n", "_copies", F.col("_pivot").alias("_tried")).join(known, "_x", "left")
    return named.withColumn("_comp", F.coalesce("_label", "_x")).withColumn("_rank", F.coalesce("_rank", F.lit(0))).drop("_label")


def _with_pivots(opened: DataFrame, percent: int) -> DataFrame:
    """Each open member and its bucket's pivot, if they are of two components and their sizes allow a link."""
    near = f"_comp <> _comp_pivot and _pivot <> _tried and 100 * least(_n, _n_pivot) >= {percent} * greatest(_n, _n_pivot)"
    return opened.where(near).select("_x", "_pivot").distinct()


def _bounded(opened: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """_x, _n, _bits and _reach of the open documents that can still link: the greatest size of a partner by the shingles that others have."""
    ids = R.materialize(opened.select("_x").distinct(), "near-ids")
    shingles = R.rows_of(texts.withColumn("_x", F.col("_rid")), ids, "_x").mapInArrow(_listed(width), "_shingle long, _x long")
    alone = shingles.groupBy("_shingle").agg(F.count("*").alias("_df"), F.min("_x").alias("_x")).where("_df = 1").groupBy("_x").agg(F.count("*").alias("_alone"))
    shared = R.rows_of(reps, ids, "_x").select("_x", "_n", "_bits").join(alone, "_x", "left").withColumn("_shared", F.col("_n") - F.coalesce("_alone", F.lit(0)))
    reach = shared.where(f"100 * _shared >= {percent} * _n").withColumn("_reach", F.expr(f"({100 + percent} * _shared) div {percent} - _n"))
    out = R.materialize(reach.select("_x", "_n", "_bits", "_reach"), "near-bounds")
    R.drop_tables(ids)
    return out


def _by_size(opened: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """Pairs (_x, _pivot) of a bucket and different components that the bounds allow; _x is the larger."""
    cell = lambda c: F.floor(F.ln(c) * 10)
    lanes = F.expr(f"cast(1 + _size div {LANE} as int)")
    rows = opened.select("_key", "_x", "_comp", "_size").join(bounds, "_x")
    least, most = F.expr(f"({percent} * _n + 99) div 100"), F.least("_n", "_reach")
    large = rows.where(most >= least).withColumn("_cell", F.explode(F.sequence(cell(least), cell(most)))).withColumn("_lane", F.pmod(F.hash("_x"), lanes))
    small = rows.withColumn("_lane", F.explode(F.sequence(F.lit(0), lanes - 1))).select("_key", cell(F.col("_n")).alias("_cell"), "_lane", *[F.col(c).alias(f"{c}_y") for c in ("_x", "_comp", "_n", "_reach", "_bits")])
    differ = F.expr(" + ".join(f"bit_count(_bits[{i}] ^ _bits_y[{i}])" for i in range(BITS)))
    fit = F.expr(f"_comp <> _comp_y and (_n_y < _n or _n_y = _n and _x_y < _x) and _n_y <= _reach and _n <= _reach_y and 100 * _n_y >= {percent} * _n")
    alike = differ * (100 + percent) <= (F.col("_n") + F.col("_n_y")) * (100 - percent)
    return large.join(small, ["_key", "_cell", "_lane"]).where(fit & alike).select("_x", F.col("_x_y").alias("_pivot")).distinct()


def _components(reps: DataFrame, staged: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Components (node, comp) of the class representatives under all links between bucket mates."""
    every = reps.select("_x", "_n", "_copies", F.explode("_bands").alias("_key")).withColumn("_comp", F.col("_x")).withColumn("_rank", F.lit(0).cast("long")).withColumn("_tried", F.lit(-1).cast("long"))
    total = reps.agg(F.sum(F.size("_bands"))).first()[0] or 0
    opened = _open(every, total)
    ids = R.materialize(opened.select(F.col("_x").alias("_rid")).distinct(), "near-ids")
    texts = R.materialize(R.rows_of(staged.select("_rid", "_text"), ids, "_rid"), "near-candidates")
    R.drop_tables(ids)
    linked = f"_both * 100 >= _all * {percent}"
    tables, links, labels = [], None, None

    def found(pairs: DataFrame) -> bool:
        """Verify the pairs; whether they bring links, which then change the components."""
        nonlocal links, labels
        pairs = R.materialize(pairs, "near-pairs")
        got = _verify(pairs, texts, width)
        tables.append(got)
        R.drop_tables(pairs)
        new = got.where(linked).select("_x", "_pivot")
        if new.isEmpty():
            return False
        links = new if links is None else links.unionByName(new)
        if labels is not None:
            R.drop_tables(labels)
        labels = components(links.selectExpr("_x as a", "_pivot as b"))
        return True

    total = opened.count()
    for _ in range(2):
        if not total or not found(_with_pivots(opened, percent)):
            break
        before, opened = opened, _open(_relabelled(opened, links, labels), total)
        R.drop_tables(before)
        total = opened.count()
    if total:
        bounds = _bounded(opened, reps, texts, width, percent)
        found(_by_size(opened, bounds, percent))
        R.drop_tables(bounds)
    R.drop_tables(opened, texts, *tables)
    return labels


def _decide(staged: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    signed = staged.select("_rid", "_text").mapInArrow(_sign(width, bands, rows), "_rid long, _n long, _d1 long, _d2 long, _bands array<long>, _bits array<long>")
    sigs = R.materialize(signed, "near-signatures")
    total = sigs.count()
    key = ["_n", "_d1", "_d2"]
    classes = R.materialize(sigs.where("_n > 0").groupBy(*key).agg(F.count("*").alias("_size"), F.min("_rid").alias("_x")), "near-classes")
    members = R.attach(sigs.select("_rid", *key), classes, key, "_size", total, "_rid").select("_rid", "_n", F.coalesce("_x", "_rid").alias("_x"))
    members = R.materialize(members, "near-members")
    reps = classes.select(F.col("_x").alias("_rid"), F.col("_size").alias("_copies")).join(sigs.select("_rid", "_n", "_bands", "_bits"), "_rid")
    reps = R.materialize(reps.withColumnRenamed("_rid", "_x"), "near-reps")
    R.drop_tables(sigs, classes)
    labels = _components(reps, staged, width, percent)
    R.drop_tables(reps)
    if labels is None:
        named = members.select("_rid", "_n", F.col("_x").alias("_comp"))
    else:
        named = members.join(labels.selectExpr("node as _x", "comp"), "_x", "left").select("_rid", "_n", F.coalesce("comp", "_x").alias("_comp"))
    named = R.materialize(named.join(staged.select("_rid", "_id"), "_rid"), "near-named")
    R.drop_tables(members, *([] if labels is None else [labels]))
    best = F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_rid").alias("r"))).alias("_best")
    sizes = R.materialize(named.groupBy("_comp").agg(F.count("*").alias("_size"), best), "near-components")
    return R.attach(named, sizes, ["_comp"], "_size", total, "_rid").withColumn("_kept", F.expr("_best.r = _rid"))


def _stage(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(text_col).isNull().alias("_null"), *([F.struct(*rest).alias("_rest")] if rest else []))
    return R.materialize(base.withColumn("_rid", F.monotonically_increasing_id()), "near-text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.  percent: the least 100 * shared / united of a link."""
    staged = _stage(docs, id_col, text_col, [])
    out = _decide(staged, width, percent, bands, rows)
    R.drop_tables(staged)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_best.i").alias("component_id"), F.col("_kept").alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """One document of each component, all columns as they were."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    staged = _stage(docs, id_col, text_col, rest)
    kept = _decide(staged, width, percent, bands, rows).where("_kept").select("_rid")
    own = {id_col: F.col("_id"), text_col: F.when(~F.col("_null"), F.col("_text"))}
    return staged.join(kept, "_rid", "left_semi").select(*[own.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])
