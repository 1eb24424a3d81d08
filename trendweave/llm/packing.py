"""Best-fit packing by patterns fitted with non-negative least squares.

Documents are tokenized and cut to pieces of at most ``capacity`` ids (the first piece of a long document may
be shorter).  Only the histogram of piece lengths comes to the driver: at most ``capacity`` numbers.  Patterns
of up to three lengths that fill a sequence are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded down; what remains is packed by best fit decreasing, on the histogram
too.  The plan says, for each length, which runs of pieces go to which sequences and offsets.  Each piece then
finds its rank among those of its length by two-level counting in Spark, and its place by that rank.  Pieces of
full length are sequences of their own (with negative ids) and need neither plan nor shuffle.

Defined results: a null or empty text is one piece holding the end id; rows with a repeated id are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R
from .tokens import encode, pieces, vocabulary

END_ID = 2
Plan = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def patterns_of(counts: np.ndarray, per_length: int = 8, slack: int = 4) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths, longest first, that leave at most ``slack`` of the capacity; the most frequent of each longest length."""
    capacity = len(counts) - 1
    present = np.flatnonzero(counts)
    below = np.zeros(capacity + 1, np.int64)  # the greatest present length up to each
    below[present] = present
    below = np.maximum.accumulate(below)
    out = []
    for a in present[present * 3 >= capacity - slack][::-1]:
        room = capacity - a
        options = [((int(a),), 0)] if room <= slack else []
        b = present[(present <= min(a, room)) & (present * 2 >= room - slack)]
        c = below[room - b]
        for x, y in zip(b.tolist(), c.tolist(), strict=True):
            if room - x <= slack:
                options.append(((int(a), x), int(counts[x])))
            elif y and room - x - y <= slack:
                options.append(((int(a), x, y), int(min(counts[x], counts[y]))))
        options.sort(key=lambda o: (sum(o[0]) - capacity, o[1]), reverse=True)
        out += [o[0] for o in options[:per_length]]
    return out


def fit(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by accelerated projected gradient steps."""
    if not patterns:
        return np.zeros(0)
    lengths = np.concatenate([np.array(p) for p in patterns])
    owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    load = np.bincount(lengths, minlength=len(counts))
    target = counts * (load > 0)
    step = 1.0 / (3.0 * max(1, load.max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        over = np.bincount(lengths, y[owner], minlength=len(counts)) - target
        new = np.maximum(0.0, y - step * np.bincount(owner, over[lengths], minlength=len(patterns)))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: (lengths in a sequence, how many such sequences)."""
    capacity = len(counts) - 1
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free room: [lengths, sequences]
    for a in range(capacity, 0, -1):
        left = int(counts[a])
        free = a
        while left:
            while free <= capacity and not open_[free]:
                free += 1
            if free > capacity:
                each = capacity // a
                n, rest = divmod(left, each)
                for k, m in ((each, n), (rest, 1)):
                    if k and m:
                        open_[capacity - k * a].append([(a,) * k, m])
                break
            held = open_[free][-1]
            fits = min(free // a, left)
            n = min(held[1], left // fits)
            held[1] -= n
            if not held[1]:
                open_[free].pop()
            open_[free - fits * a].append([held[0] + (a,) * fits, n])
            left -= n * fits
            free = a
    return [(tuple(x), n) for group in open_ for x, n in group]


def plan(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], Plan]:
    """Sequences by pattern, and for each length the first rank, first sequence and offset of every run of pieces."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    patterns = patterns_of(left)
    fitted = fit(patterns, left.astype(float))
    chosen = []
    for k in np.argsort(-fitted, kind="stable"):
        need = np.unique(np.array(patterns[k]), return_counts=True)
        n = int(min(np.floor(fitted[k] + 1e-6), (left[need[0]] // need[1]).min()))
        if n > 0:
            left[need[0]] -= n * need[1]
            chosen.append((patterns[k], n))
    chosen += best_fit(left)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(len(counts), np.int64)
    sequence = 0
    for lengths, n in chosen:
        offset = 0
        for a in lengths:
            runs.setdefault(a, []).append((int(used[a]), sequence, offset))
            used[a] += n
            offset += a
        sequence += n
    return chosen, {a: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for a, r in runs.items()}


def _cut(vocab: str, end_id: int, capacity: int):
    def cut(batches):
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                dtype = "<u2" if pieces(vocab).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
                own, number, start, length, ids = [], [], [], [], []
                for i, data in enumerate(encode(vocab, part.column("_text").to_pylist(), end_id)):
                    flat = np.frombuffer(data, "<u4")
                    at, n = 0, len(flat)
                    take = n % capacity or capacity
                    while at < n:
                        own.append(i)
                        number.append(-(-at // capacity))
                        start.append(at)
                        length.append(take)
                        ids.append(flat[at : at + take].astype(dtype).tobytes())
                        at, take = at + take, capacity
                rows = part.select([c for c in part.schema.names if c != "_text"]).take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], [*rows.schema.names, "piece", "start", "length", "ids"])

    return cut


def _place(runs: Plan):
    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = np.asarray(length, np.int64), np.asarray(rank, np.int64)
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for a in np.unique(lengths):
            rows = np.flatnonzero(lengths == a)
            first, base, at = runs[int(a)]
            k = np.searchsorted(first, ranks[rows], side="right") - 1
            sequence[rows], offset[rows] = base[k] + ranks[rows] - first[k], at[k]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, vocab_name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = 1024) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, 16 bits each where the vocabulary allows, else 32), sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_rid", F.monotonically_increasing_id())
    id_type = docs.schema[id_col].dataType.simpleString()
    cut = texts.mapInArrow(_cut(vocabulary(vocab_name), end_id, capacity), f"_id {id_type}, _rid long, piece int, start long, length long, ids binary")
    pieces_ = R.materialize(cut.withColumn("_pid", F.monotonically_increasing_id()), "pack-pieces")
    counted = pieces_.groupBy("length").count().collect()  # at most one row per length
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["count"]
    counts[capacity] = 0  # a full piece is a sequence of its own
    _, runs = plan(counts)
    sizes = spark.createDataFrame([(int(a), int(-(-counts[a] // 128))) for a in np.flatnonzero(counts)], "length long, _buckets int")
    bucketed = pieces_.select("_rid", "piece", "length").join(F.broadcast(sizes), "length").withColumn("_bucket", F.pmod(F.hash("_rid", "piece"), F.col("_buckets"))).drop("_buckets")
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = R.materialize(bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "pack-buckets").withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_bucket").orderBy("_rid", "piece")
    ranked = bucketed.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1)
    placed = ranked.select("_rid", "piece", _place(runs)("length", "_rank").alias("_at"))
    shared = pieces_.where(F.col("length") < capacity).join(placed, ["_rid", "piece"])
    full = pieces_.where(F.col("length") == capacity).withColumn("_at", F.struct((-F.col("_pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return shared.unionByName(full).select(F.col("_id").alias(id_col), "piece", "start", "length", "ids", "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, and ids and lengths of their pieces by offset; a group is at most one sequence."""
    part = F.struct("offset", "length", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("_p")).select("sequence_id", F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("_p", lambda x: x["length"]).alias("lengths"))


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array, length: pa.Array) -> pa.Array:
    """crc32 of packed ids as little-endian unsigned 32-bit integers."""
    out = []
    for data, n in zip(ids.to_pylist(), length.to_pylist(), strict=True):
        out.append(zlib.crc32(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4").tobytes()))
    return pa.array(out, pa.int64())
