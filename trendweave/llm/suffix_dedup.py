"""Removal of repeated byte strings by sorting names of prefixes of growing length.

Every position of every text is the start of a suffix; a byte goes if it lies in a ``threshold``-byte string
(a window) that also starts in a document with a smaller id.  Three rounds name ever longer strings, Spark sorts
the names, and what is unique or settled drops out before the next:

1. grams of about half the threshold.  Each window has as its minimizer the least name among the grams inside
   it; equal windows have equal minimizers, so only minimizers, about one for thirteen bytes, are sorted, and
   windows whose minimizer occurs in one document alone drop out.
2. runs: neighbouring windows with one minimizer, as one string.  If a smaller document has the whole run, all
   its windows go at once.  (The least document with a window never has its run settled so, as a smaller one
   would then have the window; so the next round still finds each window's least document.)
3. the windows of the runs that are left.

This is not prefix doubling with ranks: Spark sorts no pairs of ranks.  A name is an 80-bit hash of its string,
from two running sums, which keeps names of any length computable from the text alone; nothing but one or two
bits per name comes back.  Bytes go on equality of names and are not compared (false match of two of n windows
of the last round: about n**2 / 2**81).

Documents are dealt in ascending id order into chunks of about ``chunk_bytes``.  A chunk names a string once,
however often it repeats there: a frequent passage costs a name per chunk and never a group of its own.  Names
go as sorted blocks to ``buckets`` ranges of the name space, where Spark brings all chunks' blocks together.
Rows of one id may fall into several chunks: a name carries whether a smaller id than the chunk's last has it.

Defined results: a null or empty text has no bytes; rows with a repeated id are one another's equals, neither
is smaller; rows without an id come last, in the same way; texts shorter than the threshold stay whole; an
empty table gives an empty result; other columns are ignored.  Ids must be integral.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R
from .textops import STEP, mix64

NO_ID = np.iinfo(np.int64).max
_rng = np.random.Generator(np.random.PCG64(50))
CODES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
MORE_CODES = _rng.integers(0, 2**32, 256, dtype=np.uint32)
BASE, MORE_BASE = 0x9E3779B97F4A7C15, 0x85EBCA6B
CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("text", pa.binary())])
REQUEST = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("names", pa.binary()), ("more", pa.binary()), ("flags", pa.binary())])
REPLY = pa.schema([("chunk", pa.int64()), ("round", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("below", pa.binary())])
REQUEST_DDL = "bucket int, chunk long, first_id long, last_id long, names binary, more binary, flags binary"
REPLY_DDL = "chunk long, round int, bucket int, bits binary, below binary"
GRAMS, RUNS, WINDOWS = range(3)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, ...]:
    """Powers of both bases and of their inverses; kept, and made longer when asked for."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 21)
        for key, base, kind in (("up", BASE, np.uint64), ("down", pow(BASE, -1, 1 << 64), np.uint64), ("more_up", MORE_BASE, np.uint32), ("more_down", pow(MORE_BASE, -1, 1 << 32), np.uint32)):
            steps = np.full(size, kind(base))
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
    return tuple(_tables[k][:n] for k in ("up", "down", "more_up", "more_down"))


def packed_names(names: np.ndarray) -> bytes:
    """Ascending names without loss: the first one, then the steps in as many byte planes as the largest step needs."""
    steps = np.diff(names)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + names[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked_names(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    planes = raw[9:].reshape(raw[0], -1)
    steps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    steps[0], steps[1:, : raw[0]] = raw[1:9], planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


class Names:
    """Names of the strings of any length at every position of a chunk, from running sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down, more_up, self.more_down = _powers(max(1, len(raw)))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(CODES[raw] * up[: len(raw)], out=self.sums[1:])
        self.more_sums = np.zeros(len(raw) + 1, np.uint32)
        np.cumsum(MORE_CODES[raw] * more_up[: len(raw)], out=self.more_sums[1:])

    def at(self, positions: np.ndarray, lengths) -> tuple[np.ndarray, np.ndarray]:
        """64 bits, and 16 more, of the strings at positions."""
        names = mix64((self.sums[positions + lengths] - self.sums[positions]) * self.down[positions] + np.uint64(STEP) * np.asarray(lengths, np.uint64))
        more = (self.more_sums[positions + lengths] - self.more_sums[positions]) * self.more_down[positions]
        return names, (more * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.uint16)

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Named:
    """Distinct names in order, the index of each string among them, and the least and greatest place of each."""

    def __init__(self, values: np.ndarray, more: np.ndarray, places: np.ndarray):
        order = np.lexsort((more, values))
        values, more = values[order], more[order]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (more[1:] != more[:-1])]) if len(order) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.inverse = np.empty(len(values), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.values, self.more, self.places = values[heads], more[heads], places
        self.low = np.minimum.reduceat(places[order], heads) if len(heads) else places[:0]
        self.high = np.maximum.reduceat(places[order], heads) if len(heads) else places[:0]

    def earlier(self, bits: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Per string, whether a smaller document has it.

        bits: an earlier chunk has the name; below: with a smaller id than the first one here.
        """
        there = np.where(self.places == 0, below[self.inverse], bits[self.inverse])
        return there | (self.places > self.low[self.inverse])


class Chunk:
    """The windows of one chunk that are still alive, round by round."""

    def __init__(self, row: dict, threshold: int):
        self.ids = np.array(row["ids"], np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.raw = np.frombuffer(row["text"], np.uint8)
        self.threshold = threshold
        self.names = Names(self.raw)
        self.ends = np.cumsum(self.lengths)
        self.edge = np.zeros(len(self.raw) + 1, np.int32)
        _, place = np.unique(self.ids, return_inverse=True)
        left = np.repeat(self.ends, self.lengths) - np.arange(len(self.raw))
        starts = np.flatnonzero(left >= threshold)
        places = np.repeat(place.astype(np.int32), self.lengths)[starts]
        gram = min(32, -(-threshold // 2))
        least = sliding_least(self.names.all(gram), threshold - gram + 1)[starts]
        change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(least) else np.zeros(0, np.int64)
        self.starts, self.counts = starts[change], np.diff(np.append(change, len(starts)))
        names = mix64(least[change] ^ STEP)  # least names are small ones: mixed anew, they spread over all buckets
        self.named = Named(names, np.zeros(len(change), np.uint16), places[change])

    def answer(self, round_: int, bits: np.ndarray, below: np.ndarray) -> None:
        """Take in the answers of a round, and name what is left for the next."""
        if round_ == GRAMS:
            alive = bits[self.named.inverse]
            self.starts, self.counts, places = self.starts[alive], self.counts[alive], self.named.places[alive]
            self.named = Named(*self.names.at(self.starts, self.counts - 1 + self.threshold), places)
            return
        go = self.named.earlier(bits, below)
        np.add.at(self.edge, self.starts[go], 1)
        np.add.at(self.edge, self.starts[go] + self.counts[go] - 1 + self.threshold, -1)
        if round_ == RUNS:
            stay, n = ~go, self.counts[~go]
            first = np.repeat(self.starts[stay] - np.cumsum(n) + n, n)
            self.starts = first + np.arange(len(first))
            self.counts = np.ones(len(first), np.int64)
            self.named = Named(*self.names.at(self.starts, self.threshold), np.repeat(self.named.places[stay], n))

    def requests(self, chunk: int, round_: int, bits: int):
        """Blocks of names by bucket; flags: several documents here have it, or after the first round, one below the last id."""
        named = self.named
        cuts = np.searchsorted((named.values >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        flags = named.low != named.high if round_ == GRAMS else self.ids[self._by_place()[named.low]] < self.ids[-1]
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            part = slice(cuts[b], cuts[b + 1])
            more = b"" if round_ == GRAMS else named.more[part].astype("<u2").tobytes()
            yield int(b), chunk, int(self.ids[0]), int(self.ids[-1]), packed_names(named.values[part]), more, np.packbits(flags[part]).tobytes()

    def _by_place(self) -> np.ndarray:
        """A row of each distinct id, ascending."""
        return np.unique(self.ids, return_index=True)[1]

    def removed(self) -> np.ndarray:
        """The mask of bytes in a window that also starts in a smaller document."""
        return np.cumsum(self.edge[:-1]) > 0


def _chunked(chunk_bytes: int):
    """Whole documents in order, gathered to about chunk_bytes."""

    def gather(batches):
        ids, texts, held, number = [], [], 0, 0

        def row():
            nonlocal ids, texts, held, number
            chunk = (TaskContext.get().partitionId() << 32) + number
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((chunk, ids, [len(t) for t in texts], b"".join(texts)), CHUNK.types, strict=True)], schema=CHUNK)
            ids, texts, held, number = [], [], 0, number + 1
            return out

        for batch in batches:
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
                i = NO_ID if i is None else i
                if held >= chunk_bytes:
                    yield row()
                ids.append(i)
                texts.append(text.as_buffer().to_pybytes())
                held += len(texts[-1]) + 64
        if ids:
            yield row()

    return gather


def _requests(rows, schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _first_requests(threshold: int, bits: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _requests(list(Chunk(row, threshold).requests(row["chunk"], GRAMS, bits)), REQUEST)

    return ask


def _flags(column, sizes) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n).astype(bool) for x, n in zip(column, sizes, strict=True)])


def _replies(round_: int):
    """One bucket: all chunks' names sorted; a bit per name, set in the first round if another document has it, later if
    an earlier chunk has it; and whether one has it with a smaller id than this chunk's first."""

    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        blocks = [unpacked_names(b.as_buffer()) for b in table.column("names")]
        sizes = np.array([len(b) for b in blocks])
        names, flags = np.concatenate(blocks), _flags(table.column("flags"), sizes)
        if round_ == GRAMS:
            order = np.argsort(names, kind="stable")
            new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        else:
            more = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in table.column("more")])
            order = np.lexsort((more, names))
            new = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (more[order][1:] != more[order][:-1])])
        heads, group, flags = np.flatnonzero(new), np.cumsum(new) - 1, flags[order]
        if round_ == GRAMS:
            hit = ((np.diff(np.append(heads, len(order))) > 1) | np.logical_or.reduceat(flags, heads))[group]
            under = np.zeros(0, bool)
        else:
            hit = ~new
            first, last = (np.repeat(np.asarray(table.column(c)), sizes)[order] for c in ("first_id", "last_id"))
            before = np.cumsum(flags) - flags  # flags of the names before, in all and in this group
            under = hit & ((last[heads][group] < first) | (before > before[heads][group]))
        packed = []
        for found in (hit, under):
            bits = np.zeros(len(order), bool)
            if len(found):
                bits[order] = found
            packed.append([np.packbits(b).tobytes() if len(found) else b"" for b in np.split(bits, np.cumsum(sizes)[:-1])])
        n, bucket = len(sizes), table.column("bucket")[0].as_py()
        return pa.table([table.column("chunk"), pa.array([round_] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), *[pa.array(p, pa.binary()) for p in packed]], schema=REPLY)

    return reply


def _replay(chunk: Chunk, replies: pa.Table, rounds: int, bits: int) -> None:
    """Bring a chunk to the state after the first ``rounds`` answers."""
    rows = sorted(zip(*(replies.column(c).to_pylist() for c in ("round", "bucket", "bits", "below")), strict=True))
    for r in range(rounds):
        sizes = np.bincount((chunk.named.values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        own = [(x, y, sizes[b]) for k, b, x, y in rows if k == r]
        hit, under = (np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(x[i], np.uint8), count=x[2]).astype(bool) for x in own if x[i]]]) for i in (0, 1))
        chunk.answer(r, hit, under)


def _next_requests(threshold: int, done: int, bits: int):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            chunk = Chunk(row, threshold)
            _replay(chunk, right, done, bits)
            rows += chunk.requests(row["chunk"], done, bits)
        return pa.Table.from_batches([_requests(rows, REQUEST)])

    return ask


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(SPAN)), ("kept", pa.binary())])


def _results(threshold: int, bits: int):
    def results(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n_bytes, spans, kept = [], [], [], []
        for row in left.to_pylist():
            chunk = Chunk(row, threshold)
            _replay(chunk, right, WINDOWS + 1, bits)
            gone = chunk.removed()
            for i, a, b in zip(chunk.ids.tolist(), chunk.ends - chunk.lengths, chunk.ends, strict=True):
                own = gone[a:b]
                step = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                ids.append(None if i == NO_ID else i)
                n_bytes.append(int(b - a))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
                kept.append(chunk.raw[a:b][~own].tobytes())
        return pa.table([pa.array(c, t) for c, t in zip((ids, n_bytes, spans, kept), RESULT.types, strict=True)], schema=RESULT)

    return results


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 50, chunk_bytes: int = 1 << 20, bucket_bytes: int = 1 << 23) -> DataFrame:
    """One row per document: id, n_bytes, spans (removed runs of bytes, start and end), kept (the other bytes).

    Between rounds only the texts and the bits of the names are joined, by chunk; buckets grow in number with the
    input (one for ``bucket_bytes`` of text, at least 128), so no task's share does.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    order = [F.col("_id").asc_nulls_last(), F.col("_tie")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    chunks = R.materialize(ordered.mapInArrow(_chunked(chunk_bytes), "chunk long, ids array<long>, lengths array<long>, text binary"), "suffix-chunks", block_bytes=1 << 24)
    total = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(7, (int(total) // bucket_bytes).bit_length())
    replies = None
    with R.setting(spark, R.BATCH_ROWS, "4"):
        for r in (GRAMS, RUNS, WINDOWS):
            if r == GRAMS:
                asked = chunks.mapInArrow(_first_requests(threshold, bits), REQUEST_DDL)
            else:
                asked = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_next_requests(threshold, r, bits), REQUEST_DDL)
            got = R.materialize(asked.groupBy("bucket").applyInArrow(_replies(r), REPLY_DDL), "suffix-replies")
            replies = got if replies is None else replies.unionByName(got)
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    done = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_results(threshold, bits), schema)
    return done.withColumnRenamed("_id", id_col)


def digest(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of bytes and removed runs, and the hash of what is kept."""
    gone = F.col("n_bytes") - F.octet_length("kept")
    return done.select(id_col, "n_bytes", gone.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
