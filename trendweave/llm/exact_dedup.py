"""Exact dedup by composable polynomial fingerprints and chunkwise streaming comparison.

A text's fingerprint is the polynomial sum(b[i] * B**i) of its normalised bytes, for two bases modulo a
Mersenne prime.  Chunks are hashed on their own and combine by length-shifted arithmetic:
``H(xy) = H(x) + B**len(x) * H(y)``, so a huge document is hashed by many tasks at once.  Equal
fingerprints only nominate: nominated documents are then compared in blocks of about ``salt_rows``, each with the first of
its block, chunk by chunk, in a stream sorted by Spark; the first ones of all blocks of a group are compared in the same
way, and so on until one is left.  So no text is written more than once for each round, whatever the size of its group,
and what differs is grouped anew.

Defined results: a null text counts as empty and all empty texts are copies of each other; of equal
texts the row with most code points stays, then the smallest id (null ids last), then any one of fully
repeated rows, so exactly one row of a group is kept.  An empty table gives an empty result.  Columns
besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R
from .textops import IS_SPACE, buffers, slices

PRIME = (1 << 31) - 1
BASES = (0x3B9ACA07, 0x5F356495)
BLOCK = 1024
BLANKS = "\t\n\x0b\x0c\r "
FINGERPRINT = "struct<f1:bigint,f2:bigint,n:bigint>"


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.int64)
    filled = 1
    while filled < n:  # doubles the known powers
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * pow(base, filled, prime) % prime
        filled += take
    return out


def combine(parts: list[tuple[int, int, int]], prime: int = PRIME) -> tuple[int, int, int]:
    """Fingerprint of the concatenation of parts, each given as (f1, f2, length)."""
    f1 = f2 = n = 0
    for a, b, m in parts:
        f1 = (f1 + pow(BASES[0], n, prime) * a) % prime
        f2 = (f2 + pow(BASES[1], n, prime) * b) % prime
        n += m
    return f1, f2, n


def squeeze(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without ASCII white space, and their offsets."""
    keep = ~IS_SPACE[raw]
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def fingerprints(raw: np.ndarray, offsets: np.ndarray, prime: int = PRIME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """f1, f2 and length of each document: block hashes, shifted by the length before them and summed."""
    n = np.diff(offsets)
    blocks = -(-n // BLOCK)
    f = np.zeros((2, len(n)), np.int64)
    if len(raw):
        own = np.repeat(np.arange(len(n)), blocks)
        k = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = offsets[own] + k * BLOCK
        lengths = np.minimum(BLOCK, offsets[own + 1] - starts)
        within = np.arange(len(raw)) - np.repeat(starts, lengths)
        first = np.flatnonzero(blocks)
        heads = (np.cumsum(blocks) - blocks)[first]
        for row, base in enumerate(BASES):
            h = np.add.reduceat(raw * _powers(base, BLOCK, prime)[within], starts) % prime
            shift = _powers(pow(base, BLOCK, prime), int(blocks.max()), prime)
            f[row, first] = np.add.reduceat(h * shift[k] % prime, heads) % prime
    return f[0], f[1], n


def _struct(f1, f2, n) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (f1, f2, n)], ["f1", "f2", "n"])


def fingerprint_udf(prime: int = PRIME):
    """Arrow UDF: fingerprint of a text without its white space."""

    @F.arrow_udf(FINGERPRINT)
    def fingerprint(text: pa.Array) -> pa.Array:
        raw, offsets = buffers(text)
        out = [np.zeros(0, np.int64)] * 3
        for a, b in slices(np.diff(offsets), 1 << 21):
            got = fingerprints(*squeeze(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), prime)
            out = [np.concatenate(x) for x in zip(out, got, strict=True)]
        return _struct(*out)

    return fingerprint


def _combine_udf(prime: int):
    @F.arrow_udf(FINGERPRINT)
    def combined(parts: pa.Array) -> pa.Array:
        got = [combine([(p["f1"], p["f2"], p["n"]) for p in x], prime) for x in parts.to_pylist()]
        return _struct(*zip(*got, strict=True)) if got else _struct([], [], [])

    return combined


def _facts(staged: DataFrame, part_chars: int, prime: int) -> DataFrame:
    """A fingerprint per row; documents longer than part_chars are hashed in parts by many tasks."""
    fp = fingerprint_udf(prime)
    keep = ["_rid", "_id", "_points", "_sha"]
    short = staged.where(F.col("_points") <= part_chars).select(*keep, fp("_text").alias("_fp"))
    huge = staged.where(F.col("_points") > part_chars)
    parts = huge.select("_rid", "_text").mapInArrow(_parts(part_chars), "_rid long, _part int, _bytes binary").repartition("_rid", "_part").select("_rid", "_part", fp("_bytes").alias("_fp"))
    whole = parts.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("_part", "_fp.f1", "_fp.f2", "_fp.n"))).alias("_parts")).select("_rid", _combine_udf(prime)("_parts").alias("_fp"))
    return short.unionByName(huge.select(*keep).join(whole, "_rid").select(*keep, "_fp")).select(*keep, "_fp.f1", "_fp.f2", "_fp.n")


def _batches(rows, schema: pa.Schema, most: int = 1 << 23):
    """Record batches of rows whose last field is bytes, of about ``most`` of them each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _parts(size: int):
    """Rows (rid, part, bytes): texts cut every ``size`` bytes; white space is single bytes, so any cut will do."""
    schema = pa.schema([("_rid", pa.int64()), ("_part", pa.int32()), ("_bytes", pa.binary())])

    def cut(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            rids = batch.column("_rid").to_pylist()
            yield from _batches(((rid, k // size, raw[offsets[i] + k : min(offsets[i] + k + size, offsets[i + 1])].tobytes()) for i, rid in enumerate(rids) for k in range(0, int(offsets[i + 1] - offsets[i]), size)), schema)

    return cut


def _chunks(chunk: int):
    """Rows (ref, part, role, rid, bytes): the normalised text in pieces."""
    schema = pa.schema([("_ref", pa.int64()), ("_part", pa.int32()), ("_role", pa.int32()), ("_rid", pa.int64()), ("_bytes", pa.binary())])

    def rows(batch):
        raw, offsets = buffers(batch.column("_text"))
        for i, (ref, rid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_ref", "_rid")), strict=True)):
            own = raw[offsets[i] : offsets[i + 1]]
            data = own[~IS_SPACE[own]].tobytes()
            for k in range(max(1, -(-len(data) // chunk))):
                yield ref, k, int(rid != ref), rid, data[k * chunk : (k + 1) * chunk]

    def cut(batches):
        for batch in batches:
            yield from _batches(rows(batch), schema)

    return cut


def _differing(batches):
    """Streams chunks sorted by (ref, part, role): holds one reference chunk, names the rows that differ from it."""
    place, held = None, b""
    for batch in batches:
        found = []
        cols = [batch.column(c).to_pylist() for c in ("_ref", "_part", "_role", "_rid")]
        for at, data in zip(zip(*cols, strict=True), batch.column("_bytes"), strict=True):
            if at[2] == 0:
                place, held = at[:2], data.as_buffer()
            elif place != at[:2] or not held.equals(data.as_buffer()):
                found.append(at[3])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["_rid"])


def _compared(rows: DataFrame, staged: DataFrame, key: list[str], chunk_bytes: int, salt_rows: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(_rid, _ref) of the rows that equal the first of their group; the rows that may not, or None; and the tables made.

    Level by level, rows of a group meet in blocks, and the first of each block goes on.  Links are followed from the top,
    where they are fewest, so no first one is looked up by more rows than a block has.
    """
    current, levels, made, differ = rows, [], [], False
    while True:
        groups = R.materialize(current.groupBy(*key).agg(F.count("*").alias("_size")), "exact-groups")
        made.append(groups)
        n, most = groups.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
        if levels and most <= 1:
            break
        salt = F.pmod(F.hash("_rid", F.lit(len(levels))), F.expr(f"cast(ceil(_size / {salt_rows}) as int)"))
        block = Window.partitionBy(*key, "_salt")
        dealt = R.attach(current, groups, key, "_size", n, "_rid").withColumn("_salt", salt).repartition(*key, "_salt").withColumns({"_ref": F.min("_rid").over(block), "_n": F.count("*").over(block)})
        members = R.materialize(dealt.select("_rid", *key, "_ref", "_n"), "exact-members")
        few = members.where("_n > 1").select("_rid", "_ref")
        texts = staged.select("_rid", "_text").join(F.broadcast(few) if few.count() <= R.BROADCAST_ROWS else few, "_rid")
        chunks = texts.mapInArrow(_chunks(chunk_bytes), "_ref long, _part int, _role int, _rid long, _bytes binary")
        bad = R.materialize(chunks.repartition("_ref").sortWithinPartitions("_ref", "_part", "_role", "_rid").mapInArrow(_differing, "_rid long").distinct(), "exact-differing")
        made += [members, bad]
        good = members
        if not bad.isEmpty():
            good, differ = members.join(bad, "_rid", "left_anti"), True
        levels.append(good.select("_rid", "_ref"))
        current = good.where("_rid = _ref").select("_rid", *key)
        if most <= salt_rows and not differ:
            break
    links = levels.pop()
    while levels:
        links = levels.pop().join(links.select(F.col("_rid").alias("_ref"), F.col("_ref").alias("_top")), "_ref").select("_rid", F.col("_top").alias("_ref"))
    links = R.materialize(links, "exact-links")
    made.append(links)
    return links, rows.join(links, "_rid", "left_anti") if differ else None, made


def _stage(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """The texts with a row number that stays the same however often the table is read."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).isNull().alias("_null"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *([F.struct(*rest).alias("_rest")] if rest else []))
    sha = F.sha2(F.translate("_text", BLANKS, "").cast("binary"), 256)
    return R.materialize(base.withColumns({"_rid": F.monotonically_increasing_id(), "_points": F.length("_text").cast("long"), "_sha": sha}), "exact-text")


def _decide(staged: DataFrame, part_chars: int, chunk_bytes: int, salt_rows: int, prime: int) -> DataFrame:
    facts = R.materialize(_facts(staged, part_chars, prime), "exact-facts")
    total = facts.count()
    key = ["f1", "f2", "n"]
    left, classes, tables = facts.select("_rid", *key), None, [facts]
    while left is not None:
        good, rest, made = _compared(left, staged, key, chunk_bytes, salt_rows)
        classes = good if classes is None else classes.unionByName(good)
        left = None if rest is None else R.materialize(rest, "exact-left")
        tables += made + ([] if left is None else [left])
    rows = R.materialize(facts.join(classes, "_rid").select("_rid", "_ref", "_id", "_points", "_sha"), "exact-classes")
    R.drop_tables(*tables)
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_rid").alias("r"))).alias("_best")
    sizes = R.materialize(rows.groupBy("_ref").agg(F.count("*").alias("group_size"), best), "exact-sizes")
    return R.attach(rows, sizes, ["_ref"], "group_size", total, "_rid").withColumn("kept", F.expr("_best.r = _rid"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_chars: int = 1 << 20, chunk_bytes: int = 1 << 16, salt_rows: int = 256, prime: int = PRIME) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The text travels only towards the comparison of nominated copies, once for most of them, and once more for each level on
    which it is the first of its block.
    """
    staged = _stage(docs, id_col, text_col, [])
    out = _decide(staged, part_chars, chunk_bytes, salt_rows, prime)
    R.drop_tables(staged)
    return out.select(F.col("_id").alias(id_col), F.col("_best.i").alias("keep_id"), "group_size", "kept", F.col("_sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_chars: int = 1 << 20, chunk_bytes: int = 1 << 16, salt_rows: int = 256) -> DataFrame:
    """The rows of docs that stay, with all their columns as they were."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    staged = _stage(docs, id_col, text_col, rest)
    kept = _decide(staged, part_chars, chunk_bytes, salt_rows, PRIME).where("kept").select("_rid")
    own = {id_col: F.col("_id"), text_col: F.when(~F.col("_null"), F.col("_text"))}
    return staged.join(kept, "_rid", "left_semi").select(*[own.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])
