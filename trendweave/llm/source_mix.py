"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Sizes are words.  Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the sum of
all sizes; a target stops at ``max_epochs`` times its source's size and the excess goes to the others by
weight.  A source has a slot for each ``block_words`` words of its target, the last one for what is left of it, so
a target of one word has a slot as well, and every source gives its target, rounded to a whole word.  Without
``block_words`` a block has BLOCK_WORDS words, fewer where that would make fewer than MANY slots; what a document gives
does not depend on it.  The N slots of all
sources lie side by side; the schedule visits them in golden-ratio steps modulo N, by a step without a common factor with N,
so that each is visited once.  Slots are ranked per source by their position in the schedule, and slot k takes the k-th block
of the source's shuffled stream, which starts again from its beginning when it ends, ``max_epochs`` times at
most.  So after any number of slots each source is within a few blocks of its share.

Steps are whole numbers and exact up to 2**40 slots.  Slots and sources meet in cells that hold equally many slots; ranks
are counted in stripes of the schedule.  Only figures of sources (one row each) pass through one task.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own; rows with
a repeated id count as rows of their own; ties in the shuffle break by id and size, so reruns agree; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R

WORD = r"[^\x20\x09-\x0D]+"
SPAN = 1 << 31
GOLDEN = 1327217885  # the odd number next to SPAN divided by the golden ratio
BLOCK_WORDS = 64
MANY = 1 << 16


def _targets(sizes: DataFrame, max_epochs: int) -> DataFrame:
    """Per source: weight, size, target and words to take.  Its windows run over one row per source."""
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("_source").asc_nulls_last())
    ratio = everything.orderBy(F.col("_source_size") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before, onward = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    w = sizes.withColumn("_weight", F.pmod(F.row_number().over(named) - 1, F.lit(3)) + 1).withColumns(
        {
            "_total": F.sum("_source_size").over(everything),
            "_capped": F.coalesce(F.sum(F.col("_source_size") * max_epochs).over(before), F.lit(0)),
            "_others": F.sum("_weight").over(onward),
            "_turn": F.row_number().over(ratio),
        }
    )
    level = (F.col("_total") - F.col("_capped")).cast("double") / F.col("_others")
    free = level * F.col("_weight") <= F.col("_source_size") * max_epochs
    w = w.withColumn("_level", F.min_by(F.when(free, level), F.when(free, F.col("_turn"))).over(everything))
    target = F.least((F.col("_source_size") * max_epochs).cast("double"), F.col("_level") * F.col("_weight"))
    return w.withColumn("_target", target).withColumn("_words", F.floor(F.col("_target") + 0.5).cast("long")).select("_src", "_source", "_source_size", "_target", "_words")


def golden_step(n: int) -> int:
    """The first whole number from n divided by the golden ratio on that has no common factor with n."""
    step = n * GOLDEN // SPAN
    while gcd(step, n) != 1:
        step += 1
    return step


def _block(targets: DataFrame, block_words: int | None) -> int:
    """Words of a slot, as asked or so that there are MANY slots."""
    if block_words is not None:
        return block_words
    return max(1, min(BLOCK_WORDS, targets.agg(F.coalesce(F.sum("_words"), F.lit(0))).first()[0] // MANY))


def _schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots (_src, _k, position) with their rank in the source."""
    spark = targets.sparkSession
    need = targets.where("_words > 0").withColumn("_slots", F.expr(f"(_words + {block - 1}L) div {block}L"))
    n_sources, n_slots = need.agg(F.count("*"), F.coalesce(F.sum("_slots"), F.lit(0))).first()
    back = pow(golden_step(n_slots), -1, n_slots) if n_slots else 0  # from a slot to its position
    wide = max(1, n_slots >> max(12, (4 * n_sources - 1).bit_length()))
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())
    spans = need.withColumn("_hi", F.sum("_slots").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lo", F.col("_hi") - F.col("_slots"))
    spans = spans.select("_src", "_lo", "_hi", F.explode(F.expr(f"sequence(_lo div {wide}L, (_hi - 1) div {wide}L)")).alias("_cell"))
    position = F.expr(f"((id * {back >> 20}L % {max(1, n_slots)}L) * {1 << 20}L + id * {back & ((1 << 20) - 1)}L) % {max(1, n_slots)}L")
    points = spark.range(n_slots).select("id", position.alias("position"), F.expr(f"id div {wide}L").alias("_cell"))
    stripe = max(16, int(n_slots**0.5))
    hits = points.join(spans, "_cell").where("id >= _lo and id < _hi").select("_src", "position", F.expr(f"position div {stripe}L").alias("_stripe"))
    counted = R.materialize(hits.groupBy("_src", "_stripe").agg(F.count("*").alias("_n")), "mix-stripes")
    ahead = Window.partitionBy("_src").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    own = Window.partitionBy("_src", "_stripe").orderBy("position")
    return hits.join(before, ["_src", "_stripe"]).select("_src", (F.col("_before") + F.row_number().over(own) - 1).alias("_k"), "position")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, rest: list[str]) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    src = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), key.alias("_key"), src.alias("_src"), F.substring(key, 1, 3).alias("_bucket"), *([F.struct(*rest).alias("_row")] if rest else [])).withColumn("_rid", F.monotonically_increasing_id())


def _placed(staged: DataFrame, block_words: int | None, max_epochs: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their source's figures and place in its stream; the schedule; and the size of a block.

    _given: the words that the slots of the source take from its stream.
    """
    sums = R.materialize(staged.groupBy("_src", "_source", "_bucket").agg(F.sum("_size").alias("_in_bucket")), "mix-buckets")
    targets = R.materialize(_targets(sums.groupBy("_src", "_source").agg(F.sum("_in_bucket").alias("_source_size")), max_epochs), "mix-targets")
    block = _block(targets, block_words)
    slots = _schedule(targets, block)
    sources = targets.select("_src", "_source_size", "_target", F.col("_words").alias("_given"))
    ahead = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("_ahead", F.coalesce(F.sum("_in_bucket").over(ahead), F.lit(0))).select("_src", "_bucket", "_ahead").join(sources, "_src")
    own = Window.partitionBy("_src", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    rows = staged.select("_rid", "_id", "_src", "_source", "_size", "_key", "_bucket").join(places, ["_src", "_bucket"])
    start = F.col("_ahead") + F.sum("_size").over(own) - F.col("_size")
    placed = R.materialize(rows.select("_rid", "_id", "_src", "_source", "_size", "_source_size", "_target", "_given", start.alias("_start")), "mix-placed")
    R.drop_tables(sums)
    return placed, slots, block


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int | None = None, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: for each slot of the schedule, by position, which words of which documents it takes."""
    placed, slots, block = _placed(R.materialize(_sized(docs, id_col, text_col, source_col, seed, []), "mix-sizes"), block_words, max_epochs)
    spans = (
        placed.where("_size > 0 and _given > 0")
        .withColumn("_epoch", F.explode(F.expr("sequence(0L, (_given - 1) div _source_size)")))
        .withColumn("_from", F.expr("_epoch * _source_size + _start"))
        .withColumn("_to", F.expr("least(_from + _size, _given)"))
        .where("_from < _given")
        .withColumn("_k", F.explode(F.expr(f"sequence(_from div {block}L, (_to - 1) div {block}L)")))
    )
    taken = spans.join(slots, ["_src", "_k"]).withColumns({"_a": F.expr(f"greatest(_from, _k * {block}L)"), "_b": F.expr(f"least(_to, (_k + 1) * {block}L)")})
    return taken.select("position", F.col("_source").alias(source_col), F.col("_epoch").alias("epoch"), F.col("_id").alias(id_col), (F.col("_a") - F.col("_from")).alias("from_word"), (F.col("_b") - F.col("_from")).alias("to_word"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int | None = None, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """Per document: id, size, source_size, target of its source, words the mix takes of it, first position (-1: none) and number of slots."""
    staged = R.materialize(_sized(docs, id_col, text_col, source_col, seed, []), "mix-sizes")
    return _counts(staged, block_words, max_epochs).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "taken", "first_position", "n_slots")


def _counts(staged: DataFrame, block_words: int | None, max_epochs: int) -> DataFrame:
    """Every epoch of a document as its part of what the source gives, and the slot that its first word falls to."""
    placed, slots, block = _placed(staged, block_words, max_epochs)
    part = lambda e: f"greatest(0L, least(_size, _given - _start - {e} * _source_size))"
    over = lambda e: f"if({part(e)} > 0, (_start + {e} * _source_size + {part(e)} - 1) div {block}L - (_start + {e} * _source_size) div {block}L + 1, 0L)"
    sums = {c: F.expr(" + ".join(f(e) for e in range(max_epochs))) for c, f in (("taken", part), ("n_slots", over))}
    first = F.when(F.col("taken") > 0, F.expr(f"_start div {block}L"))
    rows = placed.withColumns(sums).withColumn("_k", first)
    return rows.join(slots.withColumnRenamed("position", "first_position"), ["_src", "_k"], "left").fillna(-1, ["first_position"])


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int | None = None, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The documents as the mix repeats or drops them, all columns: as many copies as it takes of their words, to the nearest whole.

    Documents without a word carry no weight in a mix and stay once.
    """
    staged = R.materialize(_sized(docs, id_col, text_col, source_col, seed, docs.columns), "mix-rows")
    copies = F.expr("case when _size = 0 then 1L else (2L * taken + _size) div (2L * _size) end")
    counts = _counts(staged, block_words, max_epochs).select("_rid", copies.alias("_copies")).where("_copies > 0")
    rows = staged.select("_rid", "_row").join(counts, "_rid").withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
