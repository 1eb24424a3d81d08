"""Language ID: prediction by partial matching over bytes, with frozen statistics.

Per language a tree of byte contexts of 0 to ``order`` bytes holds the symbols that followed each context in the
training texts.  A byte is coded from its longest known context; a symbol that never followed it costs an escape
(method C: as likely as the number of different symbols seen there) to the next shorter context, where the symbols
of the longer one are excluded, and in the end one of the bytes that no context knows.  Statistics stay as they
were learnt, so the code length of a text is a sum over its windows of ``order + 1`` bytes.  Each task keeps the
code lengths, in all languages, of windows it has met in a table of fixed size and computes the others in batches.
The language with the shortest code wins, the code of its prior counted in.

The whole text is coded, A-Z lower-cased, as if ``order`` line feeds stood before it.  Learning: bytes and documents
of each language are counted over all rows; the trees take pieces of 8 KB drawn by a hash of id and piece, about
``max_bytes`` in all, an equal part for each language (a documented bound of the fitted sample); at most ``max_langs``
languages, those with most bytes, are learnt.

Defined results: null texts and those without a letter (\\p{L}) are ``und`` with score 0; so is every text where
nothing was learnt; ties go to the smaller name; rows without lang teach nothing; a null id is not held out; repeated
rows are scored alike and all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import LOWER, STEP, buffers, slices

PIECE = 8192
SAMPLE_BITS = 30


def held_out(id_column: Column) -> Column:
    """True for the fifth of ids whose languages are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(raw: np.ndarray, order: int) -> np.ndarray:
    """Every ``order + 1`` bytes in a row as one number, the last byte in the highest place."""
    if len(raw) <= order:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(7, np.uint8)])
    eight = np.ndarray((len(raw),), "<u8", padded, strides=(1,))
    return eight[: len(raw) - order] & np.uint64((1 << (8 * order + 8)) - 1)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked numbers in sorted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Tree:
    """Context tree of one language: by order, sorted contexts and edges (context and symbol) with their costs in bits."""

    order: int
    contexts: list[np.ndarray]
    whole: list[np.ndarray]  # log2 of the total of a context that coding starts at
    first: list[np.ndarray]  # escape from it
    after: list[np.ndarray]  # log2 of the parent's total without the symbols of this context
    escapes: list[np.ndarray]  # escapes from all shorter contexts on the way down, each without its child's symbols
    edges: list[np.ndarray]
    counts: list[np.ndarray]  # log2

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> Tree:
        """From windows and how often each occurs."""
        edges, often = [], []
        for j in range(order + 1):
            e, back = np.unique(keys >> np.uint64(8 * (order - j)), return_inverse=True)
            edges.append(e)
            often.append(np.bincount(back, counts))
        tree = cls(order, [], [], [], [], [], edges, [np.log2(c) for c in often])
        n, d = np.zeros(0), np.zeros(0)
        for j in range(order + 1):
            c, of = np.unique(edges[j] & np.uint64((1 << 8 * j) - 1), return_inverse=True)
            shorter, n, d = (n, d), np.bincount(of, often[j]), np.bincount(of).astype(float)
            if j == 0:
                after, escapes = np.log2(np.maximum(256 - d, 1)), np.zeros(1)
            else:
                up, _ = _find(tree.contexts[j - 1], c >> np.uint64(8))
                same, _ = _find(edges[j - 1], edges[j] >> np.uint64(8))
                left = shorter[0][up] - np.bincount(of, often[j - 1][same])
                fresh = shorter[1][up] - d
                after = np.log2(np.where(fresh > 0, left + fresh, 1))
                escapes = np.where(fresh > 0, after - np.log2(np.maximum(fresh, 1)), 0) + tree.escapes[j - 1][up]
            for held, x in ((tree.contexts, c), (tree.whole, np.log2(n + d)), (tree.first, np.log2(n + d) - np.log2(d)), (tree.after, after), (tree.escapes, escapes)):
                held.append(x)
        return tree

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window after the bytes before it."""
        n = len(keys)
        start, down, total, count, below, stop = (np.zeros(n) for _ in range(6))
        known, going = np.arange(n), np.ones(n, bool)
        for j in range(self.order + 1):
            part = keys[known] >> np.uint64(8 * (self.order - j))
            at, there = _find(self.contexts[j], part & np.uint64((1 << 8 * j) - 1))
            known, at, part = known[there], at[there], part[there]
            start[known], down[known], total[known] = self.first[j][at], self.escapes[j][at], self.whole[j][at]
            on = going[known]
            asked = known[on]
            edge, hit = _find(self.edges[j], part[on])
            count[asked[hit]] = self.counts[j][edge[hit]]
            lost = asked[~hit]
            going[lost] = False
            stop[lost], below[lost] = self.after[j][at[on][~hit]], self.escapes[j][at[on][~hit]]
        return np.where(going, total, start + down - below + stop) - count


@dataclass
class Model:
    names: list[str]
    prior: np.ndarray  # bits
    trees: list[Tree]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(keys) for t in self.trees], axis=1)


def _count(order: int, places: dict[str, int]):
    """Windows of each language's pieces with their numbers, for each batch."""

    def count(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("_piece"))
            raw, names = LOWER[raw], batch.column("_lang").to_pylist()
            by: dict[int, list] = {}
            for i, name in enumerate(names):
                if name in places:
                    by.setdefault(places[name], []).append(windows(raw[offsets[i] : offsets[i + 1]], order))
            for place, found in by.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), place, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["_place", "_key", "_n"])

    return count


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, max_bytes: int = 1 << 23, max_langs: int = 1024) -> Model | None:
    """Trees of the languages of documents that are not held out; None without any."""
    body = F.col(text_col).cast("binary")
    taught = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), body.alias("_body"))
    sizes = taught.groupBy("_lang").agg(F.count("*").alias("_docs"), F.sum(F.octet_length("_body")).alias("_bytes")).orderBy(F.desc("_bytes"), "_lang").limit(max_langs).collect()
    sizes = sorted(sizes, key=lambda r: r["_lang"])
    if not sizes:
        return None
    share = max_bytes / len(sizes)
    odds = {r["_lang"]: int(min(1.0, share / r["_bytes"]) * (1 << SAMPLE_BITS)) for r in sizes}
    odds_of = F.from_json(F.lit(json.dumps(odds)), "map<string,bigint>")[F.col("_lang")]
    drawn = lambda k: F.pmod(F.xxhash64("_id", k), F.lit(1 << SAMPLE_BITS)) < F.col("_odds")
    pieces = taught.withColumn("_odds", odds_of).where("_odds is not null")
    pieces = pieces.withColumn("_k", F.explode(F.filter(F.sequence(F.lit(0), F.floor((F.octet_length("_body") - 1) / PIECE).cast("int")), drawn)))
    lead = F.lit(b"\n" * order)
    piece = F.when(F.col("_k") == 0, F.concat(lead, F.substring("_body", 1, PIECE))).otherwise(F.substring("_body", F.col("_k") * PIECE - order + 1, F.lit(PIECE + order)))
    places = {r["_lang"]: i for i, r in enumerate(sizes)}
    counted = pieces.select("_lang", piece.alias("_piece")).mapInArrow(_count(order, places), "_place int, _key long, _n long").groupBy("_place", "_key").agg(F.sum("_n").alias("_n")).toArrow()
    place, key, n = (counted.column(c).to_numpy() for c in ("_place", "_key", "_n"))
    n_docs = sum(r["_docs"] for r in sizes)
    names, prior, trees = [], [], []
    for r in sizes:
        own = place == places[r["_lang"]]
        if own.any():
            names.append(r["_lang"])
            prior.append(-np.log2((r["_docs"] + 1) / (n_docs + len(sizes))))
            trees.append(Tree.of(key[own].view(np.uint64), n[own], order))
    return Model(names, np.array(prior), trees) if names else None


class Memory:
    """Code lengths, in every language, of the windows met so far: one place for each hash, the newest stays."""

    def __init__(self, model: Model, order: int, most_bytes: int = 1 << 25):
        self.model = model
        self.bits = max(8, int(np.log2(most_bytes / (8 * len(model.names) + 8))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.costs = np.zeros((1 << self.bits, len(model.names)))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * STEP) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.costs[slot]
        missing = np.flatnonzero(self.keys[slot] != keys)
        if len(missing):
            new, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            costs = self.model.bits(new)
            out[missing] = costs[back]
            at = slot[missing][where]
            self.keys[at] = new
            kept = self.keys[at] == new
            self.costs[at[kept]] = costs[kept]
        return out


def code_lengths(memory: Memory, raw: np.ndarray, offsets: np.ndarray, order: int, piece: int) -> np.ndarray:
    """Bits of each document in each language."""
    n, langs = len(offsets) - 1, len(memory.model.names)
    out = np.zeros((n, langs))
    for i in np.flatnonzero(np.diff(offsets) > piece):
        text = np.concatenate([np.full(order, 10, np.uint8), LOWER[raw[offsets[i] : offsets[i + 1]]]])
        for k in range(0, len(text) - order, piece):
            out[i] += memory(windows(text[k : k + piece + order], order)).sum(axis=0)
    short = np.flatnonzero((np.diff(offsets) <= piece) & (np.diff(offsets) > 0))
    for a, b in slices(np.diff(offsets)[short], piece):
        rows = short[a:b]
        lengths = np.diff(offsets)[rows]
        ends = np.cumsum(lengths + order)
        text = np.full(ends[-1], 10, np.uint8)
        body = np.ones(len(text), bool)
        body[(np.repeat(ends - lengths - order, order) + np.tile(np.arange(order), len(rows)))] = False
        text[body] = np.concatenate([LOWER[raw[offsets[i] : offsets[i + 1]]] for i in rows])
        costs = memory(windows(text, order)[body[order:]])
        out[rows] = np.add.reduceat(costs, np.cumsum(lengths) - lengths, axis=0)
    return out


def _predict(model: Model, order: int):
    def predict(batches):
        memory, piece = Memory(model, order), max(4096, (1 << 20) // len(model.names))
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            bits = code_lengths(memory, raw, offsets, order, piece) + model.prior
            best = bits.argmin(axis=1)
            odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            named = np.array(model.names, object)[best]
            spoken = batch.column("_spoken").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("held_out"), pa.array(np.where(spoken, named, "und"), pa.string()), pa.array(np.where(spoken, 1 / odds, 0.0))], ["_id", "held_out", "lang_pred", "score"]
            )

    return predict


def predict_languages(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, **bounds) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (probability of that language among those learnt)."""
    model = model or learn(docs, id_col, text_col, lang_col, order, **bounds)
    spoken = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    texts = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"), spoken.alias("_spoken"), F.when(spoken, F.col(text_col)).otherwise("").alias("_text"))
    if model is None:
        return texts.select(F.col("_id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return texts.mapInArrow(_predict(model, order), schema).withColumnRenamed("_id", id_col)
