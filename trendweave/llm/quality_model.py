"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted in numpy from whole texts; language, source and id are never among them.  The trees are
fitted on the driver on at most ``max_rows`` labelled rows (a documented bound; those with the smallest hash of
their id), found by a broadcast join of that bounded table.  They are flattened into arrays, complete trees of
one depth, so a batch of documents walks all of them with array lookups.  Scoring is one map-only pass.

Defined results: a null or empty text is scored by its statistics, which are all zero; without any labelled
row of either class every score is 0.5; a label given twice for an id counts by its mean; repeated rows are
scored alike and all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import CLASS_MATRIX, CLASSES, duplicate_lines, repeated_words
from .textops import LOWER, STEP, buffers, byte_counts, hash_spans, mix64, slices, words_of

MARKS = b"!?.,;:|#$%&*<>@/=_\"'()-"
FEATURES = (
    *(f"share_{c}" for c in CLASSES), *(f"mark_{i}" for i in range(len(MARKS))), "log_chars", "log_words", "word_mean", "word_spread", "word_longest", "distinct_words", "top_word", "repeat_words",
    "lines", "duplicate_lines", "short_lines", "capital_words", "marked_words", "byte_entropy", "beyond_ascii",
)


def _per(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x len(FEATURES) statistics of the documents."""
    n = len(offsets) - 1
    starts, ends, first = words_of(raw, offsets)
    by_byte = byte_counts(raw, offsets)
    classes = by_byte @ CLASS_MATRIX
    chars = classes.sum(axis=1)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    lengths = (ends - starts).astype(float)
    total = np.bincount(doc, lengths, minlength=n)
    mean = _per(total, n_words)
    spread = np.sqrt(np.maximum(_per(np.bincount(doc, lengths**2, minlength=n), n_words) - mean**2, 0))
    longest = np.zeros(n)
    some = n_words > 0
    if len(starts):
        longest[some] = np.maximum.reduceat(lengths, first[:-1][some])
    low = hash_spans(LOWER[raw], starts, ends)
    own = mix64(low ^ mix64(doc.astype(np.uint64) * STEP))
    ordered, where, often = np.unique(own, return_index=True, return_counts=True)
    distinct = np.bincount(doc[where], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc[where], often)
    repeat = repeated_words(low, first)
    line_starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    line_words = np.diff(np.append(np.searchsorted(starts, line_starts), len(starts)))
    lines = np.bincount(line_doc, minlength=n)
    short = np.bincount(line_doc[line_words <= 3], minlength=n)
    capital = np.bincount(doc[(raw[starts] >= 65) & (raw[starts] <= 90)], minlength=n)
    marked = np.bincount(doc[np.isin(raw[ends - 1], np.frombuffer(MARKS, np.uint8))], minlength=n)
    share = by_byte / np.maximum(by_byte.sum(axis=1), 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    beyond = by_byte[:, 0xC2:].sum(axis=1)
    columns = [
        *(_per(classes[:, k], chars) for k in range(len(CLASSES))),
        *(_per(by_byte[:, b], chars) for b in MARKS),
        np.log1p(chars), np.log1p(n_words), mean, spread, longest, _per(distinct, n_words), _per(top, n_words), _per(repeat, n_words),
        _per(lines, n_words), _per(duplicate_lines(raw, offsets, starts), lines), _per(short, lines), _per(capital, n_words), _per(marked, n_words), entropy, _per(beyond, chars),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    """Complete trees of one depth: a node's feature and threshold by tree and heap place, a leaf's value by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, margin = np.arange(len(x)), np.full(len(x), self.bias)
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            margin += leaf[at - (len(leaf) - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 2.0) -> Forest:
    """Boosting on the logistic loss; each level's gradient histograms come from one count over (node, feature, bin)."""
    n, f = x.shape
    inner = np.arange(1, bins) / bins
    edges = [np.unique(np.quantile(x[:, k], inner)) for k in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    margin = np.full(n, bias)
    nodes, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, leaves))
    cells = np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            key = (((at - first) * f * bins)[:, None] + cells + binned).ravel()
            sums = [np.bincount(key, np.repeat(v, f), minlength=width * f * bins).reshape(width, f, bins) for v in (g, h)]
            left = [s.cumsum(axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + l2) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(left[1] < least) | (total[1] - left[1] < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for j, b in enumerate(best):
                k, cut = divmod(int(b), bins)
                if gain[j].flat[b] > 1e-6 and cut < len(edges[k]):
                    feature[t, first + j], threshold[t, first + j] = k, edges[k][cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        at -= nodes
        leaf[t] = -rate * np.bincount(at, g, minlength=leaves) / (np.bincount(at, h, minlength=leaves) + l2)
        margin += leaf[t][at]
    return Forest(feature, threshold, leaf, bias)


def held_out(id_column: Column) -> Column:
    """True for the third of ids whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _map_statistics(batches):
    for batch in batches:
        raw, offsets = buffers(batch.column("_text"))
        parts = [statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(np.diff(offsets), 1 << 22)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        ends = np.arange(len(batch) + 1, dtype=np.int32) * len(FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["_label", "_x"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000) -> Forest | None:
    """Trees fitted on labelled rows that are not held out, at most max_rows; None without both classes."""
    given = labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null")
    given = given.where(~held_out(F.col("_id"))).groupBy("_id").agg((F.avg("_y") >= 0.5).cast("double").alias("_label"))
    bounded = given.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(bounded), "_id").select("_text", "_label").mapInArrow(_map_statistics, "_label double, _x array<double>")
    got = rows.orderBy(F.hash("_x"), "_label").limit(2 * max_rows).toPandas()
    if got["_label"].nunique() < 2:
        return None
    return fit_forest(np.stack(got["_x"].to_numpy()), got["_label"].to_numpy())


def _score(forest: Forest | None):
    def score(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            out = np.full(len(batch), 0.5)
            if forest is not None:
                for a, b in slices(np.diff(offsets), 1 << 22):
                    out[a:b] = forest.score(statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(out)], ["_id", "held_out", "score"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    forest = learn(docs, labels, id_col, text_col, label_col=label_col, max_rows=max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    scored = texts.mapInArrow(_score(forest), schema)
    return scored.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
