"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram of common words are compared with a reference of
its language by the Jensen-Shannon distance (base 2, 0 to 1).  The references are counted over all documents
that pass the base rules: a language's classes, and its ``common`` most frequent word buckets (words are
lower-cased and hashed to ``buckets``; everything else is one more bin).  Every language with ``min_docs`` documents that
pass the base rules has a reference of its own, whatever the size of the others; documents of languages with fewer, too few to
tell how they are written, use the pooled one.  A reference's limit for words is ``most_word_distance``, or where less,
FAR_SHARE of the distance at which a text without any of its common words lies.  A document is measured against its own
reference and, if that rejects it, against the nearest of the other languages' that it shares common words with (at
least SHARED of their share in that language), so that a document in another language than its label says is not
lost.  A histogram of fewer than ``min_chars`` characters or ``min_words`` words is not compared.

References are rows of a table, about 1 KB each.  Tasks hold up to about MOST_LANGS of them; where there are more, languages are
dealt to blocks by hash, the documents of each block are measured against it, and the rejected ones against every
other block in turn, with the same result.

Defined results: a null or empty text has no words and fails the base rule of 50 words; a null language is
one of its own; repeated rows are judged alike and all returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R
from .textops import LOWER, STEP, buffers, byte_counts, code_points, hash_spans, mix64, repeats, slices, words_of

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "symbol", "other")
POOLED = "\x00pooled"
FAR_SHARE, SHARED = 0.8, 0.5
MOST_LANGS = 1 << 14
HELD_LANGS = 512  # languages whose counts a task holds before it hands them on
VERDICTS = ["base_failed", "kept", "class_distance", "word_distance", "_worst"]
BASE = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint")]


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[0xC3:] = 0  # a code point beyond ASCII counts by its first byte: as a letter,
    table[0xE2], table[0xF0:] = 7, 7  # but for general punctuation, arrows, symbols and emoji
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    for k, chars in ((4, b".,;:!?"), (5, b"'\"()-"), (6, SYMBOLS)):
        table[list(chars)] = k
    return table


#: 256 x classes: the class of each byte that begins a code point.
CLASS_MATRIX = (_class_table()[:, None] == np.arange(len(CLASSES))).astype(np.int64) * (code_points(np.arange(256, dtype=np.uint8))[:, None])


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(raw: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Per document: lines (split at newlines) that hold a word and equal an earlier line of it."""
    n = len(offsets) - 1
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1, offsets[1:]]))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))[: len(starts)]
    ends = ends - (raw[ends - 1] == 10)
    has = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    key = hash_spans(raw, starts, ends) ^ mix64(doc.astype(np.uint64) * STEP)
    twice = repeats(key)
    kinds, at = np.unique(key[twice], return_index=True)
    return np.bincount(doc[twice], minlength=n) - np.bincount(doc[twice][at], minlength=n)


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: words inside a window of three words that occurs twice or more in the document."""
    n = len(first) - 1
    if len(words) < 3:
        return np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    at = np.flatnonzero(doc[2:] == doc[:-2])
    h = mix64(words[at] * np.uint64(3) + (words[at + 1] ^ STEP) * np.uint64(0xD1342543DE82EF95) + mix64(words[at + 2]))
    twice = at[repeats(h ^ mix64(doc[at].astype(np.uint64) * STEP))]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    return _sum(covered, first)


def measure(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The five base counts, class counts (n x classes), and each word's bucket with the first word of each document."""
    starts, ends, first = words_of(raw, offsets)
    by_byte = byte_counts(raw, offsets)
    classes = by_byte @ CLASS_MATRIX
    points = classes.sum(axis=1)
    symbols = by_byte[:, list(SYMBOLS)].sum(axis=1)
    n_words = np.diff(first)
    base = [n_words, points - classes[:, CLASSES.index("space")], symbols, duplicate_lines(raw, offsets, starts), repeated_words(hash_spans(raw, starts, ends), first)]
    folded = hash_spans(LOWER[raw], starts, ends)
    return base, classes, ((folded >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), first


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p and q, which each sum to 1 (an empty row: 0)."""
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)

    return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0.0, 1.0)) * (p.sum(axis=1) > 0)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def _gather(buckets: int):
    """Rows (lang, kind, bin, n): class and word counts of a task's documents that pass the base rules."""

    def rows(words, kinds, docs):
        for lang in docs:
            at = np.flatnonzero(words[lang])
            n = len(at) + len(CLASSES) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array(["w"] * len(at) + ["c"] * len(CLASSES) + ["d"], pa.string()),
                    pa.array(np.concatenate([at, np.arange(len(CLASSES)), [0]]).astype(np.int32)),
                    pa.array(np.concatenate([words[lang][at], kinds[lang], [docs[lang]]]).astype(np.int64)),
                ],
                ["_lang", "kind", "bin", "n"],
            )

    def counts(batches):
        words: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            langs = np.array(batch.column("_lang").to_pylist(), object)
            for a, b in slices(np.diff(offsets), 1 << 22):
                base, classes, bucket, first = measure(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                good = ~base_failed(base[0], base[4])
                for lang in dict.fromkeys(langs[a:b]):
                    own = (langs[a:b] == lang) & good
                    docs[lang] = docs.get(lang, 0) + int(own.sum())
                    words[lang] = words.get(lang, 0) + np.bincount(bucket[np.repeat(own, np.diff(first))], minlength=buckets)
                    kinds[lang] = kinds.get(lang, 0) + classes[own].sum(axis=0)
                    if len(docs) >= HELD_LANGS:
                        yield from rows(words, kinds, docs)
                        words, kinds, docs = {}, {}, {}
        yield from rows(words, kinds, docs)

    return counts


def _references(texts: DataFrame, buckets: int, common: int, min_docs: int) -> DataFrame:
    """A written row per language: _lang, total (words), counts (kind, bin and number of its classes and common words)."""
    counted = R.materialize(texts.mapInArrow(_gather(buckets), "_lang string, kind string, bin int, n long").groupBy("_lang", "kind", "bin").agg(F.sum("n").alias("n")), "rules-counts")
    enough = counted.where(f"kind = 'd' and n >= {max(1, min_docs)}").select("_lang")
    pooled = counted.groupBy("kind", "bin").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("_lang"), "kind", "bin", "n")
    kept = counted.join(enough, "_lang", "left_semi").unionByName(pooled).where("kind <> 'd'")
    ranked = kept.withColumns({"_r": F.row_number().over(Window.partitionBy("_lang", "kind").orderBy(F.desc("n"), "bin")), "_t": F.sum("n").over(Window.partitionBy("_lang", "kind"))})
    top = ranked.where(f"kind = 'c' or _r <= {common}")
    refs = R.materialize(top.groupBy("_lang").agg(F.max(F.when(F.col("kind") == "w", F.col("_t"))).alias("total"), F.collect_list(F.struct("kind", "bin", "n")).alias("counts")).where("total > 0"), "rules-references")
    R.drop_tables(counted)
    return refs


def _block_of(lang: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(lang), F.lit(blocks))


def _loaded(refs: DataFrame, block: int, blocks: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """lang -> (class shares, common buckets, their shares with the rest's last) of a block of references, and the pooled one."""
    out = {}
    for r in refs.where((_block_of(F.col("_lang"), blocks) == block) | (F.col("_lang") == POOLED)).collect():  # about MOST_LANGS at most
        classes = np.zeros(len(CLASSES))
        words = sorted((x["bin"], x["n"]) for x in r["counts"] if x["kind"] == "w")
        for x in r["counts"]:
            if x["kind"] == "c":
                classes[x["bin"]] = x["n"]
        bins, n = (np.array(x) for x in zip(*words, strict=True))
        out[r["_lang"]] = classes / classes.sum(), bins.astype(np.int64), np.append(n, r["total"] - n.sum()) / r["total"]
    return out


def _judge(references, buckets: int, min_chars: int, min_words: int, most_class: float, most_word: float, own: bool = True, others: bool = True):
    """own: measures documents against the reference of their language; others: those that it rejects, or without ``own`` all, against the rest."""
    where, limit = {}, {}
    for lang, (_, bins, ref) in references.items():
        none = np.zeros((1, len(ref)))
        none[0, -1] = 1.0
        limit[lang] = max(1e-9, min(most_word, FAR_SHARE * float(js_distance(none, ref[None, :])[0])))
        where[lang] = bins

    def distances(lang, classes, bucket, own_first):
        shares, bins, ref = references[lang]
        n = len(classes)
        chars = classes.sum(axis=1)
        p = classes / np.maximum(chars, 1)[:, None]
        by_class = js_distance(p, np.broadcast_to(shares, p.shape))
        counts = np.diff(own_first)
        doc = np.repeat(np.arange(n), counts)
        at = np.searchsorted(where[lang], bucket)
        at = np.where(where[lang][np.minimum(at, len(bins) - 1)] == bucket, at, len(bins))
        hist = np.bincount(doc * (len(bins) + 1) + at, minlength=n * (len(bins) + 1)).reshape(n, -1)
        q = hist / np.maximum(counts, 1)[:, None]
        by_word = js_distance(q, np.broadcast_to(ref, q.shape))
        by_class, by_word = np.where(chars >= min_chars, by_class, 0.0), np.where(counts >= min_words, by_word, 0.0)
        return by_class, by_word, np.maximum(by_class / most_class, by_word / limit[lang]), 1 - q[:, -1] >= SHARED * (1 - ref[-1])

    def judged(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            langs = np.array(batch.column("_lang").to_pylist(), object)
            parts = []
            for a, b in slices(np.diff(offsets), 1 << 22):
                base, classes, bucket, first = measure(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                failed = base_failed(base[0], base[4])
                by_class, by_word, worst = np.zeros(b - a), np.zeros(b - a), np.zeros(b - a)

                def of(rows, lang, classes=classes, bucket=bucket, first=first):
                    picked = np.zeros(len(classes), bool)
                    picked[rows] = True
                    counts = np.diff(first)
                    return distances(lang, classes[rows], bucket[np.repeat(picked, counts)], np.concatenate([[0], np.cumsum(counts[rows])]))

                if not own:
                    worst[:] = np.inf
                elif references:
                    named = np.array([x if x in references else POOLED for x in langs[a:b]], object)
                    for lang in dict.fromkeys(named):
                        rows = np.flatnonzero(named == lang)
                        by_class[rows], by_word[rows], worst[rows], _ = of(rows, lang)
                doubt = np.flatnonzero(~failed & (worst > 1))
                if others and len(doubt):
                    for lang in [x for x in references if x != POOLED]:
                        c, w, far, shares = of(doubt, lang)
                        nearer = shares & (far < worst[doubt])
                        by_class[doubt[nearer]], by_word[doubt[nearer]], worst[doubt[nearer]] = c[nearer], w[nearer], far[nearer]
                kept = ~failed & (worst <= 1)
                parts.append([*base, failed, kept, by_class, by_word, worst])
            names = [n for n, _ in BASE] + VERDICTS
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(names))]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            rest = [i for i, c in enumerate(batch.schema.names) if c not in ("_text", "_lang")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *[pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)]], [*[batch.schema.names[i] for i in rest], *names])

    return judged


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 4096, common: int = 64, min_chars: int = 200, min_words: int = 100, most_class_distance: float = 0.28, most_word_distance: float = 0.42, keep: tuple[str, ...] = (), min_docs: int = 30) -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept, class_distance, word_distance; and the columns in ``keep`` as struct _row.

    Two passes over the texts, both map-only; only histograms of bounded size are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang")
    refs = _references(docs.select(text, lang), buckets, common, min_docs)
    source = docs.select(F.col(id_col).alias("_id"), text, lang, *([F.struct(*keep).alias("_row")] if keep else []))
    blocks = -(-refs.count() // MOST_LANGS)
    options = (buckets, min_chars, min_words, most_class_distance, most_word_distance)
    out = _judged(source, _loaded(refs, 0, 1), *options) if blocks <= 1 else _in_blocks(source, refs, blocks, options)
    R.drop_tables(refs)
    names = [n for n, _ in BASE] + VERDICTS[:-1]
    return out.select(F.col("_id").alias(id_col), *names, *(["_row"] if keep else []))


def _judged(rows: DataFrame, references, *options, **ways) -> DataFrame:
    passed = [f for f in rows.schema.fields if f.name not in ("_text", "_lang")]
    kinds = [T.BooleanType()] * 2 + [T.DoubleType()] * 3
    schema = T.StructType([*passed, *[T.StructField(n, T.LongType()) for n, _ in BASE], *[T.StructField(n, k) for n, k in zip(VERDICTS, kinds, strict=True)]])
    return rows.mapInArrow(_judge(references, *options, **ways), schema)


def _in_blocks(source: DataFrame, refs: DataFrame, blocks: int, options: tuple) -> DataFrame:
    """As ``_judged`` with all references at once."""
    staged = R.materialize(source.withColumn("_rid", F.monotonically_increasing_id()), "rules-staged")
    loaded = lambda k: _loaded(refs, k, blocks)
    first = reduce(DataFrame.unionByName, [_judged(staged.where(_block_of(F.col("_lang"), blocks) == k), loaded(k), *options, others=False) for k in range(blocks)])
    first = R.materialize(first, "rules-first")
    doubt = staged.select("_rid", "_text", "_lang").join(first.where("not base_failed and _worst > 1").select("_rid"), "_rid", "left_semi")
    tried = reduce(DataFrame.unionByName, [_judged(doubt, loaded(k), *options, own=False) for k in range(blocks)])
    near = R.materialize(tried.groupBy("_rid").agg(F.min(F.struct("_worst", "class_distance", "word_distance")).alias("_near")), "rules-near")
    better = F.coalesce(F.col("_near._worst") < F.col("_worst"), F.lit(False))
    rows = first.join(near, "_rid", "left").withColumn("_better", better)
    told = {c: F.when(F.col("_better"), F.col(f"_near.{c}")).otherwise(F.col(c)) for c in ("class_distance", "word_distance", "_worst")}
    return rows.withColumns(told).withColumn("kept", ~F.col("base_failed") & (F.col("_worst") <= 1))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, all columns as they were."""
    judged = judge_documents(docs, keep=tuple(docs.columns), **options)
    return judged.where("kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
