"""Spelling variants: words one edit apart, found by the rarest of their positional bigrams.

All bigrams are put in one order, the rarest (over the distinct words) first.  One edit touches at most two bigrams of
a word, so two words that are one edit apart share, in place, one of the first three of each.  The edit lies
wholly after that bigram or wholly before it, so the words also agree on everything up to its end, or on everything
from its start on: this is the position limit, and the key they are joined by is (side, agreed part).  Only the rests
are compared.  Keys of more than ``split`` words go on by what is left of the rest after one deletion (or none): words
one edit apart have that in common, and no more than an alphabet times a length of words can share it, so
no key ever pairs a number of words that grows with the table.

Everything is DataFrame expressions.  Only the order of the bigrams passes through the driver; its size is the square
of the alphabet (90 letters) whatever the input.

Defined results: a null text has no words; a null id counts as empty; repeated rows count again; a word without near
words has none as form and itself as root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime as R

LETTERS = "[A-Za-zÀ-ÿ]"
ALPHABET = 26 + 64
PREFIX = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 7, least_n: int = 2, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n of the maximal runs of letters, A-Z lower-cased; change: of id and run, what is counted instead of the run (no longer than it)."""
    runs = F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{least_points},}}"), F.lit(0))
    each = docs.select(F.col(id_col).alias("_id"), F.explode(runs).alias("_run")).withColumn("_run", F.translate("_run", UPPER, LOWER))
    word = each.select((change(F.col("_id"), F.col("_run")) if change else F.col("_run")).alias("word"))
    return word.where(F.length("word") >= least_points).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _code(word: Column, i: Column) -> Column:
    """Number of the bigram at the i-th letter, from 0."""
    at = lambda k: F.when((c := F.ascii(F.substring(word, k, F.lit(1)))) < 128, c - 97).otherwise(c - 192 + 26)
    return at(i + 1) * ALPHABET + at(i + 2)


def _codes(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(word) - 2), lambda i: _code(word, i))


def bigram_order(words: DataFrame) -> list[int]:
    """Place of every possible bigram, the rarest first."""
    n = {r["_code"]: r["count"] for r in words.select(F.explode(_codes(F.col("word"))).alias("_code")).groupBy("_code").count().collect()}
    place = [0] * (ALPHABET * ALPHABET)
    for k, code in enumerate(sorted(range(len(place)), key=lambda c: (n.get(c, 0), c))):
        place[code] = k
    return place


def prefix_keys(words: DataFrame, place: list[int]) -> DataFrame:
    """word, n, key, rest: for each of the three rarest bigrams, what lies up to its end and what lies from its start on, with the rest."""
    order = F.from_json(F.lit(json.dumps(place)), "array<int>")
    codes = F.transform(_codes(F.col("word")), lambda c, i: F.struct(F.get(order, c).alias("place"), i.alias("at")))
    first = F.transform(F.slice(F.array_sort(codes), 1, PREFIX), lambda g: g["at"])
    word = F.col("word")
    upto = lambda i: F.struct(F.xxhash64(F.lit(0), F.substring(word, F.lit(1), i + 2)).alias("key"), F.substring(word, i + 3, F.length(word)).alias("rest"))
    since = lambda i: F.struct(F.xxhash64(F.lit(1), F.substring(word, i + 1, F.length(word))).alias("key"), F.substring(word, F.lit(1), i).alias("rest"))
    both = F.concat(F.transform(first, upto), F.transform(first, since))
    return words.select("word", "n", F.explode(both).alias("_k")).select("word", "n", "_k.key", "_k.rest")


def _pairs(keys: DataFrame) -> DataFrame:
    """Pairs of words of a key whose rests are one edit apart, each pair with the smaller word first."""
    one, two = (keys.select(*[F.col(c).alias(f"{c}{i}") if c != "key" else F.col(c) for c in ("key", "word", "n", "rest")]) for i in (1, 2))
    near = (F.col("word1") < F.col("word2")) & (F.abs(F.length("rest1") - F.length("rest2")) <= 1) & (F.levenshtein("rest1", "rest2", 1) == 1)
    return one.join(two, "key").where(near).select("word1", "n1", "word2", "n2")


def near_words(words: DataFrame, split: int = 128) -> DataFrame:
    """word, n, n_near, best (n and word of the most frequent near word; the smallest of equals) of the words that have near words."""
    keys = R.materialize(prefix_keys(words, bigram_order(words)), "variant-keys")
    sizes = R.materialize(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "variant-sizes")
    few = keys.join(sizes.where(F.col("size") <= split).select("key"), "key", "left_semi")
    many = keys.join(sizes.where(F.col("size") > split).select("key"), "key", "left_semi")
    rest = F.col("rest")
    cut = F.transform(F.sequence(F.lit(1), F.length(rest)), lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))))
    left = F.array_distinct(F.when(F.length(rest) > 0, F.concat(F.array(rest), cut)).otherwise(F.array(rest)))
    finer = many.select("word", "n", "key", "rest", F.explode(left).alias("_left")).select("word", "n", F.xxhash64("key", "_left").alias("key"), "rest")
    pairs = _pairs(few).unionByName(_pairs(finer)).groupBy("word1", "word2").agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("word1").alias("word"), F.col("n1").alias("n"), F.col("word2").alias("near"), F.col("n2").alias("m")), F.struct(F.col("word2").alias("word"), F.col("n2").alias("n"), F.col("word1").alias("near"), F.col("n1").alias("m")))).alias("e")).select("e.*")
    best = ends.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("_b"))
    found = R.materialize(best.select("word", "n", "n_near", F.col("_b.near").alias("near"), (-F.col("_b.m")).alias("near_n")), "variant-near")
    R.drop_tables(keys, sizes)
    return found


def _roots(links: DataFrame) -> DataFrame:
    """word, root at the end of its chain of forms, by pointer doubling; a form is more frequent than its word, so there is no cycle."""
    roots = R.materialize(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        further = R.materialize(roots.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "variant-roots")
        moved = further.where("moved").limit(1).count()
        R.drop_tables(roots)
        roots = further.select("word", "root")
        roots.scratch = further.scratch
        if not moved:
            return roots


def group_variants(words: DataFrame, factor: int = 10, split: int = 128) -> DataFrame:
    """One row per word of (word, n), both distinct: word, form, root, n, n_near, form_n.

    The form of a word is its near word of largest n (the smallest of equals), where that is at least ``factor`` > 1 times the word's.
    """
    words = R.materialize(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    near = near_words(words, split)
    formed = F.col("near_n") >= factor * F.col("n")
    links = near.where(formed).select("word", F.col("near").alias("form"))
    known = near.select("word", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    joined = words.join(known, "word", "left").join(_roots(links), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
