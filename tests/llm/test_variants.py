"""Spelling variants against all pairs, whatever the bigrams and the size of a key, and odd rows."""

import random
import zlib
from collections import Counter

import pytest

from trendweave.llm import queries
from trendweave.llm import spelling_variants as V


def _apart(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(counts, factor=10):
    forms, out = {}, {}
    for w in counts:
        near = [v for v in counts if v != w and _apart(v, w)]
        best = min(near, key=lambda v: (-counts[v], v.encode()), default=None)
        forms[w] = best if best is not None and counts[best] >= factor * counts[w] else None
        out[w] = len(near)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return rows


def _family(seed):
    """Words around a few stems, with repeated letters, many edits and steep frequencies."""
    rng = random.Random(seed)
    stems = ["anananana", "internat", "überführ", "aaaaaaaa", "compoundword", "Éclairages"]
    words = Counter()
    while len(words) < 500:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "n", "b", "é", "ab"])
        if len(w) >= 7:
            words["".join(w)] += rng.choice([2, 3, 29, 300, 3001])
    return words


@pytest.mark.parametrize("split", [1, 5, 128])
def test_all_pairs(spark, split):
    counts = _family(split)
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    got = V.group_variants(words, split=split).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == _plain(counts)


def test_chain_of_forms(spark):
    chain = ["aaaaaaabcd", "aaaaaaabc", "aaaaaaab", "aaaaaaa", "aaaaaax", "aaaaayx"]
    words = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: r for r in V.group_variants(words).collect()}
    assert all(got[w]["root"] == chain[-1] for w in chain) and [got[w]["form"] for w in chain] == [*chain[1:], None]


def test_a_large_key_makes_no_pairs_of_all(spark):
    """10,000 words that share their ends: a key holds thousands of them, pairs stay what they are."""
    import itertools

    words = ["qx" + "".join(m) + "qxqx" for m in itertools.product("abcdefghij", repeat=4)]
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = V.near_words(table, split=16)
    assert got.count() == len(words) and {r["n_near"] for r in got.select("n_near").distinct().collect()} == {36}


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Wörterbuch", "wörterbuch", "Dictionary", "dictionnaire", "ÀÉÎõü÷×ß", "short", "abc1defghij"]) for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (7, ""), (7, texts[7]), (7, texts[7]), (8, "dictionary " * 40000)]
    spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, word string, n int, _run string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "a" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                w = run[:k] + run[k + 1 :] if h % 31 == 0 else run
                counts[w] += len(w) >= 7
            run = ""
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == _plain({w: n for w, n in counts.items() if n >= 2}) and any(r["form"] for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert V.group_variants(V.count_words(docs)).count() == 0
