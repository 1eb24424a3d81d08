"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables for every operator."""

import pytest
from pyspark.sql import functions as F

from trendweave.llm import exact_dedup, near_dedup, packing, quality_model, quality_rules, secret_scan, source_mix, suffix_dedup, token_files, url_templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id string, _rid string, _rest string"
LONG = " ".join(f"word{i % 977} and{i % 313}" for i in range(30000))
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (4, LONG, "en", "b"), (4, LONG, "en", "b"), (5, LONG + " more", None, None), (None, "without id", "en", "a"), (6, "one  two", "xx", "a")]
OPERATORS = {
    "exact": exact_dedup.exact_duplicates,
    "secrets": lambda d: secret_scan.digest(secret_scan.find_secrets(d)),
    "suffix": lambda d: suffix_dedup.digest(suffix_dedup.remove_repeats(d)),
    "model": lambda d: quality_model.score_documents(d, d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).cast("int").alias("quality"))),
    "near": near_dedup.near_duplicates,
    "rules": quality_rules.judge_documents,
    "tokens": token_files.token_digests,
    "pack": lambda d: packing.pack_documents(d).where("piece = 0"),
    "mix": source_mix.mix_counts,
}


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "w") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](_docs(spark, ROWS)).collect()
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](_docs(spark, [])).count() == 0


def test_copies(spark):
    got = OPERATORS["exact"](_docs(spark, ROWS)).collect()
    assert sorted(r["group_size"] for r in got if r["doc_id"] in (1, 2, 3, 6)) == [2, 2, 2, 2]
    near = near_dedup.near_duplicates(_docs(spark, ROWS)).collect()
    assert {r["component_id"] for r in near if r["doc_id"] in (4, 5)} == {4} and sum(r["kept"] for r in near if r["doc_id"] in (4, 5)) == 1


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1", "https://a.example.org/en/12?x", "http://x.com/de/", "http://x.com/fr/1", "http://y.net", "http://example.org/es/1"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_templates.judge_urls(pages).collect()}
    assert [got[i]["verdict"] for i in (3, 4, 5, 6, 8)] == ["block", "block", "block", "allow", "block"]
    assert (got[0]["host"], got[2]["path"], got[3]["host"], got[7]["path"]) == ("", "", "example.org", "")
    assert url_templates.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("prime", [exact_dedup.PRIME, 13])
def test_parts_and_unequal_texts_with_equal_fingerprints(spark, prime):
    """Long texts hashed in parts; with a tiny prime most groups hold unequal texts, which the comparison takes apart."""
    texts = [f"{'word ' * (i % 7)}{i % 5} {'tail' * (i % 3) * 40}" for i in range(120)] + [LONG[:5000], LONG[:5000] + " ", LONG[:4999] + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs, part_chars=300, chunk_bytes=64, salt_rows=4, prime=prime).collect()}
    assert got == {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_a_text_of_64_mb_and_large_groups(spark):
    """A huge text is cut in linear time; 3,000 copies meet in blocks of 16, with one text that only its end tells apart."""
    import time

    page = "words of a page " * 500
    rows = [(i, page + " " * (i % 5)) for i in range(2, 3002)] + [(5000, page + "x"), (5001, None), (5002, "")]
    small = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    docs = small.unionByName(spark.createDataFrame([(0,), (1,)], "doc_id long").select("doc_id", F.concat(F.repeat(F.lit("0123456789abcde "), 1 << 22), F.when(F.col("doc_id") == 1, "\n").otherwise("")).alias("text")))
    began = time.time()
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs, salt_rows=16).collect()}
    assert time.time() - began < 200
    assert (got[0]["keep_id"], got[0]["group_size"], got[1]["kept"]) == (1, 2, True)
    assert {got[i]["group_size"] for i in range(2, 3002)} == {3000} and {got[i]["keep_id"] for i in range(2, 3002)} == {4} and got[5000]["group_size"] == 1
    assert got[5001]["keep_id"] == got[5002]["keep_id"] == 5001


def test_no_text_is_written_more_often_than_there_are_levels(spark, monkeypatch):
    """Chunks of 2,000 copies in blocks of 8: each row once, and the first of a block again on the next level."""
    written, plain = [], exact_dedup.R.materialize

    def counted(df, name, *a, **k):
        out = plain(df, name, *a, **k)
        if name == "exact-members":
            written.append(out.where("_n > 1").groupBy("_rid").count().agg(F.sum("count"), F.max("count")).first())
        return out

    monkeypatch.setattr(exact_dedup.R, "materialize", counted)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    assert {r["group_size"] for r in exact_dedup.exact_duplicates(docs, salt_rows=8).select("group_size").distinct().collect()} == {2000}
    assert [r[1] for r in written if r[0]] == [1] * len([r for r in written if r[0]]) and sum(r[0] or 0 for r in written) <= 2000 * 1.2
