"""Near dedup where buckets are large: a common template, one very large component, and families around the threshold."""

import random

import pytest

from pyspark.sql import functions as F

from trendweave.llm import near_dedup, runtime


def _components(texts, percent):
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return [find(i) for i in range(len(texts))]


def _edited(rng, base, n, tag):
    words = list(base)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"{tag}x{k}"
    return " ".join(words)


def _got(spark, texts, percent):
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=percent).collect()
    return [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("percent", [80, 85])
def test_families(spark, percent):
    rng = random.Random(percent)
    texts = []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(150 + 60 * family)]
        texts += [_edited(rng, base, rng.randrange(0, 14), f"f{family}e{k}") for k in range(60)]  # similarities from 0.2 to 1
        texts += [" ".join(base[rng.randrange(25) : len(base) - rng.randrange(25)]) for _ in range(20)]  # parts of one another
        texts += [_edited(rng, base, rng.randrange(1, 6), f"f{family}same{k % 4}") for k in range(20)]  # edits in common
    rng.shuffle(texts)
    assert _got(spark, texts, percent) == _components(texts, percent)


def test_template(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [_edited(rng, base, 9, f"t{k}") for k in range(200)]
    assert _got(spark, texts, 85) == _components(texts, 85)


def test_one_large_component(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [_edited(rng, base, rng.randrange(1, 3), f"t{k}") for k in range(3000)]
    assert set(_got(spark, texts, 85)) == {0}


def test_only_own_tables_are_dropped(spark, tmp_path):
    own = f"file://{tmp_path}/trendweave/data/documents.parquet"
    spark.range(5).write.parquet(own)
    mine = spark.read.parquet(own)
    made = runtime.materialize(mine, "test")
    runtime.drop_tables(mine, made)
    assert mine.count() == 5 and (tmp_path / "trendweave" / "data").exists()
    with pytest.raises(Exception, match=r"PATH_NOT_FOUND|FAILED_READ_FILE|not exist"):
        spark.read.parquet(made.scratch).count()
    left = runtime.Leftovers()
    with left.step(mine, 0):
        first = runtime.materialize(mine, "test")
    with left.step(first.where("id > 1"), 1):
        assert first.count() == 5
    left.release(mine, 0)
    assert first.count() == 5
    left.release(mine, 1)
    assert first.scratch not in runtime._made


def test_lanes_follow_a_pivots_own_pairs(spark):
    """A pivot of 40,000 pairs has some 150 lanes of its text; the others one each, however large the table is."""
    pairs = near_dedup.R.materialize(spark.range(40000).select(F.col("id").alias("_x"), F.lit(-1).cast("long").alias("_pivot")).unionByName(spark.range(3000).select(F.col("id").alias("_x"), (-2 - F.col("id") % 1000).alias("_pivot"))), "test-pairs")
    lanes = {r["_pivot"]: r["n"] for r in near_dedup._lanes(pairs).select("_pivot", "_salt").distinct().groupBy("_pivot").agg(F.count("*").alias("n")).collect()}
    assert 140 < lanes.pop(-1) <= 157 and set(lanes.values()) == {1} and len(lanes) == 1000
