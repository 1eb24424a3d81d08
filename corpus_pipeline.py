"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller may write as Parquet and
reread as the next stage's docs.  All but the last return the columns of ``docs``:

1. quality_rules  - documents that the base rules or the distribution divergence reject go
2. exact_dedup    - one document of each group of equal texts stays
3. near_dedup     - one document of each component of near copies (similarity 0.8, five words) stays
4. source_mix     - documents are repeated or dropped until every source meets its target weight
5. packing        - all documents become pieces placed in sequences of 1024 tokens

Every stage works on all rows its predecessor kept.  A stage's frame can be read until a later stage is called on
something else than that frame.  Nulls, empty texts, repeated rows and empty tables are
treated as the operators' docstrings say; further columns travel through stages 1 to 4 unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendweave.llm import exact_dedup, near_dedup, packing, quality_rules, runtime, source_mix

#: Tables that the frame of a stage still reads; a later stage drops them, unless its input reads them too.
LEFTOVERS = runtime.Leftovers()


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with LEFTOVERS.step(docs, 0):
        return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with LEFTOVERS.step(docs, 1):
        return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with LEFTOVERS.step(docs, 2):
        return near_dedup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with LEFTOVERS.step(docs, 3):
        return source_mix.mix_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, sequence_id, offset, ids (base64 of the packed token ids)."""
    LEFTOVERS.release(docs, 4)
    return packing.pack_documents(docs).withColumn("ids", F.base64("ids"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("packing", pack_stage),
]

#: MinHash, the divergence references and the tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; each but the last is written to the shared folder once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, runtime.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        runtime.drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)
