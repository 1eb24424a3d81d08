"""Shared-folder tables and skew-proof lookups used by the corpus operators.

Lineage is cut with Parquet tables in the folder that ``spark.checkpoint.dir`` names, so a lost
executor costs the running tasks only.  A table is written once and re-read by every later step.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BROADCAST_ROWS = 1 << 18
_local: list[str] = []
_made: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir; where it is unset, a temp folder, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="trendweave-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/trendweave/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialize(df: DataFrame, name: str, block_bytes: int = 1 << 27) -> DataFrame:
    """Write df to the shared folder and read it back; the shuffle files of the write are dropped with it.

    block_bytes: size of a row group; small ones for tables whose rows are large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").option("parquet.block.size", block_bytes).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _made.discard(path)


def _plain(path: str) -> str:
    """A path without its scheme and host, as the default file system may be named or not."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)


def _read_by(df: DataFrame) -> set[str]:
    """The folders of this module that a frame reads."""
    folders = {_plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
    return {p for p in _made if _plain(p) in folders}


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; other frames are left alone."""
    for t in tables:
        if t.__dict__.get("scratch") in _made:
            _delete(t.sparkSession, t.scratch)


class Leftovers:
    """Tables that frames already handed out still read, by the number of their step: a later step drops those of earlier ones, unless its input reads them."""

    def __init__(self):
        self.steps: dict[str, int] = {}

    def release(self, docs: DataFrame, number: int) -> None:
        """Drop what the steps before ``number`` left, but for what ``docs`` reads."""
        self.steps = {p: k for p, k in self.steps.items() if p in _made}
        old = {p for p, k in self.steps.items() if k < number}
        for path in old - _read_by(docs) if old else ():
            _delete(docs.sparkSession, path)

    @contextmanager
    def step(self, docs: DataFrame, number: int):
        """Releases earlier steps' tables, and notes those that are made inside and not dropped there."""
        self.release(docs, number)
        before = set(_made)
        yield
        self.steps |= dict.fromkeys(_made - before, number)


def rows_of(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ``few``, a written table of distinct keys: broadcast while it is small, else shuffled."""
    few = few.select(key)
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, key, "left_semi")


def attach(members: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: str) -> DataFrame:
    """Left join of each member with its group's row, whatever the size of a group.

    Groups holding at least a thousandth of all ``total`` members are at most 1000 in number: they are
    broadcast.  Members of the others meet their group in a shuffle join where no key has more than
    that thousandth.  ``spread`` is a column that is unique, or nearly, per member.
    """
    values = [c for c in groups.columns if c not in keys]
    floor = max(64, total // 1000)
    heavy = groups.where(F.col(size) >= floor).select(*keys, F.struct(*values).alias("_heavy"))
    light = groups.where(F.col(size) < floor).select(*keys, F.lit(-1).alias("_lane"), F.struct(*values).alias("_light"))
    lane = F.when(F.col("_heavy").isNotNull(), F.pmod(F.hash(spread), F.lit(1 << 20))).otherwise(F.lit(-1))
    return (
        members.join(F.broadcast(heavy), keys, "left")
        .withColumn("_lane", lane)
        .join(light, [*keys, "_lane"], "left")
        .withColumn("_group", F.coalesce("_heavy", "_light"))
        .select(*members.columns, *[F.col(f"_group.{v}").alias(v) for v in values])
    )


def members_of(members: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner form of ``attach``, for groups that few of the members belong to: each member of a group with its row."""
    floor = max(64, total // 1000)
    heavy, light = groups.where(F.col(size) >= floor), groups.where(F.col(size) < floor)
    return members.join(F.broadcast(heavy), keys).unionByName(members.join(light, keys))
