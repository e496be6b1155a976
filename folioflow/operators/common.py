"""Helpers shared by operators: checkpoints, bounded broadcasts and private column names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. Where the session names none a local one serves, in local mode only."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not conf and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="folioflow-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def passing(spark: SparkSession, at: str) -> str:
    """Marks a folder as one that goes when the session's file system is closed; returns it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, of which each reader takes the columns it needs.

    The table goes when the session's file system is closed.
    """
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    passing(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """Rows of a table that is small by contract, or None if it has more than ``limit`` rows.

    At most ``limit + 1`` rows reach the driver whatever the table's size.
    """
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 * 1024 * 1024


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written out and counted: to be broadcast if it has at most so many rows and characters, else as it is.

    A join gives the same rows either way; beyond the bound it is shuffled.
    """
    kept = cut_lineage(df)
    chars = sum((F.coalesce(F.length(F.col(c)), F.lit(0)) for c, kind in kept.dtypes if kind == "string"), F.lit(0))
    n, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
    return F.broadcast(kept) if n <= rows and 4 * total + 64 * n <= size else kept


def hashed_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows of ``df``, at most that many, chosen by the hash of ``key``; all rows where there are no more.

    A count sets the share of hashes that pass, so only about as many rows as are wanted leave their tasks, however
    many tasks there are. Rows of one key come or stay together but for the last.
    """
    n = df.count()
    if n <= limit:
        return df
    steps = 1 << 30
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(steps))
    return df.filter(h < int(steps * limit / n)).limit(limit)


def salt_of(key: Column, n: int) -> Column:
    """A salt in [0, n) that depends on ``key`` alone, so that a retried task gives the same rows."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def unlike(columns: list[str], taken: tuple[str, ...]) -> list[str]:
    """Names for kept columns beside an operator's own: one that clashes gets the ending _in."""
    out: list[str] = []
    for c in columns:
        while c in taken or c in out:
            c += "_in"
        out.append(c)
    return out


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with its place, from 1, in a total order.

    The sort is by ranges, as many as there are partitions; a place is the rows of the ranges before
    plus the place within one's own, so no task sees all rows. Rows equal in ``order`` come in any order.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(before.drop("_n"), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_row", "_before")
