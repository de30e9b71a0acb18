"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid.sources.readers import BATCH_BYTES, small_batches  # noqa: F401

#: ASCII white space as the contracts define it: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of input for each task of a written table, tasks for each core that smaller inputs keep, and the least bytes of one.
TASK_BYTES, TASKS_A_CORE, LEAST_BYTES = 16 << 20, 4, 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrowed(df: DataFrame) -> DataFrame:
    """Fewer tasks, so that small results do not become very many files; nothing is shuffled.

    Tasks stay in proportion to the bytes that the plan's tables have: one for
    each ``LEAST_BYTES`` up to four a core, then one for each ``TASK_BYTES``.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(TASKS_A_CORE * cores, -(-size // LEAST_BYTES)), min(-(-size // TASK_BYTES), (1 << 31) - 1)))


def _folder(spark: SparkSession) -> str:
    """The shared folder for written tables: the session's ``spark.checkpoint.dir``.

    Only in one process on one machine (tests) a temporary folder stands in for it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="tellgrid-ck-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its lineage is cut, and the optimizer knows its size.

    The table is deleted by :func:`forget`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    narrowed(df).write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions for ``rows`` rows that are worked on a partition at a time: about ``most`` rows in each at any size."""
    return max(partitions(spark), -(-rows // most))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or script."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def sliced(batches, column: str | int, limit: int):
    """Cut record batches into slices of about ``limit`` bytes of ``column`` (a row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size) // limit
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
