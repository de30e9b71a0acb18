"""Sources: tables, whole text files, labelled JSON lines, profiles and voices."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid import model


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python, unless the session asks for less (a batch holds a row at least).
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded in bytes.

    Ten thousand rows, Spark's bound, are more than a worker's memory, or than
    Arrow's two gigabytes, where texts are long.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores, dealt out to all cores; any larger one as it is.

    A small table of one row group would otherwise be worked on by one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Splits for each core from which on a scan's splits are taken for even; of fewer, how much longer than all cores at work they may take.
MANY_SPLITS, UNEVEN = 8, 1.2


def balanced(df: DataFrame) -> DataFrame:
    """A scan whose splits would leave cores without work, dealt out evenly; any other one as it is.

    For work that takes far longer than a shuffle of its rows: a split may hold
    no row group, and sixteen even ones keep twelve cores busy for two rounds.
    Only counts are read for it, from the footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= MANY_SPLITS * cores:
        return df
    if splits >= cores:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        ends = [0] * cores
        for n in sorted(rows, reverse=True):
            heapq.heapreplace(ends, ends[0] + n)
        if max(ends) * cores <= UNEVEN * sum(rows):
            return df
    return df.repartition(4 * cores if splits >= cores else cores)


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, text): a row for each file, its content as it is."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, replaced): files decoded as UTF-8; ``replaced`` counts the bytes that were not."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    bad = (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).cast("long")
    return raw.select("path", text.alias("text"), bad.alias("replaced"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled passages, an object a line; blank lines are skipped."""
    return spark.read.schema(model.CORPUS).option("mode", "FAILFAST").json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.REQUEST).json(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of document events from JSON files."""
    return spark.readStream.schema(model.DOCUMENT_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
