"""Exact dedup by content sort (operator 8).

Texts are equal when they are identical after each run of ASCII white space
became one space.  Rows are range-partitioned on (leading normalised bytes,
content hash, id, the input's partition) with splitters that Spark samples,
sorted externally inside each range, and neighbours are then compared in full.
Id and partition are in the range key, so a group of copies of any size is
spread over as many ranges as its share of the rows asks for, rows that repeat
their id too; runs that touch a range's edge (two per range at most), and the
stretches of very long runs, are stitched together afterwards by their SHA-256.

Defined results: a null text counts as empty; a very long text is compared
whole; of equal texts the row with the smallest id stays, null ids come last;
of rows that repeat one id and text exactly one stays; an empty table gives an
empty result; other columns of the input are neither read nor returned (but
for :func:`kept_rows`, which returns the rows that stay as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tellgrid.llm.common import SPACE, cut, partitions, small_batches, text_or_empty

#: Leading characters of the normalised text that order the ranges.
PREFIX = 48
#: Rows of a run that are held; a longer one goes on as another, and is stitched.
HELD = 1 << 20

_RUNS = "id long, sha string, first_id long, n long, head boolean, edge boolean, place long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted range; holds the ids of one run and one batch.

    A column ``row``, if there is one, goes on with the first row of each run.
    """
    part = -1
    open_ids: list[pa.Array] = []
    open_norm = open_sha = open_row = None
    held, seen, first = 0, 0, True

    def told(ids: pa.Array, shas: pa.Array, starts: np.ndarray, edges: np.ndarray, rows: pa.Array | None) -> pa.RecordBatch:
        nonlocal seen
        n = len(ids)
        lengths = np.diff(np.append(starts, n))
        head = np.zeros(n, bool)
        head[starts] = True
        seen += n
        columns = {
            "id": ids,
            "sha": shas,
            "first_id": ids.take(pa.array(np.repeat(starts, lengths))),
            "n": pa.array(np.repeat(lengths, lengths), pa.int64()),
            "head": pa.array(head),
            "edge": pa.array(np.repeat(edges, lengths)),
            "place": pa.array((part << 40) + np.arange(seen - n, seen)),  # of no other row
        }
        if rows is not None:
            at = np.full(n, -1)
            at[starts] = np.arange(len(starts))
            columns["row"] = rows.take(pa.array(at, mask=at < 0))
        return pa.RecordBatch.from_pydict(columns)

    def close(edge: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(open_ids)
        return told(ids, pa.array([open_sha] * len(ids), pa.string()), np.array([0]), np.array([edge]), open_row)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        ids, sha, norm = (batch.column(names.index(k)) for k in ("id", "sha", "norm"))
        row = batch.column(names.index("row")) if "row" in names else None
        part = batch.column(names.index("part"))[0].as_py()
        new = np.ones(batch.num_rows, bool)
        new[1:] = ~pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        new[0] = open_norm is None or norm[0].as_py() != open_norm
        starts = np.flatnonzero(new)
        if starts.size == 0 or starts[0]:
            some = ids[: starts[0]] if starts.size else ids
            open_ids.append(some)
            held += len(some)
        if not starts.size:
            if held > HELD:
                yield close(True)
                open_ids, held, first, open_norm = [], 0, True, None
            continue
        if open_ids:
            yield close(first)
            first = False
        last = int(starts[-1])
        if len(starts) > 1:
            edges = np.zeros(len(starts) - 1, bool)
            edges[0] = first
            first = False
            at = pa.array(starts[:-1])
            yield told(ids[starts[0] : last], sha[starts[0] : last], starts[:-1] - starts[0], edges, None if row is None else row.take(at))
        open_ids, open_sha, open_norm, open_row, held = [ids[last:]], sha[last].as_py(), norm[last].as_py(), None if row is None else row[last : last + 1], len(ids) - last
    if open_ids:
        yield close(True)


def _stitched(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """The runs of all ranges, of each row: id, sha, keep_id, group_size, kept (and ``row`` of rows that stay)."""
    spark = small_batches(docs).sparkSession
    norm = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"), F.spark_partition_id().alias("pid"), *([F.struct("*").alias("row")] if carry else []))
    rows = rows.select("id", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.substring("norm", 1, PREFIX).alias("prefix"), "pid", "row" if carry else "norm")
    ranged = rows.repartitionByRange(partitions(spark), "prefix", "sha", F.col("id").asc_nulls_last(), "pid")
    if carry:  # the text is shuffled once
        ranged = ranged.withColumn("norm", F.regexp_replace(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")), SPACE, " "))
    ranged = ranged.sortWithinPartitions("prefix", "sha", "norm", F.col("id").asc_nulls_last())
    schema = _parse_datatype_string(_RUNS)
    if carry:
        schema = StructType([*schema.fields, StructField("row", StructType([StructField(f.name, f.dataType) for f in docs.schema]))])
    told = ranged.select("id", "sha", "norm", F.spark_partition_id().alias("part"), *(["row"] if carry else [])).mapInArrow(_runs, schema)
    # only heads can stay
    runs = cut(told.where("head or edge")) if carry else cut(told)
    # Runs at the edges of ranges, two a range at most, and the stretches of very long ones: a bounded table.
    joined = (
        runs.where("edge and head")
        .groupBy("sha")
        .agg(F.min(F.struct(F.col("first_id").isNull().alias("o"), F.col("first_id").alias("id"), F.col("place").alias("place"))).alias("w"), F.sum("n").alias("total"))
        .select(F.col("sha").alias("e_sha"), F.col("w.id").alias("e_id"), F.col("w.place").alias("e_place"), "total")
    )
    out = runs.join(F.broadcast(joined), F.col("edge") & (F.col("sha") == F.col("e_sha")), "left")
    stitched = F.col("total").isNotNull()
    return out.select(
        "id",
        "sha",
        F.when(stitched, F.col("e_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        (F.col("head") & (~stitched | (F.col("place") == F.col("e_place")))).alias("kept"),
        *(["row"] if carry else []),
    )


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    out = _stitched(docs, id_col, text_col, carry=False)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return _stitched(docs, id_col, text_col, carry=True).where("kept").select("row.*")
