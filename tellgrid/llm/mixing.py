"""Mixing sources to target weights by cube-method balanced sampling (operator 5).

Every document gets whole copies (the integer part of its source's rate) and
one more with an inclusion probability (the fractional part).  The flight
phase moves these probabilities through the null space of two balancing
constraints, words and documents of the source, until at most two of a block
are undecided.  Blocks are bounded in rows; their leftovers meet in blocks of
the next flight, level by level, until a source is one block, whose last two
units are landed by the rounding that comes nearest to the target.

Defined results: a null text has size 0; a very long text is one unit; null
sources are one source, ordered last; documents of size 0 take 0; an empty
table gives an empty result; repeated rows are separate units, and ties of
their hashes are broken by id and size; the order of rows and the partitioning
do not change the result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellgrid.llm.common import WORD, cut, small_batches, text_or_empty

#: Weights by the rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MOST = 3
#: Rows of one flight block; a large source has many blocks.
BLOCK = 2_000
#: Sources up to which their table (two numbers each) is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_EPS = 1e-9


def words(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, held at ``most`` times a source's size.

    With sources sorted by the level at which they reach their bound, the ones
    before the first whose share at the common level stays below it are bound.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    lv = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("bound", F.col("cap") / F.col("w"))
    by = Window.orderBy("bound", "rank")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("bound", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lv = lv.withColumn("all", F.sum("source_size").over(everything)).withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    lv = lv.withColumn("final", F.first(F.when(F.col("level") <= F.col("bound"), F.col("level")), ignorenulls=True).over(everything))
    return lv.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("w"), "cap")).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Cube flight: balances sum(size) and the number of units; at most two stay fractional.

    ``unit`` holds a hash of each unit, which throws its coins.
    """
    unit = unit.tolist()
    out = p.copy()
    live: list[int] = []
    for i in range(len(out)):
        if _EPS < out[i] < 1 - _EPS:
            live.append(i)
        else:
            out[i] = round(out[i])
        while len(live) == 3:
            a, b, c = live
            # the vector orthogonal to (1, 1, 1) and to the sizes
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - out[k]) / v if v > 0 else -out[k] / v) for k, v in zip(live, u, strict=True) if v)
            down = min((out[k] / v if v > 0 else (out[k] - 1) / v) for k, v in zip(live, u, strict=True) if v)
            # the side is fixed by the units themselves, so reruns agree
            step = up if _coin(unit[a], unit[b], unit[c]) * (up + down) < down else -down
            for k, v in zip(live, u, strict=True):
                out[k] = min(1.0, max(0.0, out[k] + step * v))
                if out[k] < _EPS or out[k] > 1 - _EPS:
                    out[k] = round(out[k])
            live = [k for k in live if 0 < out[k] < 1]
    return out


def _coin(*key: int) -> float:
    """A number in [0, 1) that depends on the key alone."""
    h = 0x9E3779B97F4A7C15
    for k in key:
        h = ((h ^ (k & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return (h >> 11) / 2**53


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round what a flight left (two units at most) so that the sum of sizes stays nearest."""
    out = p.copy()
    free = np.flatnonzero((out > 0) & (out < 1))
    want, best = float((out[free] * size[free]).sum()), None
    for bits in range(1 << len(free)):
        pick = np.array([(bits >> j) & 1 for j in range(len(free))], float)
        miss = abs(float((pick * size[free]).sum()) - want)
        if best is None or miss < best[0] - 1e-12:
            best = (miss, pick)
    if len(free):
        out[free] = best[1]
    return out


_FLOWN = "doc_id long, size long, source string, unit long, whole long, p double, rows long"


def _flight(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["unit", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
    return pdf.assign(p=fly(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), pdf["unit"].to_numpy()))[["doc_id", "size", "source", "unit", "whole", "p", "rows"]]


def _landing(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _flight(pdf)
    return pdf.assign(p=land(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, unit (a hash of id and text)."""
    unit = F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col)).alias("unit")
    sizes = cut(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), words(text_col).alias("size"), F.col(source_col).cast("string").alias("source"), unit))
    per_source = cut(source_targets(sizes, weights, most).join(sizes.groupBy(F.col("source").alias("s2")).agg(F.count("*").alias("rows")), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    seen = per_source.agg(F.count("*").alias("n"), F.max("rows").alias("rows")).first()
    side = per_source.withColumnRenamed("source", "s")
    side = F.broadcast(side) if seen["n"] <= BROADCAST_SOURCES else side
    rows = sizes.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    open_ = rows.withColumn("rate", rate).select("doc_id", "size", "source", "unit", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), "rows")
    decided = (F.col("p") == 0) | (F.col("p") == 1)
    # a level leaves two units of a block at most, so their number falls by a thousand each time
    done, left, level = [], seen["rows"] or 0, 0
    while left > block or not level:
        chunk = F.pmod(F.xxhash64("unit", F.lit(17 + level)), F.ceil(F.col("rows") / F.lit(block))).alias("chunk")
        flown = cut(open_.groupBy("source", chunk).applyInPandas(lambda pdf: _flight(pdf), _FLOWN))
        done.append(flown.where(decided))
        open_ = flown.where(~decided).withColumn("rows", 2 * F.ceil(F.col("rows") / F.lit(block)))
        left, level = 2 * -(-left // block), level + 1
    done.append(open_.groupBy("source").applyInPandas(_landing, _FLOWN))
    out = reduce(DataFrame.unionByName, done).withColumn("copies", F.col("whole") + F.col("p").cast("long")).drop("rows")
    out = out.join(side, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "unit")
