"""Exact top-k search by Fagin's threshold algorithm (operator 3).

Candidates are dealt to tiles.  A tile's lists, its candidates sorted by each
dimension, are built once and written with it.  Queries pass the tiles in
blocks of bounded size: a task takes a block past its tiles one after the
other and keeps each query's best so far, so the kth score of earlier tiles is
the bound that later ones start with.

In a tile a query reads the lists in the direction of its signs, level by
level (32 entries of each list, then four times as many).  What a level meets
is scored in full.  The threshold at a level is the query's product with the
lists' values there; as no unseen candidate can score higher, the query stops
once the threshold is below its kth score, which may be before it reads
anything.  The level at which the known kth score would stop it is read at
once.  Only results, k for each query and task, are shuffled.

Components are quantised to floor(scale * x).  Scores are exact integers: sums
stay in float32 or float64 only where the magnitudes prove that they are
exact, else they are added as Python integers and held to the range of a long.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part; a shorter vector is padded with zeros; very long
vectors make smaller tiles; rows that repeat an id are candidates each (a
query is not its own candidate: rows of its id are left out), and of its rows
the least vector is the query; ties go to the smaller id; fewer candidates
than k give fewer rows; an empty table gives an empty result; other columns
are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellgrid.llm.common import cut, forget, small_batches

K, SCALE, EVERY = 20, 64, 20
#: Bytes of a tile's and of a block of queries' components.
TILE_BYTES, BLOCK_BYTES = 2 << 20, 32 << 20
#: Entries of each list that the first level reads; each level reads so many times more.
DEPTH, DEEPER = 32, 4


_INT = np.frompyfunc(int, 1, 1)


def _matrix(vectors: list, width: int, scale: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


class Tile:
    """Candidates with their sorted lists: positions by each dimension, ascending."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, order: np.ndarray) -> None:
        self.ids, self.values, self.order = ids, values, order
        n = len(ids)
        depths = [0]
        while depths[-1] < n:
            depths.append(min(n, depths[-1] * DEEPER or DEPTH))
        self.depths = depths
        lists = np.take_along_axis(values.T, order, axis=1)
        # the values at which each level's reading goes on, from the high and from the low end; none is left behind the last
        self.high = np.stack([lists[:, n - 1 - min(t, n - 1)] for t in depths])
        self.low = np.stack([lists[:, min(t, n - 1)] for t in depths])
        self._met: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Tile:
        return cls(ids, values, np.argsort(values.T, axis=1, kind="stable").astype(np.int32))

    def met(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each dimension the bitmap of what is read from the high, and from the low end, down to a level."""
        if level not in self._met:
            n, dims = self.values.shape
            t = self.depths[level]
            out = []
            for part in (self.order[:, n - t :], self.order[:, :t]):
                bits = np.zeros((dims, n), bool)
                np.put_along_axis(bits, part, True, axis=1)
                out.append(np.packbits(bits, axis=1))
            self._met[level] = (out[0], out[1])
        return self._met[level]


class Search:
    """A block of queries on its way past tiles."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int = K) -> None:
        self.ids, self.values, self.k = ids, values, k
        self.score: list[np.ndarray] = [np.zeros(0)] * len(ids)  # of each query's best so far, in their order
        self.best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        #: Candidates scored, passages of a query past a tile, those of them that stopped before the lists ended.
        self.read = self.passed = self.stopped = 0

    def _kth(self, row: int) -> float | None:
        return self.score[row][-1:].tolist()[0] if len(self.score[row]) == self.k else None

    def _take(self, row: int, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge candidates into a query's best; ties go to smaller ids."""
        known = self.score[row]
        if known.dtype != score.dtype:  # tiles of other magnitudes: the wider kind, in which both are exact
            if object in (known.dtype, score.dtype):
                known, score = (x if x.dtype == object else _INT(x.astype(float)) for x in (known, score))
            else:
                known, score = known.astype(float), score.astype(float)
        if len(known) == self.k:
            may = (score >= known[-1]).astype(bool)
            ids, score = ids[may], score[may]
        ids, score = np.concatenate((self.best[row], ids)), np.concatenate((known, score))
        if len(score) > self.k and score.dtype != object:
            cut_off = np.partition(score, len(score) - self.k)[len(score) - self.k]
            ids, score = ids[score >= cut_off], score[score >= cut_off]
        order = np.lexsort((ids, -score))[: self.k] if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k], int)
        self.best[row], self.score[row] = ids[order], score[order]

    def past(self, tile: Tile) -> None:
        q, c = self.values, tile.values
        n, dims = c.shape
        if not n or not len(q):
            return
        most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dims)
        if most < 1 << 53:
            kind = np.float32 if most < 1 << 24 else np.float64
            q, c, high, low = (x.astype(kind) for x in (q, c, tile.high, tile.low))
        else:
            q, c, high, low = (_INT(x) for x in (q, c, tile.high, tile.low))
        # thresholds of all levels: dimensions of positive sign are read from the high end, of negative from the low end
        limits = (high @ np.maximum(q, 0).T + low @ np.minimum(q, 0).T).tolist()
        end = len(tile.depths) - 1
        ends = [np.flatnonzero(tile.ids == i) for i in self.ids] if len(self.ids) < 8 else None
        place = None
        if ends is None:
            by_id = np.argsort(tile.ids, kind="stable")
            at, stop = (np.searchsorted(tile.ids[by_id], self.ids, side) for side in ("left", "right"))
            place = [by_id[a:b] for a, b in zip(at, stop, strict=True)]
        own = ends or place
        self.passed += len(q)

        def aim(row: int, after: int) -> int | None:
            """The next level to read for a query that has read up to ``after``; None where it stops."""
            kth = self._kth(row)
            if kth is None:
                return min(after + 1, end) if after < end else None
            first = next((x for x in range(after, end) if limits[x][row] < kth), end)
            return None if first == after else first

        state = {row: 0 for row in range(len(q))}
        goal = {row: aim(row, 0) for row in state}
        seen: dict[int, np.ndarray] = {}
        while goal:
            for level in sorted({g for g in goal.values() if g is not None}):
                rows = [row for row, g in goal.items() if g == level]
                for lo in range(0, len(rows), 64):
                    some = rows[lo : lo + 64]
                    fresh = [self._fresh(tile, row, level, seen, own[row]) for row in some]
                    # many together in one product, few by themselves
                    whole = [i for i, f in enumerate(fresh) if 4 * len(f) > n]
                    product = dict(zip(whole, q[[some[i] for i in whole]] @ c.T, strict=True)) if whole else {}
                    for i, (row, f) in enumerate(zip(some, fresh, strict=True)):
                        self.read += len(f)
                        self._take(row, tile.ids[f], product[i][f] if i in product else c[f] @ q[row])
                        state[row] = level
            after = {}
            for row, g in goal.items():
                if g is None:
                    self.stopped += state[row] < end
                elif g < end:
                    after[row] = aim(row, g)
            goal = after

    def _fresh(self, tile: Tile, row: int, level: int, seen: dict[int, np.ndarray], own: np.ndarray) -> np.ndarray:
        """Positions that a level meets for the first time, but the query's own."""
        n = len(tile.ids)
        if level == len(tile.depths) - 1:
            bits = np.ones(n, bool)
        else:
            up, down = self.values[row] > 0, self.values[row] < 0
            high, low = tile.met(level)
            bits = np.unpackbits(np.bitwise_or.reduce(np.concatenate((high[up], low[down])), axis=0, initial=np.uint8(0)), count=n).astype(bool)
        bits[own] = False
        new = bits & ~seen[row] if row in seen else bits
        seen[row] = bits
        return np.flatnonzero(new)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids and scores of the best."""
        q = np.repeat(self.ids, [len(b) for b in self.best])
        score = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for s in self.score for x in s]
        return q, np.concatenate([*self.best, np.zeros(0, np.int64)]).astype(np.int64), np.array(score, np.int64)


_OUT = "query_id long, vec_id long, score long"


def _tiles(rows: DataFrame, tiles: int, width: int, scale: int, k: int) -> DataFrame:
    """A row for each tile: ids, quantised components and the order of each list, packed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["n"].clip(upper=k))]  # of equal rows no more than k can be among the best
        tile = Tile.of(pdf["id"].to_numpy(np.int64), _matrix(pdf["v"].tolist(), width, scale))
        return pd.DataFrame({"ids": [tile.ids.tobytes()], "components": [tile.values.tobytes()], "orders": [tile.order.tobytes()]})

    one_each = rows.groupBy("id", "v").agg(F.count("*").alias("n"))
    tile = F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).alias("tile")
    return one_each.groupBy(tile).applyInPandas(run, "ids binary, components binary, orders binary")


def topk(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE, tile_bytes: int = TILE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all rows."""
    spark = small_batches(vectors).sparkSession
    e = F.col("v")
    finite = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & finite)
    asks = F.pmod("id", F.lit(every)) == 0
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("m"), F.max(F.size("v")).alias("width")).first()
    width = size["width"] or 1
    tiles = cut(_tiles(rows, max(1, -(-size["n"] * 8 * width // tile_bytes)), width, scale, k))
    blocks = max(1, -(-size["m"] * 8 * width // block_bytes))
    queries = cut(rows.where(asks).groupBy("id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    found = []
    for b in range(blocks):
        block = queries.where(F.col("block") == b).select("id", "v").collect()  # of bounded size
        told = spark.sparkContext.broadcast((np.array([r["id"] for r in block], np.int64), _matrix([r["v"] for r in block], width, scale)))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            search = Search(*told.value, k)
            for batch in batches:
                for ids, values, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    search.past(Tile(np.frombuffer(ids, np.int64), np.frombuffer(values, float).reshape(-1, width), np.frombuffer(order, np.int32).reshape(width, -1)))
            q, c, score = search.rows()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(score)], names=["query_id", "vec_id", "score"])

        best = tiles.mapInArrow(run, _OUT)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
        found.append(cut(best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)))
        told.destroy()
    forget(tiles, queries)
    return reduce(DataFrame.unionByName, found)
