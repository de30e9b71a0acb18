"""SimHash near-dedup with a Gray-order hierarchical index (operator 6).

A fingerprint bit is set when it is set in over half of the 64-bit hashes of
the text's word shingles.  Distinct fingerprints are dealt by each of four
16-bit blocks: two within three bits agree in one of them at least.  A shard
sorts its fingerprints by the Gray rank of the other 48 bits; equal leading
bytes of that order form the upper nodes of a tree.  Pairs of nodes descend
together, accumulate the differing bits of the bytes passed, and whole groups
are pruned once these exceed the limit.  A shard returns a spanning forest of
its links, and components are joined over all shards.

A block value that very many distinct fingerprints share is dealt further, by
four 12-bit parts of the other bits, of which again one agrees.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; equal fingerprints are one class; null ids never name a component
unless all its ids are null; repeated rows are returned each; an empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.common import cut, partitions, sliced
from tellgrid.llm.components import components

#: Words of a shingle, bits in which linked fingerprints may differ, seed of the hash.
SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Distinct fingerprints of one block value from which it is dealt further.
HOT = 20_000
#: Pairs of nodes expanded at once.
FRONTIER = 1 << 20
SLICE = 2 << 20
_spaces = re.compile(rb"[\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The unsigned 64-bit hash of each word shingle; a text of fewer words is one shingle, a blank one has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def voted(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return voted(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            fp = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each 64-bit pattern in Gray order."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Forest:
    """Vectorised union by smallest index."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            two = self.up[self.up]
            if np.array_equal(two, self.up):
                return two
            self.up = two

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if len(a):
                np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def link_shard(key: np.ndarray, fp: np.ndarray, turn: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints (unsigned) of the same key within ``distance`` bits.

    ``turn``: by how many bits the block that is equal within a key is rotated to the top.
    """
    turned = (fp << turn) | np.where(turn > 0, fp >> ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
    rest = turned << np.uint64(16)
    order = np.lexsort((gray_rank(rest), key))
    key, fp, rest = key[order], fp[order], rest[order]
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    forest = Forest(n)
    # nodes of each level: runs of equal key and leading bytes, contiguous in Gray order
    new = np.concatenate(([True], key[1:] != key[:-1]))
    starts = [np.flatnonzero(new)]
    octets = []
    for level in range(6):
        octet = ((rest >> np.uint64(56 - 8 * level)) & np.uint64(255)).astype(np.uint8)
        new = new | np.concatenate(([True], octet[1:] != octet[:-1]))
        starts.append(np.flatnonzero(new))
        octets.append(octet[starts[-1]])
    same = np.searchsorted(starts[-1], np.arange(n), "right") - 1
    forest.link(starts[-1][same], np.arange(n))
    first = [np.searchsorted(starts[level + 1], starts[level]) for level in range(6)]
    count = [np.diff(np.append(first[level], len(starts[level + 1]))) for level in range(6)]
    roots = np.arange(len(starts[0]))
    stack = [(0, roots, roots, np.zeros(len(roots), np.uint8))]
    while stack:
        level, a, b, d = stack.pop()
        if level == 6:
            apart = a != b
            forest.link(starts[6][a[apart]], starts[6][b[apart]])
            continue
        na, nb = count[level][a], count[level][b]
        total = np.cumsum(na * nb)
        if total[-1] > FRONTIER and len(a) > 1:
            half = min(max(1, int(np.searchsorted(total, total[-1] // 2))), len(a) - 1)
            stack += [(level, a[half:], b[half:], d[half:]), (level, a[:half], b[:half], d[:half])]
            continue
        pair = np.repeat(np.arange(len(a)), na * nb)
        within = np.arange(len(pair)) - np.repeat(total - na * nb, na * nb)
        width = nb[pair]
        ca = first[level][a[pair]] + within // width
        cb = first[level][b[pair]] + within % width
        nd = d[pair] + _POP[octets[level][ca] ^ octets[level][cb]]
        keep = (nd <= distance) & (ca <= cb)
        if keep.any():
            stack.append((level + 1, ca[keep], cb[keep], nd[keep]))
    root = forest.roots()
    linked = root != np.arange(n)
    return fp[linked], fp[root[linked]]


def links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """a, b: links whose components are those of all pairs of ``fp`` within ``distance`` (at most 3) bits."""
    if distance > 3:
        raise ValueError("four blocks find up to three differing bits")
    spark = fps.sparkSession
    block = lambda c, at, width: F.shiftrightunsigned(c, 64 - at - width).bitwiseAND((1 << width) - 1)
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), block(F.col("fp"), 16 * r, 16).alias("v")) for r in range(4)])).alias("k")).select("fp", "k.r", "k.v")
    # at most 4 * (number of fingerprints) / hot values are hot; a value has 16 bits, so never more than 262,144
    heavy = dealt.groupBy("r", "v").count().where(F.col("count") > hot).select(F.col("r").alias("hr"), F.col("v").alias("hv"))
    marked = dealt.join(F.broadcast(heavy), (F.col("r") == F.col("hr")) & (F.col("v") == F.col("hv")), "left")
    turned = F.expr("shiftleft(fp, 16 * r + 16) | shiftrightunsigned(fp, 48 - 16 * r)")
    turned = F.when(F.col("r") == 3, F.col("fp")).otherwise(turned)  # the other 48 bits on top
    finer = F.array(*[F.struct(F.lit(s).alias("s"), block(F.col("t"), 12 * s, 12).alias("w")) for s in range(4)])
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("w")))
    keyed = marked.withColumn("t", turned).select("fp", "r", "v", F.explode(F.when(F.col("hr").isNotNull(), finer).otherwise(whole)).alias("k"))
    keyed = keyed.select("fp", (F.lit(16) * F.col("r")).alias("turn"), F.xxhash64("r", "v", "k.s", "k.w").alias("key"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(frames)  # one shard: a bounded share of the distinct fingerprints
        if got:
            pdf = pd.concat(got)
            a, b = link_shard(pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["turn"].to_numpy().astype(np.uint64), distance)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.repartition(partitions(spark), "key").mapInPandas(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, component_size."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes)
    comp = components(links(classes.select("fp"), distance))
    member = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    member = cut(member)
    tops = member.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("component_size"))
    of_fp = member.join(tops, "root").select(F.col("fp").alias("f"), "component_id", "component_size")
    out = fps.join(of_fp, fps["fp"] == of_fp["f"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")
