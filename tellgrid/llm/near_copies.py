"""Near copies by exact Jaccard similarity of word shingles (the pipeline's near-dedup).

Two texts are linked when the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; components are joined over all links.  No link is
lost to a fingerprint: 64 bits differ in about ten places at 0.8, which no
small radius reaches.

* Prefix filter.  In any one order of all shingles, the first
  n - ceil(0.8 n) + 1 of two similar sets share one.  The order here is: lone
  shingles, shared ones by how many texts have them, and last those that a
  sample shows to be common.  So a passage that many texts share makes no
  candidates of texts that differ elsewhere.
* A shingle is shared when two texts have it among their early ones (the
  first part of a set by hash).  A text whose early lone shingles fill its
  prefix has no near copy: a similar text would have one of them among its own
  early ones (the parts are cut so that this holds at any two sizes), and then
  that one were shared.  The other texts are the suspects; only their further
  shingles are looked up, and only their sets are kept.
* Links of operator 6 (fingerprints of the same shingles within three bits)
  are candidates, as are a few pairs of each prefix shingle: every text with
  the smallest one, and with its neighbours in an order of the shingle's own.
  What the exact check confirms gives first components; then all pairs of
  different components that share a prefix shingle are checked.
* Candidates whose parity bits differ in more places than two such sets can
  differ in elements go before the exact check; this loses no pair either.

Shingles are compared by 64-bit hashes, texts are named by theirs.

Defined results: blank and null texts are copies of each other; a text of
fewer words than a shingle is one shingle; a very long text is compared whole;
null ids never name a component unless all its ids are null; ties of ids go to
the smaller hash; repeated rows are returned each; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.common import cut, forget, shards, sliced, small_batches, text_or_empty
from tellgrid.llm.components import components
from tellgrid.llm.simhash import SEED, SLICE, links, shingle_hashes, voted

#: Words of a shingle, least similarity as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: About so many documents show which shingles are common; so many of these are told to the workers.
SAMPLE_ROWS, COMMON = 10_000, 100_000
#: Texts to be compared up to which their names are broadcast; more are joined by a shuffle.
NAMED = 500_000
#: Candidate pairs that a shard holds before it hands them on, and shingles of a shard.
HELD, SHARD = 1 << 20, 1 << 21
#: Sets of up to so many shingles are early as a whole.
SMALL = 16
#: Neighbours of each text in a prefix shingle's own order that are candidates at once.
NEIGHBOURS = 4
#: Least bits of a parity; so many of it are compared inside a shard.
PARITY = 512


def prefix_size(n: int, least: tuple[int, int] = LEAST) -> int:
    """How many first shingles of a set of ``n`` share one with those of any similar set."""
    return n + least[0] * n // -least[1] + 1


def early_sizes(n: int, least: tuple[int, int] = LEAST) -> tuple[int, int]:
    """How many first shingles (by hash) of a set are early, and among how many of them its prefix is looked for.

    With t the similarity, one of the first b(n) of a set is among the first
    e(m) of a similar one, which has at most (m - t n) / (1 + t) others before
    it: this holds for e(n) = a n and b(n) = (a - (1 - t)) n / t, if a is at
    most 1 / (1 + t).  Here a = 2.25 (1 - t).
    """
    p, q = least
    if 9 * (q * q - p * p) > 4 * q * q:
        return n, n
    early = n if p * n <= q * SMALL else min(n, -(-9 * (q - p) * n // (4 * q)))
    return early, n if n <= SMALL else 5 * (q - p) * n // (4 * p)


def _set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, shingle, SEED).view(np.int64))


def _hashes(docs: DataFrame, shingle: int) -> DataFrame:
    """node, set, parity: the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            sets = [_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.binary())], names=["node", "set", "parity"])

    return docs.select("node", "text").mapInArrow(run, "node long, set array<long>, parity binary")


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that are common in a sample of the texts."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    seen = _hashes(docs.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0), shingle).select(F.explode("set").alias("h"))
    rows = seen.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, n = np.array([r["h"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _found(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``h`` stands in the sorted ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def parity(h: np.ndarray) -> bytes:
    """For each low-bit value of the hashes whether an odd number has it; ``PARITY`` values or the power of two from the number of hashes."""
    bits = max(PARITY, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount(h & np.int64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the elements that are in one of two sets only, from their parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))  # the longer one folds to the shorter one's values
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _nodes(docs: DataFrame, common: np.ndarray, shingle: int, least: tuple[int, int]) -> DataFrame:
    """doc_id, node, fp, n (distinct shingles), parity, slack (shared shingles that its first early ones may have beside its prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            fps, sizes, odd, slack = [], [], [], []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t, shingle, SEED)
                fps.append(voted(h))
                h = np.unique(h.view(np.int64))
                sizes.append(len(h))
                odd.append(parity(h))
                first = early_sizes(len(h), least)[1]
                slack.append(first - int(_found(h[:first], common)[1].sum()) - prefix_size(len(h), least))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), pa.array(slack, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "n", "parity", "slack"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, fp long, n int, parity binary, slack int")


_PACKED = "shard int, h binary, node binary, told binary"


def _packed(h: np.ndarray, node: np.ndarray, told: np.ndarray, parts: int) -> pa.RecordBatch:
    """Shingles with a number of 8 and one of 4 bytes each, dealt by hash: a row for each shard instead of one for each shingle."""
    shard = ((h.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)) if len(shard) else np.zeros(0, int)
    starts = np.concatenate(([0], ends[:-1])).astype(int) if len(ends) else ends
    bins = [[x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] for x in (h[order], node[order], told[order].astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(shard[starts], pa.int32()), *[pa.array(b, pa.binary()) for b in bins]], names=["shard", "h", "node", "told"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of a shard: its size is bounded by the number of shards."""
    got: list[list[bytes]] = [[], [], []]
    for batch in batches:
        for out, name in zip(got, ("h", "node", "told"), strict=True):
            out += batch.column(batch.schema.get_field_index(name)).to_pylist()
    return tuple(np.frombuffer(b"".join(x), kind) for x, kind in zip(got, (np.int64, np.int64, np.int32), strict=True))


def _early(docs: DataFrame, common: np.ndarray, shingle: int, least: tuple[int, int], parts: int) -> DataFrame:
    """The early shingles of all texts, but common ones, packed; told: whether it is one of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            hs, nodes, firsts = [], [], []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _set(t, shingle)
                early, first = early_sizes(len(h), least)
                lone = ~_found(h[:early], common)[1]
                hs.append(h[:early][lone])
                firsts.append((np.arange(early) < first)[lone])
                nodes.append(np.full(len(hs[-1]), node, np.int64))
            yield _packed(np.concatenate(hs), np.concatenate(nodes), np.concatenate(firsts), parts)

    return docs.select("node", "text").mapInArrow(run, _PACKED)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's early shingles that several texts have: node, h, first, df (how many have it)."""
    h, node, first = _unpacked(batches)
    order = np.lexsort((node, h))
    h, node, first = h[order], node[order], first[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # equal texts are one
    h, node, first = h[new], node[new], first[new]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    size = np.diff(np.append(start, len(h)))
    df = np.repeat(size, size)
    keep = np.flatnonzero(df > 1)
    for lo in range(0, len(keep), HELD):
        k = keep[lo : lo + HELD]
        yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(h[k]), pa.array(first[k] > 0), pa.array(df[k].astype(np.int32))], names=["node", "h", "first", "df"])


def _further(sets: DataFrame, common: np.ndarray, least: tuple[int, int], parts: int) -> DataFrame:
    """The suspects' shingles that are not early, packed; told: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for node, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = s.values.to_numpy()
                h = h[early_sizes(len(h), least)[0] :]
                hs.append(h[~_found(h, common)[1]])
                nodes.append(np.full(len(hs[-1]), node, np.int64))
            h = np.concatenate(hs)
            yield _packed(h, np.concatenate(nodes), np.zeros(len(h)), parts)

    return sets.select("node", "set").mapInArrow(run, _PACKED)


def _known(shared: DataFrame, parts: int) -> DataFrame:
    """The shared shingles, packed (some more than once); told: how many texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, df = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            h, at = np.unique(h, return_index=True)
            yield _packed(h, np.zeros(len(h), np.int64), df[at], parts)

    return shared.select("h", "df").mapInArrow(run, _PACKED)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard's further shingles, those that are shared: node, h, df."""
    h, node, df = _unpacked(batches)
    known, at = np.unique(h[df > 0], return_index=True)
    df, h, node = df[df > 0][at], h[df == 0], node[df == 0]
    at, hit = _found(h, known)
    keep = np.flatnonzero(hit)
    for lo in range(0, len(keep), HELD):
        k = keep[lo : lo + HELD]
        yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(h[k]), pa.array(df[at[k]].astype(np.int32))], names=["node", "h", "df"])


def prefix(h: np.ndarray, shared: np.ndarray, df: np.ndarray, common: np.ndarray, counts: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The first shingles of a set in the order of the prefix filter; ``shared`` is sorted."""
    key = np.zeros(len(h), np.int64)
    at, hit = _found(h, shared)
    key[hit] = df[at[hit]]
    at, hit = _found(h, common)
    key[hit] = (1 << 40) + counts[at[hit]]
    return h[np.lexsort((h, key))][: prefix_size(len(h), least)] if len(h) else h


def _prefixes(sets: DataFrame, common: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> DataFrame:
    """(node, set, parity, shared: array of (h, df)) -> node, n, at, h, parity: the prefix of each suspect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ns, ats, hs, odd = [], [], [], [], []
            for node, s, bits, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                h = s.values.to_numpy()
                if known.is_valid:
                    k, df = (known.values.field(i).to_numpy() for i in (0, 1))
                    k, first = np.unique(k, return_index=True)
                    df = df[first]
                else:
                    k = df = np.zeros(0, np.int64)
                own = prefix(h, k, df, common, counts, least)
                nodes.append(np.full(len(own), node, np.int64))
                ns.append(np.full(len(own), len(h), np.int32))
                ats.append(np.arange(len(own), dtype=np.int32))
                hs.append(own)
                odd += [_folded(np.frombuffer(bits, np.uint64), PARITY // 64).tobytes()] * len(own)
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in (nodes, ns, ats, hs)], pa.array(odd, pa.binary())], names=["node", "n", "at", "h", "parity"])

    return sets.select("node", "set", "parity", "shared").mapInArrow(run, "node long, n int, at int, h long, parity binary")


class _Shard:
    """A shard's entries of prefix shingles, and the pairs of them that may be similar."""

    def __init__(self, pdf: pd.DataFrame, least: tuple[int, int]) -> None:
        self.least = least
        self.h, self.node = pdf["h"].to_numpy(), pdf["node"].to_numpy()
        self.n, self.at = pdf["n"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
        self.odd = np.frombuffer(b"".join(pdf["parity"]), np.uint64).reshape(len(pdf), PARITY // 64)
        self.held: list[pd.DataFrame] = []

    def offer(self, i: np.ndarray, j: np.ndarray) -> Iterator[pd.DataFrame]:
        """Hold the pairs whose sizes, places of the shingle and parities allow the similarity; yields when many are held."""
        p, q = self.least
        n, at = self.n, self.at
        both = n[i] + n[j]
        may = (q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j])) & ((p + q) * np.minimum(n[i] - at[i], n[j] - at[j]) >= p * both)
        i, j, both = i[may], j[may], both[may]
        near = (q + p) * np.bitwise_count(self.odd[i] ^ self.odd[j]).sum(axis=1, dtype=np.int64) <= (q - p) * both
        i, j = i[near], j[near]
        if len(i):
            self.held.append(pd.DataFrame({"a": np.minimum(self.node[i], self.node[j]), "b": np.maximum(self.node[i], self.node[j])}))
            if sum(map(len, self.held)) > HELD:
                self.held = [pd.concat(self.held).drop_duplicates()]
                if len(self.held[0]) > HELD // 2:
                    yield self.held.pop()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.held:
            yield pd.concat(self.held).drop_duplicates()


def _few_pairs(frames: Iterator[pd.DataFrame], least: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """a, b: each entry with the smallest text of its shingle, and with the next ones in an order of the shingle's own.

    These are few, and join nearly all of a group whose members are mostly
    similar, in whatever way: every prefix shingle brings other neighbours.
    """
    got = list(frames)  # one shard: a bounded share of the entries
    if not got:
        return
    pdf = pd.concat(got)
    with np.errstate(over="ignore"):
        turn = ((pdf["node"].to_numpy() ^ pdf["h"].to_numpy()).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)
    pdf = pdf.iloc[np.lexsort((turn, pdf["h"].to_numpy()))]
    shard = _Shard(pdf, least)
    start = np.concatenate(([0], np.flatnonzero(shard.h[1:] != shard.h[:-1]) + 1))
    size = np.diff(np.append(start, len(pdf)))
    by_node = np.lexsort((shard.node, shard.h))  # the same runs, smallest text first
    everyone = np.arange(len(pdf))
    yield from shard.offer(np.repeat(by_node[start], size), everyone)
    for shift in range(1, NEIGHBOURS + 1):
        i = everyone[: len(pdf) - shift]
        i = i[shard.h[i] == shard.h[i + shift]]
        yield from shard.offer(i, i + shift)
    yield from shard.rest()


def cross_pairs(pdf: pd.DataFrame, least: tuple[int, int] = LEAST) -> Iterator[pd.DataFrame]:
    """a, b: all texts of different roots that share a shingle and may be similar."""
    p, q = least
    pdf = pdf.sort_values(["h", "n"])
    shard, root = _Shard(pdf, least), pdf["root"].to_numpy()
    i, shift = np.arange(len(pdf)), 1
    while len(i):
        i = i[i + shift < len(pdf)]
        j = i + shift
        # sizes rise within a shingle: a text that is too large stays so
        i = i[(shard.h[i] == shard.h[j]) & (q * shard.n[i] >= p * shard.n[j])]
        apart_ = i[root[i] != root[i + shift]]
        yield from shard.offer(apart_, apart_ + shift)
        shift += 1
    yield from shard.rest()


def _alike(pairs: DataFrame, suspects: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs of suspects whose shingle sets have the similarity."""
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, pa_, pb = (c.to_pylist() for c in batch.columns)
            # |A ^ B| is at most (q - p) / (q + p) of |A| + |B|
            may = [(q + p) * apart(x, y) <= (q - p) * (m + n) for m, n, x, y in zip(na, nb, pa_, pb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: suspects.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{q} * least(na, nb) >= {p} * greatest(na, nb)")
    pairs = cut(pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    met = F.size(F.array_intersect("sa", "sb"))
    linked = cut(both.where((p + q) * met >= p * (F.size("sa") + F.size("sb"))).select("a", "b"))
    forget(pairs)
    return linked


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per input row: doc_id, component_id, component_size, node (a hash of the text), kept.

    ``kept`` is true for one text of a component: the one of the smallest id, null
    ids last, then of the smallest hash (and for each row that repeats its id and text).
    """
    spark = small_batches(docs).sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("node", F.xxhash64("text"))
    common, counts = _common(rows, shingle)
    nodes = cut(_nodes(rows, common, shingle, least))
    one_each = nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "parity", "slack")])
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = shards(spark, total, SHARD)
    deal = lambda packed: packed.repartition(parts, "shard")
    shared = cut(deal(_early(rows, common, shingle, least, 4 * parts)).mapInArrow(_shared, "node long, h long, first boolean, df int"))
    met = shared.where("first").groupBy("node").agg(F.count("*").alias("met"))
    suspects = cut(one_each.join(met, "node", "left").where("coalesce(met, 0) > slack").select("node", "n", "parity"))
    names = suspects.select("node")
    named = rows.join(F.broadcast(names) if names.count() <= NAMED else names, "node", "left_semi")
    sets = cut(_hashes(named.dropDuplicates(["node"]), shingle))
    # which of the suspects' shingles are shared
    more = deal(_further(sets, common, least, 4 * parts).unionByName(_known(shared, 4 * parts))).mapInArrow(_looked_up, "node long, h long, df int")
    of_node = shared.join(names, "node", "left_semi").select("node", "h", "df").unionByName(more).groupBy("node").agg(F.collect_list(F.struct("h", "df")).alias("shared"))
    entries = cut(_prefixes(sets.join(of_node, "node", "left"), common, counts, least))
    forget(shared)
    # candidates of operator 6: equal fingerprints, and links of the distinct ones
    of_fp = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(of_fp, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    name = lambda c: of_fp.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = links(of_fp.select("fp")).join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    few = entries.repartition(parts, "h").mapInPandas(lambda frames: _few_pairs(frames, least), "a long, b long")
    first = _alike(same.unionByName(near).unionByName(few), suspects, sets, least)
    comp = components(first)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(frames)
        if got:
            yield from cross_pairs(pd.concat(got), least)

    told = entries.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _alike(told.repartition(parts, "h").mapInPandas(run, "a long, b long"), suspects, sets, least)
    if not rest.isEmpty():
        comp = components(first.unionByName(rest))
    member = cut(nodes.select("doc_id", "node").join(comp, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")))
    first_of = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("w")
    tops = member.groupBy("root").agg(first_of, F.count("*").alias("component_size"))
    tops = tops.select("root", F.col("w.doc_id").alias("component_id"), F.col("w.node").alias("top"), "component_size")
    forget(nodes, suspects, sets, entries, of_fp, first, rest)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("top"))
    return member.join(tops, "root").select("doc_id", "component_id", "component_size", "node", kept.alias("kept"))
