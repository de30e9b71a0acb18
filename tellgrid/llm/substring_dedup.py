"""Substring dedup with a logarithmic family of suffix arrays (operator 2).

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else.  Every such string (a window) is filed under one of its own
32-byte grams, the one of the smallest hash, so equal windows are filed alike;
neighbouring windows under one gram form a run, the unit that is shuffled.

* Grams that occur once cannot hold a repeat.  Where all runs of a gram are
  alike, all their windows repeat; alike means equal 64-bit hashes, and the
  bytes of these are not compared.
* The rest (edges of repeats, edited copies) is dealt by gram with its bytes.
  A shard reads it in batches: a batch gets a suffix array of its windows,
  which is merge-scanned against the shard's existing levels for matches of
  ``length`` bytes and then added as a level; levels of equal size merge
  geometrically.  All comparisons here are of whole windows.

Where a gram has very many different runs (edits of one text, or whatever
stands beside a passage that very many documents share), these are cut into
pieces, filed by the bytes that a piece's windows have in common.  Pieces that
hold none of the differences are alike and counted; with the last width, four
windows, those of one key differ in three bytes on either side at most.

Runs that are alike are counted before they are shuffled, so a passage that
very many documents share costs a row a task.  A bitmap of fixed size marks
the documents that have a hit; only their texts are joined with their spans.

Defined results: a null text counts as empty; texts shorter than ``length``
bytes lose nothing; rows that repeat id and text are documents of their own
(so each loses what it shares with the other); ties do not arise; an empty
table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.common import cut, forget, shards, sliced, text_or_empty

LENGTH = 200
GRAM = 32
#: Bytes of documents scanned at once; positions must fit in 20 bits, longer documents are cut into overlapping stretches.
BUFFER = 1 << 18
_POSITIONS = 1 << 20
#: Windows of one batch of a shard.
BATCH = 1 << 17
#: Runs that a shard holds at most on average, and different runs of one gram from which they are cut into pieces.
SHARD_RUNS, HOT = 1 << 15, 1 << 10
#: Windows of a piece, from the first cut to the last.
WIDTHS = (32, 4)
#: Bits of the bitmap of documents with a hit.
BITMAP = 1 << 26
_NO_ID = -(1 << 63)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums of which :func:`hashes` takes the hash of any stretch."""
    up, _ = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return sums


def hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = _power(len(sums))
    return _mix((sums[stop] - sums[start]) * down[start])


def find_runs(data: np.ndarray, owner: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """gram hash, run hash, start, windows of each run in a buffer; ``owner`` says whose each byte is."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none
    sums = rolling(data)
    at = np.arange(n - gram + 1)
    g = hashes(sums, at, at + gram)
    key = (g & ~np.uint64(_POSITIONS - 1)) | at.astype(np.uint64)
    w, span = length - gram + 1, 1
    low = key
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: n - length + 1], low[w - span : w - span + n - length + 1])
    pos = (low[: n - length + 1] & np.uint64(_POSITIONS - 1)).astype(np.int64)
    valid = owner[: n - length + 1] == owner[length - 1 :]
    change = np.ones(len(pos), bool)
    change[1:] = (pos[1:] != pos[:-1]) | (owner[1 : len(pos)] != owner[: len(pos) - 1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, len(pos)))
    ok = valid[starts]
    starts, counts = starts[ok], counts[ok]
    return g[pos[starts]], hashes(sums, starts, starts + counts + length - 1), starts, counts


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, owners (positions in ``texts``) and owner's offsets; long texts come in stretches that overlap."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), BUFFER):
            piece = t[lo : lo + BUFFER + length - 1]
            if len(piece) < length:
                continue
            # stretches of one text lie in buffers of their own, so no two are taken for one
            if parts and (held + len(piece) > 2 * BUFFER or parts[-1][0] == i):
                yield _joined(parts)
                parts, held = [], 0
            parts.append((i, lo, piece))
            held += len(piece)
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(p) for _, _, p in parts]
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    owner = np.repeat(np.array([i for i, _, _ in parts]), sizes)
    offset = np.repeat(np.array([lo for _, lo, _ in parts]) - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return data, owner, offset


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            ids, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
            for data, owner, offset in _buffers(texts, length):
                mh, ch, start, count = find_runs(data, owner, length, gram)
                own = owner[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mh.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(ids[own]), pa.array(th[own]), pa.array((start + offset[start]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["mh", "ch", "id", "th", "start", "r"],
                )

    return run


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks, equal values alike."""
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def leads(data: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes (8 at most) from every position as a number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``start`` in the order of their first ``length`` bytes, and the ranks of those bytes, by prefix doubling."""
    width = min(8, length)
    rank = _ranks(leads(data, width))
    while width < length:
        step = min(width, length - width)  # the last step overlaps, so that exactly ``length`` bytes count
        after = np.zeros(len(rank), np.uint64)
        after[: len(rank) - step] = rank[step:]
        rank = _ranks((rank << np.uint64(32)) | after)
        width += step
    rank = rank[start]
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


class LevelFamily:
    """Suffix arrays in levels of doubling size; ``add`` marks the windows that repeat.

    A level holds each different window once, in the order of its bytes.
    """

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.text = np.zeros(0, np.uint8)  # bytes of all batches
        self.repeats = np.zeros(0, bool)  # by window number
        self.starts = np.zeros(0, np.int64)  # a window's first byte
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # first bytes as a number, window numbers

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the bytes of window a[i] are below, equal to or above those of b[i]."""
        out = np.zeros(len(a), np.int8)
        windows = np.lib.stride_tricks.sliding_window_view(self.text, self.length)
        for lo in range(0, len(a), 1 << 14):
            x, y = windows[self.starts[a[lo : lo + (1 << 14)]]], windows[self.starts[b[lo : lo + (1 << 14)]]]
            row = np.arange(len(x))
            first = (x != y).argmax(axis=1)
            x, y = x[row, first], y[row, first]
            out[lo : lo + (1 << 14)] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        return out

    def _scan(self, level: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``level`` of each window of ``new``, both sorted, and whether the window there is equal.

        The merge scan of two suffix arrays for all windows at once: first
        bytes give the stretch, comparisons of whole windows halve it.
        """
        (lead, number), (lead2, own) = level, new
        lo, hi = np.searchsorted(lead, lead2, "left"), np.searchsorted(lead, lead2, "right")
        equal = np.zeros(len(own), bool)
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) // 2
            sign = self._compare(own[left], number[mid])
            equal[left[sign == 0]] = True
            lo[left] = np.where(sign > 0, mid + 1, np.where(sign == 0, mid, lo[left]))
            hi[left] = np.where(sign > 0, hi[left], mid)
            left = left[(lo[left] < hi[left]) & (sign != 0)]
        return lo, equal

    def add(self, contents: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Add a batch of runs (with how often each occurs); returns the numbers of its windows."""
        data = np.frombuffer(b"".join(contents), np.uint8)
        sizes = np.array([len(c) for c in contents])
        windows = sizes - self.length + 1
        first = np.cumsum(sizes) - sizes
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(first, windows) + within
        numbers = np.arange(len(start)) + len(self.starts)
        self.starts = np.concatenate((self.starts, start + len(self.text)))
        self.text = np.concatenate((self.text, data))
        self.repeats = np.concatenate((self.repeats, np.repeat(counts > 1, windows)))
        order, rank = suffix_array(data, start, self.length)
        own = numbers[order]
        head = np.ones(len(own), bool)
        head[1:] = rank[1:] != rank[:-1]
        # equal neighbours of the batch's own suffix array repeat
        self.repeats[own[1:][~head[1:]]] = self.repeats[own[:-1][~head[1:]]] = True
        new = leads(data, min(8, self.length))[start[order[head]]], own[head]
        for level in self.levels:
            at, equal = self._scan(level, new)
            self.repeats[new[1][equal]] = self.repeats[level[1][at[equal]]] = True
        # a window that repeats stays marked through any one copy of it: the others were marked when they met
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            level, new = self.levels[-2:]
            at, equal = self._scan(level, new)
            self.levels[-2:] = [tuple(np.insert(kept, at[~equal], added[~equal]) for kept, added in zip(level, new, strict=True))]
        return numbers


def _shard(length: int):
    """(mh, ch, n, content) of a shard -> (mh, ch, from, to): stretches of repeating windows in each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = LevelFamily(length)
        mhs, chs, windows = [], [], []
        for batch in batches:
            sizes = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            block = np.cumsum(np.maximum(1, sizes - length + 1)) // BATCH
            cuts = [*np.flatnonzero(np.diff(block, prepend=-1)), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                family.add(part.column(3).to_pylist(), part.column(2).to_numpy(zero_copy_only=False))
                mhs.append(part.column(0).to_numpy(zero_copy_only=False))
                chs.append(part.column(1).to_numpy(zero_copy_only=False))
                windows.append(sizes[a:b] - length + 1)
        if not mhs:
            return
        mh, ch, count = np.concatenate(mhs), np.concatenate(chs), np.concatenate(windows)
        run_of = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(run_of)) - np.repeat(np.cumsum(count) - count, count)
        hit = np.flatnonzero(family.repeats)
        if not len(hit):
            return
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (run_of[hit[1:]] != run_of[hit[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        own = run_of[hit[first]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(mh[own]), pa.array(ch[own]), pa.array(within[hit[first]].astype(np.int32)), pa.array(within[hit[last]].astype(np.int32))], names=["mh", "ch", "a", "b"]
        )

    return run


def _anchor(content: bytes, mh: int, gram: int) -> int:
    """Where the gram of a run stands: it is the first of its hash, as an earlier one would have been chosen."""
    data = np.frombuffer(content, np.uint8)
    at = np.arange(len(data) - gram + 1)
    return int(np.flatnonzero(hashes(rolling(data), at, at + gram).view(np.int64) == mh)[0])


def _cut_runs(width: int, length: int, gram: int):
    """(mh, ch, n, anchor, content) -> the same, and pieces of ``width`` windows filed by the bytes that these share.

    Windows go to pieces by the distance of their start from the gram, so
    equal windows share the piece's core and are filed alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content", 1 << 18):
            out: dict[str, list] = {k: [] for k in ("mh", "ch", "n", "mh2", "ch2", "shift", "anchor", "content")}
            for row in batch.to_pylist():
                content, anchor = row["content"], row["anchor"]
                if anchor is None:
                    anchor = _anchor(content, row["mh"], gram)
                last = len(content) - length  # the last window's start
                for k in range((anchor - last) // width, anchor // width + 1):
                    # windows whose start is width * k to width * k + width - 1 bytes before the gram
                    lo, hi = max(0, anchor - width * k - width + 1), min(last, anchor - width * k)
                    core = content[anchor - width * k : anchor - width * k - width + 1 + length]
                    piece = content[lo : hi + length]
                    key = hashlib.blake2b(b"%d %d %d " % (row["mh"], k, width) + core, digest_size=8).digest()
                    for name, value in zip(out, (row["mh"], row["ch"], row["n"], int.from_bytes(key, "little", signed=True), None, lo, anchor - lo, piece), strict=True):
                        out[name].append(value)
                    out["ch2"][-1] = int.from_bytes(hashlib.blake2b(b"%d " % (anchor - lo) + piece, digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary()), strict=True)], names=list(out)
            )

    return run


_PIECES = "mh long, ch long, n long, mh2 long, ch2 long, shift int, anchor int, content binary"


def _verdict(distinct: DataFrame, length: int, gram: int, widths: tuple[int, ...]) -> DataFrame:
    """(mh, ch, n, anchor, content), different runs -> (mh, ch, a, b), the stretches of their windows that repeat.

    Runs of a gram that has more than ``HOT`` of them are cut into pieces;
    equal pieces are counted, and the rest is judged in the same way.
    """
    key = ("mh", "ch")
    distinct = cut(distinct)
    hot = cut(distinct.groupBy("mh").agg(F.count("*").alias("__runs")).where(F.col("__runs") > HOT).select("mh")) if widths else None
    if hot is None or hot.isEmpty():
        dealt = distinct.repartition(shards(distinct.sparkSession, distinct.count(), SHARD_RUNS), "mh")
        return dealt.select("mh", "ch", "n", "content").mapInArrow(_shard(length), "mh long, ch long, a int, b int")
    cold = _verdict(distinct.join(hot, "mh", "left_anti"), length, gram, ())
    pieces = distinct.join(hot, "mh", "left_semi").select("mh", "ch", "n", "anchor", "content").mapInArrow(_cut_runs(widths[0], length, gram), _PIECES)
    pieces = cut(pieces)
    fewer = pieces.groupBy(F.col("mh2").alias("mh"), F.col("ch2").alias("ch")).agg(F.sum("n").alias("n"), F.min("anchor").alias("anchor"), F.min("content").alias("content"))
    fine = _verdict(fewer, length, gram, widths[1:]).withColumnsRenamed({"mh": "mh2", "ch": "ch2"})
    back = pieces.select(*key, "mh2", "ch2", "shift").join(fine, ["mh2", "ch2"])
    return cold.unionByName(back.select(*key, (F.col("shift") + F.col("a")).alias("a"), (F.col("shift") + F.col("b")).alias("b")))


def _contents(length: int):
    """(text, runs of one document) -> the bytes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            mh, ch, out = [], [], []
            for text, runs in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in runs:
                    mh.append(x["mh"])
                    ch.append(x["ch"])
                    out.append(data[x["start"] : x["start"] + x["r"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(mh, pa.int64()), pa.array(ch, pa.int64()), pa.array(out, pa.binary())], names=["mh", "ch", "content"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> the digest columns; spans may touch and overlap."""
    for batch in sliced(batches, "text", 4 << 20):
        sizes, removed, merged, digests, kept_texts = [], [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            kept, at, n = [], 0, 0
            end = -1
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if s > end:
                    if end >= 0:
                        at = end
                    kept.append(data[at:s])
                    n += 1
                    end = e
                else:
                    end = max(end, e)
            kept.append(data[max(end, 0) :])
            rest = b"".join(kept)
            sizes.append(len(data))
            removed.append(len(data) - len(rest))
            merged.append(n)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    runs = cut(rows.where(F.octet_length("text") >= length).select("id", "th", "text").mapInArrow(_scan(length, gram), "mh long, ch long, id long, th long, start int, r int"))
    groups = runs.groupBy("mh").agg(F.count("*").alias("n"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).where("n > 1")
    # a table of its own: a join that reads plain shuffles on both sides can split the runs of a gram that very many documents share
    groups = cut(groups.select(F.col("mh").alias("m"), (F.col("lo") != F.col("hi")).alias("mixed")))
    hits = cut(runs.join(groups, F.col("mh") == F.col("m")).drop("m"))
    forget(runs, groups)

    # a bitmap of fixed size over the documents with a hit: 2,048 rows of 4 KB at most
    spot = F.pmod(F.xxhash64("id", "th"), F.lit(BITMAP))
    bits = hits.select(spot.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    marks = F.broadcast(cut(bits))
    looked = rows.withColumn("b", spot).join(marks, F.expr("bitmap_bucket_number(b)") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.expr("cast(bitmap_bit_position(b) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright({0}, cast(bitmap_bit_position(b) % 8 as int)) & 1".format("byte")) == 1, F.lit(False))
    looked = looked.withColumn("byte", byte).withColumn("maybe", maybe).select("doc_id", "id", "th", "text", "maybe")
    suspects = looked.where("maybe").drop("maybe")

    mixed = hits.where("mixed").groupBy("id", "th").agg(F.collect_list(F.struct("start", "r", "mh", "ch")).alias("runs"))
    contents = suspects.join(mixed, ["id", "th"]).select("text", "runs").mapInArrow(_contents(length), "mh long, ch long, content binary")
    distinct = contents.groupBy("mh", "ch").agg(F.count("*").alias("n"), F.lit(None).cast("int").alias("anchor"), F.min("content").alias("content"))
    verdict = _verdict(distinct, length, gram, WIDTHS)

    whole = hits.where("not mixed").select("id", "th", F.col("start").alias("s"), (F.col("start") + F.col("r") + (length - 1)).alias("e"))
    parts = hits.where("mixed").join(verdict, ["mh", "ch"]).select("id", "th", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + length).alias("e"))
    spans = whole.unionByName(parts).groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    cleaned = suspects.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_without, _RESULT)
    zero = F.lit(0).cast("long")
    clean = looked.where("not maybe").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept")
    )
    return cleaned.unionByName(clean)
