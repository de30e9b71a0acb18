"""Byte-level BPE encoding and decoding by a given rank table (operator 1).

A text is split by the tokenizer's pattern; each distinct piece is folded once:
its bytes start as single tokens and the adjacent pair of the lowest rank,
leftmost first, is merged until no pair has a rank.  Decoding concatenates the
binary pieces of the ids.

The main path folds the distinct pieces of a task in Arrow batches.  The fold
by Spark higher-order functions over a literal rank map is
:func:`fold_distinct_words`; it gives the same ids, but costs far more per
distinct word and would need every word of every document shuffled to its ids
(figures in the README), so it serves vocabularies, not whole corpora.

Defined results: a null text is encoded as the empty text (no ids, empty
decoded bytes); a very long text is encoded whole, its matches listed some at
a time; repeated rows and ties of ids are encoded row by row; an empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.common import sliced, small_batches, text_or_empty

#: Distinct pieces that a task remembers; beyond them it starts anew.
CACHE = 1 << 17
#: Pieces of more bytes are merged with a heap instead of repeated scans.
LONG = 96
#: Bytes of text worked on at once.
SLICE = 4 << 20
#: Characters of a text from which its matches are listed some at a time.
STRETCH = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the lowest-ranked adjacent pair, leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > LONG:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same order of merges with a heap of (rank, start) over a linked list."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def _encoder(table, pattern: str):
    """Batches of (doc_id, text) -> (doc_id, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks, compiled = table.value, regex.compile(pattern)
        known: dict[str, bytes] = {}  # of this task only: what a worker keeps after a stage is lost to the next one
        for batch in sliced(batches, "text", SLICE):
            ids: list[bytes] = []
            for text in batch.column(1).to_pylist():
                parts = []
                for pieces in _stretches(compiled, text):
                    try:
                        parts.append(b"".join([known[p] for p in pieces]))
                    except KeyError:
                        if len(known) > CACHE:
                            known.clear()
                        for p in set(pieces):
                            if p not in known:
                                known[p] = np.array(merge(p.encode(), ranks), "<u4").tobytes()
                        parts.append(b"".join([known[p] for p in pieces]))
                ids.append(parts[0] if len(parts) == 1 else b"".join(parts))
            lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _stretches(compiled, text: str) -> Iterator[list[str]]:
    """The matches of a text; of a very long one some at a time."""
    if len(text) <= STRETCH:
        yield compiled.findall(text)
        return
    matches = compiled.finditer(text)
    while pieces := [m[0] for m in islice(matches, STRETCH // 8)]:
        yield pieces


def _decoder(table):
    """Batches of (doc_id, n_tokens, ids) -> the same with ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = table.value
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        for batch in sliced(batches, "ids", SLICE):
            out = [b"".join(map(pieces.__getitem__, np.frombuffer(x.as_buffer(), "<u4").tolist())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


_IDS, _DECODED = "doc_id long, n_tokens long, ids binary", "doc_id long, n_tokens long, ids binary, decoded binary"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: the ids packed as little-endian unsigned 32-bit integers."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)  # one tokenizer's vocabulary, a fixed size
    return _rows(docs, id_col, text_col).mapInArrow(_encoder(table, pattern), _IDS)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The encoded rows with ``decoded``: the concatenated bytes of their ids."""
    table = encoded.sparkSession.sparkContext.broadcast(ranks)
    return small_batches(encoded).select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(table), _DECODED)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one stage, so that a task needs one Python worker and one table."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)
    code, uncode = _encoder(table, pattern), _decoder(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return uncode(code(batches))

    return _rows(docs, id_col, text_col).mapInArrow(run, _DECODED)


# --- the fold by higher-order functions --------------------------------------

#: Buckets of the literal map: Spark scans a map literal from its start, so each bucket holds a few pieces.
BUCKETS = 8192


def fold_distinct_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", buckets: int = BUCKETS) -> DataFrame:
    """word, ids array<int>, by a fold of ranked merges in Spark's higher-order functions.

    ``words`` holds distinct pieces of a text's pattern matches.  The rank map is
    a literal (a constant that the optimizer folds): an array of ``buckets``
    small maps of hexadecimal bytes, addressed by a hash of the pair.
    """
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        text = piece.hex().upper()
        maps[zlib.crc32(text.encode()) % buckets][text] = rank
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
    none = 1 << 30

    def rank(piece: Column) -> Column:
        bucket = (F.crc32(piece.cast("binary")) % buckets).cast("int")
        return F.coalesce(F.try_element_at(F.get(table, bucket), piece), F.lit(none))

    raw = F.hex(F.col(word_col).cast("binary"))
    size = F.octet_length(F.col(word_col))
    parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(raw, i * 2 - 1, F.lit(2)))

    def step(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.struct(rank(F.concat(F.element_at(acc, i), F.element_at(acc, i + 1))).alias("r"), i.alias("i")))

        def join(best: Column) -> Column:
            pair = F.array(F.concat(F.element_at(acc, best["i"]), F.element_at(acc, best["i"] + 1)))
            merged = F.concat(F.slice(acc, F.lit(1), best["i"] - 1), pair, F.slice(acc, best["i"] + 2, F.size(acc)))
            return F.when(best["r"] == none, acc).otherwise(merged)

        # an array of one binds the best pair, so it is looked for once
        return F.when(F.size(acc) < 2, acc).otherwise(F.get(F.transform(F.array(F.array_min(pairs)), join), F.lit(0)))

    folded = F.when(size == 0, F.array().cast("array<string>")).when(size == 1, F.array(raw)).otherwise(F.aggregate(F.sequence(F.lit(2), size), parts, step))
    return words.select(F.col(word_col).alias("word"), F.transform(folded, rank).alias("ids"))
