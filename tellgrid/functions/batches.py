"""Many texts at once: what rules and scores look for in each text, found by a few array operations over all of them.

Arrays are of the texts' UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

from tellgrid.plans.profile import UNICODE_SPACE

#: Bytes by which a literal is filed.
GRAM = 4
#: Bytes whose pairs are numbers of eight bytes at a time.
BLOCK = 1 << 16
#: Common ones first, and what many words have in common.
_BY_USE = {c: i for i, c in enumerate(b" etaoinshrdlucmfwypvbgkqjxz")}
_COMMON = (b"ing", b"th", b"er", b"on")

_SPACE, _STOP, _LEAD = 1, 2, 4
_wide_spaces = [c.encode() for c in UNICODE_SPACE if not c.isascii()]
_kinds = bytes(_SPACE if chr(i) in UNICODE_SPACE and i < 128 else _STOP if chr(i) in ".!?" else _LEAD if any(c[0] == i for c in _wide_spaces) else 0 for i in range(256))
#: ASCII letters, digits and the underscore.
_in_word = bytes(i < 128 and (chr(i).isalnum() or chr(i) == "_") for i in range(256))


def _encoded(texts: Iterable[str], between: str) -> bytes:
    return between.join(texts).encode("utf-8", "surrogatepass")


def _ends(texts: Sequence[str]) -> np.ndarray:
    """Where the next text begins, after a byte between them."""
    return np.cumsum([1 + (len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))) for x in texts])


def _begins(cut: np.ndarray) -> np.ndarray:
    """Where runs begin of what is not cut away."""
    inside = ~cut
    inside[1:] &= cut[:-1]
    return np.flatnonzero(inside)


class _Grams:
    """Where runs of two to four bytes are."""

    def __init__(self, runs: Iterable[bytes]) -> None:
        self._pairs = np.zeros(1 << 16, bool)
        #: By length the hashes of the runs.
        self._hashed: dict[int, np.ndarray] = {}
        for run in runs:
            self._pairs[run[0] | run[1] << 8] = True
            self._hashed.setdefault(len(run), np.zeros(1 << 16, bool))[_hash(np.array([int.from_bytes(run, "little")], np.uint32))] = True

    def __call__(self, raw: bytes, where: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places) of the runs in ``raw``, and of few others; ``where``: the only places to look at."""
        padded = raw + bytes(GRAM)
        pairs, fours = (np.ndarray(len(raw), t, padded, strides=(1,)) for t in ("<u2", "<u4"))
        if where is None:
            at = np.concatenate([np.flatnonzero(self._pairs.take(pairs[i : i + BLOCK], mode="clip")) + i for i in range(0, len(raw) or 1, BLOCK)])
        else:
            at = where[self._pairs.take(pairs[where], mode="clip")]
        held = fours[at]
        for n, hashed in self._hashed.items():
            yield n, at[hashed.take(_hash(held & np.uint32((1 << 8 * n) - 1)), mode="clip")]


def _hash(run: np.ndarray) -> np.ndarray:
    return run * np.uint32(2654435761) >> 16


class Finder:
    """Which literals each text holds.

    A literal is filed by its run of up to four bytes that other words have
    least; it is compared only where such a run is.
    """

    def __init__(self, literals: Iterable[str]) -> None:
        #: Those that are looked for; what most texts hold, or a search for one character finds, is left to the texts.
        self.literals = frozenset(x for x in literals if x and "\0" not in x and not (x.isascii() and (len(x) == 1 or len(x) == 2 and x.isalpha())))
        self._filed: dict[bytes, list[tuple[str, bytes, int]]] = {}
        for x in self.literals:
            raw = x.encode("utf-8", "surrogatepass")
            n = min(len(raw), GRAM)
            at = max(range(len(raw) - n + 1), key=lambda i: _rarity(raw[i : i + n]))
            self._filed.setdefault(raw[at : at + n], []).append((x, raw, at))
        self._grams = _Grams(self._filed)

    def __call__(self, texts: Sequence[str]) -> list[set[str]]:
        out: list[set[str]] = [set() for _ in texts]
        raw, ends = _encoded(texts, "\0"), _ends(texts)
        for n, places in self._grams(raw):
            for at, owner in zip(places.tolist(), np.searchsorted(ends, places, "right").tolist(), strict=True):
                for x, literal, before in self._filed.get(raw[at : at + n], ()):
                    if at >= before and raw.startswith(literal, at - before):
                        out[owner].add(x)
        return out


def _rarity(run: bytes) -> int:
    """Of the run, and once more of the pair that opens it."""
    return sum(_BY_USE.get(c, len(_BY_USE)) for c in run + run[:2]) - 30 * sum(x in run for x in _COMMON)


class Starts:
    """Where in each text words begin as some heads do."""

    def __init__(self, heads: Iterable[str]) -> None:
        #: Those that are looked for: of ASCII, in lower case, and two characters at least.
        self.heads = frozenset(x for x in heads if len(x) > 1 and x.isascii() and x == x.lower() and _in_word[ord(x[0])])
        self._filed: dict[bytes, list[tuple[str, bytes]]] = {}
        for x in self.heads:
            self._filed.setdefault(x.encode()[:GRAM], []).append((x, x.encode()))
        self._grams = _Grams(self._filed)

    def __call__(self, texts: Sequence[str]) -> list[dict[str, list[int]]]:
        """By head the places, in characters."""
        out: list[dict[str, list[int]]] = [{} for _ in texts]
        if not texts:
            return out
        raw, ends = _encoded(texts, "\0").lower(), _ends(texts)
        begins = _begins(~np.frombuffer(raw.translate(_in_word), bool))
        before = np.append(0, ends)
        more = np.flatnonzero(np.frombuffer(raw, np.int8) < -64)  # bytes that go on with a character
        more_before = np.searchsorted(more, before)
        for n, places in self._grams(raw, begins):
            owners = np.searchsorted(ends, places, "right")
            within = places - before[owners] - (np.searchsorted(more, places) - more_before[owners])
            for at, owner, i in zip(places.tolist(), owners.tolist(), within.tolist(), strict=True):
                for x, head in self._filed.get(raw[at : at + n], ()):
                    if raw.startswith(head, at):
                        out[owner].setdefault(x, []).append(i)
        return out


def words_and_sentences(texts: Sequence[str]) -> list[tuple[int, list[int]]]:
    """Of each text the words, and the words of each sentence that has any."""
    if not texts:
        return []
    raw, ends = _encoded([*texts, ""], "\n"), _ends(texts)
    kinds = np.frombuffer(raw.translate(_kinds), np.uint8).copy()
    leads = np.flatnonzero(kinds == _LEAD)
    kinds[leads] = 0
    for at in leads.tolist():
        for space in _wide_spaces:
            if raw.startswith(space, at):
                kinds[at : at + len(space)] = _SPACE
    words = np.diff(np.searchsorted(_begins(kinds & _SPACE != 0), ends), prepend=0).tolist()
    kinds[ends - 1] |= _STOP
    stops = np.flatnonzero(kinds & _STOP)
    lengths = np.diff(np.searchsorted(_begins(kinds != 0), stops), prepend=0)
    last = np.searchsorted(stops, ends - 1)  # the sentence that a text's end closes
    some = np.cumsum(lengths > 0)[last].tolist()
    lengths = lengths[lengths > 0].tolist()
    return [(n, lengths[a:b]) for n, a, b in zip(words, [0, *some], some, strict=False)]
