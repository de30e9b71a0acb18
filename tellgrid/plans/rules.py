"""The physical plan: a profile compiled into ordered rules.

What one scan can find is fused into one pattern (all block words, all
spellings, all word swaps, all allowed phrases); every rule also knows literals
of which one must occur, so that most rules of most texts cost a substring
search and no pattern at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

import regex

from tellgrid.functions import letters
from tellgrid.functions.batches import Finder, Starts
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.dialect import dialect_name, spelling_map
from tellgrid.plans.profile import Profile, fields, trim
from tellgrid.plans.regex_dialect import compile_python, expand, leading_words, quote, required_literals

Match = regex.Match
GAP = fixed.PHRASE_GAP

#: Letters that a pattern without case takes for ASCII ones.
_FOLDED = (("İ", "i"), ("ı", "i"), ("ſ", "s"), ("\u212a", "k"))
_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
_runs = re.compile("[0-9A-Za-z_]+")
#: Over UTF-8: ASCII words stay, anything else is a blank.
_words_only = bytes(i if chr(i) in _WORD else 32 for i in range(256))
#: Literals from which on the words of a text are gathered to be looked up.
MANY = 16


class Scan:
    """A text as rules look at it; each view is made once."""

    __slots__ = ("text", "protected", "kept", "code", "found", "sought", "places", "heads", "_folded", "_low", "_words", "_exact")

    def __init__(
        self,
        text: str,
        folded: str | None = None,
        found: set[str] | None = None,
        sought: frozenset[str] = frozenset(),
        places: dict[str, list[int]] | None = None,
        heads: frozenset[str] = frozenset(),
    ) -> None:
        self.text, self._folded = text, folded
        #: Of the literals that were looked for in many texts at once, those that the folded text holds; None: no such search.
        self.found, self.sought = found, sought
        #: Likewise by the heads that were looked for, where words begin so.
        self.places, self.heads = places, heads
        #: Set by the engine when the first match asks for it.
        self.protected: Callable[[int, int], bool] | None = None
        #: The ranges of code, set by the engine too.
        self.code: list[tuple[int, int]] | None = None
        self._low: str | None = None
        #: By the order of a rule, its matches that count; also the engine's.
        self.kept: dict[int, list[Match]] = {}
        self._words: set[bytes] | None = None
        self._exact = True

    @property
    def folded(self) -> str:
        if self._folded is None:
            self._folded = self.text.casefold()
        return self._folded

    @property
    def low(self) -> str:
        """The text in lower case, offsets kept, with ASCII letters wherever a pattern without case sees them."""
        if self._low is None:
            text = self.text
            if text.isascii():
                self._low = self.folded
            else:
                for c, to in _FOLDED:
                    if c in text:
                        text, self._exact = text.replace(c, to), False
                self._low = text.lower()
        return self._low

    @property
    def words(self) -> set[bytes] | None:
        """The ASCII words in lower case; None where letters outside of ASCII fold to such, so that words may begin inside."""
        if self._words is None:
            low = self.low
            if not self._exact:
                return None
            self._words = set(low.encode("utf-8", "surrogatepass").translate(_words_only).split())
        return self._words

    def holds(self, literals: tuple[str, ...]) -> bool:
        if self.found is not None:
            if not self.found.isdisjoint(literals):
                return True
            if self.sought.issuperset(literals):
                return False
        folded = self.folded
        for x in literals:  # noqa: SIM110 (a generator costs more than most searches)
            if x in folded:
                return True
        return False


def _whole_words(parts: Iterable[str]) -> str:
    return r"(?i)\b(?:" + "|".join(parts) + r")\b"


@dataclass(frozen=True)
class Rule:
    order: int
    kind: str
    name: str
    source: str  # the pattern in the RE2 dialect
    pattern: regex.Pattern
    #: The text a match becomes; None for a rule that only flags.
    rewrite: Callable[[str, Match], str] | None = None
    #: Whether a match counts, by its context.
    keep: Callable[[str, Match], bool] | None = None
    tidy: bool = False
    #: The finding is named for what matched.
    by_match: bool = False
    #: Casefolded literals; a text without any of them cannot match.
    literals: tuple[str, ...] = ()
    replacement: str | None = None
    #: What also holds for a text with a match that counts.
    needs: Callable[[Scan], bool] | None = None
    #: How all matches begin, in lower case; they begin where a word does.
    starts: tuple[str, ...] = ()
    #: Of a phrase: one of its words.
    word: bytes | None = None
    #: Of a fused rule: for each literal how its alternative begins, in lower case.
    heads: tuple[str, ...] = ()
    #: Of a fused rule: the literals that are whole words of a match, with their places, and the places of the others.
    _whole: dict[bytes, list[int]] = field(default_factory=dict, compare=False, repr=False)
    _parts: list[int] = field(default_factory=list, compare=False, repr=False)
    _places: dict[str, list[int]] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.heads:
            for i, x in enumerate(self.literals):
                self._places.setdefault(x, []).append(i)
                if _runs.fullmatch(x):
                    self._whole.setdefault(x.encode(), []).append(i)
                else:
                    self._parts.append(i)

    def matches(self, scan: Scan) -> Iterable[Match]:
        """All matches.  A fused rule is tried only where one of its alternatives begins whose literal occurs."""
        if self.heads:
            return self._from_heads(scan)
        if self.word and scan.found is None and (words := scan.words) is not None and self.word not in words:
            return ()
        if self.literals and not scan.holds(self.literals) or self.needs and not self.needs(scan):
            return ()
        if self.starts and scan.places is not None and scan.heads.issuperset(self.starts):
            return self._from(scan.text, chain.from_iterable(scan.places.get(x, ()) for x in self.starts))
        return self._at_starts(scan, self.starts) if self.starts else self.pattern.finditer(scan.text)

    def _from_heads(self, scan: Scan) -> Iterable[Match]:
        folded = scan.folded
        if scan.found is not None and scan.sought.issuperset(self._places):
            present = [i for x in self._places.keys() & scan.found for i in self._places[x]]
        elif len(self.literals) < MANY or (words := scan.words) is None:
            present = [i for i, x in enumerate(self.literals) if x in folded]
        else:
            present = [i for x in self._whole.keys() & words for i in self._whole[x]] + [i for i in self._parts if self.literals[i] in folded]
        return self._at_starts(scan, {self.heads[i] for i in present}) if present else ()

    def _at_starts(self, scan: Scan, heads: Iterable[str]) -> list[Match]:
        low, text = scan.low, scan.text
        starts: set[int] = set()
        for head in heads:
            at = low.find(head)
            while at >= 0:
                if not at or text[at - 1] not in _WORD:
                    starts.add(at)
                at = low.find(head, at + 1)
        return self._from(text, starts)

    def _from(self, text: str, starts: Iterable[int]) -> list[Match]:
        """The matches that begin at one of these places."""
        out, at = [], 0
        for start in sorted(starts):
            if start >= at and (m := self.pattern.match(text, start)):
                out.append(m)
                at = m.end()
        return out

    def finding_name(self, match: str) -> str:
        return f"{self.name}:{letters.lower(' '.join(fields(match)))}" if self.by_match else self.name


@dataclass(frozen=True)
class Plan:
    profile: Profile
    rules: tuple[Rule, ...]
    allow: frozenset[str]
    allow_phrases: regex.Pattern | None
    allow_literals: tuple[str, ...]
    protect_quotes: bool
    #: Looks in many texts at once for the literals of rules, allowed phrases and hedges.
    finder: Finder
    #: And for how their matches begin.
    starts: Starts
    #: By literal, the rules that take one of the finder's literals; the rules that may match without any.
    by_literal: Mapping[str, tuple[int, ...]]
    always: tuple[int, ...]

    def scans(self, texts: Sequence[str]) -> list[Scan]:
        """The texts, looked at together."""
        folded = [t.casefold() for t in texts]
        places: list[dict[str, list[int]] | None] = [*self.starts(texts)]
        for i, t in enumerate(texts):
            if not t.isascii() and any(c in t for c, _ in _FOLDED):
                places[i] = None
        found = self.finder(folded)
        return [Scan(t, f, x, self.finder.literals, at, self.starts.heads) for t, f, x, at in zip(texts, folded, found, places, strict=True)]

    def tried(self, scan: Scan) -> Iterable[Rule]:
        """The rules, in order, without those that cannot match by what the finder found."""
        if scan.found is None:
            return self.rules
        return [self.rules[i] for i in sorted({*self.always, *chain.from_iterable(self.by_literal.get(x, ()) for x in scan.found)})]


def _phrase_source(text: str) -> str:
    text = text.rstrip(" ")
    bound = r"\b" if text[-1:].isascii() and (text[-1:].isalnum() or text[-1:] == "_") else ""
    return r"(?i)\b" + quote(text).replace(" ", GAP) + bound


def _literal(text: str) -> str:
    """The longest blank-free part of a phrase, casefolded."""
    return max(text.split(" "), key=len, default="").casefold()


def _heads(words: Iterable[str]) -> tuple[str, ...]:
    """How the matches of words and phrases begin; none where one is not all ASCII or does not begin as words do."""
    words = tuple(words)
    if not all(w.isascii() and w[0] in _WORD for w in words):
        return ()
    return tuple(w.split(" ", 1)[0].lower() for w in words)


def _word(phrase: str) -> bytes | None:
    """The longest ASCII word of a phrase, which is one of a text's wherever the phrase is; none for other phrases."""
    phrase = phrase.rstrip(" ")
    return max(_runs.findall(phrase), key=len).lower().encode() if phrase.isascii() and phrase[:1] in _WORD else None


_after_stop = re.compile(r"[\n.!?][ \t]*,")
_BEFORE_COMMA = tuple(x + "," for x in " \t\n.!?")


def _opening_comma(scan: Scan) -> bool:
    """A comma that opens a sentence."""
    return scan.text.lstrip(" \t").startswith(",") or scan.holds(_BEFORE_COMMA) and bool(_after_stop.search(scan.text))


def _delete(text: str, m: Match) -> str:
    """Nothing, or the letter taken along, which becomes a capital where the deletion opened a sentence."""
    letter = m[1] or m[2] or ""
    return letters.upper(letter) if letter and letters.opens_sentence(text, m.start()) else letter


def _swap(table: Mapping[str, str]) -> Callable[[str, Match], str]:
    def rewrite(_: str, m: Match) -> str:
        to = table.get(letters.lower(m[0]))
        return m[0] if to is None else letters.carry_case(m[0], to)

    return rewrite


def _not_a_name(text: str, m: Match) -> bool:
    return not letters.may_be_name(text, *m.span())


def _semicolon(text: str, m: Match) -> str:
    stopped = m.start() > 0 and text[m.start() - 1] in ".!?"
    return (" " if stopped else ". ") + letters.upper(m[1])


def _article(_: str, m: Match) -> str:
    return m[1][0] + ("n" if letters.vowel_sound(m[3]) else "") + m[2] + m[3]


def _before_punctuation(text: str, m: Match) -> bool:
    # a "!" that opens an image keeps its blank
    return not letters.line_begin(text, m.start()) and not (m[0][-1] == "!" and text.startswith("[", m.end()))


def _collapsible(text: str, m: Match) -> bool:
    if letters.line_begin(text, m.start()) or m.end() == len(text) or text[m.end()] in "\n\r":
        return False
    return not letters.in_table_row(text, m.start())


class _Builder:
    def __init__(self) -> None:
        self.rules: list[Rule] = []

    def add(self, kind: str, name: str, source: str, literals: Iterable[str] = (), **more) -> None:
        literals = tuple(literals) or required_literals(source)
        pattern = compile_python(source)
        more.setdefault("starts", leading_words(source) if isinstance(pattern, re.Pattern) and "heads" not in more else ())
        self.rules.append(Rule(len(self.rules), kind, name, source, pattern, literals=literals, **more))

    def phrase(self, phrase: str, to: str) -> None:
        name = f"phrase:{trim(phrase)}"
        if to == "":
            self.deletion("phrase", name, phrase)
        else:
            self.add("phrase", name, _phrase_source(phrase), [_literal(phrase)], word=_word(phrase), rewrite=lambda _, m: letters.carry_case(m[0], to), replacement=to)

    def deletion(self, kind: str, name: str, phrase: str) -> None:
        source = _phrase_source(phrase) + fixed.DELETION_TAIL
        self.add(kind, name, source, [_literal(phrase)], word=_word(phrase), rewrite=_delete, replacement="")

    def swaps(self, kind: str, name: str, table: Mapping[str, str], keep=None) -> None:
        if table:
            words = sorted(table)
            parts = tuple(map(quote, words))
            self.add(kind, name, _whole_words(parts), [w.casefold() for w in words], rewrite=_swap(table), keep=keep, heads=_heads(words))

    def tidy(self, name: str, literals: Iterable[str], rewrite, keep=None, needs=None, **more) -> None:
        self.add("tidy", name, fixed.TIDY_PATTERNS[name], literals, rewrite=rewrite, keep=keep, tidy=True, needs=needs, **more)


def compile_profile(p: Profile) -> Plan:
    """All rules in their fixed order; patterns that do not compile raise."""
    b = _Builder()
    for char in sorted(p.charReplace):
        to = p.charReplace[char]
        b.add("char", f"char:{char}", quote(char), [char.casefold()], rewrite=lambda _, m, to=to: to, replacement=to)
    for phrase in sorted(p.phraseReplace):
        b.phrase(phrase, p.phraseReplace[phrase])
    b.swaps("spelling", "spelling", spelling_map(dialect_name(p.dialect)))
    # of keys that differ in case only, the last by code points wins
    b.swaps("replace", "replace", {letters.lower(k): p.wordReplace[k] for k in sorted(p.wordReplace) if k and p.wordReplace[k]}, _not_a_name)
    for word in sorted(k for k, v in p.wordReplace.items() if k and not v):
        b.deletion("drop", f"drop:{word}", word)
    for source in sorted(p.regexReplace):
        to = p.regexReplace[source]
        b.add("regex", f"regex:{source}", source, rewrite=lambda _, m, to=to: expand(to, m), keep=lambda _, m: m.end() > m.start(), replacement=to)
    if words := [w for w in p.blockWords if w]:
        # longest first (in bytes), so that a longer term wins over one that begins it
        words.sort(key=lambda w: (-len(w.encode()), w))
        parts = tuple(quote(w).replace(" ", GAP) for w in words)
        b.add("word", "word", _whole_words(parts), [_literal(w) for w in words], keep=_not_a_name, by_match=True, heads=_heads(words))
    for name in sorted(p.flagPatterns):
        b.add("structural", f"structural:{name}", p.flagPatterns[name])
    if p.splitSemicolons:
        b.tidy("semicolon", ";", _semicolon, lambda t, m: letters.joins_clauses(t, m.start()))
    if p.collapseSpaces:
        b.tidy("orphan-comma", ",", lambda _, m: letters.upper(m[1]), lambda t, m: letters.opens_sentence(t, m.start()), _opening_comma)
        b.tidy("space-before-punct", [x + y for x in " \t" for y in ",.!?;:"], lambda _, m: m[0].lstrip(" \t"), _before_punctuation)
        b.tidy("comma-before-stop", ["," + x for x in ".!?;:"], lambda _, m: m[0][-1])
        b.tidy("comma-run", [",,"], lambda *_: ",")
        b.tidy("double-space", ["  "], lambda *_: " ", _collapsible)
    if p.fixArticles:
        b.tidy("article", "a", _article, lambda _, m: letters.vowel_sound(m[3]) != (len(m[1]) == 2), starts=("a ", "a\t", "an ", "an\t"))
    phrases = [" ".join(f) for f in map(fields, p.allow) if len(f) > 1]
    source = r"(?i)\b(?:" + "|".join(sorted(quote(x).replace(" ", GAP) for x in phrases)) + r")\b"
    allow_literals = tuple(_literal(x) for x in phrases)
    finder = Finder(chain(chain.from_iterable(r.literals for r in b.rules), _BEFORE_COMMA, allow_literals, fixed.HEDGES))
    sought = {r.order: bool(r.literals) and finder.literals.issuperset(r.literals) for r in b.rules}
    by_literal: dict[str, tuple[int, ...]] = {}
    for r in b.rules:
        for x in set(r.literals) if sought[r.order] else ():
            by_literal[x] = (*by_literal.get(x, ()), r.order)
    return Plan(
        profile=p,
        rules=tuple(b.rules),
        allow=frozenset(map(letters.lower, p.allow)),
        allow_phrases=compile_python(source) if phrases else None,
        allow_literals=allow_literals,
        protect_quotes=p.protectQuotes,
        finder=finder,
        starts=Starts(chain.from_iterable(r.starts for r in b.rules)),
        by_literal=by_literal,
        always=tuple(i for i, told in sought.items() if not told),
    )
