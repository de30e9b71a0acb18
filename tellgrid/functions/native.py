"""Operators as native expressions: everything here stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellgrid.functions.letters import AN_BEFORE_CAPITALS, AN_BEFORE_WORD
from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.regex_dialect import quote, to_java

#: Unicode white space, for Java.
SPACE_CLASS = r"\t\n\x0B\f\r \x85\xA0  -     　"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text: Column | str) -> Column:
    # splitting is several times faster than collecting matches
    return F.size(F.array_remove(F.split(_c(text), f"[{SPACE_CLASS}]+", -1), "")).cast("long")


def sentence_lengths(text: Column | str) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(F.split(_c(text), "[.!?]+", -1), lambda s: word_count(s)), lambda n: n > 0)


def cadence_cv(text: Column | str) -> Column:
    """Unrounded; -1 for fewer than three sentences.  One fold over whole numbers: count, sum, sum of squares."""
    lengths = F.transform(F.split(_c(text), "[.!?]+", -1), lambda s: word_count(s))
    zero = F.lit(0).cast("long")

    def step(acc: Column, n: Column) -> Column:
        some = (n > 0).cast("long")
        return F.struct((acc["k"] + some).alias("k"), (acc["s"] + n).alias("s"), (acc["q"] + n * n).alias("q"))

    def finish(acc: Column) -> Column:
        spread = F.sqrt((acc["k"] * acc["q"] - acc["s"] * acc["s"]).cast("double")) / acc["s"]
        return F.when(acc["k"] < fixed.LEAST_SENTENCES, F.lit(-1.0)).otherwise(spread)

    return F.aggregate(lengths, F.struct(zero.alias("k"), zero.alias("s"), zero.alias("q")), step, finish)


def bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def cadence_points(cv: Column) -> Column:
    points = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (fixed.FLAT_CV - c) / fixed.FLAT_CV)) * fixed.CADENCE_CAP
    return bound(cv, lambda c: F.when(c >= 0, points(c)).otherwise(F.lit(0.0)))


def hedge_count(text: Column | str, hedges: Sequence[str] = fixed.HEDGES) -> Column:
    return F.size(F.filter(F.split(F.lower(_c(text)), r"[^\p{L}]+", -1), lambda w: w.isin(*hedges))).cast("long")


def per_100(n: Column, words: Column) -> Column:
    return bound(words, lambda w: F.when(w > 0, n.cast("double") / w * 100).otherwise(F.lit(0.0)))


def score_band(value: Column) -> Column:
    return F.when(value < fixed.CLEAN_BELOW, "low").when(value < fixed.MIDDLE_BELOW, "mid").otherwise("high")


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the binary value, not on its shortest decimal."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


#: Matches of one block of running offsets.
BLOCK = 256


def located(steps: Column, out, empty: Column) -> Column:
    """``out(x, start, end)`` of the steps x (with gap, n and ok) that are ok; offsets are sums of gaps and lengths.

    Arrays grow inside blocks and offsets run on from block to block, so the
    time is in proportion to the steps.
    """

    def within(block: Column, offset: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["n"]
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(out(x, start, end)))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(offset.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def blocks(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"]))
        offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
        return bound(offsets, lambda o: F.flatten(F.transform(parts, lambda p, i: within(p, F.get(o, i)))))

    return bound(steps, lambda all_: F.when(F.size(all_) == 0, empty).when(F.size(all_) <= BLOCK, within(all_, F.lit(0))).otherwise(bound(blocks(all_), joined)))


def matches(text: Column | str, pattern: str) -> Column:
    """All matches of an RE2 pattern with byte offsets: array of (match, offset)."""
    t, p = _c(text), to_java(pattern)

    def of(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.octet_length(g).alias("gap"), F.octet_length(m).alias("n"), F.lit(True).alias("ok"), m.alias("match")))
        return located(steps, lambda x, s, e: F.struct(x["match"].alias("match"), s.alias("offset")), F.expr("cast(array() as array<struct<match:string,offset:int>>)"))

    return bound(F.struct(F.split(t, p, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("found")), of)


def line_of(prefix: Column) -> Column:
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_of(prefix: Column) -> Column:
    return F.length(F.substring_index(prefix, "\n", -1)) + 1


def utf16_length(text: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16LE")) / 2).cast("long")


def swap_chars(text: Column | str, table: Mapping[str, str] = fixed.CHAR_REPLACE) -> Column:
    """Character swaps, for texts without protected ranges."""
    out = _c(text)
    for char in sorted(table):
        out = F.replace(out, F.lit(char), F.lit(table[char]))
    return out


def comma_before_stop(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r",+([.!?;:])", "$1")


def comma_runs(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r",{2,}", ",")


def space_before_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?<![\n\r \t]|\A)[ \t]+((?:[,.?;:])|!(?!\[))", "$1")


def double_spaces(text: Column | str) -> Column:
    """Runs of blanks inside lines that are no table rows."""
    line = lambda x: F.when(x.rlike(r"^[ \t]*\|"), x).otherwise(F.regexp_replace(x, r"(?<=[^\r ])  +(?=[^\r ])", " "))
    return F.array_join(F.transform(F.split(_c(text), "\n", -1), line), "\n")


ARTICLE = fixed.TIDY_PATTERNS["article"]


def vowel_sound(word: Column) -> Column:
    bare = F.lower(F.regexp_replace(word, "^'+|'+$", ""))
    in_capitals = (F.length(word) > 1) & (word == F.upper(word)) & (word != bare)
    return F.when(in_capitals, word.rlike(AN_BEFORE_CAPITALS)).otherwise(bare.rlike(AN_BEFORE_WORD))


def wrong_articles(text: Column | str) -> Column:
    """Article matches that disagree with the next word's sound."""
    found = F.regexp_extract_all(_c(text), F.lit(to_java(ARTICLE)), F.lit(0))

    def wrong(m: Column) -> Column:
        return vowel_sound(F.regexp_extract(m, r"[ \t]+(.*)$", 1)) != (F.length(F.regexp_extract(m, "^([Aa]n?)", 1)) == 2)

    return F.filter(found, wrong)


def _named(kind: str):
    return lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("anchor"))


#: What a text must hold for a kind of anchor: most texts skip most patterns.
_NEEDS = {"url": "://", "email": "@", "percent": "%"}


def anchors(text: Column | str) -> Column:
    """(kind, anchor) in the order of kinds; each kind sees the text without what earlier ones took."""
    kinds = list(fixed.ANCHOR_PATTERNS.items())
    none = F.expr("cast(array() as array<struct<kind:string,anchor:string>>)")

    def taken(at: int, rest: Column) -> Column:
        kind, pattern = kinds[at]
        p = to_java(pattern)
        may = rest.contains(_NEEDS[kind]) if kind in _NEEDS else rest.rlike("[$£€]") if kind == "money" else F.lit(True)
        found = F.when(may, F.transform(F.regexp_extract_all(rest, F.lit(p), F.lit(0)), _named(kind))).otherwise(none)
        if at + 1 == len(kinds):
            return found
        # the rest is bound, or each kind would take the earlier ones' anew
        return F.concat(found, bound(F.when(may, F.regexp_replace(rest, p, " ")).otherwise(rest), lambda r: taken(at + 1, r)))

    return taken(0, _c(text))


def swap_words(text: Column | str, table: Mapping[str, str], boundary: str = "0-9A-Za-z_") -> Column:
    """Whole words swapped with their case carried on, for ASCII keys and texts without protected ranges.

    One scan marks the words that are keys, and the text is split at the marks.
    A text that holds the mark itself is split where words end and begin.
    """
    table = {k: v for k, v in table.items() if re.fullmatch(f"[{boundary}]+", k, re.A) and k == k.lower()}
    if not table:
        return _c(text)
    keys = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])

    def one(w: Column) -> Column:
        # a set of literals is hashed, a map is scanned: only words that are keys are looked up in it
        to = F.when(F.lower(w).isin(*table), F.element_at(keys, F.lower(w)))
        caps = (w == F.upper(w)) & (w != F.lower(w))
        lead = w.rlike("^[A-Z]")
        return F.when(to.isNull(), w).when(caps, F.upper(to)).when(lead, F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, 2, 1 << 20))).otherwise(to)

    def swapped(t: Column, marked: Column) -> Column:
        pieces = F.split(t, f"(?<=[{boundary}])(?![{boundary}])|(?<![{boundary}])(?=[{boundary}])", -1)
        at_marks = F.transform(F.split(marked, MARK, -1), lambda w, i: F.when(i % 2 == 1, one(w)).otherwise(w))
        return F.when(t.contains(MARK), F.array_join(F.transform(pieces, one), "")).when(marked.contains(MARK), F.array_join(at_marks, "")).otherwise(t)

    pattern = f"(?<![{boundary}])({_trie(table)})(?![{boundary}])"
    both = F.struct(_c(text).alias("text"), F.regexp_replace(_c(text), pattern, f"{MARK}$1{MARK}").alias("marked"))
    return bound(both, lambda x: swapped(x["text"], x["marked"]))


#: Put around words that are swapped.
MARK = "\x01"
#: Letters that RE2 takes for ASCII ones where case is ignored.
_FOLDS = {"s": "\u017f", "k": "\u212a"}


def _trie(words: Iterable[str], folds: Mapping[str, str] = {}) -> str:  # noqa: B006
    """A Java pattern of ASCII words in any case, in which each letter is tried once; which of two that fit is left open."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w.lower():
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        parts = [(f"[{c}{c.upper()}{folds.get(c, '')}]" if c.isalpha() else quote(c)) + written(more) for c, more in sorted(at.items(), reverse=True) if c]
        parts += [""] if "" in at else []
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return written(tree)


def before_first(text: Column | str, words: Sequence[str]) -> Column:
    """What stands before the first of some whole ASCII words in any case, as RE2 finds it; null where there is none.

    Only the first match is looked for, and each letter of a word is tried once.
    """
    if not all(w.isascii() and re.fullmatch(r"\w(?:.*\w)?", w, re.A | re.S) for w in words):
        raise ValueError("words are of ASCII, and begin and end with a letter, digit or underscore")
    edge = "[0-9A-Za-z_]"
    # in UTF-16 units, from 1
    at = F.regexp_instr(_c(text), F.lit(f"(?<!{edge})(?:{_trie(words, _FOLDS)})(?!{edge})"))

    def prefix(n: Column) -> Column:
        raw = F.substring(F.encode(_c(text), "UTF-16BE"), F.lit(1), (n - 1) * 2)
        return F.when(n > 0, F.decode(raw, "UTF-16BE"))

    return bound(at, prefix)


def any_word(words: Sequence[str]) -> str:
    """One alternation of whole words, longest first (RE2)."""
    return r"(?i)\b(?:" + "|".join(quote(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"


def share_encode(json: Column | str) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.replace(F.base64(_c(json).cast("binary")), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def share_decode(code: Column | str) -> Column:
    """What :func:`share_encode` encoded; null for anything else."""
    plain = F.translate(_c(code), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    good = _c(code).rlike(r"^[A-Za-z0-9_-]*$") & (F.length(plain) % 4 != 1)
    return F.when(good, F.try_to_binary(padded, F.lit("base64")).cast("string"))


def json_object(reply: Column | str) -> Column:
    """From the first brace to the last; empty where there is none."""
    return F.regexp_extract(_c(reply), r"(?s)\{.*\}", 0)


def split_list(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def report_line(path: Column, finding: Column) -> Column:
    """path:line:col rule: "match" -> "replacement"."""

    def quoted(x: Column) -> Column:
        for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            x = F.replace(x, F.lit(raw), F.lit(escaped))
        return F.concat(F.lit('"'), x, F.lit('"'))

    head = F.concat(path, F.lit(":"), finding["line"], F.lit(":"), finding["col"], F.lit(" "), finding["rule"], F.lit(": "), quoted(finding["match"]))
    return F.when(finding["replacement"].isNull(), head).otherwise(F.concat(head, F.lit(" -> "), quoted(finding["replacement"])))
