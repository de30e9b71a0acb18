"""RE2 patterns for two other engines: Python's ``regex`` and Java.

Both engines treat classes, boundaries and anchors differently, and both know
constructs that RE2 rejects.  A pattern is read once, token by token; what RE2
would reject raises :class:`ProfileCompileError`, and the rest is written in
explicit ASCII classes so that all engines agree.
"""

from __future__ import annotations

import re as _re
from functools import lru_cache
from re import _parser

import regex

from tellgrid.plans.errors import ProfileCompileError

WORD = "0-9A-Za-z_"
_CLASSES = {"w": WORD, "d": "0-9", "s": r"\t\n\f\r "}
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_INSIDE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\v\f\r ", "upper": "A-Z", "word": WORD, "xdigit": "0-9A-Fa-f",
}
_MAX_REPEAT = 1000


def quote(literal: str) -> str:
    """A literal as a pattern of any of the engines."""
    return _re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", literal)


def _fail(pattern: str, why: str) -> ProfileCompileError:
    return ProfileCompileError(f"pattern {pattern!r}: {why}")


def _translate(pattern: str, engine: str) -> str:
    out: list[str] = []
    multiline = [False]
    i, n, in_class, first = 0, len(pattern), False, False
    # a boundary must not fold case: under (?i) the classes would take the long s and the Kelvin sign
    fixed = lambda s: f"(?-i:{s})"
    end = r"\z" if engine == "java" else r"\Z"
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise _fail(pattern, "trailing backslash")
            d = pattern[i + 1]
            if d == "Q":
                stop = pattern.find(r"\E", i + 2)
                stop = n if stop < 0 else stop
                out.append(quote(pattern[i + 2 : stop]))
                i = min(n, stop + 2)
                continue
            i += 2
            first = False
            if d in "wds":
                out.append(_CLASSES[d] if in_class else fixed(f"[{_CLASSES[d]}]"))
            elif d in "WDS":
                if in_class:
                    raise _fail(pattern, f"\\{d} inside a class is not supported")
                out.append(fixed(f"[^{_CLASSES[d.lower()]}]"))
            elif d == "b" and not in_class:
                out.append(r"(?a:\b)" if engine == "python" else fixed(_BOUNDARY))
            elif d == "B" and not in_class:
                out.append(r"(?a:\B)" if engine == "python" else fixed(_INSIDE))
            elif d == "A":
                out.append(r"\A")
            elif d == "z":
                out.append(end)
            elif d in "pP":
                m = _re.compile(r"\{\^?\w+\}|\w").match(pattern, i)
                if not m:
                    raise _fail(pattern, "malformed \\p")
                out.append(f"\\{d}{m[0]}")
                i = m.end()
            elif d == "x":
                m = _re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(pattern, i)
                if not m:
                    raise _fail(pattern, "malformed \\x")
                out.append(quote(chr(int(m[1] or m[2], 16))))
                i = m.end()
            elif d in "aftnrv":
                out.append({"a": r"\x07", "v": r"\x0B"}.get(d, f"\\{d}"))
            elif d.isdigit():
                m = _re.compile(r"[0-7]{1,3}").match(pattern, i - 1)
                if d != "0" or not m:
                    raise _fail(pattern, "back-references are not supported")
                out.append(quote(chr(int(m[0], 8))))
                i = m.end() if m.end() > i else i
            elif d.isalpha():
                raise _fail(pattern, f"unknown escape \\{d}")
            else:
                out.append(f"\\{d}")
            continue
        if in_class:
            if c == "]" and not first:
                in_class = False
                out.append("]")
                i += 1
                continue
            first = False
            if c == "[":
                m = _re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)
                if m and m[2] in _POSIX:
                    if m[1]:
                        raise _fail(pattern, "negated POSIX classes are not supported")
                    out.append(_POSIX[m[2]])
                    i = m.end()
                    continue
                out.append(r"\[")
            elif c in "&~|" and pattern[i : i + 2] == c * 2 or c == "-" and pattern[i : i + 2] == "--":
                out.append(f"\\{c}")
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class, first = True, True
            out.append("[")
            i += 1
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < n and pattern[i] == "]":
                out.append(r"\]")
                i += 1
                first = False
            continue
        if c == "(":
            multiline.append(multiline[-1])
            if pattern.startswith("(?", i):
                m = _re.compile(r"\(\?P?<(\w+)>").match(pattern, i)
                if m:
                    out.append(f"(?<{m[1]}>" if engine == "java" else f"(?P<{m[1]}>")
                    i = m.end()
                    continue
                m = _re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(pattern, i)
                if not m:
                    raise _fail(pattern, "lookaround, atomic groups and unknown group flags are not supported")
                on, off = m[1], m[2] or ""
                if "U" in on + off:
                    raise _fail(pattern, "the ungreedy flag is not supported")
                if m[3] == ")":
                    multiline.pop()
                if "m" in on:
                    multiline[-1] = True
                if "m" in off:
                    multiline[-1] = False
                keep = lambda f: "".join(x for x in f if x != "m")  # noqa: E731 - anchors are written out
                unicode_fold = "u" if engine == "java" and "i" in on else ""
                flags = keep(on) + unicode_fold + (f"-{keep(off)}" if keep(off) else "")
                if m[3] == ")":
                    if flags:
                        out.append(f"(?{flags})")
                else:
                    out.append(f"(?{flags}:")
                i = m.end()
                continue
            out.append("(")
            i += 1
            continue
        if c == ")":
            if len(multiline) > 1:
                multiline.pop()
            out.append(")")
        elif c == "^":
            out.append(r"(?:\A|(?<=\n))" if multiline[-1] else r"\A")
        elif c == "$":
            out.append(f"(?:{end}|(?=\\n))" if multiline[-1] else end)
        elif c in "*+?":
            out.append(c)
            if pattern[i + 1 : i + 2] == "+":
                raise _fail(pattern, "possessive repeats are not supported")
        elif c == "{":
            m = _re.compile(r"\{(\d+)(,?)(\d*)\}").match(pattern, i)
            if m:
                if int(m[1]) > _MAX_REPEAT or int(m[3] or 0) > _MAX_REPEAT:
                    raise _fail(pattern, f"repeats above {_MAX_REPEAT} are not supported")
                if pattern[m.end() : m.end() + 1] == "+":
                    raise _fail(pattern, "possessive repeats are not supported")
                out.append(m[0])
                i = m.end()
                continue
            out.append(r"\{")
        elif c == "}":
            out.append(r"\}")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise _fail(pattern, "missing ]")
    return "".join(out)


@lru_cache(maxsize=4096)
def compile_python(pattern: str) -> regex.Pattern | _re.Pattern:
    """The pattern for Python, where the dot, like RE2's, stops at newlines only.

    The standard engine is the faster one; ``regex`` serves patterns with
    Unicode properties, which the standard engine does not know.
    """
    try:
        if _re.search(r"\\[pP]", pattern):
            return regex.compile(_translate(pattern, "regex"), regex.V0)
        return _re.compile(_translate(pattern, "python"))
    except (regex.error, _re.error) as e:
        raise _fail(pattern, str(e)) from e


@lru_cache(maxsize=4096)
def required_literals(pattern: str) -> tuple[str, ...]:
    """Casefolded strings of which every match holds one; empty where none can be told."""
    text = _re.sub(r"\\[pP](?:\{\^?\w+\}|\w)", r"\\w", _translate(pattern, "python"))
    try:
        tree = _parser.parse(text)
    except (_re.error, RecursionError):
        return ()
    best = _required(tree)
    return tuple(sorted(best)) if best and min(map(len, best)) > 1 else ()


def _required(tree) -> set[str] | None:
    """The best set of alternatives in a sequence: the one whose shortest member is longest."""
    sets: list[set[str]] = []
    run: list[str] = []

    def close() -> None:
        if run:
            sets.append({"".join(run).casefold()})
            run.clear()

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(arg))
            continue
        close()
        if name == "SUBPATTERN" and (inner := _required(arg[-1])):
            sets.append(inner)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1 and (inner := _required(arg[2])):
            sets.append(inner)
        elif name == "BRANCH":
            parts = [_required(x) for x in arg[1]]
            if all(parts):
                sets.append(set().union(*parts))
    close()
    return max(sets, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@lru_cache(maxsize=4096)
def leading_words(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII strings with one of which every match begins, at the begin of a word; empty where none can be told."""
    text = _translate(pattern, "python")
    try:
        found = _leading(_parser.parse(text), False)
    except (_re.error, RecursionError):
        return ()
    good = found and all(len(x) > 1 and x.isascii() and _re.match(f"[{WORD}]", x) for x in found)
    return tuple(sorted(x.lower() for x in found)) if good else ()


def _leading(tree, bounded: bool) -> set[str] | None:
    """The literals that a sequence begins with, after a boundary."""
    run: list[str] = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and bounded:
            run.append(chr(arg))
        elif run:
            break
        elif name == "AT" and str(arg).endswith("AT_BOUNDARY") or name == "SUBPATTERN" and [str(x) for x, _ in arg[-1]] == ["AT"] and str(arg[-1][0][1]) == "AT_BOUNDARY":
            bounded = True
        elif name == "SUBPATTERN" and bounded:
            return _leading(arg[-1], True)
        elif name == "BRANCH" and bounded:
            parts = [_leading(x, True) for x in arg[1]]
            return set().union(*parts) if all(parts) else None
        else:
            return None
    return {"".join(run)} if run else None


@lru_cache(maxsize=4096)
def to_java(pattern: str) -> str:
    """The pattern for Spark's functions; (?d) makes the dot stop at newlines only."""
    return "(?d)" + _translate(pattern, "java")


def expand(template: str, match: regex.Match | _re.Match) -> str:
    """Expand ``$1``, ``${name}`` and ``$$`` the way RE2's Go interface does."""

    def group(name: str) -> str:
        try:
            return (match[int(name)] if name.isdigit() else match[name]) or ""
        except (IndexError, KeyError):
            return ""

    def one(m: _re.Match) -> str:
        if m[0] == "$$":
            return "$"
        return group(m[1] or m[2])

    return _re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)", one, template)
