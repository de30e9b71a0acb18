"""Profiles: the logical plan of a run, their algebra, and how one is resolved."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.errors import ProfileError, UnknownPresetError

MAPS = ("charReplace", "phraseReplace", "wordReplace", "regexReplace", "flagPatterns")
LISTS = ("blockWords", "allow", "tone")
SWITCHES = ("collapseSpaces", "splitSemicolons", "fixArticles", "protectQuotes")
#: Unicode white space.
UNICODE_SPACE = "\t\n\v\f\r \x85\xa0                　"
_spaces = re.compile(f"[{UNICODE_SPACE}]+")
_separators = re.compile("[\x1c-\x1f]")


def splitter(text: str) -> Callable[[str], list[str]]:
    """What gives the parts of this text, or of any piece of it, between runs of Unicode white space."""
    # Python also splits at four control characters
    return (lambda piece: [x for x in _spaces.split(piece) if x]) if _separators.search(text) else str.split


def fields(text: str) -> list[str]:
    """The parts between runs of Unicode white space."""
    return splitter(text)(text)


def trim(text: str) -> str:
    return text.strip(UNICODE_SPACE)


@dataclass(frozen=True)
class Profile:
    """What is flagged and what is rewritten.  Field names are those of the JSON form."""

    charReplace: Mapping[str, str] = field(default_factory=dict)
    phraseReplace: Mapping[str, str] = field(default_factory=dict)
    wordReplace: Mapping[str, str] = field(default_factory=dict)
    regexReplace: Mapping[str, str] = field(default_factory=dict)
    blockWords: Sequence[str] = ()
    flagPatterns: Mapping[str, str] = field(default_factory=dict)
    allow: Sequence[str] = ()
    collapseSpaces: bool = False
    splitSemicolons: bool = False
    fixArticles: bool = False
    protectQuotes: bool = False
    tone: Sequence[str] = ()
    dialect: str = ""

    def to_dict(self) -> dict:
        return {k: list(v) if k in LISTS else dict(v) if k in MAPS else v for k, v in asdict(self).items()}

    def to_json(self, pretty: bool = False) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))

    @staticmethod
    def from_dict(data: Mapping) -> Profile:
        """Unset fields are empty, unknown ones ignored; field names match in any case."""
        known = {k.lower(): k for k in (*MAPS, *LISTS, *SWITCHES, "dialect")}
        out: dict = {}
        for key, value in data.items():
            name = known.get(str(key).lower())
            if name is None or value is None:
                continue
            kind = dict if name in MAPS else list if name in LISTS else bool if name in SWITCHES else str
            if not isinstance(value, kind):
                raise ProfileError(f"profile decode: {name} must be {kind.__name__}")
            parts = [*value.keys(), *value.values()] if kind is dict else value if kind is list else []
            if any(not isinstance(x, str) for x in parts):
                raise ProfileError(f"profile decode: {name} must hold strings")
            out[name] = tuple(value) if kind is list else value
        return Profile(**out)


def default_profile() -> Profile:
    return Profile(
        charReplace=fixed.CHAR_REPLACE,
        phraseReplace=dict.fromkeys(fixed.PHRASE_DROPS, ""),
        blockWords=fixed.BLOCK_WORDS,
        flagPatterns=fixed.FLAG_PATTERNS,
        allow=fixed.ALLOW,
        collapseSpaces=True,
        splitSemicolons=True,
        fixArticles=True,
    )


def load_profile(text: str) -> Profile:
    try:
        data = json.JSONDecoder().raw_decode(text.lstrip())[0]
    except ValueError as e:
        raise ProfileError(f"profile decode: {e}") from e
    if not isinstance(data, dict):
        raise ProfileError("profile decode: not an object")
    return Profile.from_dict(data)


def load_profile_file(path: str | os.PathLike) -> Profile:
    return load_profile(Path(path).read_text(encoding="utf-8"))


# --- algebra -------------------------------------------------------------------


def union_map(low: Mapping[str, str], high: Mapping[str, str]) -> dict[str, str]:
    """Union of two maps; ``high`` wins on a shared key."""
    return {**low, **high}


def ordered_union(a: Sequence[str], b: Sequence[str]) -> tuple[str, ...]:
    return tuple(a) if not b else tuple(dict.fromkeys([*a, *b]))


def preset_names() -> list[str]:
    return sorted(fixed.PRESETS)


def load_preset(name: str) -> Profile:
    if name not in fixed.PRESETS:
        raise UnknownPresetError(f"unknown preset {name!r}: have {', '.join(preset_names())}")
    return Profile.from_dict(fixed.PRESETS[name])


def with_preset(base: Profile, pack: Profile) -> Profile:
    """``pack`` under ``base``: maps but the flag patterns, block words and allow list."""
    maps = {k: union_map(getattr(pack, k), getattr(base, k)) for k in MAPS if k != "flagPatterns"}
    lists = {k: ordered_union(getattr(base, k), getattr(pack, k)) for k in ("blockWords", "allow")}
    return replace(base, **maps, **lists)


def apply_presets(base: Profile, names: Sequence[str]) -> Profile:
    for name in names:
        base = with_preset(base, load_preset(name))
    return base


def overlay(base: Profile, top: Profile) -> Profile:
    """``top`` over ``base``: all maps and lists; switches and dialect stay the base's."""
    maps = {k: union_map(getattr(base, k), getattr(top, k)) for k in MAPS}
    return replace(base, **maps, **{k: ordered_union(getattr(base, k), getattr(top, k)) for k in LISTS})


@dataclass(frozen=True)
class Voice:
    """A personal layer: terms to keep, swaps to prefer, words to avoid, notes on tone."""

    keep: Sequence[str] = ()
    prefer: Mapping[str, str] = field(default_factory=dict)
    avoid: Sequence[str] = ()
    tone: Sequence[str] = ()

    @property
    def empty(self) -> bool:
        return not (self.keep or self.prefer or self.avoid or self.tone)

    def as_profile(self) -> Profile:
        sizes = {k: len(fields(k)) for k in self.prefer}
        return Profile(
            allow=tuple(self.keep),
            blockWords=tuple(self.avoid),
            tone=tuple(self.tone),
            wordReplace={k: v for k, v in self.prefer.items() if sizes[k] == 1},
            phraseReplace={k: v for k, v in self.prefer.items() if sizes[k] > 1},
        )


def load_voice(text: str) -> Voice:
    try:
        data = json.JSONDecoder().raw_decode(text.lstrip())[0]
    except ValueError as e:
        raise ProfileError(f"voice decode: {e}") from e
    if not isinstance(data, dict):
        raise ProfileError("voice decode: not an object")
    low = {str(k).lower(): v for k, v in data.items() if v is not None}
    return Voice(keep=tuple(low.get("keep", ())), prefer=dict(low.get("prefer", {})), avoid=tuple(low.get("avoid", ())), tone=tuple(low.get("tone", ())))


def with_voice(base: Profile, voice: Voice) -> Profile:
    return base if voice.empty else overlay(base, voice.as_profile())


def resolve(profile: Profile | None = None, presets: Sequence[str] = (), voice: Voice | None = None, dialect: str | None = None) -> Profile:
    """The profile of a run: given or default, presets under it, a voice over these, and a given profile over the voice."""
    out = default_profile() if profile is None else profile
    if dialect:
        out = replace(out, dialect=dialect)
    out = apply_presets(out, presets)
    if voice is not None and not voice.empty:
        out = with_voice(out, voice)
        if profile is not None:
            out = overlay(out, profile)
    return out


# --- small parsers around profiles -----------------------------------------------


def split_list(text: str) -> list[str]:
    """A comma list without blanks."""
    return [x for x in (trim(p) for p in text.split(",")) if x]


def parse_pairs(text: str) -> dict[str, str]:
    """Lines of ``a => b``; without an arrow, or with nothing after it, a deletion."""
    out = {}
    for line in text.split("\n"):
        left, _, right = line.partition("=>")
        if trim(left):
            out[trim(left)] = trim(right)
    return out


def parse_lines(text: str) -> list[str]:
    return [x for x in (trim(line) for line in text.split("\n")) if x]


def merge_tone(existing: Sequence[str], notes: Sequence[str]) -> list[str]:
    """Both lists, each note once by its trimmed lower-case form, the first kept."""
    first: dict[str, str] = {}
    for note in [*existing, *notes]:
        if key := trim(note).lower():
            first.setdefault(key, note)
    return list(first.values())


def parse_tone_notes(reply: str) -> list[str]:
    """The JSON array between the first and the last bracket of a reply."""
    a, b = reply.find("["), reply.rfind("]")
    if a < 0 or b <= a:
        raise ProfileError("the reply had no JSON array")
    try:
        notes = json.loads(reply[a : b + 1])
    except ValueError as e:
        raise ProfileError(f"tone notes decode: {e}") from e
    if any(not isinstance(x, str) for x in notes):
        raise ProfileError("tone notes decode: not strings")
    notes = [trim(x) for x in notes if trim(x)]
    if not notes:
        raise ProfileError("the reply had no tone notes")
    return notes


# --- options ---------------------------------------------------------------------

OPTIONS = (
    "profile", "dialect", "preset", "voice", "json", "pretty", "markdown", "write", "rewrite", "provider", "model", "base-url",
    "judge-provider", "judge-model", "judge-base-url", "verify", "verify-strict", "verify-retry", "max",
)
_BOOLS = {"json", "pretty", "markdown", "write", "rewrite", "verify", "verify-strict"}
_INTS = {"verify-retry": 1, "max": -1}


def option(name: str, given: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None, prefix: str = "TELLGRID", default=None):
    """A run's option: given, else the environment's, else the default; what cannot be parsed is the default."""
    if name not in OPTIONS:
        raise KeyError(name)
    if default is None:
        default = False if name in _BOOLS else _INTS.get(name, "")
    raw = (given or {}).get(name)
    if raw is None:
        raw = (env or {}).get(f"{prefix}_{name.upper().replace('-', '_')}")
    if raw is None or raw == "":
        return default
    if name in _BOOLS:
        return {"1": True, "t": True, "true": True, "0": False, "f": False, "false": False}.get(str(raw).lower(), default)
    if name in _INTS:
        try:
            return int(raw)
        except ValueError:
            return default
    return raw


def validate_options(command: str, given: Mapping[str, str], files: int = 0) -> None:
    """Combinations that make no sense raise before anything is read."""
    on = lambda k: option(k, given) not in (False, "", None)
    rules = [
        (command == "fix" and on("write") and on("json"), "write and json cannot be combined"),
        (command == "fix" and on("json") and files > 1, "json takes one file"),
        (command == "fix" and on("write") and files == 0, "write needs a file"),
        (command == "fix" and files > 1 and not on("write"), "several files need write"),
        (on("pretty") and not on("json"), "pretty needs json"),
        *[(k in given and not on("rewrite"), f"{k} needs rewrite") for k in ("provider", "model", "base-url")],
        (on("verify") and not on("rewrite"), "verify needs rewrite"),
        *[(k in given and not on("verify"), f"{k} needs verify") for k in ("verify-strict", "verify-retry", "judge-provider", "judge-model", "judge-base-url")],
        (option("verify-retry", given) < 0, "verify-retry must not be negative"),
        (command in ("check", "score") and on("json") and files > 1, "json takes one file"),
    ]
    for bad, why in rules:
        if bad:
            raise ProfileError(why)
