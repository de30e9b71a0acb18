"""British and American spellings."""

from __future__ import annotations

from dataclasses import dataclass

from tellgrid.plans import fixed_values as fixed
from tellgrid.plans.errors import UnknownDialectError


@dataclass(frozen=True)
class SpellingPair:
    british: str
    american: str
    oneway: bool = False  # the American form is also another word, so only British text is changed


def spelling_pairs() -> tuple[SpellingPair, ...]:
    """All pairs, ordered by their British form."""
    return tuple(sorted((SpellingPair(*x) for x in fixed.SPELLINGS), key=lambda p: p.british))


def dialect_name(dialect: str) -> str:
    """american, british, or the empty string for none; raises for any other name."""
    low = dialect.lower()
    if low in ("", "off", "none"):
        return ""
    if low in ("american", "british"):
        return low
    raise UnknownDialectError(f"unknown dialect {dialect!r}")


def spelling_map(dialect: str) -> dict[str, str]:
    """Foreign spelling -> the dialect's own."""
    if dialect == "american":
        return {p.british: p.american for p in spelling_pairs()}
    if dialect == "british":
        return {p.american: p.british for p in spelling_pairs() if not p.oneway}
    return {}
