"""First-match helpers for rule patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import needles, rx
from .rows import bound
from .text import strip

SNIPPET_CHARS = 60

@dataclass(frozen=True)
class Message:
    """A text column, by name or (inside a lambda) as a column, and the names of its folded form and of its needles if any.

    With both, the needles are those of the text where the folded form is null.

    Named columns are tested through SQL text: a rule set holds hundreds of substring tests, and
    one parsed expression is built far faster than hundreds of column objects.
    """

    raw: Column | str
    folded: str | None = None
    needles: str | None = None

    @property
    def column(self) -> Column:
        return F.col(f"`{self.raw}`") if isinstance(self.raw, str) else self.raw


def sql_text(text: str) -> str:
    """String literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold(text: Column) -> Column:
    """Lower case, with the four other characters that count as i, s or k when case is ignored."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.lower(F.when(ascii_only, text).otherwise(F.translate(text, "İıſK", "iisk")))


def _may_have(msg: Message, pattern: str) -> str | None:
    """Substring tests that every match of the pattern passes; None when there are none."""
    words = rx.needles(pattern)
    if not words:
        return None
    read = msg.folded and "(" + " OR ".join(f"contains(`{msg.folded}`, {sql_text(w)})" for w in words) + ")"
    known = msg.needles and needles.any_of(msg.needles, words)
    if read and msg.needles:
        # where the text has no form of its own and the needles don't tell, the pattern decides
        return f"(CASE WHEN `{msg.folded}` IS NOT NULL THEN {read} ELSE {known or 'true'} END)"
    return read or known


def _matches(msg: Message, pattern: str, flags: str) -> str:
    return f"rlike(`{msg.raw}`, {sql_text(rx.java(pattern, flags))})"


def _guarded(cheap: str, exact: str) -> str:
    """``exact`` where ``cheap`` holds.  With AND, a pattern that several rules test is run ahead of all their cheap tests."""
    return f"CASE WHEN {cheap} THEN {exact} ELSE false END"


def has(msg: Message, pattern: str, flags: str = "is") -> Column:
    if not isinstance(msg.raw, str):
        return F.rlike(msg.raw, F.lit(rx.java(pattern, flags)))
    cheap = _may_have(msg, pattern)
    exact = _matches(msg, pattern, flags)
    return F.expr(exact if cheap is None else _guarded(cheap, exact))


def first(msg: Message, pattern: str, flags: str = "is") -> Column:
    """First match, stripped; empty string without a match."""
    return strip(F.regexp_extract(msg.column, rx.java(pattern, flags), 0))


def all_of(msg: Message, patterns) -> Column:
    """True when every pattern occurs: substring tests of all of them first, then the patterns."""
    cheap = [c for c in (_may_have(msg, p) for p in patterns) if c is not None]
    exact = " AND ".join(_matches(msg, p, "is") for p in patterns)
    return F.expr(_guarded(" AND ".join(cheap), exact) if cheap else exact)


def snippets(items: Column) -> Column:
    """Cut to 60 characters, repeats (ignoring case) dropped, order kept."""
    cut = F.transform(items, lambda m: F.substring(m, 1, SNIPPET_CHARS))
    return bound(cut, lambda c: bound(
        F.transform(c, lambda m: F.lower(m)),
        lambda low: F.filter(c, lambda m, i: F.array_position(low, F.lower(m)) == (i + 1).cast("long"))))


def literal_map(items: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(sql_text(x) for pair in items.items() for x in pair) + ")")
