"""Regular-expression dialect helpers.

Rule and brand patterns are kept in one plain dialect (``\\w``, ``\\b``, ``\\s``, ``\\d`` all
Unicode-aware, marks are not word characters).  Java reads those escapes differently from
release to release, so ``java()`` spells each of them out as an explicit class.

Two things make long word lists cheap.  A list such as ``parcel|courier|deliver`` tries every word
at every character; with the first letters in front as a look-ahead
(``(?=[pPcCdD])(?:parcel|courier|deliver)``) many positions cost one table lookup.  And
``needles()`` names substrings of which every match holds at least one, so that a plain
``contains`` can rule a message out before any pattern runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Unicode word characters (letters and numbers of any kind, underscore; no combining marks).
WORD = r"\p{L}\p{N}_"
# Unicode white space: Java's ASCII set, the information separators, NEL and all separators.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"

NOT_IN_WORD_BEFORE = rf"(?<![{WORD}])"
NOT_IN_WORD_AFTER = rf"(?![{WORD}])"
BOUNDARY = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

_OUTSIDE = {
    "w": f"[{WORD}]", "W": f"[^{WORD}]",
    "s": f"[{SPACE}]", "S": f"[^{SPACE}]",
    "d": DIGIT, "D": r"\P{Nd}",
}
_INSIDE = {"w": WORD, "s": SPACE, "d": DIGIT, "v": r"\x0B"}
# letters that fold to an ASCII letter besides its two cases
_FOLDS = {"i": "İı", "k": "K", "s": "ſ"}
# the nested-group form of a dotted host name, replaced by the looped form of ``dotted``
_DOTTED_PLAIN, _DOTTED_MARK = r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.", "\ue000"
_NARROW = 30  # a first-letter set wider than this is not worth testing ahead

_PIECE = re.compile(
    r"(?P<open>\(\?(?::|=|!|<=|<!)|\()|(?P<close>\))|(?P<bar>\|)"
    r"|(?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<esc>\\.)|(?P<lit>.)", re.S)
_REPEAT = re.compile(r"(?:[*+?]|\{\d*,?\d*\})[?+]?")


@dataclass
class _Item:
    """One element of a sequence: its Java text, its first and last characters, whether it may be empty."""

    text: str
    first: frozenset | None = None  # None: anything
    last: frozenset | None = None
    empty: bool = False
    edge: bool = False  # a word boundary still to be spelled out
    char: str = ""  # the one character it stands for, if any
    needles: frozenset | None = None  # every match holds at least one of these


@dataclass
class _Reader:
    pattern: str
    at: int = 0
    depth: int = 0

    def alternatives(self, fold: bool) -> _Item:
        branches = [self._sequence(fold)]
        while self.pattern[self.at:self.at + 1] == "|":
            self.at += 1
            branches.append(self._sequence(fold))
        return _join(branches, fold, top=self.depth == 0)

    def _sequence(self, fold: bool) -> _Item:
        items: list[_Item] = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            m = _PIECE.match(self.pattern, self.at)
            self.at = m.end()
            if m["open"]:
                self.depth += 1
                inner = self.alternatives(fold)
                self.depth -= 1
                self.at += 1  # the closing bracket
                item = _Item(f"{m['open']}{inner.text})", inner.first, inner.last, inner.empty,
                             needles=inner.needles)
                if m["open"] not in ("(", "(?:"):
                    item = _Item(item.text, frozenset(), frozenset(), True)
            else:
                item = _atom(m)
            rep = _REPEAT.match(self.pattern, self.at)
            if rep and not item.edge:
                self.at = rep.end()
                optional = rep[0][0] in "*?" or rep[0].startswith(("{0", "{,"))
                item = _Item(item.text + rep[0], item.first, item.last, item.empty or optional,
                             char="" if optional else item.char, needles=None if optional else item.needles)
                items.append(item)
                items.append(_Item("", frozenset(), frozenset(), True, char="\n"))  # ends a literal run
                continue
            items.append(item)
        return _chain(items)


def _atom(m: re.Match) -> _Item:
    if m["esc"]:
        c = m["esc"][1]
        if c == "b":
            return _Item("", frozenset(), frozenset(), True, edge=True)
        if c == "d":
            return _Item(DIGIT, frozenset({DIGIT}), frozenset({DIGIT}))
        if c in _OUTSIDE:
            return _Item(_OUTSIDE[c])
        if c.isalnum():
            return _Item(m["esc"])
        return _Item(m["esc"], frozenset(c), frozenset(c), char=c)
    if m["cls"]:
        body = re.sub(r"\\(.)", lambda e: _INSIDE.get(e[1], e[0]), m["cls"])
        plain = re.fullmatch(r"\[([^\\^\]-]+)\]", m["cls"])
        chars = frozenset(plain[1]) if plain else None
        return _Item(body, chars, chars)
    if m["lit"] == _DOTTED_MARK:
        return _Item(dotted("a-z0-9-"))
    if m["lit"] == ".":
        return _Item(".")
    if m["lit"] in "^$":
        return _Item(m["lit"], frozenset(), frozenset(), True)
    return _Item(m["lit"], frozenset(m["lit"]), frozenset(m["lit"]), char=m["lit"])


def _reach(items: list[_Item], side: str) -> frozenset | None:
    """Characters a run of items can start (or, read backwards, end) with."""
    seen: frozenset = frozenset()
    for it in items:
        chars = getattr(it, side)
        if chars is None:
            return None
        seen |= chars
        if not it.empty:
            return seen
    return None if not items or all(i.empty for i in items) else seen


def _all_word(chars: frozenset | None) -> bool:
    return bool(chars) and all(c == DIGIT or c.isalnum() or c == "_" for c in chars)


def _chain(items: list[_Item]) -> _Item:
    out = []
    for k, it in enumerate(items):
        if not it.edge:
            out.append(it.text)
        elif _all_word(_reach(items[k + 1:], "first")):
            out.append(NOT_IN_WORD_BEFORE)
        elif _all_word(_reach(items[:k][::-1], "last")):
            out.append(NOT_IN_WORD_AFTER)
        else:
            out.append(BOUNDARY)
    return _Item("".join(out), _reach(items, "first"), _reach(items[::-1], "last"),
                 all(i.empty for i in items), needles=_sequence_needles(items))


def _sequence_needles(items: list[_Item]) -> frozenset | None:
    """The literal run or word list of a sequence whose shortest entry is longest."""
    found = [it.needles for it in items if it.needles]
    run = ""
    for it in [*items, _Item("", char="\n")]:
        if it.char and it.char != "\n":
            run += it.char
        elif it.char or not it.empty or it.first != frozenset():
            if run:
                found.append(frozenset({run.lower()}))
            run = ""
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def _union(sets: list) -> frozenset | None:
    return None if any(s is None for s in sets) else frozenset().union(*sets)


def _look_ahead(chars: frozenset, fold: bool) -> str:
    letters: set[str] = set()
    for c in chars - {DIGIT}:
        letters |= {c, c.lower(), c.upper(), *_FOLDS.get(c.lower(), "")} if fold else {c}
    body = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in sorted(letters) if len(c) == 1)
    case = "(?-i)" if fold else ""  # every case is listed, and a case-blind class would be slower
    return f"(?={case}[{body}{DIGIT if DIGIT in chars else ''}])"


def _join(branches: list[_Item], fold: bool, top: bool) -> _Item:
    """Alternatives in their order; neighbours with few first letters share one look-ahead."""
    parts: list[str] = []
    run: list[_Item] = []

    def flush() -> None:
        if not run:
            return
        text = "|".join(b.text for b in run)
        chars = _union([b.first for b in run])
        if len(chars) <= _NARROW and (len(run) > 2 or top):
            text = _look_ahead(chars, fold) + (f"(?:{text})" if len(run) > 1 else text)
        parts.append(text)
        run.clear()

    for b in branches:
        if b.first and not b.empty and len(b.first) <= _NARROW:
            run.append(b)
        else:
            flush()
            parts.append(b.text)
    flush()
    return _Item("|".join(parts), _union([b.first for b in branches]), _union([b.last for b in branches]),
                 any(b.empty for b in branches), needles=_union([b.needles for b in branches]))


@lru_cache(maxsize=None)
def needles(pattern: str) -> list[str]:
    """Lower-case substrings one of which is in every match; empty when there is no such set."""
    found = _Reader(pattern.replace(_DOTTED_PLAIN, _DOTTED_MARK)).alternatives(True).needles or ()
    # a needle that holds another one adds nothing
    return sorted(n for n in found if not any(o != n and o in n for o in found))


def java(pattern: str, flags: str = "is") -> str:
    """Plain dialect -> Java pattern text with inline flags."""
    if "i" in flags:
        flags += "u"
    return (f"(?{flags})" if flags else "") + java_body(pattern, fold="i" in flags)


@lru_cache(maxsize=None)
def java_body(pattern: str, fold: bool) -> str:
    """The same without flags, for use inside a larger pattern; ``fold``: that one ignores case."""
    return _Reader(pattern.replace(_DOTTED_PLAIN, _DOTTED_MARK)).alternatives(fold).text


def dotted(chars: str) -> str:
    """``(?:[chars]+\\.)+`` without per-label recursion in the matcher.

    Java recurses once per repetition of a group whose width varies, so a message made of
    thousands of dots would overflow a task's stack.  A one-character group with a look-behind is
    repeated in a loop instead: a first label, no two dots in a row, and a dot at the end.
    """
    return rf"(?=[{chars}]++\.)(?:[.{chars}](?<!\.\.))+(?<=\.)"


def one_typo(word: str) -> str:
    """Pattern for ``word`` with at most one edit (drop, add, change, swap neighbours) inside a string.

    Nested by prefix, so a scan gives up at the first character that cannot start the word.
    """
    tail = ""
    for i in range(len(word) - 1, -1, -1):
        rest = word[i + 1:]
        edits = [rest, "." + rest]
        if i > 0:
            edits.append("." + word[i:])
        if rest:
            edits.append(rest[0] + word[i] + rest[1:])
        exact = word[i] + tail
        tail = "(?:" + "|".join([exact] + [e for e in edits if e or i]) + ")"
    return tail
