"""Character references (``&name;``, ``&#233;``, ``&#xE9;``) resolved inside the row.

The names are the standard's own table as the Python library holds it, forms without a semicolon
included.  A text is cut at its ampersands, so a reference lies at the start of one piece; a pattern
shaped like a tree of the names finds the longest one that the piece starts with.
"""

from __future__ import annotations

import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import bound

#: Parts of the name table; a name is sought in the part that its checksum gives.
PARTS = 256
#: Numbers 128 to 159 mean what the Windows code page has there; its gaps stay control characters.
C1 = tuple(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
BAD = "\ufffd"
_PAIR, _NEXT = "\x01", "\x02"


def tree(names) -> str:
    """A pattern for the longest of these names that a text starts with; branches begin with different characters."""
    branches: dict[str, list[str]] = {}
    for name in names:
        if name:
            branches.setdefault(name[0], []).append(name[1:])
    if not branches:
        return ""
    inner = "|".join(first + tree(rest) for first, rest in sorted(branches.items()))
    if "" in names:
        return f"(?:{inner})?"
    return f"(?:{inner})" if len(branches) > 1 else inner


_NAME = "^" + tree(list(html5))
_DECIMAL, _HEX = "^#0*([0-9]+);?", "^#[xX]0*([0-9a-fA-F]+);?"


def _named(name: Column) -> Column:
    """The characters of a name of the table: its part is a text of names and values between marks."""
    parts = [_NEXT] * PARTS
    for key, value in html5.items():
        parts[zlib.crc32(key.encode()) % PARTS] += f"{key}{_PAIR}{value}{_NEXT}"
    part = F.get(F.array(*map(F.lit, parts)), (F.crc32(name.cast("binary")) % PARTS).cast("int"))
    behind = F.call_function("substring_index", part, F.concat(F.lit(_NEXT), name, F.lit(_PAIR)), F.lit(-1))
    return F.substring_index(behind, _NEXT, 1)


def of_number(n: Column) -> Column:
    """The character of a number; no text for numbers that stand for none, U+FFFD for surrogates, 0 and those out of range."""
    low = n.bitwiseAND(F.lit(0xFFFF))
    nothing = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE))
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), BAD)
            .when(n.between(0x80, 0x9F), F.get(F.split(F.lit(_NEXT.join(C1)), _NEXT), n - 0x80))
            .when(nothing, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def _piece(p: Column) -> Column:
    """What follows an ampersand, with the reference that it starts with resolved."""
    def number(pattern: str, digits: int, base: int) -> Column:
        read = F.regexp_extract(p, pattern, 1)
        n = F.when(F.length(read) > digits, F.lit(0x110000)).otherwise(F.conv(read, base, 10).cast("int"))
        return F.concat(bound(n, of_number), F.regexp_replace(p, pattern, ""))

    def name(found: Column) -> Column:
        rest = F.substring(p, F.length(found) + 1, F.length(p))
        return F.when(found == "", F.concat(F.lit("&"), p)).otherwise(F.concat(_named(found), rest))

    return (F.when(F.rlike(p, F.lit(_DECIMAL)), number(_DECIMAL, 7, 10)).when(F.rlike(p, F.lit(_HEX)), number(_HEX, 6, 16))
            .otherwise(bound(F.regexp_extract(p, _NAME, 0), name)))


def resolve(text: Column) -> Column:
    """The text with every character reference resolved once; what is none stays, and so does a null."""
    def joined(pieces: Column) -> Column:
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _piece), ""))

    return F.when(F.contains(text, F.lit("&")), bound(F.split(text, "&"), joined)).otherwise(text)
