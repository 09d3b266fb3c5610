"""Text column expressions: cleaning, HTML reduction, normalisation, tokens and n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import entities, rx
from .rows import bound

# --- fixed values: length limits in characters; texts are taken whole unless a caller passes them ----
SHORT_TEXTS = {"clean": 4000, "norm": 6000, "norm_short": 1500}
GATE_CHARS = 10000

# --- fixed values: placeholder patterns and tokens --------------------------------------------------
NORMAL_URL_TLDS = "com|net|org|info|biz|ly|in|co|io|xyz|top|club|online|site|me|us|uk|ru|cn"
PLACEHOLDERS = ("zzemail", "zzurl", "zzmoney", "zzphone", "zznum")
MONEY_SIGN = r"[$£€₹¥]|\b(?:rs|inr|usd|eur|gbp)\b\.?"
PHONE_RUN = r"(?<![\w])\+?\d[\dXx\s().-]{8,}\d(?![\w])"
CAPS_WORD = r"\b[A-Z]{3,}\b"

_URL = rx.java(
    rf"(?:https?://|www\.)\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{NORMAL_URL_TLDS})\b(?:/\S*)?", "i")
# first label and dot, then single characters with no two dots in a row, ending on a label
_EMAIL = rx.java(r"\b[\w.+-]+@[\w-]++\.[\w-](?:[\w.-](?<!\.\.))*(?<=[\w-])\b", "")
# digits with single separators between them
_NUM = rx.java(r"(?<![a-z0-9])\d(?:[\d.,](?<![.,][.,]))*(?<=\d)(?![a-z0-9])", "i")

_PLACEHOLDER_RX = tuple(zip(PLACEHOLDERS, (
    _EMAIL, _URL, rx.java(MONEY_SIGN, "i"), rx.java(PHONE_RUN, ""), _NUM)))

_EDGE_SPACE = rf"^[{rx.SPACE}]+|[{rx.SPACE}]+\z"
_SPACES = rf"[{rx.SPACE}]+"
_WORD_RUN = rf"[{rx.WORD}]+"


def strip(text: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~F.rlike(text, F.lit(rf"[^{rx.SPACE}]"))


def cut(text: Column, limit: int | None) -> Column:
    """The first ``limit`` characters; the whole text without a limit."""
    return text if limit is None else F.substring(text, 1, limit)


def clean(text: Column, limit: int | None = None) -> Column:
    """Carriage returns out, runs of blanks to one space, blank lines squeezed, stripped; cut if a limit is given."""
    c = F.replace(text, F.lit("\r"), F.lit(""))
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, rf"\n[{rx.SPACE}]*\n+", "\n\n")
    return cut(strip(c), limit)


def html_to_text(html: Column) -> Column:
    """Style and script bodies out, line-ending tags to newlines, other tags to spaces, character references resolved."""
    c = F.regexp_replace(html, r"(?is)<(style|script)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, rf"(?iu)<br[{rx.SPACE}]*/?>|</p>|</div>|</tr>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return entities.resolve(c)


def dedup_key(text: Column) -> Column:
    """Lower-cased text with every run of non-word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^{rx.WORD}]+", " "))


def _where_any(text: Column, signs: str, changed: Column, same: Column) -> Column:
    """``changed`` where the text has one of the signs that the change needs, else ``same``: a scan is far cheaper than a pattern."""
    return F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in signs)), changed).otherwise(same)


def undo_pretokenised(text: Column) -> Column:
    """``don ' t`` -> ``don't``, `` .`` -> ``.``, ``1 , 000`` -> ``1,000``, ``$ 1`` -> ``$1``."""
    c = _where_any(text, "'", F.regexp_replace(text, rx.java(r"(\w)\s+'\s+(\w)", ""), "$1'$2"), text)
    c = F.regexp_replace(c, rx.java(r"\s+([.,!?;:%)])", ""), "$1")
    c = F.regexp_replace(c, rx.java(r"(\d)\s*([.,])\s*(\d)", ""), "$1$2$3")
    # the steps before neither add nor drop such a sign
    return _where_any(text, "$£€₹", F.regexp_replace(c, rx.java(r"([$£€₹])\s+(\d)", ""), "$1$2"), c)


def caps_count(text: Column) -> Column:
    # three capitals are looked for first, since most places have none
    return F.regexp_count(text, F.lit("(?=[A-Z]{3})" + rx.java(CAPS_WORD, "")))


def substitute_placeholders(text: Column) -> Column:
    (email, address), *others = _PLACEHOLDER_RX
    c = _where_any(text, "@", F.regexp_replace(text, address, f" {email} "), text)
    for token, pattern in others:
        c = F.regexp_replace(c, pattern, f" {token} ")
    return c


def squeeze_lower(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, _SPACES, " ")))


def normalise(text: Column, limit: int | None = None) -> Column:
    """Whole normalisation as one expression; ``with_normalised`` shares its steps between columns."""
    joined = undo_pretokenised(cut(text, limit))
    body = squeeze_lower(substitute_placeholders(joined))
    return F.concat(body, F.when(caps_count(joined) >= 2, F.lit(" zzcaps")).otherwise(F.lit("")))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD_RUN), F.lit(0))


def word_grams(tokens: Column) -> Column:
    """Single tokens, then neighbours joined by a space."""
    pairs = F.zip_with(
        tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def split_words(text: Column) -> Column:
    """White-space separated words; no empty words."""
    return F.regexp_extract_all(text, F.lit(rf"[^{rx.SPACE}]+"), F.lit(0))


#: Shortest and longest window.
WINDOWS = (3, 5)


def padded_windows(word: Column, low: int = WINDOWS[0], high: int = WINDOWS[1]) -> Column:
    """Windows of ``low..high`` characters over the word padded by one space on each side.

    A word that is not longer than the window once padded is given whole, once.
    """
    def cut_up(p: Column) -> Column:
        # largest useful window: the padded word itself when it is short
        top = F.greatest(F.lit(low), F.least(F.length(p), F.lit(high)))
        return F.flatten(F.transform(
            F.sequence(F.lit(low), top),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))),
                lambda i: F.substring(p, i, n))))

    # padded once a word, not once a window
    return bound(F.concat(F.lit(" "), word, F.lit(" ")), cut_up)


def char_grams(text: Column) -> Column:
    return F.flatten(F.transform(split_words(text), lambda w: padded_windows(w)))


def run_counts(items: Column) -> Column:
    """Array -> ``array<struct<gram, tf>>`` of its distinct items, without a shuffle.

    Sort, keep the positions where a new item begins, and take the gaps between them.
    """
    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(s)),
                        lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))

    def counted(s: Column) -> Column:
        return bound(starts(s), lambda b: F.zip_with(
            b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s) + 1)),
            lambda here, after: F.struct(F.get(s, here - 1).alias("gram"), (after - here).cast("long").alias("tf"))))

    empty = F.array().cast("array<struct<gram:string,tf:bigint>>")
    return F.when(F.size(items) > 0, bound(F.sort_array(items), counted)).otherwise(empty)
