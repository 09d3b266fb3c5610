"""Host column expressions: parsing, ownership, registrable part, brand imitation, kind.

All of them work on plain columns and inside ``transform`` lambdas, so a link array can be
classified inside its row: no shuffle, and the same code runs on a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import domains as d
from . import rx
from .match import literal_map
from .rows import bound

_PATH = r"""[^\s<>"'()]"""
_TAIL = rx.java_body(rf"(?:{d.LINK_TLDS})\b(?:[/:?#]{_PATH}*)?", fold=True)
LINK = "(?iu)" + "|".join((
    rx.java_body(rf"(?:https?://|www\.){_PATH}+", fold=True),
    rx.java_body(r"(?<![\w@.-])", fold=True) + rx.dotted("a-z0-9@-") + _TAIL,
    rx.java_body(r"(?<![\w.-])", fold=True) + rx.dotted("a-z0-9-") + _TAIL,
    rx.java_body(rf"(?:{d.SHORT_LINK_HOSTS})/\S+", fold=True),
))


def _brand_pattern(pattern: str, keywords: tuple[str, ...]) -> str:
    return "|".join([pattern, *(rx.one_typo(k) for k in keywords)])


_BRANDS = tuple((name, "(?s)" + _brand_pattern(p, kws)) for name, p, kws in d.HOST_BRANDS)
_ANY_BRAND = "(?s)" + "|".join(_brand_pattern(p, kws) for _, p, kws in d.HOST_BRANDS)
_TEXT_BRANDS = tuple((name, rx.java(p, "i")) for name, p in d.TEXT_BRANDS)
_ANY_TEXT_BRAND = rx.java("|".join(p for _, p in d.TEXT_BRANDS), "i")
_OWNER_LABELS = max(k.count(".") + 1 for k in d.OFFICIAL)
_SUFFIX_LABELS = max(k.count(".") + 1 for k in d.NEUTRAL_SUFFIXES)


def link_matches(text: Column) -> Column:
    """Every link in the text; a text without a dot or a scheme holds none and is not searched."""
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    return F.when(F.contains(text, F.lit(".")) | F.contains(text, F.lit("://")), found).otherwise(
        F.array().cast("array<string>"))


def trim_link(match: Column) -> Column:
    return F.rtrim(match, F.lit(d.LINK_TAIL))


def authority(raw: Column) -> Column:
    """Text between the scheme and the first ``/ ? # \\``."""
    return F.regexp_extract(F.regexp_replace(raw, "(?iu)^https?://", ""), r"^[^/?#\\]*", 0)


def split_userinfo(auth: Column) -> tuple[Column, Column]:
    """(text before the last ``@``, text after it)."""
    after = F.substring_index(auth, "@", -1)
    before = F.when(
        F.contains(auth, F.lit("@")), F.substring(auth, F.lit(1), F.length(auth) - F.length(after) - 1)
    ).otherwise(F.lit(""))
    return before, after


def host_of(site: Column) -> Column:
    """Port dropped, lower-cased, outer dots and one leading ``www.`` dropped."""
    h = F.btrim(F.lower(F.substring_index(site, ":", 1)), F.lit("."))
    return F.regexp_replace(h, r"^www\.", "")


def owner_of(host: Column) -> Column:
    """Owner by the longest allowlist entry that the host equals or ends with, else NULL."""
    owners = literal_map(d.OFFICIAL)
    h = F.regexp_replace(F.btrim(F.lower(host), F.lit(".")), r"^www\.", "")
    return bound(h, lambda x: F.coalesce(*[
        F.try_element_at(owners, F.substring_index(x, ".", -k)) for k in range(_OWNER_LABELS, 0, -1)]))


def registrable(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*d.TWO_LEVEL), F.substring_index(host, ".", -3)).otherwise(two)


def is_shortener(host: Column) -> Column:
    return host.isin(*d.SHORTENERS)


def is_neutral(host: Column) -> Column:
    by_suffix = [F.substring_index(host, ".", -k).isin(*d.NEUTRAL_SUFFIXES) for k in range(1, _SUFFIX_LABELS + 1)]
    return reduce(lambda a, b: a | b, [host.isin(*d.NEUTRAL), *by_suffix])


def host_tokens(host: Column) -> Column:
    """Labels without the public suffix, each whole and then in hyphen pieces."""

    def pieces(labels: Column) -> Column:
        two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
        suffix = F.when((F.size(labels) >= 3) & two.isin(*d.TWO_LEVEL), 2).otherwise(1)
        kept = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - suffix, F.lit(0)))
        kept = F.when(F.size(kept) > 0, kept).otherwise(labels)
        return F.filter(F.flatten(F.transform(kept, lambda lab: F.concat(
            F.array(lab), F.filter(F.split(lab, "-"), lambda p: p != lab)))), lambda t: t != "")

    return bound(F.split(host, r"\."), pieces)


def homoglyph_variants(token: Column) -> Column:
    digits = F.translate(token, d.HOMOGLYPH_FROM, d.HOMOGLYPH_TO)
    l_form = F.translate(F.translate(token, d.L_FORM_FROM, d.L_FORM_TO), d.HOMOGLYPH_FROM, d.HOMOGLYPH_TO)

    def merged(v: Column) -> Column:
        return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), d.HOMOGLYPH_PAIRS, v)

    return bound(F.array(token, digits, l_form),
                 lambda vs: F.array_distinct(F.concat(vs, F.transform(vs, merged))))


def host_variants(host: Column) -> Column:
    """Every variant of every token, in (token, variant) order."""
    return F.array_distinct(F.flatten(F.transform(host_tokens(host), homoglyph_variants)))


def brand_of_variant(variant: Column) -> Column:
    """First brand, in list order, whose pattern or one-typo form is in the variant."""
    hit = F.lit(None).cast("string")
    for name, pattern in reversed(_BRANDS):
        hit = F.when(F.rlike(variant, F.lit(pattern)), F.lit(name)).otherwise(hit)
    return hit


def brand_of_host(host: Column) -> Column:
    """First brand in (token, variant, brand) order, else NULL.

    One combined pattern finds the first variant that carries any brand; the separate patterns
    run on that variant only.
    """
    first = F.slice(F.filter(host_variants(host), lambda v: F.rlike(v, F.lit(_ANY_BRAND))), F.lit(1), F.lit(1))
    return F.get(F.transform(first, brand_of_variant), F.lit(0))


def brands_in_text(text: Column) -> Column:
    """Names of the brands in the text, in list order."""
    named = F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(name)) for name, p in _TEXT_BRANDS]))
    return F.when(F.rlike(text, F.lit(_ANY_TEXT_BRAND)), named).otherwise(F.array().cast("array<string>"))


def classify(host: Column, userinfo: Column) -> Column:
    """``struct<kind, owner, brand, official_host>`` of one host.

    The brand patterns run on the decoy in front of an ``@``, and on the host only where nothing
    else has settled its kind.
    """
    def facts(owner: Column) -> Column:
        plain = (F.when(owner.isNotNull(), "official").when(is_shortener(host), "shortener")
                 .when(is_neutral(host), "neutral"))
        return bound(plain, lambda k: F.struct(owner.alias("owner"), k.alias("plain"), F.transform(F.array(
            F.when(userinfo != "", F.concat(F.replace(userinfo, F.lit("@"), F.lit(".")), F.lit(".x"))),
            F.when(userinfo != "", F.concat(userinfo, F.lit(".x"))),
            F.when(k.isNull(), host)), lambda x: brand_of_host(x)).alias("brands")))

    def final(f: Column) -> Column:
        decoy = F.get(f["brands"], F.lit(0)).isNotNull()
        own = F.get(f["brands"], F.lit(2))
        kind = F.when(decoy, "lookalike").otherwise(F.coalesce(
            f["plain"], F.when(own.isNotNull(), "lookalike").otherwise("other")))
        owner = F.when(decoy | f["plain"].isNull(), registrable(host)).otherwise(f["owner"])
        brand = F.when(decoy, F.get(f["brands"], F.lit(1))).otherwise(own)
        return F.struct(kind.alias("kind"), owner.alias("owner"), brand.alias("brand"),
                        f["owner"].isNotNull().alias("official_host"))

    return bound(bound(owner_of(host), facts), final)
