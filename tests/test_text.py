"""Dialect, normalisation and n-grams against small restatements in Python."""

import random
import re

from pyspark.sql import functions as F

from siftwire.functions import rx
from siftwire.functions import text as t


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def near(a, b):
    """At most one drop, add, change or swap apart."""
    if a == b:
        return True
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        swap = len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]
        return len(diff) == 1 or swap
    if abs(len(a) - len(b)) != 1:
        return False
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def test_one_typo_equals_windowed_distance():
    rng = random.Random(7)
    for word in ("paypal", "hdfcbank", "flipkart"):
        pattern = re.compile(rx.one_typo(word), re.S)
        for _ in range(3000):
            chars = list(word)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(chars))
                chars[i:i + rng.randint(0, 2)] = rng.choices("abcdefhklpty", k=rng.randint(0, 2))
                chars = chars or ["a"]
            s = "".join(rng.choices("axp", k=rng.randint(0, 2))) + "".join(chars)
            n = len(word)
            expect = any(near(s[i:i + k], word) for k in (n - 1, n, n + 1) for i in range(len(s) - k + 1))
            assert bool(pattern.search(s)) == expect, (s, word)


def test_every_match_holds_a_needle():
    pattern = r"parcel|packa?ge|\b(?:won|wi+n)\b\s?\d|don'?t (?:tell|call)"
    for text in ("my parcel", "a packge", "won 5", "wiin 3", "dont call", "don't tell"):
        assert re.search(pattern, text)
        assert any(n in text for n in rx.needles(pattern)), text
    assert rx.needles(r"\d+|abc") == []


def test_dialect(spark):
    assert one(spark, "बधाई", t.word_tokens) == ["बध", "ई"]
    assert not one(spark, "élan", lambda c: F.rlike(c, F.lit(rx.java(r"\blan\b"))))
    assert one(spark, "a b", t.split_words) == ["a", "b"]
    assert one(spark, "a \t b\r\n \n\n c\x0b", t.clean) == "a b\n\n c"  # a blank after the squeezed lines stays


def test_normaliser(spark):
    src = "Win $ 1 , 000 NOW!!! Call +91 98765 43210 or visit www.win-big.xyz, email prize@win.com. FREE ENTRY"
    assert one(spark, src, t.normalise) == (
        "win zzmoney zznum now!!! call zzphone or visit zzurl email zzemail . free entry zzcaps")
    assert one(spark, "I don ' t know .", t.normalise) == "i don't know."
    assert one(spark, "1.5a 12,5", t.normalise) == "zznum .5a zznum"


def test_long_dotted_text_does_not_overflow(spark):
    for s in ("a." * 3000, "1," * 3000 + "1", "x@" + "a." * 2900 + "com"):
        assert one(spark, s, t.normalise) is not None


def windows(word):
    p, out = f" {word} ", []
    for n in (3, 4, 5):
        if n >= len(p):
            return out + [p]
        out += [p[i:i + n] for i in range(len(p) - n + 1)]
    return out


def test_char_grams_and_counts(spark):
    text = "a ab abc abcdef abc éà"
    expect = [g for w in text.split() for g in windows(w)]
    assert one(spark, text, t.char_grams) == expect
    counted = one(spark, text, lambda c: t.run_counts(t.char_grams(c)))
    assert {(r.gram, r.tf) for r in counted} == {(g, expect.count(g)) for g in expect}
    assert one(spark, "", lambda c: t.run_counts(t.char_grams(c))) == []


def test_html(spark):
    html = "<style>x{}</style><p>A &amp; B<br/>c</p><SCRIPT a=1>var t='</p>'</SCRIPT>d"
    assert one(spark, html, t.html_to_text).split() == ["A", "&", "B", "c", "d"]
