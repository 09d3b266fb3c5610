"""Character references against the Python library's own decoder."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from siftwire.functions import entities


def decoded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.d for r in rows.select("i", entities.resolve(F.col("t")).alias("d")).orderBy("i").collect()]


def test_every_name(spark):
    texts = [f"a&{name}b" for name in html5] + [f"&{name}" for name in html5]
    assert decoded(spark, texts) == [html.unescape(x) for x in texts]


def test_every_kind_of_number(spark):
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600,
               0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 9_999_999, 10_000_000, 10**30]
    texts = [f"x&#{n};y" for n in numbers] + [f"&#x{n:x}" for n in numbers] + [f"&#X{n:X};&#000{n}z" for n in numbers]
    assert decoded(spark, texts) == [html.unescape(x) for x in texts]


def test_generated(spark):
    rng = random.Random(3)
    names = sorted(html5)
    bits = ["&", "#", ";", "x", "X", "amp", "lt", "not", "notin", "é", " ", "<", "\n", "9", "12", "0", "f", "😀", "&&", "&#", "&#x", "\\", "$1"]
    texts = []
    for _ in range(4000):
        parts = []
        for _ in range(rng.randint(0, 8)):
            name = rng.choice(names)
            parts.append(rng.choice([rng.choice(bits), f"&{name}", f"&{name[:rng.randint(1, len(name))]}", f"&#{rng.randrange(70000)}"]))
        texts.append("".join(parts))
    assert decoded(spark, texts) == [html.unescape(x) for x in texts]


def test_defined_cases(spark):
    # null stays null, nothing is resolved twice, and a long run of ampersands is no deep recursion
    long = "&" * 20000 + "&eacute;" * 20000
    assert decoded(spark, [None, "", "&amp;lt;", long]) == [None, "", "&lt;", html.unescape(long)]


def test_the_name_table_is_a_constant(spark):
    df = spark.createDataFrame([("&lt;",)], "t string").select(entities.resolve(F.col("t")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split(" AS ")[0].count("substring_index(substring_index([") == 1  # an array literal, not 256 expressions
