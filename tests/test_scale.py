"""Steps that must not be repeated or done in one task."""

import re

from pyspark.sql import functions as F

from siftwire.catalog import features
from siftwire.functions import rx
from siftwire.functions import text as t
from siftwire.operators import corpus as c
from siftwire.operators import normal as nm

SF = "/root/testdata/sf0.001"
ODD = [None, "", "don ' t", "$ 1 , 000 now", "a@b.co @ x@y", "£  5", "€ 5 ₹ 7", "ABC ABCD eABC ABC1 _ABC ABC", "AB ABC",
       "x ' y ' z", "$ 1 @ m.n@o.pq.rs..", "É ABC ÉABC", "a.b@c-d.e_f. g"]


def test_texts_without_its_sign_skip_a_pattern(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "msg_id long, text string")
    joined = F.col("text")
    for pattern, by in ((r"(\w)\s+'\s+(\w)", "$1'$2"), (r"\s+([.,!?;:%)])", "$1"), (r"(\d)\s*([.,])\s*(\d)", "$1$2$3"), ("([$£€₹])\\s+(\\d)", "$1$2")):
        joined = F.regexp_replace(joined, rx.java(pattern, ""), by)
    marked = joined
    for token, pattern in t._PLACEHOLDER_RX:
        marked = F.regexp_replace(marked, pattern, f" {token} ")
    plain = F.concat(t.squeeze_lower(marked), F.when(F.regexp_count(joined, F.lit(rx.java(t.CAPS_WORD, ""))) >= 2, " zzcaps").otherwise(""))
    found = nm.with_normalised(rows).select("norm", plain.alias("plain")).collect()
    assert [x["norm"] for x in found] == [x["plain"] for x in found]
    text = nm.with_normalised(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text#" in text and ", @)" in text


def test_labelled_texts_are_dealt_before_their_patterns_run(spark):
    plan = features.labelled(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"RoundRobinPartitioning\(\d+\)", plan)


def test_counts_read_digests_not_texts(spark, tmp_path):
    rows = spark.createDataFrame([("A b!", 1, "x", 0, 1), ("a  B", 0, "y", 1, 1), ("c d", 1, "y", 1, 2), ("c, d", 0, "y", 1, 3), ("?", 1, "y", 1, 4)],
                                 "text string, label int, source string, prio int, ord long")
    whole = c.prepare(rows)
    lean = c.digested(whole, str(tmp_path / "lean"))
    assert set(lean.columns) == {"label", "source", "prio", "ord", "key"} and {len(x["key"]) for x in lean.collect()} == {64}
    stats = [sorted(map(tuple, c.source_stats(p, c.first_wins(p)).collect())) for p in (whole, lean)]
    assert stats[0] == stats[1] == [("x", 1, 1, 0, 0), ("y", 1, 1, 0, 2)]
