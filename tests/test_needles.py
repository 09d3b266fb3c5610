"""Needles of texts against plain substring tests, and what the rules' plans do with texts."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from siftwire.catalog import QUERIES
from siftwire.catalog.base import msgs
from siftwire.dims import rules as r
from siftwire.functions import needles as nd
from siftwire.functions import rx
from siftwire.functions.match import Message, _may_have
from siftwire.operators import flags as fl
from siftwire.operators import verdict as vd
from siftwire.plans.messages import TEMPLATES

SF = "/root/testdata/sf0.001"


def held(bits):
    return {w for w, k in nd.PLACE.items() if bits[k // 64] >> (k % 64) & 1}


def test_needles_of_texts_are_those_that_they_contain():
    rnd = random.Random(7)
    texts = [t.lower() for _, _, t in TEMPLATES] + ["", None, "k", "\u20b9", "parce", "long text " * 3000]
    for _ in range(400):
        texts.append("".join(rnd.choice([w := rnd.choice(nd.NEEDLES), w[1:], w[:-1], rnd.choice(" ab\u0930x")]) for _ in range(rnd.randint(0, 9))))
    found = nd.finder(nd.NEEDLES)(pa.array(["parcel", *texts]).slice(1)).to_pylist()
    for text, bits in zip(texts, found, strict=True):
        assert (bits is None) == (text is None)
        if text is not None:
            assert held(bits) == {w for w in nd.NEEDLES if w in text}, text


def test_every_rule_and_signal_is_tested_by_needles():
    for p in r.PATTERNS:
        assert nd.any_of("n", rx.needles(p)) is not None or not rx.needles(p)
        # one look at the needles' bits, no scan of the text for each of them
        assert "contains" not in (_may_have(Message("text", needles="n"), p) or "")
    # a pattern that is not among the rules' is left to the pattern itself
    assert _may_have(Message("text", needles="n"), "zebra crossing") is None


def test_masked_text_has_needles_of_its_own(spark):
    rows = spark.createDataFrame([(1, "see https://www.hdfcbank.com/kyc and my-kyc.top now"), (2, "see https://www.hdfcbank.com/kyc"),
                                  (3, "visit secure-login.xyz"), (4, None), (5, "")], "msg_id long, text string")
    assert {x["msg_id"] for x in fl.single_rule(rows, "suspicious_link").collect()} == {1, 3}
    assert [x["n"] for x in fl.with_flags(rows).select("msg_id", F.size("flags").alias("n")).where("msg_id >= 4").collect()] == [0, 0]


def test_texts_are_not_shuffled_and_judged_once(spark):
    plan = msgs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange RoundRobin")  # the deal is below the join that makes the text
    plan = QUERIES["j5_verdict_matrix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_matrices_of_several_judges(spark):
    rows = spark.createDataFrame([("spam", "spam", "ham"), ("spam", "unsure", "spam"), ("ham", "ham", "ham"), (None, "ham", "spam")], "expected string, verdict string, ml string")
    found = {(x["expected"], x["judge"]): (x["ham"], x["unsure"], x["spam"]) for x in vd.verdict_matrices(rows, "expected", {"full": "verdict", "ml": "ml"}).collect()}
    assert found == {("spam", "full"): (0, 1, 1), ("spam", "ml"): (1, 0, 1), ("ham", "full"): (1, 0, 0), ("ham", "ml"): (1, 0, 0),
                     (None, "full"): (1, 0, 0), (None, "ml"): (0, 0, 1)}
