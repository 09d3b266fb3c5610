"""Terms by chunks against plain counters, and what of them travels."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from siftwire.catalog.features import derived_model, light
from siftwire.operators import explain as x
from siftwire.operators import features as f
from siftwire.operators import grams
from siftwire.operators import model as md

TEXTS = [(1, "Free cash, free CASH now"), (2, None), (3, "é漢 🙂🙂x a.b_c ٣"), (1, "now free"), (4, ""), (5, "a b\x1cc d"), (6, "free " * 40), (None, "cash")]


def windows(word):
    pad = f" {word} "
    return [pad[i:i + n] for n in (3, 4, 5) if n <= len(pad) for i in range(len(pad) - n + 1)]


def plain():
    tf = defaultdict(Counter)
    for key, text in TEXTS:
        tokens = regex.findall(r"[\p{L}\p{N}_]+", text or "")
        tf[key] += Counter(("word", w) for w in tokens) + Counter(("word", f"{a} {b}") for a, b in zip(tokens, tokens[1:], strict=False))
        tf[key] += Counter(("char", g) for w in regex.findall(r"[^\s\x1c-\x1f\x85\p{Z}]+", text or "") for g in windows(w))
    return tf


def test_terms_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(grams, "LEAST", 20)
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    terms = f.term_table(rows, "doc_id", "text", "text", with_bias=True)
    want = {(k, *g): n for k, c in plain().items() for g, n in (c + Counter([("bias", "")])).items()}
    got = {(r.doc_id, r.kind, r.gram): r.tf for r in terms.rows().where("kind <> 'bias'").collect()}
    assert got == {k: n for k, n in want.items() if k[1] != "bias"}
    found = terms.counts().collect()
    assert len({r.chunk for r in found}) > 1
    assert len(found) == len({(r.chunk, r.kind, r.gram) for r in found})  # a chunk's gram travels once, however many messages have it
    df = Counter((kind, g) for _, kind, g in want)
    assert {(r.kind, r.gram): r.df for r in f.document_frequency(terms).collect()} == df


def test_known_terms_have_length_one_and_the_top_is_whole(spark, monkeypatch):
    monkeypatch.setattr(grams, "LEAST", 20)
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    terms = f.term_table(rows, "doc_id", "text", "text")
    vocab = f.document_frequency(terms).where("gram <> 'now'").select("kind", "gram", (1 + 1 / F.col("df")).alias("idf"), (F.length("gram") % 5 - 2).cast("double").alias("w"))
    idf = {(r.kind, r.gram): (r.idf, r.w) for r in vocab.collect()}
    model = md.Model(vocab, len(idf))
    got = {(r.doc_id, r.kind, r.gram): (r.x, r.c) for r in md.contributions(terms, model).collect()}
    want = {}
    for key, tf in plain().items():
        raw = {g: (math.log(n) + 1) * idf[g][0] for g, n in tf.items() if g in idf}
        for kind, gram in raw:
            x = raw[kind, gram] / math.sqrt(sum(v * v for g, v in raw.items() if g[0] == kind))
            want[key, kind, gram] = x, x * idf[kind, gram][1]
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    some = {(r.doc_id, r.kind, r.gram): r.c for r in md.contributions(terms, model, top=2).collect()}
    assert len(some) < len(got)
    for key in {k[0] for k in want}:
        for sign in (1, -1):
            sizes = sorted((round(c * sign, 4) for k, (_, c) in want.items() if k[0] == key and c * sign > 0), reverse=True)[:2]
            kept = sorted((round(c * sign, 4) for k, c in some.items() if k[0] == key and c * sign > 0), reverse=True)
            assert kept[:2] == sizes


def test_numbers_too_large_for_one_word_are_counted_alike():
    keys, times = np.array([1 << 61, 5, 1 << 61, 5, 7]), np.array([3, 1, 4, 1, 1])
    assert [x.tolist() for x in grams.counted(keys, times)] == [[5, 7, 1 << 61], [2, 1, 7]]
    assert [x.tolist() for x in grams.counted(keys)] == [[5, 7, 1 << 61], [2, 1, 2]]


def test_positions_equal_those_of_the_row_by_row_form_and_no_gram_of_a_message_travels(spark, monkeypatch):
    monkeypatch.setattr(grams, "LEAST", 20)
    monkeypatch.setattr(grams, "ROWS", 7)
    texts = ["free cash, free-cash now", "a.b a b", "a.b.a c b.a a.b.c", "x.x x", "x.x", "", None, "é漢 🙂🙂x ٣ é漢", "aaaa aaaa b-a-b-a end", "... now ... now", "free " * 30]
    rows = light(spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string"))
    model = derived_model(f.with_idf(f.vocabulary(f.term_table(rows), {"word": 1, "char": 1}), rows).where("gram <> 'now'"))
    new = x.feature_table(rows, model)
    got = {(r.msg_id, r.kind, r.gram): r for r in new.collect()}
    want = {(r.msg_id, r.kind, r.gram): r for r in x.feature_table(rows, model, at_rest=True).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k].hits == want[k].hits and np.isclose(got[k].c, want[k].c) for k in want)
    assert any(len(r.hits) == 2 and " " in r.gram and r.kind == "word" for r in got.values())
    some = {(r.msg_id, r.kind, r.gram): r.hits for r in x.feature_table(rows, model, top=2).collect()}
    assert len(some) < len(got) and all(got[k].hits == hits for k, hits in some.items())
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(msg_id" not in plan


def test_only_packed_grams_travel(spark, monkeypatch):
    monkeypatch.setattr(grams, "LEAST", 20)
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    terms = f.term_table(rows, "doc_id", "text", "text", with_bias=True)
    want = {(r.kind, r.gram): (r.df, r.total) for r in terms.counts().groupBy("kind", "gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect()}
    assert {(r.kind, r.gram): (r.df, r.total) for r in f.document_frequency(terms).collect()} == want
    low = {"word": 2, "char": 3}
    assert {(r.kind, r.gram) for r in f.vocabulary(terms, low).collect()} == {k for k, (df, _) in want.items() if df >= low.get(k[0], 3)}
    vocab = f.document_frequency(terms).select("kind", "gram", F.lit(1.5).alias("idf"), F.length("gram").cast("double").alias("w"))
    z = md.score(terms, md.Model(vocab, len(want)))
    sums = {r.doc_id: r.z for r in terms.known(vocab, ("w",)).groupBy("doc_id").agg(F.sum(F.col("x") * F.col("w")).alias("z")).collect()}
    got = {r.doc_id: r.z for r in z.collect()}
    assert got.keys() == sums.keys() == {k for k, _ in TEXTS} and all(np.isclose(got[k], sums[k]) for k in sums)
    for df in (f.vocabulary(terms), z, terms.known(vocab)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "gram#" not in "".join(regex.findall(r"Exchange [^\n]*", plan)) and "Join" not in plan


def test_packed_grams_come_back_whole():
    assert all(chr(c).isspace() == grams.classes()[1][c] for c in range(len(grams.classes()[1])))  # what str.split goes by
    rng = np.random.default_rng(2)
    for size in (1, 2, 40, 300):
        names = sorted("".join(rng.choice(list("abé漢 "), rng.integers(0, 6))) for _ in range(size))
        part, blob = grams.packed(pa.array(names), np.zeros(size, np.int8), 3, [np.arange(size)])
        found = [grams.loaded(b) for b in blob]
        assert sorted(zip(grams.unpacked(found).to_pylist(), np.concatenate([x[4] for x in found]).tolist(), strict=True)) == sorted(zip(names, range(size), strict=True))
        assert len(set(part)) == len(part)
    for column in (np.array([], np.int64), np.arange(5), np.array([7, 7, -7, 7])):
        assert grams.uncoded(*grams.coded(column)).tolist() == column.tolist()


def test_scores_and_means_folded_at_the_texts_equal_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(grams, "LEAST", 20)
    monkeypatch.setattr(grams, "ROWS", 7)
    texts = ["free cash, free-cash now", "a.b a b", "a.b.a c b.a a.b.c", "x.x x", "", None, "é漢 🙂🙂x ٣ é漢", "aaaa  aaaa\tb-a-b-a end", "... now ... now", "free " * 30 + "Free 9 now"]
    rows = light(spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string"))
    model = derived_model(f.with_idf(f.vocabulary(f.term_table(rows), {"word": 1, "char": 1}), rows).where("gram <> 'now'"))
    features, there = x.feature_table(rows, model), x.Pointing(rows, model, chars="norm")
    scores = x.word_scores(features)
    got, want = ({(r.msg_id, r.pos): r.score for r in df.collect()} for df in (x.word_scores(there), scores))
    assert got.keys() == want.keys() and len(got) > 40 and all(np.isclose(got[k], want[k]) for k in want)
    folded = x.word_means(rows, x.word_scores(there, rows=False))
    got, means = ({(r.msg_id, r.word): r["mean"] for r in df.collect()} for df in (folded, x.word_means(rows, scores)))
    assert got.keys() == means.keys() and all(np.isclose(got[k], means[k]) for k in means)
    assert "hits" not in folded._jdf.queryExecution().executedPlan().toString()
    spans = {(r.msg_id, r.start, r.end, r.text): r.score for r in x.highlights(rows, folded).collect()}
    norm = {r.token: r.norm.split() for r in x.with_normalised(x.text_tokens(rows), "token").collect()}
    want = {}
    for r in x.text_tokens(rows).collect():
        s = [means[r.msg_id, w] for w in norm[r.token] if (r.msg_id, w) in means]
        if s and abs(sum(s)) >= x.MIN_SPAN:
            want[r.msg_id, r.start, r.end, r.token] = sum(s)
    assert spans.keys() == want.keys() and len(spans) > 10 and all(abs(spans[k] - want[k]) < 6e-4 for k in want)


def test_source_words_need_the_first_place_of_a_word_only(spark, monkeypatch):
    monkeypatch.setattr(grams, "LEAST", 20)
    rows = light(spark.createDataFrame([(1, "free cash " * 40), (2, "cash now"), (3, "a.b a b a.b"), (3, "b a.b"), (4, "")], "msg_id long, text string"))
    model = derived_model(f.with_idf(f.vocabulary(f.term_table(rows), {"word": 1, "char": 1}), rows))
    whole, first = ({(r.msg_id, r.kind, r.gram): r.hits for r in x.feature_table(rows, model, first_of_word=some).collect()} for some in (False, True))
    words = {1: ["free", "cash"] * 40, 2: ["cash", "now"]}
    assert whole.keys() == first.keys() and max(map(len, whole.values())) >= 40
    for k, hits in whole.items():
        if k[0] in words:
            kept = [words[k[0]][p] for p in first[k]]
            assert len(set(kept)) == len(kept) and set(kept) == {words[k[0]][p] for p in hits}
        else:
            assert first[k] == hits
