"""Tokenizer, decontamination, line and substring dedup, similarity join, personal data, scores: small cases and brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from siftwire.llm import bpe, brown, decontamination, jaccard, lines, pii, queries, suffixes, toxicity
from siftwire.llm.common import stored, words



tiktoken = pytest.importorskip("tiktoken")
ODD = [None, "", "   \n\t ", "a", "x" * 70_000, "naïve café 漢字 🙂 123", "a b c d e f g h"]


def rng_texts(n, seed=3, words=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "in", "it"] + ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 7))) for _ in range(120)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, words))) for _ in range(n)]
    out = []
    for k, text in enumerate(base):
        kind = k % 5
        if kind == 1:
            text = base[k - 1]
        elif kind == 2:
            w = base[k - 2].split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = text + "\n" + base[0] + " " + base[5 % n] + "\n" + text[:20]
        out.append(text)
    return out


def table(spark, texts, extra=True):
    rows = [(i, t, "en", "s", -1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    return df.withColumnsRenamed({"node": "ids"}) if extra else df.drop("node")


def test_prefixes_equal_the_tokenizer_and_edits_reuse_them():
    path, pattern = queries.tokenizer()
    encoder, own, vocabulary = bpe.ready(bpe.read_ranks(path), pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(5)
    for k in range(600):
        text = "".join(rng.choice("abc defgh  \n\t'éßñ漢1234.,!?À🙂%##aa") for _ in range(rng.randrange(80)))
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == other.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()
        piece = text.encode() or b"x"
        prefixes = bpe.Prefixes(encoder, piece[:5])
        prefixes.append(piece[5:])
        at = rng.randrange(len(piece))
        prefixes.replace(at, min(3, len(piece) - at), b"zq")
        assert prefixes.tokens() == bpe.Prefixes(encoder, prefixes.data).tokens()


def test_encoding_round_trip(spark):
    path, pattern = queries.tokenizer()
    df = bpe.decode(bpe.encode(table(spark, ODD), path, pattern), path)
    rows = {r.doc_id: r for r in df.collect()}
    for i, text in enumerate(ODD):
        assert bytes(rows[i].decoded) == (text or "").encode() and rows[i].n_tokens == len(rows[i].ids) // 4
    assert bpe.encode(table(spark, []), path, pattern).count() == 0


def brute_removed(docs):
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], d)
    out = []
    for d, t in docs:
        b, m = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - 49):
            if d is not None and first[b[i:i + 50]] < d:
                m[i:i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((d, len(b), sum(m), len([x for x in bytes(m).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_against_brute_force(spark):
    texts = rng_texts(60) + ODD + ["z" * 300, "z" * 49, "z" * 50, "é" * 80]
    docs = [*enumerate(texts), (3, texts[3]), (None, texts[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r)[:5] for r in suffixes.removed(df).collect()), key=repr)
    assert got == brute_removed(docs)
    assert suffixes.removed(df.limit(0)).count() == 0


def test_substrings_of_texts_beyond_16_mib(spark):
    long = np.random.default_rng(7).integers(97, 123, 17_500_000, np.uint8).tobytes()
    late = b"#" * 60 + long[17_000_000:17_000_050] + b"$" * 60
    docs = [(0, long), (1, long), (2, b"%" * 1000 + long[3:]), (3, late)]
    got = {r.doc_id: r for r in suffixes.removed(spark.createDataFrame([(d, t.decode()) for d, t in docs], "doc_id long, text string")).collect()}
    assert (got[0].n_removed, got[1].n_removed, got[1].n_spans) == (0, len(long), 1)
    for d, t in docs[2:]:
        mark = np.zeros(len(t), bool)
        for i in [*range(min(1100, len(t) - 49))]:
            mark[i:i + 50] |= t[i:i + 50] in long
        if d == 2:
            mark[1000:] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mark])
        assert (got[d].n_removed, got[d].kept_sha256) == (int(mark.sum()), hashlib.sha256(kept).hexdigest())


def test_substrings_in_batches_of_one_text(spark):
    docs = [(k, "every text here is the same text of more than fifty letters") for k in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = sorted(tuple(r)[:5] for r in suffixes.removed(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_removed(docs)


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in range(len(texts)))


def test_buckets_of_suffixes_grow_with_the_text_not_with_the_session(spark, monkeypatch):
    texts = rng_texts(60, seed=8, words=60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(tuple(r)[:5] for r in suffixes.removed(df).collect())
    monkeypatch.setattr(suffixes, "BUCKET", 400)
    n = suffixes.parts(df)
    assert n >= sum(len(t.encode()) for t in texts) / 400 > 8 and n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert suffixes.parts(df.limit(0)) == 8
    small = suffixes.removed(df)
    assert sorted(tuple(r)[:5] for r in small.collect()) == whole and any(r[2] for r in whole)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(bucket#\d+, {n}\), REPARTITION_BY_NUM", plan)) >= 2


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_similarity_components_against_brute_force(spark, width, percent):
    near = "one two three four five six seven eight nine ten " * 8
    words = near.split()
    chain = [" ".join(words[:80 - k] + [f"w{k}x{j}" for j in range(k)]) for k in range(9)]
    texts = rng_texts(80) + ODD + chain
    got = sorted(map(tuple, jaccard.components(table(spark, texts), width, percent).collect()))
    assert got == brute_components(texts, width, percent)


def test_similarity_without_rows_or_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (2, "q"), (5, "q")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.components(df, 4, 85).collect()), key=repr)
    assert got == sorted([(None, 1, None), (5, 1, 2), (5, 1, 2), (2, 1, 2), (5, 1, 2)], key=repr)
    assert jaccard.components(df.limit(0), 4, 85).count() == 0


@pytest.mark.parametrize("words_", [200, 60])
def test_pairs_follow_the_members_of_a_group(spark, monkeypatch, words_):
    """Groups of near copies, linked to each other (200 words) or hardly (60): pairs that are looked at stay in proportion to the texts."""
    rng = random.Random(1)
    texts = []
    for group, size in enumerate((20, 40, 48, 49, 400)):
        base = [f"g{group}w{k}" for k in range(words_)]
        for k in range(size):
            mine = list(base)
            mine[rng.randrange(words_)] = f"new{group}x{k}"
            texts.append(" ".join(mine))
    seen = []
    for name in ("star_pairs", "open_pairs"):
        job = getattr(jaccard, name)

        def counted(*args, job=job, **more):
            out = stored(job(*args, **more), "pairs")
            seen.append(out.count())
            return out

        monkeypatch.setattr(jaccard, name, counted)
    got = sorted(map(tuple, jaccard.components(table(spark, texts), 4, 85).collect()))
    assert got == brute_components(texts, 4, 85)
    assert words_ == 60 or sum(seen) <= 4 * len(texts)


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 9, (300, 6))
    n = points.sum(1)
    found = {(int(a), int(b)) for x, y in jaccard.tree_pairs(points, n, points, n, 80) for a, b in zip(x, y, strict=True)}
    for a in range(300):
        for b in range(300):
            possible = np.minimum(points[a], points[b]).sum() >= jaccard.need(n[a], n[b], 80) and min(n[a], n[b]) * 100 >= max(n[a], n[b]) * 80
            assert ((a, b) in found) == bool(possible)


def plain_units(text):
    out, start = [], 0
    for piece in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text or ""):
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), piece))
        if found:
            out.append((start, start + len(piece), " ".join(found)))
        start += len(piece)
    return out


def test_lines_equal_a_plain_dictionary(spark):
    rng = random.Random(8)
    said = [" ".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 9))) + rng.choice(".!?\n") for _ in range(25)] + ["Same  Line\n", "same line\n", "...", "\n\n"]
    texts = ["".join(rng.choice(said) for _ in range(rng.randrange(12))) for _ in range(80)] + [None, "", "  \n "]
    docs = [(None if k == 5 else k, t) for k, t in enumerate(texts)]
    docs.append(docs[7])  # a row that repeats a document
    df = spark.createDataFrame([(k, t, "u", 1, "d") for k, t in docs], "doc_id long, text string, unit string, row int, lines_gone_ string").repartition(4)
    marked = stored(lines.repeated(df), "m")
    places, times = {}, Counter()
    for k, t in docs:
        for u, (s, _, c) in enumerate(plain_units(t)):
            places[c] = min(places.get(c, (math.inf,)), (-1 if k is None else k, u, s))
            times[c] += 1
    for least in (0, 6):
        want, kept = [], []
        for k, t in docs:
            run, gone = [], []
            for u, (s, e, c) in [*enumerate(plain_units(t)), (-1, (0, 0, None))]:
                if c is not None and times[c] > 1:
                    run.append((s, e, len(c.split()), places[c][:2] != (-1 if k is None else k, u), places[c][0]))
                    continue
                if run and sum(r[2] for r in run) >= least:
                    first = min(r[4] for r in run)
                    want.append((k, run[0][0], run[-1][1], len(run), sum(r[2] for r in run), sum(r[3] for r in run), None if first < 0 else first))
                    gone += [(s, e) for s, e, _, away, _ in run if away]
                run = []
            for s, e in reversed(gone):
                t = t[:s] + t[e:]
            kept.append((k, t))
        got = [tuple(r) for r in lines.passages(marked, least).collect()]
        # a null counts as the least id: min() leaves it out
        assert sorted((r[:6] for r in got), key=repr) == sorted((r[:6] for r in want), key=repr)
        assert all(a[6] == b[6] for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True) if b[6] is not None and a[:6] == b[:6])
        out = lines.kept_texts(df, lines.removed(marked, least))
        assert out.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(kept, key=repr)
    empty = df.limit(0)
    assert lines.passages(lines.repeated(empty)).count() == 0 and lines.kept_texts(empty, lines.removed(lines.repeated(empty))).count() == 0


def test_frequent_units_travel_with_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 10)
    df = spark.createDataFrame([(k, f"one common line here\nown {k // 2}\n" * 2) for k in range(40)], "doc_id long, text string")
    found = lines.passages(lines.repeated(df), 0).collect()
    assert len(found) == 40 and all(r.n_units == 4 for r in found) and sum(r.n_removed for r in found) == 160 - 21


def test_runs_below_the_floor_have_a_query(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(30)) + ".\n"
    texts = ["Only here.\nshort line\nonly here too.\n" + long, "SHORT  line\nnew words!\n", long + "last", None, "", "nothing shared"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    least = {name: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) for name in ("op5_line_dedup", "repeated_line_runs")}
    assert [(r[0], r[4], r[5]) for r in least["op5_line_dedup"]] == [(0, 30, 0), (2, 30, 1)]
    assert [(r[0], r[4], r[5]) for r in least["repeated_line_runs"]] == [(0, 2, 0), (0, 30, 0), (1, 2, 1), (2, 30, 1)]
    assert set(least["op5_line_dedup"]) < set(least["repeated_line_runs"])


def test_decontamination_tolerates_substitutions(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"
    changed = item.replace("echo", "other").replace("lima", "else")
    texts = ["noise before " + item + " after", "NOISE, " + changed.upper(), "alpha bravo charlie", None, "", " ".join(f"w{k}" for k in range(500))]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "five small words here now")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.overlaps(table(spark, [*texts, "see five small words here now ok"]), bench).collect()}
    assert set(rows) == {0, 1, 6} and rows[0].n_equal == 16 and rows[0].start == 2 and rows[1].n_equal == 14 and rows[6].item_id == 10
    assert {r.doc_id for r in decontamination.clean(table(spark, texts), bench).collect()} == {2, 3, 4, 5}
    assert decontamination.overlaps(table(spark, texts), bench.limit(0)).count() == 0


def brute_base(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())
    found = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    ok = [lambda m: True, lambda m: all(int(p) < 256 for p in m.group().split(".")), lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m)),
          lambda m: 8 <= len(digits(m)) <= 15]
    return [[m.span() for m in re.finditer(p, text) if t(m)] for p, t in zip(found, ok, strict=True)]


def test_strict_spans_and_similar_mentions(spark):
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@+-_ ()0123456789 1.2.3.4") for _ in range(60))
        assert pii.base_spans(text) == brute_base(text)
    texts = ["call +1 (743) 555-3824 now or 743 555-3824 later", "mail joe.b@mail5.example.com or not",
             "number 12345678 alone", None, "", "card 4785380592391139 and 4785 3805 9239 1139", "0" * 6000 + ".1.1.1"] 
    df = table(spark, texts)
    plain = [f"+1 (743) 555-38{k:02d} or joe{k}@mail.example.com or 4785380592391139 or 10.0.0.{k} or {k}2345678" for k in range(40)]
    field = pii.learned(table(spark, plain))
    rows = {r.doc_id: r for r in pii.find(df, field).collect()}
    assert rows[0].n_phone == 1 and rows[0].spans == "phone:5:22,phone:30:42"
    assert rows[2].spans == rows[3].spans == rows[4].spans == ""
    assert all(r.base in r.spans for r in rows.values())
    clean = {r.doc_id: r.text for r in pii.redact(df, field).collect()}
    assert clean[0] == "call [PHONE] now or [PHONE] later" and clean[3] is None and clean[2] == texts[2]


def test_scores_against_brute_force(spark):
    texts = rng_texts(50) + ODD
    rows = [*enumerate(texts), (4, texts[4]), (None, "the of")]
    got = brown.score(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    tokens = [((t or "").encode().lower().split() + [None], zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 0) for d, t in rows]
    c = Counter(w for x, held in tokens if not held for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(d), held, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in x), 6))
                  for (d, _), (x, held) in zip(rows, tokens, strict=True))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert brown.score(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


def test_scores_are_the_plain_sum_over_class_bigrams(spark, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 0.01)  # most words are looked up in buckets
    texts = rng_texts(120) + ODD
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    model, known = brown.train(docs, 3, brown.counts(docs, 3, 8), 8)
    of = {k: c for r in known.collect() for k, c in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["classes"], np.uint8).tolist(), strict=True)}
    seen = brown.Hashes()
    tokens = [(t or "").encode("utf-8", "surrogatepass").lower().split() + [None] for t in texts]
    c = Counter(w for d, x in enumerate(tokens) for w in x if zlib.crc32(str(d).encode()) % 3)

    def kind(w):
        return model.end if w is None else of.get(seen[w], int(model.endings[seen[w] & 255]))

    want = {}
    for d, x in enumerate(tokens):
        kinds = [model.end, *map(kind, x)]
        want[d] = sum(math.log10(c[w] + .1) + model.move[a, b] - model.below[b] for w, a, b in zip(x, kinds, kinds[1:]))
    assert len(set(of.values())) > 1 and any(of.get(seen[w], -1) not in (-1, model.endings[seen[w] & 255]) for x in tokens for w in x if w is not None)
    for r in brown.score(docs, 3).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)


def test_words_are_numbered_by_arrays():
    texts = rng_texts(40) + ODD + [None, "", " \t\n\x0b\x0c\r ", "a", " b  B\x1cb\u00a0b\x85 É é 漢字 ", "x" * 70_000]
    seen = brown.Hashes()
    want = [seen.of(words(t)) for t in texts]
    for rows in (pa.array(texts, pa.string()), pa.array(["first", *texts, "last"], pa.large_string()).slice(1, len(texts)), pa.array([*texts, None]).slice(0, len(texts))):
        keys, at, many = brown.tokenised(rows)
        assert len(set(keys.tolist())) == len(keys) and many.tolist() == [len(x) for x in want]
        assert keys[at].tolist() == np.concatenate(want).tolist()
    for rows in (pa.array([], pa.string()), pa.array([None, "", " "], pa.string())):
        keys, at, many = brown.tokenised(rows)
        assert len(keys) == len(at) == sum(many) == 0 and len(many) == len(rows)


def test_class_bigrams_need_one_side(spark):
    docs = spark.createDataFrame([*enumerate(rng_texts(60) + ODD)], "doc_id long, text string")
    table = stored(brown.counts(docs, 3, 4), "c")
    keys, _ = brown.frequent(table, 20)
    found = stored(brown.coded(docs, 3, keys), "t")

    def dealt(keys):
        return (keys >> np.uint64(8)) % np.uint64(7)

    known = spark.createDataFrame([(r["bucket"], bytes(r["keys"]), dealt(np.frombuffer(r["keys"], np.uint64)).astype(np.uint8).tobytes()) for r in table.collect()],
                                  "bucket int, keys binary, classes binary")
    both, one = (brown.contexts(found, known, keys, dealt(keys).astype(np.uint8), 4, k).collect() for k in (True, False))
    want = np.zeros((brown.CLASSES, brown.CLASSES), int)
    seen = brown.Hashes()
    for d, t in enumerate(rng_texts(60) + ODD):
        if zlib.crc32(str(d).encode()) % 3:
            of = dealt(np.array([0, *seen.of(words(t)).tolist(), 0], np.uint64)).astype(int)
            np.add.at(want, (of[:-1], of[1:]), 1)
    for rows in (both, one):
        assert (sum(np.frombuffer(r["table"], np.int64) for r in rows).reshape(want.shape) == want).all()
    times = [sum(np.frombuffer(r["counts"], np.uint32).sum() for r in rows) for rows in (both, one)]
    assert 0 < len(keys) < sum(r["distinct"] for r in table.collect()) and times == [2 * want.sum(), want.sum()]


def test_rare_words_get_the_class_of_their_contexts(spark):
    rng = random.Random(8)
    rare = [f"{'ab'[k % 2]}{k}zz" for k in range(600)]  # one ending, two kinds of contexts, each word far below the share of a unit
    texts = [" ".join(rng.choice(["red dog", "blue cat"]) if j % 2 else ("sun {} moon" if w[0] == "a" else "five {} nine").format(w) for j in range(40)
                      for w in [rng.choice(rare) if j % 4 else rng.choice(["aunt", "boat"])]) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    model, known = brown.train(docs, 3, brown.counts(docs, 3, 8), 8)
    of = {k: c for r in known.collect() for k, c in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["classes"], np.uint8).tolist(), strict=True)}
    seen = brown.Hashes()
    kinds = [Counter(of[seen[w.encode()]] for w in rare[k::2] if seen[w.encode()] in of).most_common(1)[0] for k in (0, 1)]
    assert kinds[0][0] != kinds[1][0] and all(n > 200 for _, n in kinds)


def test_exchange_finds_the_classes():
    follow = np.zeros((6, 6), int)
    follow[:3, 3:], follow[3:, :3] = 20, 20
    of = brown.exchange(follow, classes=2)
    assert len(set(of[:3])) == len(set(of[3:])) == 1 and of[0] != of[3]


def test_exchange_never_loses_ground():
    def likely(follow, of):
        table = np.zeros((4, 4))
        np.add.at(table, (of[:, None], of[None, :]), follow)
        return brown._f(table).sum() - brown._f(table.sum(1)).sum() - brown._f(table.sum(0)).sum()

    for seed in range(4):
        rng = np.random.default_rng(seed)
        follow = rng.poisson(2 * rng.random((30, 1)) * rng.random((1, 30)) + 3 * (rng.random((30, 30)) < 0.1))
        steps = [likely(follow, brown.exchange(follow, 4, k)) for k in range(7)]
        assert all(b >= a - 1e-9 for a, b in zip(steps, steps[1:], strict=False)) and steps[-1] > steps[0]


def test_kernel_against_a_plain_subsequence_sum():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé ", k=rng.randint(1, 12))) for _ in range(150)]
    marks = [w for w in words if len(w) >= 3][:40]
    code = dict(zip(range(128), toxicity._CODES.tolist(), strict=True))

    def sums(word):
        letters, found = [code.get(ord(c), 28 + (ord(c) & 3)) for c in word], {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k < i + toxicity.SPAN:
                key = letters[i], letters[j], letters[k]
                found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return found

    def plain(a, b):
        x, y = sums(a), sums(b)
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        value = sum(v * y.get(key, 0) for key, v in x.items()) / norm if norm else 0
        return value ** toxicity.POWER if value >= 0.25 else 0

    got = toxicity.kernel(words, marks)
    np.testing.assert_allclose(got, [[plain(a, b) for b in marks] for a in words], atol=1e-9)
    machine = toxicity.Machine(marks, np.arange(len(marks)) - 20.0, 0.5, 1.0, 0.0)
    np.testing.assert_allclose(machine.margins(words), got @ machine.weights + 0.5, atol=1e-9)
    assert machine.margins([]).shape == (0,) and toxicity.kernel([], []).shape == (0, 0)


def test_toxicity_learns_and_tolerates_gaps(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abdefghklmnoprstu") for _ in range(6)) for _ in range(300)]
    rows = [(" ".join(rng.choices(names, k=30) + (["grumblor"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(400)]
    machine = toxicity.train(spark.createDataFrame([*rows, (None, 1), ("odd", None)], "text string, toxic int"))
    texts = ["you grumblor", "you g r u m b l o r", "gru-mb*lor", "grummblor", " ".join(names[:20]), None, "", "x" * 5000]
    score = {r.doc_id: r.score for r in toxicity.score(table(spark, texts), machine).collect()}
    assert all(score[k] >= 0.5 for k in range(4)) and all(score[k] < 0.5 for k in range(4, 8))
    assert toxicity.train(spark.createDataFrame([("a", 1)], "text string, toxic int")) is None
    assert [r.score for r in toxicity.score(table(spark, ["a"]), None).collect()] == [0.0]


def test_toxicity_learns_insults_that_are_each_rare(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abdefghklmnoprstu") for _ in range(6)) for _ in range(300)]
    insults = ["".join(rng.choice("qjxvwzyc") for _ in range(7)) for _ in range(75)]  # each marks about 20 of 1,500 toxic texts
    rows = [(" ".join(rng.choices(names, k=15) + ([insults[k // 4 % 75]] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(6000)]
    machine = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.score(table(spark, [f"you {w}" for w in insults] + names), machine).collect()}
    assert sum(score[k] >= 0.5 for k in range(75)) >= 70
    assert sum(score[75 + k] >= 0.5 for k in range(300)) <= 3
