"""Fill-in-middle: cuts against a plain regular expression, round trips, odd rows."""

import hashlib
import random
import re

from siftwire.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(text, key, seed=42):
    """The contract word for word, over a list of units."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n=150):
    rng = random.Random(4)
    letters = ["a", "é", "漢", "🙂", " ", "  ", "\n", "\t", "\x0b", " ", " ", "<", "<P", "S>", "x" * 40]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_cuts_equal_the_units_at_any_block_size():
    for text in [*odd_texts(), "", " ", "a", " a ", "a " * 700, "é" * 900 + " z"]:
        units, data = UNIT.findall(text), text.encode()
        for block in (1, 2, 7, 64, fim.BLOCK):
            blocks = fim.Blocks(data, block)
            assert blocks.before(blocks.size) == (len(units), len(text))
            for k in {0, 1, len(units) // 2, len(units) - 1, len(units)} - {-1}:
                if k <= len(units):
                    head = "".join(units[:k])
                    assert blocks.cut(k) == (len(head.encode()), len(head))


def test_output_and_round_trip(spark):
    texts = [None, "", "   \n", "no <M> here", "one", "x" * 200_000 + " y " * 50_000, *odd_texts(300)]
    rows = [(k, t, "n", "clash") for k, t in enumerate(texts)] + [(None, "a null key", "n", "c"), (7, texts[7], "n", "c"), (7, texts[7], "n", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, restored string")
    got = fim.restore(fim.transform(df)).collect()
    assert len(got) == len(rows)
    want = sorted(((k, *plain(t or "", k), t or "") for k, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=repr) == want
    assert {"plain", "spm", "psm"} == {r.form for r in got}
    assert fim.restore(fim.transform(df.limit(0))).count() == 0


def test_rates_are_parameters(spark):
    df = spark.createDataFrame([(k, "a b c d") for k in range(200)], "doc_id long, text string")
    assert {r.form for r in fim.transform(df, rate=100, suffix_first=0).collect()} == {"psm"}
    assert {r.form for r in fim.transform(df, rate=0).collect()} == {"plain"}


def test_a_sentinel_cannot_arise_between_parts():
    for p in ("", "<", "<S", "<P", "a<"):
        for s in ("", "S>", ">", "<", "M>"):
            for m in ("", "P>", "<M", "x"):
                text = (p + m + s).encode()
                if any(x in text for x in (b"<P>", b"<S>", b"<M>")):
                    continue
                p_, m_, s_ = p.encode(), m.encode(), s.encode()
                assert fim.restored(b"<P>" + p_ + b"<S>" + s_ + b"<M>" + m_, "psm") == text
                assert fim.restored(b"<S>" + s_ + b"<P>" + p_ + b"<M>" + m_, "spm") == text
