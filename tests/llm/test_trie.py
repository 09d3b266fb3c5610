"""Conversation trie: every node against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from siftwire.llm import trie
from siftwire.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string, key string, path string"


def plain(rows, group=100, heads=6):
    """The contract over Python dictionaries; ties of a turn in the order that trie.turns states."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((t is not None, t or 0, tie), (role, text)))
    convs = {c: tuple(x for _, x in sorted(v)) for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        rest = abs(c) % group * (1 if c >= 0 else -1)
        built[c] = convs.get(c - rest, ())[:h] + own[h:]
    members = {}
    for c, way in built.items():
        for d in range(len(way) + 1):
            members.setdefault(way[:d], []).append(c)
    children = {}
    for way in members:
        if way:
            children.setdefault(way[:-1], []).append(way)
    leaves, saved = {}, {}
    for way in sorted(members, key=len, reverse=True):
        own = (len(members[way]) - 1) * len(way[-1][1]) if way else 0
        saved[way] = own + sum(saved[k] for k in children.get(way, []))
        leaves[way] = sum(leaves[k] for k in children.get(way, [])) or 1
    return sorted((min(m), len(w), min(members[w[:-1]]) if w else None, len(m), len(children.get(w, [])), leaves[w], saved[w],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == w).encode()).hexdigest()) for w, m in members.items())


def result(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def some(n, seed, deep=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), n):
        for t in range(rng.randrange(1, deep)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "ab", "漢字 🙂"])))
    rows += [(5000 + k, t, "user", "same") for k in range(60) for t in range(9)]  # copies
    rows += [(7000, t, "user", f"{t}") for t in range(300)] + [(7100, t, "user", f"{t}") for t in range(299)]
    rows += [(None, 1, "user", "nobody's"), (3, 1, "x", "twice"), (3, 1, "x", "twice"), (3, 1, "y", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 40, 100_000])
def test_trie_equals_prefix_dictionary(spark, block):
    rows = some(250, seed=block)
    df = spark.createDataFrame([(*r, "k", "p") for r in rows], SCHEMA).repartition(5)
    built = trie.rebuilt(stored(trie.turns(df), "t"))
    got = result(trie.nodes(built, block=block, fewest=4, broadcast=10 if block == 40 else 1000))
    assert got == plain(rows)


def test_few_and_no_conversations(spark):
    one = [(101, 0, "user", "hi")]  # its only turn goes if it is given away and conversation 100 isn't there
    for rows in (one, [(c, 0, "user", "hi") for c in range(101, 110)], [(100, 2, "a", "x"), (100, 1, "b", "y"), (-7, None, None, None)]):
        assert result(trie.trie(spark.createDataFrame([(*r, "k", "p") for r in rows], SCHEMA))) == plain(rows)
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_of_one_path_travel_as_spans(spark):
    ids = [*range(-10, 9000), 10**15]
    df = spark.createDataFrame([(c, b"\0" * 15 + b"\1") for c in ids] + [(3, b"")], "conv_id long, path binary")
    got = {bytes(r.key): r.ends_sha256 for r in trie.ends(df).collect()}
    assert got == {b"\0" * 15 + b"\1": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"": hashlib.sha256(b"3").hexdigest()}
