"""The prefix trie against one of whole sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f0 string"


def plainly(rows):
    """Nodes as the contract words them, over tuples of turns. Turns of a number must not differ."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        bytes_saved = (len(of) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += bytes_saved
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if built[c] == node)))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    return sorted(map(str, (tuple(r)[:8] for r in df.collect())))


def conversations(seed, n, longest, words=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "é", *"abc"[:words]]), 1, "x") for c in r.sample(range(3 * n), n) for t in range(r.randrange(1, longest))]


@pytest.mark.parametrize("seed", range(3))
def test_prefix_trie(spark, seed):
    rows = conversations(seed, 60, 12)
    # Null numbers, ids and texts, rows that repeat, copies of a conversation.
    rows += [(900, None, "user", "first", 1, "x"), (900, 1, "user", "second", 1, "x"), (None, 1, "user", "nobody's", 1, "x")]
    rows += [(905 + i, t, "user", f"turn {t}", 1, "x") for i in range(30) for t in range(9)] + [(950, 3, "user", "twice", 1, "x")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.prefix_trie(df.repartition(5))) == sorted(map(str, plainly(rows)))


def test_long_conversations_go_in_blocks(spark, monkeypatch):
    """Blocks of four rows, depths and ids; a third of all rows are one conversation's, and another is its copy."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rows = conversations(8, 40, 10, 1)
    rows += [(c, t, "user", f"turn {t}", 1, "x") for c in (1000, 1001, 1003) for t in range(90 if c != 1003 else 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.prefix_trie(df.repartition(3))) == sorted(map(str, plainly(rows)))


def test_last_turns_are_referred_to(spark):
    rows = conversations(4, 20, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    own = defaultdict(list)
    for c, t, role, text, *_ in sorted(rows, key=lambda x: (x[0], x[1])):
        own[c].append((role or "", text or ""))
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        for d, turn in enumerate(own.get(c - c % 5, [])[:h] + turns[h:], 1):
            want[c, d] = turn
    for r in trie.prefix_trie(df).collect():
        assert (r.turn_pos is None) == (r.depth == 0)
        if r.depth:
            assert own[r.turn_conv_id][r.turn_pos - 1] == want[r.conv_id, r.depth]


def test_hashes_that_collide_are_tried_again(spark, monkeypatch):
    """With a tiny modulus at the first trial, turns collide; the next one must be right."""
    rows = conversations(5, 25, 8)
    df, hashed = spark.createDataFrame(rows, SCHEMA), trie.hashed

    def weak(turns, seed):
        out = hashed(turns, seed)
        return out if seed else out.withColumns({x: (out[x] % 2).cast("int") for x in trie._X})

    monkeypatch.setattr(trie, "hashed", weak)
    assert got(trie.prefix_trie(df)) == sorted(map(str, plainly(rows)))
    # With base 1 the order of turns is lost, so prefixes collide, their turns being told apart.
    monkeypatch.setattr(trie, "hashed", hashed)
    monkeypatch.setattr(trie, "bases", lambda seed, real=trie.bases: real(seed) if seed else [1] * trie.LANES)
    assert got(trie.prefix_trie(df)) == sorted(map(str, plainly(rows)))


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(df).collect() == []
    (root,) = trie.prefix_trie(spark.createDataFrame([(7, 1, "user", None, 1, "x")], SCHEMA)).where("depth = 0").collect()
    assert (root.conv_id, root.parent_conv_id, root.n_convs) == (7, None, 1)
