"""The trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pumpwatch.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Turns of each conversation, ties by entry."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            entry = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((t is not None, t or 0), entry, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    rows = []
    for node, ids in members.items():
        sub = [m for m in members if m[:len(node)] == node]
        childless = [m for m in sub if not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)]
        rows.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
                     sum(len(m) == len(node) + 1 for m in sub), len(childless),
                     sum((len(members[m]) - 1) * len(m[-1][1]) for m in sub if m),
                     hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(rows, key=repr)


def got(spark, rows, shard=None):
    df = ct.with_shared_heads(ct.sequences(spark.createDataFrame(rows, SCHEMA)))
    return sorted((tuple(r) for r in ct.prefix_trie(df, shard).collect()), key=repr)


@pytest.mark.parametrize("shard", [4096, 20, 1])
def test_equals_brute_force(spark, shard):
    r = random.Random(shard)
    rows = []
    for c in [*range(95, 130), *range(200, 260)]:
        if c >= 220 and c % 2:      # copies, many of one conversation, others of a prefix of it
            rows += [(c, t, "user", "copy") for t in range(c % 7)]
        else:
            rows += [(c, t, r.choice(["user", None]), r.choice(["a", "bb", "", None, "ünï"])) for t in range(r.randint(1, 9))]
    rows += [(200, None, "user", "first of all"), (7, 1, "u", "x"), (7, 1, "u", "x"), (7, 1, "u", "y"), (None, 0, "u", "z")]
    assert got(spark, rows, shard) == brute(rebuilt(rows))


def test_long_and_repeated_turns(spark, monkeypatch):
    monkeypatch.setattr(ct, "RUN", 7)
    rows = [(400, 5, "u", "again")] * 60 + [(401 + k, t, "u", f"t{t % 3}") for k in range(6) for t in range(40 + k)]
    assert got(spark, rows, 2) == brute(rebuilt(rows))


def test_empty_and_exact_ids(spark):
    assert got(spark, []) == []
    ids = [2**53 + 1, 2**53 + 3, 2**63 - 1, None]
    rows = [(i, 0, None, None) for i in ids]
    assert got(spark, rows) == brute(rebuilt(rows))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "u", "x", 5, "k", 9)], SCHEMA + ", n long, key string, depth long")
    assert ct.prefix_trie(ct.sequences(df)).count() == 2


def test_double_array_has_all_arcs_and_no_others():
    r = random.Random(1)
    trie, arcs, states = ct.DoubleArray(), set(), [0]
    for _ in range(6):
        level = sorted({(s, c) for s in states for c in r.sample(range(50), r.choice([0, 1, 1, 2, 9]))})
        trie.add(np.array([s for s, _ in level], np.int64), np.array([c for _, c in level], np.int64))
        to = trie.step(np.array([s for s, _ in level], np.int64), np.array([c for _, c in level], np.int64)).tolist()
        assert -1 not in to and len(set(to)) == len(to)
        arcs |= set(level)
        states = to[:40]
    for s in range(len(trie.check)):
        if s == 0 or trie.check[s] >= 0:
            have = {c for c in range(50) if trie.step(np.array([s]), np.array([c]))[0] >= 0}
            assert have == {c for x, c in arcs if x == s}
