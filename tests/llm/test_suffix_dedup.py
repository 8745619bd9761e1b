"""Suffix-array dedup against brute force over all strings of the length."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from pumpwatch.llm import suffix_dedup as sd


def brute(docs, length):
    seen, out = {}, []
    order = sorted({(-1 << 63 if d is None else d, t) for d, t in docs})
    first = {}
    for d, t in order:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s:s + length]] = min(first.get(b[s:s + length], (d, s)), (d, s))
    for d, t in docs:
        b = (t or "").encode()
        k = -1 << 63 if d is None else d
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (k, s):
                gone[s:s + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcd é\n") for _ in range(r.randint(20, 150))) for _ in range(12)]
    return [(i, "".join(r.choice(parts) if r.random() < .5 else "".join(r.choice("abcd ") for _ in range(r.randint(0, 90)))
                        for _ in range(r.randint(0, 8)))) for i in range(n)]


@pytest.mark.parametrize("length,hot,block", [(100, 2000, 1 << 23), (40, 2000, 2000), (40, 3, 2000), (20, 2, 500)])
def test_equals_brute_force(spark, monkeypatch, length, hot, block):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    docs = corpus(length + hot)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(sd.remove_repeats(df, length)) == brute(docs, length)


@pytest.mark.parametrize("salts", [1, 3])
def test_a_string_in_every_block(spark, monkeypatch, salts):
    """Its places are found part by part, ids missing in a third of the rows, and no group of it is sorted."""
    monkeypatch.setattr(sd, "HOT", 4)
    monkeypatch.setattr(sd, "SALTS", salts)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 400)
    r = random.Random(salts)
    licence, other = ("".join(r.choice("abcdefg ") for _ in range(n)) for n in (70, 45))
    docs = [(None if i % 3 == 0 else (i * 37) % 100,
             "".join(r.choice("xyz") for _ in range(i % 5)) + licence + str(i) + (other if i % 7 == 0 else "")) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(sd.remove_repeats(df, 40)) == brute(docs, 40)


@pytest.mark.parametrize("joined", [1, 3, 1000])
def test_rows_of_a_hash_are_told_as_soon_as_it_is_hot(monkeypatch, joined):
    true = sd._joined
    monkeypatch.setattr(sd, "_joined", lambda batches, n: true(batches, joined))
    r = np.random.default_rng(joined)
    h = np.sort(np.concatenate([r.integers(0, 60, 80), np.full(50, 30), np.full(9, 99)]))
    all_ = pd.DataFrame({"hash": h, "block": np.arange(len(h)), "n": r.integers(1, 3, len(h))})
    sent = [all_.iloc[a:a + 4] for a in range(0, len(h), 4)]
    got = pd.concat(list(sd._repeated(6)(iter(sent))))
    total = all_.groupby("hash")["n"].transform("sum")
    want = all_[total > 1]
    assert got["block"].tolist() == want["block"].tolist() and got["hot"].tolist() == (total[total > 1] > 6).tolist()


def test_odd_and_empty(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = rows(sd.remove_repeats(odd))
    assert {x[0]: x[2] for x in got if x[0] not in (6, 7, 9)} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 8: 0, None: 0}
    long = {x[0]: x for x in got}
    assert long[6][1:4] == (120_000, 119_999, 1)        # all but the first byte is covered by a later start
    assert len([x for x in got if x[0] == 7]) == 2 and len(got) == len(docs)
    assert sd.remove_repeats(empty).count() == 0


def test_sort_survives_lying_hashes(monkeypatch):
    """With a hash that says equal far too often, neighbours are checked and groups sorted by bytes."""
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(60)).encode() for _ in range(40)]
    true = sd.prefix_hashes
    monkeypatch.setattr(sd, "prefix_hashes", lambda data: true(data // 98))     # a and b look alike
    data = np.frombuffer(b"".join(texts), np.uint8)
    s = sd.Suffixes(data, np.arange(40) * 60, np.full(40, 60))
    order, common = s.classes(np.array([0, 25]), np.array([25, 15]))
    for a, b in ((0, 25), (25, 40)):
        assert order[a:b].tolist() == sorted(range(a, b), key=lambda i: (texts[i], i))
        for k in range(a + 1, b):
            x, y = texts[order[k - 1]], texts[order[k]]
            want = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), 60)
            assert common[k] == want


def test_sort_of_uneven_suffixes_by_merging():
    r = random.Random(6)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(200)]
    size = np.array([len(t) for t in texts])
    s = sd.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)
    order = s.sort(np.array([0]), np.array([200]))
    assert order.tolist() == sorted(range(200), key=lambda i: (texts[i], i))


def test_anchors_of_equal_strings_are_at_equal_places():
    r = np.random.default_rng(1)
    shared = r.integers(97, 123, 300).astype(np.uint8)
    found = []
    for n in (17, 230):
        data = np.concatenate([r.integers(97, 123, n).astype(np.uint8), shared])
        h, place, first, last = sd.anchors(data, np.full(len(data), len(data)), 100)
        found.append({(int(k), int(p) - n) for k, p, a in zip(h, place, first) if a >= n})
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        assert starts.tolist() == list(range(len(data) - 99))       # each string has one anchor
    assert found[0] == found[1]


def test_pieces_cut_long_texts_without_losing_a_string():
    body = bytes(np.random.default_rng(2).integers(97, 123, (1 << 20) * 2 + 500).astype(np.uint8))
    seen = [(int(own[0]), len(data)) for data, _, _, own in sd._pieces([body], 100)]
    assert seen[0] == (0, 1 << 20) and all(b[0] == a[0] + a[1] - 99 for a, b in zip(seen, seen[1:]))
