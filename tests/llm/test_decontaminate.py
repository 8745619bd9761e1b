"""Decontamination against brute force over all item-sized windows."""

import random
from collections import Counter

import numpy as np

from pumpwatch.llm import decontaminate as dc


def brute(docs, items, similarity=0.8):
    out = {}
    for d, text in docs:
        w = (text or "").encode().lower().split()
        for i, item in items:
            want = (item or "").encode().lower().split()
            if not want or len(w) < len(want):
                continue
            k = min(5, len(want))
            shingles = lambda x: Counter(b" ".join(x[j:j + k]) for j in range(len(x) - k + 1))
            target, n = shingles(want), len(want) - k + 1
            like = [(lambda both: both / (2 * n - both))((shingles(w[s:s + len(want)]) & target).total())
                    for s in range(len(w) - len(want) + 1)]
            best = max(like)
            if best >= similarity:
                out[d, i] = (best, like.index(best), sum(x >= similarity for x in like))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 12, 30, 30, 45])))) for i in range(25)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            leak = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                leak[r.randrange(len(leak))] = word()
            at = r.randint(0, len(text))
            text[at:at] = leak
        docs.append((d, " ".join(text).upper() if d % 3 else "\n ".join(text)))
    return docs, items


def found(spark, docs, items):
    rows = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.windows) for r in rows}


def test_equals_brute_force(spark):
    for seed in range(2):
        docs, items = corpus(seed)
        want = brute(docs, items)
        assert want and found(spark, docs, items) == want


def test_large_benchmarks_go_in_blocks(spark, monkeypatch):
    docs, items = corpus(7)
    monkeypatch.setattr(dc, "ITEMS", 4)
    assert found(spark, docs, items) == brute(docs, items)
    kept = dc.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in brute(docs, items)}


def test_index_misses_no_fingerprint_within_the_radius():
    docs, items = corpus(3)
    ix = dc.Index([(i, t.encode()) for i, t in items])
    r = np.random.default_rng(0)
    near = np.array([int(p) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 30), replace=False))
                     for p in ix.prints for _ in range(20)], np.uint64)
    words = np.repeat(ix.length, 20)
    got = set(zip(*(x.tolist() for x in ix.candidates(near, words))))
    want = {(k, i) for k in range(len(near)) for i in range(len(ix.prints))
            if words[k] == ix.length[i] and bin(int(near[k]) ^ int(ix.prints[i])).count("1") <= dc.RADIUS}
    assert got == want


def test_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five one two"), (4, "word")],
                                  "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in dc.find_leaks(odd, items).collect())
    assert got == [(4, 4), (5, 4), (7, 3), (7, 3)]
    kept = dc.without_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert dc.find_leaks(empty, items).count() == 0
    assert dc.find_leaks(odd, items.limit(0)).count() == 0 and dc.without_leaks(odd, items.limit(0)).count() == odd.count()


def test_texts_shorter_than_an_item(spark):
    """Items with words missing at either end are the whole text, held against the definition."""
    r = random.Random(11)
    items = [(i, " ".join("".join(r.choice("abcdef") for _ in range(3)) for _ in range(n)))
             for i, n in enumerate([3, 8, 12, 30, 30, 45])]
    docs = [(100 * i + 10 * a + z, " ".join(t.split()[a:len(t.split()) - z])) for i, t in items
            for a in range(6) for z in range(10)]
    want = {}
    for d, text in docs:
        for i, item in items:
            w, whole = text.split(), item.split()
            if not len(w) < len(whole):
                continue
            k = min(5, len(whole))
            x, y = (Counter(tuple(v[j:j + k]) for j in range(len(v) - k + 1)) for v in (w, whole))
            like = (x & y).total() / (x | y).total()
            if like >= 0.8:
                want[d, i] = (like, 0, 1)
    got = found(spark, docs, items)
    assert len(want) > 50 and {k: v for k, v in got.items() if k in want} == want
    assert set(got) - set(want) == {(100 * i, i) for i, _ in items}
    kept = dc.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
