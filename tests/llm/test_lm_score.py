"""The backoff automaton against its formula, over blocks of any size."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pumpwatch.llm import lm_score as lm


def defined(docs, backoff, folds=7, held=2):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == held
    tokens = [(i, ("" if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)).encode().split() + [b""]) for i, t in docs]
    train = [w for i, w in tokens if not out(i)]
    c, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(w, w[1:]))
    n, v = sum(c.values()), len(c)
    one = lambda w: (c[w] or v) / (n + v) if n else 1.0
    rows = []
    for i, w in tokens:
        score = math.log10(one(w[0]))
        for h, x in zip(w, w[1:]):
            score += math.log10(backoff * one(x) + (1 - backoff) * pairs[h, x] / c[h] if c[h] else one(x))
        rows.append((i, out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), score))
    return sorted(rows, key=repr)


def compare(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block", [1 << 25, 3000, 300])
def test_equals_the_formula(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    r = random.Random(block)
    docs = [(i, " ".join(r.choice(["the", "The", "of", "a", "b\t", "É", f"w{r.randint(0, 40)}"]) for _ in range(r.randint(0, 60))))
            for i in range(120)]
    got = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), backoff=0.4).collect()
    compare(got, defined(docs, 0.4))


def test_held_out_texts_are_likelier_than_by_add_one_unigrams(spark):
    rows = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert rows and sum(x.score for x in rows) > 0.9 * sum(x.base_score for x in rows)
    assert sum(x.score < x.base_score for x in rows) < 0.05 * len(rows)


def test_odd_and_empty(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    compare(lm.score_documents(odd).collect(), defined(docs, lm.BACKOFF))
    assert lm.score_documents(empty).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score_documents(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row] == [(alone, True, 3, 0, 0, 0.0, 0.0)]


def test_arcs_of_a_state_sum_to_one():
    ids = np.array([1, 2, 1, 3, 2, 1, 0])       # 0 is the end
    counts = np.bincount(ids, minlength=5)      # word 4 was never seen
    pair, n = np.unique(ids[:-1] * 5 + ids[1:], return_counts=True)
    a = lm.Automaton(counts, pair, n, len(ids), 4)
    unseen = 4
    for context in (1, 2, 3):
        p = 10 ** a.read(np.array([x for w in (0, 1, 2, 3, unseen) for x in (context, w)]), np.arange(0, 10, 2))[1::2]
        assert math.isclose(p.sum(), 1)
