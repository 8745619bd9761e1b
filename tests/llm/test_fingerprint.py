"""One-permutation MinHash: the edited texts, equal texts, and likeness against Jaccard."""

import hashlib

import numpy as np
import pytest

from pumpwatch.llm import fingerprint as fg


def jaccard(a, b):
    def s(x):
        w = x.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = s(a), s(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(docs):
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[:len(t) - half] + n[:half], n))
    return out


@pytest.mark.parametrize("group", [1, 3, 2048])
def test_edits_and_likeness(spark, monkeypatch, group):
    monkeypatch.setattr(fg, "GROUP", group)
    r = np.random.default_rng(group)
    words = [f"w{i}" for i in range(3000)]
    docs, text = [], []
    for i in range(60):
        if r.random() < 0.6 or not text:
            text = list(r.choice(words, r.integers(0, 300)))
        else:
            text = [w if r.random() > 0.01 else str(r.choice(words)) for w in text]
        docs.append((int(r.integers(-50, 50)) * 1000 + i, " ".join(text)))
    rows = {r.doc_id: r for r in fg.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    near, by_text = [], {}
    for i, t, e, n in edited(docs):
        x = rows[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert by_text.setdefault(t, x.fingerprint) == x.fingerprint and len(x.fingerprint) == fg.BINS
        assert x.fingerprint == "0" * fg.BINS if not t else True
        near += [abs(x.near_edited - jaccard(t, e)), abs(x.near_next - jaccard(t, n))] if t and n else []
    assert np.mean(near) < 0.05 and max(near) < 0.25


def test_odd_and_empty(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rows = fg.fingerprint_documents(odd).collect()
    want = sorted((len(t), hashlib.sha256(e.encode()).hexdigest()) for _, t, e, _ in edited(docs))
    assert sorted((r.n_chars, r.edited_sha256) for r in rows) == want
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert fg.fingerprint_documents(empty).count() == 0
    one = fg.fingerprint_documents(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
