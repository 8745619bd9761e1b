"""SimHash: fingerprints from their definition, links and components against all pairs."""

import random

import numpy as np
import xxhash

from pumpwatch.llm import simhash_dedup as sh
from pumpwatch.llm.components import connected_components


def defined(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, radius=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    v = np.array(fps, np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(v[:k] ^ v[k]) <= radius):
            a, b = find(ids[j]), find(ids[k])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_is_as_defined():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("aB É\t\n\x85 c") for _ in range(r.randint(0, 40)))
        assert sh.fingerprint(text.encode()) == defined(text), ascii(text)


def cloud(seed):
    r = np.random.default_rng(seed)
    out = set()
    for c in r.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(40):
            out.add(int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)))
    return sorted(out)


def test_components_equal_all_pairs_for_any_bucket_size(spark):
    fps = cloud(2)
    ids = list(range(100, 100 + len(fps)))
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in zip(ids, fps)], "doc_id long, fp long")
    want = classes(ids, fps)
    assert {r.doc_id: r.component_id for r in sh.components(df).collect()} == want
    edges = sh.close_edges(df.select("fp"), 3, bucket=2)        # all buckets of three and more are split again
    root = {r.vertex: r.root for r in connected_components(edges).collect()}
    groups = {}
    for i, f in zip(ids, np.array(fps, np.uint64).astype(np.int64).tolist()):
        groups.setdefault(root.get(f, f), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == want


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(chain, "u long, v long"))
    assert {r.vertex: r.root for r in got.collect()} == {**{i: 0 for i in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents_odd_and_empty(spark, odd, empty):
    rows = sh.simhash_components(odd).collect()
    by = {r.doc_id: (r.fp, r.component_id) for r in rows}
    assert len(rows) == odd.count()
    assert [by[i] for i in (1, 2, 3)] == [(0, 1)] * 3           # no words: zero, linked
    assert by[4][1] == by[5][1] == 4 and by[None][1] is None
    kept = sh.near_duplicates_removed(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, {by[i][1] for i in by}))
    assert sh.simhash_components(empty).count() == 0 and sh.near_duplicates_removed(empty).count() == 0


def test_survivors_without_ids_and_unlike_texts_under_one_id(spark):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c, d, e, f = (text() for _ in range(6))
    far = 2**60 + 1
    rows = [(None, a), (None, a), (None, b), (None, c), (far, c), (None, d), (5, e), (5, f), (6, f), (5, f), (None, f)]
    got = sh.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, a), (None, b), (far, c), (None, d), (5, e), (5, f)], key=str)
