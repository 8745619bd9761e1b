"""Language identification: the forward sums against all segmentations, held-out accuracy, odd input."""

import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers

from pumpwatch.llm import language_id as li

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, begin = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[begin:i])
                begin = i
        yield [*parts, word[begin:]]


def test_forward_sums_all_segmentations_and_expected_counts():
    pieces = li.Pieces(["a", "b", "ab", "ba", "aba", "bb"])
    r = np.random.default_rng(0)
    p = li._table(r.random((pieces.count, 2)))
    at = {n: i for i, n in enumerate(pieces.names)}
    for word in ("a", "abba", "ababab", "acb", "bbbbb"):
        for lang in range(2):
            prob = lambda seg, k=lang: math.prod(p[at[x], k] if x in at else (li.UNKNOWN if len(x) == 1 else 0) for x in seg)
            total = sum(map(prob, segmentations(word)))
            got = li.log_probability(np.array([word]), pieces, p)[0, lang]
            assert math.isclose(got, math.log(total), rel_tol=1e-9)
            counts = li.expected_counts(np.array([word]), np.array([3.0]), pieces, p[:, [lang]])
            for name, i in at.items():
                want = 3 * sum(prob(s) * s.count(name) for s in segmentations(word)) / total
                assert math.isclose(counts[i], want, rel_tol=1e-9, abs_tol=1e-12)


def test_words_of_any_length_are_summed_whole(monkeypatch):
    """From left to right in parts of any size, as by arrays of the whole length, and by exact fractions."""
    pieces = li.Pieces(["a", "b", "ab", "ba", "aba", "bb", "abababababababab"])
    r = np.random.default_rng(1)
    p = li._table(r.random((pieces.count, 3)))
    words = np.array(["".join(r.choice(list("abc"), n)) for n in (1, 2, 15, 16, 17, 30, 30, 30, 31)] + ["ab" * 15], object)
    weight = r.random(len(words))
    want = li.log_probability(words, pieces, p), li.expected_counts(words, weight, pieces, p[:, [1]])
    monkeypatch.setattr(li, "SHORT", 0)
    for cells in (1, 7, 40, 1 << 13):
        monkeypatch.setattr(li, "CELLS", cells)
        got = li.log_probability(words, pieces, p), li.expected_counts(words, weight, pieces, p[:, [1]])
        assert np.allclose(got[0], want[0], rtol=1e-12) and np.allclose(got[1], want[1], rtol=1e-9, atol=1e-12)
    monkeypatch.undo()
    long = "".join(r.choice(list("abc"), 400))
    at = {n: i for i, n in enumerate(pieces.names)}
    sums = [Fraction(1)]
    for end in range(1, len(long) + 1):
        cuts = [(b, long[b:end]) for b in range(max(0, end - li.LONGEST), end)]
        sums.append(sum(sums[b] * Fraction(p[at[x], 0] if x in at else li.UNKNOWN)
                        for b, x in cuts if x in at or len(x) == 1))
    got = li.log_probability(np.array([long], object), pieces, p)[0, 0]
    exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
    assert math.isclose(got, exact, rel_tol=1e-9)


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = li.identify(docs, VOCABULARY).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()


def test_only_the_text_is_looked_at_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300).cache()
    model = li.fit(docs, VOCABULARY)
    odd = spark.createDataFrame([(1, None, "de"), (2, "123 ?! ½", "fr"), (3, "", None), (4, "the of and that is", "xx")],
                                "doc_id long, text string, lang string")
    got = [tuple(r) for r in odd.select("doc_id", li.predicted("text", model).alias("p")).select("doc_id", "p.*").collect()]
    assert [x[1:] for x in got[:3]] == [("und", 0.0)] * 3 and got[3][1] == "en" and got[3][2] > 0.5


def test_odd_and_empty(spark, odd, empty):
    rows = li.identify(odd, VOCABULARY).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert li.identify(empty, VOCABULARY).count() == 0
    kept = li.known_language(odd, VOCABULARY)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, None}


def test_long_texts_are_read_in_slices(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice("ab cé1") for _ in range(5000))
    whole = [w for part in li.words_of(text) for w in part]
    monkeypatch.setattr(li, "SLICE", 64)
    assert [w for part in li.words_of(text) for w in part] == whole
    assert [w for part in li.words_of("x" * 1000 + " y") for w in part] == ["x" * 1000, "y"]
