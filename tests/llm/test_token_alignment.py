"""Token alignment against a byte-by-byte version."""

import hashlib
import json
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pumpwatch.llm import token_alignment as ta

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(docs):
    """By sets of end offsets, without arrays."""
    byte = ta.byte_of_symbol()
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    texts, links = [], Counter()
    for i, text in docs:
        groups, pairs, a, b = [], [], [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            la = [bytes(byte[c] for c in t.id_to_token(x)) for x in a]
            lb = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [sp.id_to_piece(x)]]
            if b"".join(la) != (" " + text).encode() or b"".join(lb) != (" " + text).encode():
                a, b = [], []
        if a:
            ends = []
            for parts in (la, lb):
                at, out = 0, []
                for p in parts:
                    at += len(p)
                    out.append(at)
                ends.append(out)
            low = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                groups.append(([x for x, e in zip(a, ends[0]) if low < e <= cut], [x for x, e in zip(b, ends[1]) if low < e <= cut]))
                low = cut
            at = dict(zip(ends[1], b))
            pairs = [(x, at[e]) for x, e in zip(a, ends[0]) if e in at]
        links.update(pairs)
        texts.append((i, a, b, groups, pairs))
    best = {}
    for (x, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for i, a, b, groups, pairs in texts:
        digest = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((i, len(a), len(b), len(groups), len(pairs), sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs),
                     hashlib.sha256(digest.encode()).hexdigest() if a else "", digest))
    return sorted(rows, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1 << 21, 50])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ta, "BLOCK_LINKS", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").collect()]
    docs += [(9001, "two  spaces and a tab\t"), (9002, "ﬁ ligature"), (9003, "<|endoftext|><s></s><0x41> <unk>"), (9004, "日本語 🙂 naïve"),
             (9005, "▁"), (9006, " leading"), (9007, "\n"), (9008, "aaaaaaaa"), (9008, "aaaaaaaa")]
    assert rows(ta.align_documents(spark.createDataFrame(docs, "doc_id long, text string"), A, B)) == brute(docs)


def test_odd_and_empty(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.where("length(text) < 20000 OR text IS NULL").collect()]
    assert rows(ta.align_documents(odd.where("length(text) < 20000 OR text IS NULL"), A, B)) == brute(docs)
    assert ta.align_documents(odd, A, B, contents=False).where("groups IS NULL").count() == odd.count()
    assert ta.align_documents(empty, A, B).count() == 0


def test_ids_are_exact_beside_a_null(spark):
    ids = [2**53 + 1, 2**53 + 3, None, -2**63, 2**63 - 1]
    got = ta.align_documents(spark.createDataFrame([(i, "word") for i in ids], "doc_id long, text string"), A, B)
    assert {r.doc_id for r in got.collect()} == set(ids)


def test_special_strings_are_plain_text():
    a, b = ta.sides(A, B)
    got = ta.Aligned("x<|endoftext|>", a, b)
    special = json.load(open(A, encoding="utf-8"))["added_tokens"][0]["id"]
    assert special not in got.a and len(got.a)


def test_both_byte_level_encoders_agree():
    import pandas as pd
    a, _ = ta.sides(A, B)
    assert a.fast
    texts = [t or "" for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text][:300]
    texts += ["it's  we'LL \xa0\x85 x", "\r\n\n a1b22 ½²", "".join(map(chr, range(1, ta.PLAIN)))]
    for t in texts:
        assert a.fast.encode_ordinary(" " + t) == a.rules.encode(" " + t, add_special_tokens=False).ids


def test_overlaps_expand_within_groups():
    import numpy as np
    left, right = ta.overlaps(np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert list(zip(left, right)) == [(0, 0), (1, 0), (1, 1), (2, 2)]
    assert [g.tolist() for g in ta.coalesce(np.array([2, 5, 6]), np.array([3, 5, 6]))] == [[0, 0, 1], [0, 0, 1]]
