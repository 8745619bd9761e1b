"""The token automaton against the tokenizers library and against plain merging."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from pumpwatch.llm import bpe_automaton as bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.codec(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    ours, theirs = both[0].encode(text), both[1].encode(text, add_special_tokens=False)
    ids = np.frombuffer(ours, "<u4").tolist()
    return ids == theirs.ids and both[0].decode(ids) == both[1].decode(theirs.ids, skip_special_tokens=False)


def test_equals_the_library_on_made_up_texts(both):
    r = random.Random(3)
    alphabets = ["aehnrt ", "abc'sdltrevm 12<|>", "éÉßẞΣσςİıǅﬁ½Ⅷ ²", "日本語کتاب हिन्दी ", "\x85\x1c　​ \n\ta",
                 "".join(map(chr, range(0x20, 0x250)))]
    words = ["<|endoftext|>", "<|startoftext|>", "'LL", "don't", "naïve", "🙂"]
    for _ in range(3000):
        a = r.choice(alphabets)
        text = "".join(r.choice(words) if r.random() < .05 else r.choice(a) for _ in range(r.randint(0, 30)))
        assert same(both, text), ascii(text)
    for text in ("", "a" * 5000, "ab" * 3000, "é" * 50):
        assert same(both, text)


def test_every_character(both):
    bad = [c for c in range(1, 0x3000) if not same(both, f"a{chr(c)}b{chr(c)}")]
    assert not bad


def plain_bpe(symbols, merges):
    while True:
        pairs = [(merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
        if not pairs:
            return symbols
        _, i = min(pairs)
        a, b = symbols[i], symbols[i + 1]
        out, k = [], 0
        while k < len(symbols):
            if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == (a, b):
                out.append(a + b)
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out


def test_gadgets_on_small_vocabularies():
    r = random.Random(4)
    for _ in range(30):
        known, merges = list("ab") + ["a/", "b/"], []
        for _ in range(12):
            a, b = r.choice([k for k in known if "/" not in k]), r.choice(known)
            if a + b not in known:
                merges.append((a, b))
                known.append(a + b)
        auto = bpe.Automaton({t: i for i, t in enumerate(known)}, merges, "/")
        rank = {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
            want = plain_bpe([*word[:-1], word[-1] + "/"], rank)
            assert [auto.label[i] for i in auto.encode_word(word)] == want
        for last in auto.known:     # the walk over states and the look-up of parts agree
            for token in auto.known:
                if "/" not in auto.label[last]:
                    assert auto.follows(last, token) == auto.allows(auto.leads[last], token)


def test_a_table_begun_anew_gives_equal_words():
    r = random.Random(6)
    known = list("abc")
    merges = []
    for a, b in (("a", "b"), ("b", "c"), ("ab", "ab"), ("c", "ab"), ("a", "a"), ("aa", "bc")):
        merges.append((a, b))
        known.append(a + b)
    auto = bpe.Automaton({t: i for i, t in enumerate(known)}, merges, "")     # without an end mark
    rank = {m: i for i, m in enumerate(merges)}
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 20))) for _ in range(300)]
    want = [plain_bpe([*w], rank) for w in words]
    assert [[auto.label[i] for i in auto.encode_word(w)] for w in words] == want
    made = len(auto.table)
    assert [[auto.label[i] for i in auto.encode_word(w)] for w in words] == want and len(auto.table) == made
    auto.limit(3 / bpe.STATES)
    assert [[auto.label[i] for i in auto.encode_word(w)] for w in words] == want
    with pytest.raises(ValueError):
        auto.encode_word("abx")


def test_one_step_a_symbol(both):
    auto = both[0].automaton
    auto._begin()
    auto.encode_word("ab" * 2000)
    assert len(auto.places) < 100      # a long word goes round in the states of its period


def test_documents(spark, both, odd, empty):
    rows = bpe.encode_documents(odd, PATH).collect()
    texts = sorted((r.text or "" for r in odd.collect()))
    assert len(rows) == len(texts)
    want = sorted((len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()) for e in both[1].encode_batch(
        texts, add_special_tokens=False))
    assert sorted((r.n_tokens, r.ids_sha256) for r in rows) == want
    for r in rows:
        assert r.decoded == both[0].decode(r.ids) and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256
    little = bpe.encode_documents(odd, PATH, memory=1e-5).collect()
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in little) == sorted((r.ids_sha256, r.decoded_sha256) for r in rows)
    assert bpe.encode_documents(empty, PATH).count() == 0
