"""Language identification with segmentation-marginalised unigram models.

A language is a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces of the
product of their probabilities, computed left to right by the forward
algorithm. A text's log-probability in a language is the sum over its words
plus the log of the language's share of the training documents; the language
with the largest wins, and its posterior probability is the score.

Piece probabilities are fitted by expectation maximisation (expected piece
counts by forward and backward sums) on the words of a bounded sample of
labelled documents: about ``SAMPLE_DOCS`` of each language, taken by a hash of
the document's id. Shares are counted over all training documents. The model
is as large as the vocabulary times the languages, whatever the input.

Words are maximal runs of letters, lower-cased, with the vocabulary's mark of a
word's beginning before them. Many words of one length are summed together, from
arrays of their length; those of over ``SHORT`` characters from left to right with
the sums of the last ``LONGEST`` places, scaled to 1 at each, so that no length is
too long for memory or for floating point numbers. Both give the same sums.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwatch.llm.common import checkpoint, crc_mod, text_bytes

#: Bound of the training sample: documents of each language, on average.
SAMPLE_DOCS = 1500
EM_STEPS = 3
#: Longest piece that is used, in characters.
LONGEST = 16
#: Probability of a letter that no piece covers, and the count added to each piece.
UNKNOWN, ADDED = 1e-7, 0.05
#: Words of more characters are summed from left to right, so many characters of them at a time.
SHORT, CELLS = 32, 1 << 13
LETTERS = regex.compile(r"\p{L}+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Letters are found in slices of this many characters of a text, so that a very long one needs no list of all its words.
SLICE = 1 << 20


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, some at a time; none is cut."""
    at = 0
    while at < len(text):
        stop = min(at + SLICE, len(text))
        more = LETTERS.match(text, stop)
        stop = more.end() if more else stop
        yield LETTERS.findall(text[at:stop].lower())
        at = stop


class Pieces:
    """The pieces of a vocabulary as a sorted table of polynomial hashes."""

    def __init__(self, pieces: list[str]) -> None:
        pieces = sorted({p for p in pieces if 0 < len(p) <= LONGEST})
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.names = [pieces[i] for i in order]
        self.hashes = hashes[order]
        self.count = len(pieces)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONGEST, BASE)]), dtype=np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, words: np.ndarray, size: int) -> list[tuple[int, int, np.ndarray]]:
        """(begin, end, piece of each word) for words of ``size`` characters; ``count`` is no
        piece, ``count + 1`` a single letter that is none."""
        codes = _codes(words, size)
        prefix = [np.zeros(len(words), np.uint64)]
        for j in range(size):
            prefix.append(prefix[-1] * BASE + codes[:, j] + np.uint64(1))
        found = []
        for end in range(1, size + 1):
            for begin in range(max(0, end - LONGEST), end):
                h = prefix[end] - prefix[begin] * self.power[end - begin]
                found.append((begin, end, self._look(h, end - begin)))
        return found

    def _look(self, h: np.ndarray, size: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), self.count - 1)
        return np.where(self.hashes[at] == h, at, self.count + 1 if size == 1 else self.count)

    def ends(self, codes: np.ndarray, begin: int, end: int) -> np.ndarray:
        """The pieces of 1, 2, ... LONGEST characters that end at the places ``begin`` to ``end`` of
        words, given as rows of character codes: (LONGEST, words, places)."""
        low = max(0, begin - LONGEST + 1)
        c = codes[:, low:end].astype(np.uint64) + np.uint64(1)
        found = np.full((LONGEST, *c.shape), self.count)
        h = c
        for k in range(min(LONGEST, c.shape[1])):
            h = h[:, :-1] * BASE + c[:, k:] if k else h
            found[k, :, k:] = self._look(h, k + 1)
        return found[:, :, begin - low:]


def _by_size(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        step = 1 << 12 if n <= SHORT else 1 << 7
        for k in range(0, len(at), step):
            yield n, at[k:k + step]


def _codes(words: np.ndarray, size: int) -> np.ndarray:
    return words.astype(f"<U{size}").view("<u4").reshape(-1, size)


def _scales(codes: np.ndarray, pieces: Pieces, p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(begin, by what the sums over all segmentations grow at each place from there on) of words of
    one length: (words, places, languages). The product of all is the probability of the word."""
    last = np.zeros((LONGEST, len(codes), p.shape[1]))     # sums of the last places, that of the newest is 1
    last[0] = 1
    room = max(1, CELLS // len(codes))
    for begin in range(0, codes.shape[1], room):
        q = p[pieces.ends(codes, begin, begin + room)]
        grown = np.empty(q.shape[1:])
        for j in range(q.shape[2]):
            grown[:, j] = now = np.einsum("kwl,kwl->wl", last, q[:, :, j])
            last[1:] = last[:-1].copy()
            last[0] = now
            last /= now
        yield begin, grown


def _long_counts(codes: np.ndarray, weight: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``weight`` times each word of one length, for one language."""
    n = codes.shape[1]
    grown = np.concatenate([g[:, :, 0] for _, g in _scales(codes, pieces, p)], axis=1)
    at = np.zeros((len(codes), n + 1))      # how often a piece ends at each place
    at[:, n] = weight
    counts, room = np.zeros(pieces.count + 2), max(1, CELLS // len(codes))
    for begin in range((n - 1) // room * room, -1, -room):
        found = pieces.ends(codes, begin, begin + room)
        place, use = np.arange(begin, begin + found.shape[2]), p[found, 0]
        share = np.ones(found.shape[1:])
        for k in range(LONGEST):            # of the sum at a place, what comes by a piece of k + 1 characters
            share = share / grown[:, np.maximum(place - k, 0)]
            use[k] *= share
        for j in range(found.shape[2] - 1, -1, -1):
            end = begin + j + 1
            use[:, :, j] *= at[:, end]
            k = min(LONGEST, end)
            at[:, end - k:end] += use[:k, :, j][::-1].T
        counts += np.bincount(found.ravel(), use.ravel(), pieces.count + 2)
    return counts


def _forward(arcs: list, size: int, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: (size + 1, words, languages)."""
    total = np.zeros((size + 1, len(arcs[0][2]), p.shape[1]))
    total[0] = 1
    for begin, end, piece in arcs:
        total[end] += total[begin] * p[piece]
    return total


def log_probability(words: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """log P(word | language), a row for each word."""
    out = np.zeros((len(words), p.shape[1]))
    for n, at in _by_size(words):
        if n <= SHORT:
            out[at] = np.log(_forward(pieces.arcs(words[at], n), n, p)[n])
        else:
            out[at] = sum(np.log(g).sum(axis=1) for _, g in _scales(_codes(words[at], n), pieces, p))
    return out


def expected_counts(words: np.ndarray, weight: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``weight`` times each word, for one language."""
    counts = np.zeros(pieces.count + 2)
    for n, at in _by_size(words):
        if n > SHORT:
            counts += _long_counts(_codes(words[at], n), weight[at], pieces, p)
            continue
        arcs = pieces.arcs(words[at], n)
        ahead = _forward(arcs, n, p)[:, :, 0]
        behind = np.zeros_like(ahead)
        behind[n] = weight[at] / ahead[n]
        for begin, end, piece in reversed(arcs):
            behind[begin] += p[piece, 0] * behind[end]
        for begin, end, piece in arcs:
            counts += np.bincount(piece, ahead[begin] * p[piece, 0] * behind[end], pieces.count + 2)
    return counts[:pieces.count]


def _table(counts: np.ndarray) -> np.ndarray:
    """Smoothed piece probabilities with rows for no piece and an unknown letter."""
    p = (counts + ADDED) / (counts + ADDED).sum(axis=0)
    return np.vstack([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), UNKNOWN)])


def _together(batches: Iterator[pd.DataFrame], rows: int, chars: int) -> Iterator[pd.DataFrame]:
    """Batches of about ``rows`` rows, or ``chars`` characters of words: the vectorised sums are slow
    on few words of each size."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows or sum(b["word"].map(len).sum() for b in held) >= chars:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _marked(mark: str, words: Iterable[str]) -> np.ndarray:
    """The words as objects: one array of text would give each as much room as the longest."""
    return np.array([mark + w for w in words], object)


def load_pieces(path: str) -> tuple[list[str], str]:
    """The pieces of a public SentencePiece model and its mark of a word's beginning."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    whole = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return [x for x in whole if x.removeprefix(mark).isalpha() or x == mark], mark


class Model:
    """Languages, the log of their shares, and piece probabilities."""

    def __init__(self, langs: list[str], prior: np.ndarray, pieces: list[str], mark: str, p: np.ndarray):
        self.langs, self.prior, self.names, self.mark, self.p = langs, prior, pieces, mark, p
        self.pieces: Pieces | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pieces": None}   # rebuilt in each worker

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if self.pieces is None:
            self.pieces = Pieces(self.names)
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        sums = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), np.int64)
        number: dict[str, int] = defaultdict()      # of the different words
        number.default_factory = number.__len__
        codes, docs, held = [], [], 0

        def flush() -> None:
            lp = log_probability(_marked(self.mark, number), self.pieces, self.p)
            code = np.concatenate(codes)
            at = np.repeat(docs, [len(c) for c in codes])
            for k in range(lp.shape[1]):
                sums[:, k] += np.bincount(at, lp[code, k], len(texts))
            seen[:] += np.bincount(at, minlength=len(texts))
            number.clear()
            codes.clear()
            docs.clear()

        for i, t in enumerate(texts):
            for some in words_of(t):
                if some:
                    codes.append(np.fromiter(map(number.__getitem__, some), np.int32, len(some)))
                    docs.append(i)
                    held += len(some)
                if held > 1_000_000:
                    flush()
                    held = 0
        if codes:
            flush()
        sums += self.prior
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i in np.flatnonzero(seen):
            langs[i], scores[i] = self.langs[best[i]], float(share[i])
        return langs, scores


def fit(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS, steps: int = EM_STEPS) -> Model:
    """Fit the languages of ``docs`` (doc_id, text, lang), all of them training documents.

    Rows with a null lang are ignored. No labelled rows give a model that
    predicts ``und`` for everything.
    """
    names, mark = load_pieces(vocabulary)
    pieces = Pieces(names)
    labelled = docs.where("lang IS NOT NULL")
    share = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], np.zeros(0), names, mark, np.zeros((pieces.count + 2, 0)))
    space = 1 << 40
    limit = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, int(space * min(1, sample_docs / share[k])))]),
                         F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(space)) < limit)

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, body in zip(b["lang"], b["body"]):
                for some in words_of(body.decode("utf-8", "replace")):
                    n = pd.Series(some, dtype=object).value_counts()
                    yield pd.DataFrame({"lang": lang, "word": n.index.astype(str), "n": n.to_numpy()})
    counted = sample.select("lang", text_bytes().alias("body")).mapInPandas(
        count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = checkpoint(counted)

    counts = np.ones((pieces.count, len(langs)))
    for _ in range(steps):
        p, column = _table(counts), {k: i for i, k in enumerate(langs)}

        def expect(batches: Iterator[pd.DataFrame], p=p, column=column) -> Iterator[pd.DataFrame]:
            own = Pieces(names)
            for b in _together(batches, 100_000, 1 << 22):
                for lang, rows in b.groupby("lang"):
                    c = expected_counts(_marked(mark, rows["word"]),
                                        rows["n"].to_numpy(float), own, p[:, [column[lang]]])
                    used = np.flatnonzero(c)
                    yield pd.DataFrame({"lang": lang, "piece": used, "n": c[used]})
        # at most one row for each piece and language comes back
        rows = counted.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).toPandas()
        counts = np.zeros((pieces.count, len(langs)))
        counts[rows["piece"].to_numpy(np.int64), rows["lang"].map(column).to_numpy(np.int64)] = rows["n"]
    total = sum(share.values())
    return Model(langs, np.log([share[k] / total for k in langs]), names, mark, _table(counts))


def predicted(text: str, model: Model) -> Column:
    """Column (lang_pred, score) of a text column: ``und`` with score 0 if it is null or has no letter."""
    sent = SparkSession.active().sparkContext.broadcast(model)   # vocabulary times languages

    @F.pandas_udf("lang_pred string, score double")
    def of(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in bodies:
            langs, scores = m.predict([x.decode("utf-8", "replace") for x in b])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
    return of(text_bytes(text))


def held_out(folds: int) -> Column:
    return crc_mod("doc_id", folds) == 0


def fit_folds(docs: DataFrame, vocabulary: str, folds: int = 5) -> Model:
    """Fit on the documents whose crc32(doc_id as text) mod ``folds`` isn't 0."""
    return fit(docs.where(~held_out(folds)).select("doc_id", "text", "lang"), vocabulary)


def identify(docs: DataFrame, vocabulary: str, folds: int = 5) -> DataFrame:
    """Predict the language of every text of ``docs`` (doc_id, text, lang).

    Returns (doc_id, held_out, lang_pred, score); only the text is looked at
    for a prediction. Repeated rows stay; an empty table gives no rows.
    """
    found = docs.select("doc_id", predicted("text", fit_folds(docs, vocabulary, folds)).alias("p"))
    return found.select("doc_id", held_out(folds).alias("held_out"), "p.lang_pred", "p.score")


def known_language(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, and a score of ``least`` or more."""
    p = predicted("text", fit_folds(docs, vocabulary))
    found = docs.withColumn("_predicted", p)
    return found.where((F.col("_predicted.lang_pred") != "und") & (F.col("_predicted.score") >= least)).drop("_predicted")
