"""BPE encoding and decoding with a tokenization automaton.

The automaton's arcs carry tokens. It starts as one state with a loop for each
base symbol, where every symbol sequence is accepted, and takes the merges in
order. The gadget for a merge (a, b): the state that ``a`` leads to is copied
without its ``b`` arc and ``a`` leads to the copy from now on, so that ``a b``
can no longer be read as two tokens; wherever ``a`` and then ``b`` could be
read, an arc ``ab`` leads to where ``b`` led. After the last merge the only
path that spells a word is its BPE encoding.

In this construction all arcs of one token lead to the same state, and each
merge adds one state, a copy of an older one less one arc. So states are stored
as (parent, arc taken away, time) and tokens as (state they lead to, parts,
time): arrays of the size of the vocabulary. The states above the one that a
token leads to are the copies made for the token itself, then those made for
its right part until the token came to be, and so on; so whether a state has an
arc is found by looking up the few merges of such parts.

Encoding reads symbols, not tokens, so the arcs are spelt out and the result is
made deterministic: a state of this second automaton is the set of places in it
at once, each the arc before and the part of the next arc that is read already.
Every prefix of a word has one path only, so at most one of the places is at the
end of an arc, and the transition says which arc that is. Transitions are made
when first asked for and kept in a table (state, symbol) -> (state, arc). A word
is encoded by one step a symbol, without stepping back; at its end the arcs of
its path are picked from the last to the first, each telling where it began.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pumpwatch.llm.common import mapped, text_bytes

#: Words kept with their encoding in a Python worker, and their bytes; twice that at most.
CACHE_WORDS, CACHE_BYTES = 200_000, 16 << 20
#: States, transitions and answers kept in a Python worker; beyond that the table begins anew, with equal results.
STATES, TRANSITIONS, PAIRS = 100_000, 400_000, 200_000
#: Bits of a token and of a symbol in the keys of the tables; the highest bit of a symbol marks the end of a word.
TOKEN_BITS, SYMBOL_BITS = 20, 22
TOKEN_MASK, END_BIT = (1 << TOKEN_BITS) - 1, 1 << (SYMBOL_BITS - 1)
#: Code points below this have had their category since the first versions of Unicode.
PLAIN = 0x230  # twice that holds their lower case forms but for a few


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    shown = set(own)
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Automaton:
    """Deterministic token automaton of a vocabulary with merges.

    ``vocab`` maps token strings to ids, ``merges`` are pairs of strings in
    order of priority; ``end`` is the mark that the last symbol of a word
    carries.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.end, self.ids = end, vocab
        self.label = {i: t for t, i in vocab.items()}
        self.parent, self.gone, self.made = [-1], [-1], [-1]   # of states; 0 is the start
        self.leads = dict.fromkeys(vocab.values(), 0)          # token -> state
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.dropped: dict[int, int] = {}                      # (token, next token) -> time
        self.since: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        merged = {a + b for a, b in merges}
        self.known = {i for t, i in vocab.items() if t not in merged}
        for time, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        self.limit()
        self._spell(end)

    def limit(self, share: float = 1.0) -> None:
        """How much of the bounds above the tables may take; results are equal."""
        self.states, self.transitions, self.answers = (int(share * n) for n in (STATES, TRANSITIONS, PAIRS))

    def _spell(self, end: str) -> None:
        """The symbols of all arcs as a trie: (node, symbol) -> node, and the arcs that end at a node."""
        self.child: dict[int, int] = {}
        self.arc: dict[int, int] = {}      # arcs within a word
        self.final: dict[int, int] = {}    # arcs at its end
        self.length: dict[int, int] = {}
        nodes = 1
        for token in self.known:
            label = self.label[token]
            last = label.endswith(end)
            symbols, node = label[:len(label) - len(end)] if last else label, 0
            for c in symbols:
                key = node << SYMBOL_BITS | ord(c)
                node = self.child.get(key, nodes)
                if node == nodes:
                    self.child[key] = nodes
                    nodes += 1
            self.length[token] = len(symbols)
            if last:
                self.final[node] = token
            if not (end and last):
                self.arc[node] = token
        self._begin()

    def _begin(self) -> None:
        """An empty table; state 0 is the beginning of a word: no arc before, nothing of the next one read."""
        # of a state: its places, each a node and 1 + the arc before (0: none)
        self.places: list[tuple[int, ...]] = [(0,)]
        self.number = {self.places[0]: 0}
        self.table: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def _gadget(self, a: int, b: int, ab: int, time: int) -> None:
        state = self.leads[a]
        if ab in self.known or a not in self.known or b not in self.known or not self.allows(state, b):
            return  # no path reads a and then b, or the arc is there already
        self.leads[ab] = self.leads[b]
        self.left[ab], self.right[ab], self.since[ab] = a, b, time
        self.dropped[a << 20 | b] = time
        self.known.add(ab)
        self.parent.append(state)
        self.gone.append(b)
        self.made.append(time)
        self.leads[a] = len(self.parent) - 1

    def allows(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``."""
        parent, gone, made = self.parent, self.gone, self.made
        while True:
            since = self.since[token]
            while made[state] > since:  # states copied after the arc was added: did a copy drop it?
                if gone[state] == token:
                    return False
                state = parent[state]
            if since < 0:
                return True
            token = self.left[token]    # the arc was added where its left part could be read

    def follows(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` leads to has an arc ``token``.

        The same answer as ``allows(leads[last], token)`` without a walk over
        states: the states above are those of the right parts of ``last``.
        """
        since, left, right, dropped = self.since, self.left, self.right, self.dropped
        until = 1 << 60
        while True:
            u, before = last, until + 1
            while True:
                time = dropped.get(u << 20 | token)
                if time is not None and since[token] < time <= until and time < before:
                    return False
                if u not in right:
                    break
                before = min(before, since[u])
                u = right[u]
            if token not in left:
                return True
            until = since[token]
            token = left[token]

    def _after(self, before: int, arc: int) -> bool:
        """Whether ``arc`` may come after the arc ``before - 1`` (0: at the beginning); answers are kept, there are few."""
        key = before << TOKEN_BITS | arc
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = before == 0 or self.follows(before - 1, arc)
        return ok

    def _step(self, state: int, symbol: int) -> int:
        """A transition, made when first asked for: the next state and the arc that ends there."""
        went, ended, child, arcs, pairs = [], None, self.child.get, self.arc.get, self.pairs.get
        for place in self.places[state]:
            node = child(place >> TOKEN_BITS << SYMBOL_BITS | symbol)
            if node is not None:
                before = place & TOKEN_MASK
                went.append(node << TOKEN_BITS | before)
                if ended is None:
                    arc = arcs(node)
                    if arc is not None:
                        ok = pairs(before << TOKEN_BITS | arc)
                        if self._after(before, arc) if ok is None else ok:
                            ended = arc
        if ended is None:
            raise ValueError(f"no path spells the symbol {chr(symbol)!r}")
        went.append(ended + 1)
        places = tuple(went)
        to = self.number.setdefault(places, len(self.places))
        if to == len(self.places):
            self.places.append(places)
        made = self.table[state << SYMBOL_BITS | symbol] = to << TOKEN_BITS | ended
        return made

    def _final(self, state: int, symbol: int) -> int:
        """The arc that ends the word with its last symbol, which carries the end mark; kept in the table too."""
        key = state << SYMBOL_BITS | symbol | END_BIT
        arc = self.table.get(key)
        if arc is None:
            for place in self.places[state]:
                arc = self.final.get(self.child.get(place >> TOKEN_BITS << SYMBOL_BITS | symbol))
                if arc is not None and self._after(place & TOKEN_MASK, arc):
                    break
            else:
                raise ValueError(f"no path ends with the symbol {chr(symbol)!r}")
            self.table[key] = arc
        return arc

    def encode_word(self, symbols: str) -> list[int]:
        """Token ids of the only path that spells ``symbols`` (without the end mark)."""
        if len(self.places) > self.states or len(self.table) > self.transitions:
            pairs = self.pairs
            self._begin()
            if len(pairs) <= self.answers:
                self.pairs = pairs
        if not symbols:
            return []
        state, ended, step = 0, [], self.table.get
        stop = len(symbols) - 1 if self.end else len(symbols)
        for c in map(ord, symbols[:stop]):
            found = step(state << SYMBOL_BITS | c)
            if found is None:
                found = self._step(state, c)
            state = found >> TOKEN_BITS
            ended.append(found & TOKEN_MASK)
        if self.end:
            ended.append(self._final(state, ord(symbols[-1])))
        out, at = [], len(symbols)
        while at:
            out.append(ended[at - 1])
            at -= self.length[out[-1]]
        return out[::-1]


def plain_words() -> re.Pattern:
    """The split pattern for texts of characters below ``PLAIN``, as explicit classes.

    Fixed by the tokenizer file: contractions, runs of letters, single numbers,
    runs of anything else but white space.
    """
    kind = {c: unicodedata.category(chr(c))[0] for c in range(2 * PLAIN)}  # lower-casing goes beyond PLAIN
    chars = lambda k: "".join(re.escape(chr(c)) for c in kind if kind[c] == k)
    space = "\\t-\\r \\x85\\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{chars('L')}]+|[{chars('N')}]|[^{space}{chars('L')}{chars('N')}]+")


class Codec:
    """A tokenizer file's text rules around its automaton.

    Texts are split into words by the file's own normalizer and pre-tokenizer.
    Where a text only has characters below ``PLAIN``, whose classes are the same
    in all versions of Unicode, the same rules are applied by a compiled pattern.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = self.automaton.label | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.rules = Tokenizer.from_file(path)
        self.plain, self.odd = plain_words(), re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
        self.symbols = dict(enumerate(byte_symbols()))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.limit()

    def limit(self, share: float = 1.0) -> None:
        """How much of their bounds words and tables may take in this worker; results are equal."""
        self.words, self.bytes = int(share * CACHE_WORDS), int(share * CACHE_BYTES)
        self.automaton.limit(share)

    def split(self, text: str) -> list[str]:
        """The words of a text; those in byte symbols have a space before them."""
        if self.odd.search(text):
            return [" " + w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(
                self.rules.normalizer.normalize_str(text))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.plain.findall(text.lower())

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian unsigned 32-bit integers.

        A word that is in byte symbols already has a space before it.
        """
        found = self.old.get(word)
        if found is None:
            spelt = word[1:] if word[0] == " " else word.encode().decode("latin-1").translate(self.symbols)
            found = b"".join(i.to_bytes(4, "little") for i in self.automaton.encode_word(spelt))
        size = len(word) + len(found)
        if len(self.new) >= self.words or self.held + size > self.bytes:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[word] = found
        self.held += size
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        ids = []
        for part in self.cut.split(text) if self.special else [text]:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                continue
            known, slow = self.new.get, self.word
            for w in self.split(part):
                found = known(w)
                if found is None:
                    found = slow(w)
                    known = self.new.get    # words kept may have begun anew
                ids.append(found)
        return b"".join(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """Emit the labels of the arcs."""
        return " ".join(map(self.label.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a tokenizer file, built once in each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


ENCODED = ("doc_id long, n_tokens long, ids array<int>, ids_sha256 string, "
           "decoded string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, contents: bool = True, doc_id: str = "doc_id",
                     text: str = "text", memory: float = 1.0) -> DataFrame:
    """Encode and decode every text with the tokenizer file at ``path`` (on every machine).

    ``memory`` is the share of the bounds that words and tables kept in a worker may
    take: less memory, more time, equal results.
    Returns doc_id, n_tokens, ids, their SHA-256 (as little-endian unsigned
    32-bit integers), the decoded text and its SHA-256; ``contents`` False
    leaves out ids and decoded. A null text counts as empty and has no tokens;
    other columns are ignored; repeated rows stay; an empty table gives no rows.
    """
    schema = ENCODED if contents else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        c.limit(memory)
        for b in batches:
            rows = []
            for body in b["body"]:
                ids = c.encode(body.decode("utf-8", "replace"))
                numbers = np.frombuffer(ids, "<u4")
                decoded = c.decode(numbers.tolist())
                row = [len(numbers), hashlib.sha256(ids).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest()]
                if contents:
                    row[1:1] = [numbers.astype(np.int32)]
                    row[3:3] = [decoded]
                rows.append(row)
            names = [f.split()[0] for f in schema.split(", ")][1:]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("body")) \
        .transform(mapped, each, schema)
