"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the correct
tokenizations. It starts as one state with an arc for every base symbol. The gadget of a merge (u, v) -> w gives u a
fresh target, a copy of the old one without the arc v, and adds an arc w, to v's target, to every state with an arc u.
All arcs of one token lead to one state, so a state is "token a as of merge T" and is kept implicitly: which merges took
an arc away is in one table, and arcs added later are those of the left half. `accepts` resolves an arc from these
tables; every resolved arc is kept in a flat transition table.

A word has exactly one accepted path, and every prefix of that path is accepted too. Encoding walks the word once, symbol by
symbol, through a transition table that tells which tokens end at a place, and keeps the one of them that an arc leads to.
Decoding emits the labels of the arcs.

Which characters are letters, numbers or white space, and what their lower case is, depends on a Unicode version; the
tables are read off the library that the results must equal, once on the driver.

Nulls and empty texts have no tokens; texts of any length are processed whole; repeated rows give repeated results; an empty table
gives no rows. Of the input only the id and the text are read, so that further columns can't clash with the results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import text_column

#: Distinct white-space separated pieces, and resolved arcs, that a Python worker remembers before it starts afresh.
PIECES_KEPT = 400_000
ARCS_KEPT = 1_000_000
#: Longer pieces are encoded each time.
PIECE_CHARS = 64
#: Below this code point, a short list of ranges tells letters and numbers.
FEW = 0x250

_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The automaton of one vocabulary; picklable, so that it can be broadcast."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.word_end, self.vocab = word_end, dict(vocab)
        n = max(vocab.values()) + 1
        self.labels = [""] * n
        for label, token in vocab.items():
            self.labels[token] = label
        self.born, self.left, self.right = [-1] * n, [0] * n, [0] * n
        self.taken: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] >= 0 or max(self.born[u], self.born[v]) >= k:
                raise ValueError(f"merge {k} makes a token again or uses one that comes later")
            self._gadget(k, u, v, w)
        self._compile()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._compile()

    def _compile(self) -> None:
        """The tables of the suffix automaton over the labels. A symbol is a byte, plus 256 if the word ends with it. _next:
        state and symbol to state; _ends: the tokens, with their lengths, that end in a state, the longest first."""
        byte = {x: b for b, x in enumerate(byte_symbols())}
        self._next: dict[int, int] = {}
        self._ends: list[list[tuple[int, int]]] = [[]]
        self._fail, self._arcs = [0], {}
        rows: list[list[tuple[int, int, int]]] = []  # by depth: state above, symbol, state
        for label, token in self.vocab.items():
            body = label.removesuffix(self.word_end)
            symbols = [byte[x] for x in body]
            if len(body) < len(label):
                symbols[-1] += 256
            state = 0
            for depth, symbol in enumerate(symbols):
                key = state << 9 | symbol
                below = self._next.get(key)
                if below is None:
                    below = self._next[key] = len(self._ends)
                    self._ends.append([])
                    if depth == len(rows):
                        rows.append([])
                    rows[depth].append((state, symbol, below))
                state = below
            self._ends[state].append((token, len(symbols)))
        self._fail = [0] * len(self._ends)
        for depth, row in enumerate(rows):
            for above, symbol, state in row:
                if depth:
                    self._fail[state] = self._step(self._fail[above], symbol)
                self._ends[state] += self._ends[self._fail[state]]

    def _step(self, state: int, symbol: int) -> int:
        """The next state, which is remembered where a suffix has it."""
        found = self._next.get(state << 9 | symbol)
        if found is None:
            found = self._next[state << 9 | symbol] = self._step(self._fail[state], symbol) if state else 0
        return found

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        """Adds merge k. If no accepted path has u before v, the merge never applies and w stays without arcs."""
        if not self._resolve(u, v, k):
            self.vocab.pop(self.labels[w])
            return
        self.taken[u << 32 | v] = k
        self.born[w], self.left[w], self.right[w] = k, u, v

    def _resolve(self, a: int, b: int, before: int) -> bool:
        """Has the state after token a, as the merges under `before` left it, an arc b?"""
        born, taken = self.born, self.taken
        while True:
            if taken.get(a << 32 | b, _NEVER) < before:
                return False
            if born[b] > born[a]:
                before, b = min(before, born[b] + 1), self.left[b]
            elif born[a] >= 0:
                before, a = min(before, born[a]), self.right[a]
            else:
                return True

    def accepts(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) >= ARCS_KEPT:
                self._arcs.clear()
            found = self._arcs[key] = self._resolve(a, b, _NEVER)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        if not word:
            return []
        symbols = list(word)
        symbols[-1] += 256
        next_, ends_in, arcs = self._next, self._ends, self._arcs
        tokens, lengths, state = [-1], [0], 0
        for i, symbol in enumerate(symbols, 1):
            below = next_.get(state << 9 | symbol)
            state = self._step(state, symbol) if below is None else below
            for token, n in ends_in[state]:
                if n == i:
                    break
                before = tokens[i - n]
                ok = arcs.get(before << 32 | token)
                if self.accepts(before, token) if ok is None else ok:
                    break
            tokens.append(token)
            lengths.append(n)
        out, i = [], len(symbols)
        while i:
            out.append(tokens[i])
            i -= lengths[i]
        return out[::-1]


class WordBpe:
    """Text to ids and back, as a tokenizer file of the "BPE with word ends" kind says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] is None:
            raise ValueError(f"{path}: not a tokenizer of this kind")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"])
        top = max([len(self.automaton.labels) - 1, *self.special.values()])
        self.labels = self.automaton.labels + [""] * (top + 1 - len(self.automaton.labels))
        for label, token in self.special.items():
            self.labels[token] = label
        self.classes = {k: _class_of(k) for k in (r"\p{L}", r"\p{N}", r"\s")}
        self.lower = _lower_case()
        self._ready()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        self._marks = sorted({x[:2] for x in self.special})  # what a special token begins with
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{2}{0}{1}]+"
        self._words = regex.compile(pattern.format(*map(_ranges, self.classes.values())))
        # the same for texts without characters from FEW on, in which sets of a few ranges do
        few = [[r for r in x if r[0] < FEW] for x in self.classes.values()]
        self._few_words = re.compile(pattern.format(*map(_ranges, few)))
        self._spaces = regex.compile(r"\p{White_Space}+")
        self._separators = regex.compile("[\x1c-\x1f]")  # white space for str.split, but not for the library
        self._pieces: dict[str, bytes] = {}
        self._known: dict[str, list[int]] = {}
        self._bytes = [x.encode() for x in self.labels]

    def _plain(self, piece: str, out: list[int]) -> None:
        if piece.isascii():
            piece = piece.lower()
        else:  # the library lowers each character alone, so that a sigma is never final
            piece = unicodedata.normalize("NFC", piece).translate(self.lower).lower()
        known = self._known
        for word in (self._few_words if max(piece, default="") < chr(FEW) else self._words).findall(piece):
            ids = known.get(word)
            if ids is None:
                ids = self.automaton.encode_word(word.encode("utf-8", "replace"))
                if len(word) <= PIECE_CHARS:
                    if len(known) >= PIECES_KEPT // 2:
                        known.clear()
                    known[word] = ids
            out += ids

    def _encode_piece(self, piece: str) -> bytes:
        out: list[int] = []
        at = 0
        if any(m in piece for m in self._marks):
            for m in self._split.finditer(piece):
                self._plain(piece[at : m.start()], out)
                out.append(self.special[m[0]])
                at = m.end()
        self._plain(piece[at:], out)
        packed = array("I", out).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self._pieces) >= PIECES_KEPT:
                self._pieces.clear()
            self._pieces[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's byte order. White space separates words, so each
        piece between white space is encoded by itself."""
        pieces, encode, text = self._pieces, self._encode_piece, text or ""
        parts = [p for p in self._spaces.split(text) if p] if self._separators.search(text) else text.split()
        return b"".join([pieces.get(p) or encode(p) for p in parts])

    def decode(self, packed: bytes) -> bytes:
        """The labels of the ids, with spaces between them, in UTF-8."""
        labels = self._bytes
        return b" ".join([labels[i] for i in array("I", packed)])


def _ranges(runs: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _class_of(pattern: str) -> list[tuple[int, int]]:
    """The characters of a class of the library's regular expressions, as ranges."""
    from tokenizers import Regex, pre_tokenizers

    everything = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    runs = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(everything)
    return [(ord(x[0]), ord(x[-1])) for x, _ in runs]


def _lower_case() -> dict[int, str]:
    """Characters that the library lowers otherwise than str.lower does."""
    from tokenizers import normalizers

    lower = normalizers.Lowercase().normalize_str
    out = {ord("Σ"): "σ"}
    for c in range(128, sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and (low := lower(chr(c))) != chr(c).lower():
            out[c] = low
    return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_column(spark, text: Column, path: str, keep: bool = True, decoded: bool = True) -> Column:
    """Struct column: n_tokens, ids_sha256, decoded_sha256 and, if kept, ids (array of int) and decoded (string; it can be left out)."""
    shared = spark.sparkContext.broadcast(load(path))

    def factory():
        bpe = shared.value

        def work(texts):
            packed = [bpe.encode(t) for t in texts]
            plain = [bpe.decode(p) for p in packed]
            cols = [[len(p) // 4 for p in packed], [_sha(_little(p)) for p in packed], [_sha(d) for d in plain]]
            if keep:
                cols.append(_id_lists(packed))
            return [*cols, [d.decode() for d in plain]] if keep and decoded else cols

        return work

    ddl = "n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>" + ",decoded:string" * decoded) * keep
    return text_column(text, ddl, factory)


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    """The ids as Arrow lists over the packed bytes, without a Python object for each id."""
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.uint32).view(np.int32)))


def _little(packed: bytes) -> bytes:
    if sys.byteorder == "little":
        return packed
    a = array("I", packed)
    a.byteswap()
    return a.tobytes()


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per row of docs: the id and the columns of bpe_column; other columns are left out."""
    out = docs.select(F.col(id_col), bpe_column(docs.sparkSession, F.col(text_col), path, keep).alias("bpe"))
    return out.select(id_col, "bpe.*")
