"""Benchmark decontamination with an FM-index for each shard of training documents.

A shard is a run of whole documents of about SHARD_WORDS words. Its alphabet is the words of the test phrases; all other
words, and the document ends, are separators, and stretches between separators that are shorter than the shortest phrase
can't hold one and are left out. Over the rest: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet
matrix with packed bits, suffix positions sampled at every RATE-th place and at each stretch's start. All phrases are
searched backwards at once; occurrences are located by walking to a sampled position; hit words are merged into spans.

Phrases are the windows of WINDOW consecutive words of an item; an item of fewer words, but not none, is one phrase.
The phrases travel in blocks of about BLOCK_CHARS characters of benchmark text. The driver holds one block at a time; each further
block is one more pass over the documents, after a checkpoint of the passes before it, so that a task, too, holds one block only.

Null, empty and wordless texts have no words, no hits and aren't contaminated. Items without words never occur; rows of
the benchmark with equal ids are one item, a null id counts as the empty text. An empty benchmark contaminates nothing. Rows of the
documents are judged one by one, all their columns stay, and an empty table gives no rows; the result takes the place of a column
of its name, and another name for it can be given. `without_spans` takes the hit words out of a text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, fresh, text_column

WINDOW = 13
SHARD_WORDS = 1_000_000
RATE = 8
BLOCK_CHARS = 8_000_000

#: Lower-cases A-Z and makes every other ASCII character but a-z and 0-9 a space; other characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


class Phrases:
    """The distinct phrases of some items, as word numbers from 1 on, by their length; and the items of each phrase."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for name, text in items:
            w = [self.words.setdefault(x, len(self.words) + 1) for x in words_of(text)]
            if w:
                for i in range(max(1, len(w) - window + 1)):
                    owners[tuple(w[i : i + window])].add(number[name])
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []  # phrases in rows, and their numbers
        of = sorted(owners)
        for n in sorted({len(p) for p in of}):
            at = [k for k, p in enumerate(of) if len(p) == n]
            self.by_length.append((np.array([of[k] for k in at], np.int64), np.array(at, np.int64)))
        self.owner_of = np.array([x for p in of for x in sorted(owners[p])], np.int64)
        self.owner_at = np.cumsum([0, *(len(owners[p]) for p in of)])
        self.length = np.array([len(p) for p in of], np.int64)
        self.shortest = int(self.length.min()) if of else 0


class Bits:
    """Packed bits with ranks: how many are set before a position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FmIndex:
    """Over a sequence of numbers from 0 on, where 0 separates stretches and the last one is 0."""

    def __init__(self, text: np.ndarray, rate: int = RATE):
        n, top = len(text), int(text.max(initial=0))
        self.levels = max(1, top.bit_length())
        sa = self._suffixes(text)
        bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits: list[tuple[Bits, int]] = []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1 == 1
            self.bits.append((Bits(bit), int(n - bit.sum())))
            row = np.concatenate([row[~bit], row[bit]])
        begins = np.r_[0, np.flatnonzero(text == 0) + 1]
        sampled = np.arange(n) % rate == 0
        sampled[begins[begins < n]] = True
        self.marked = Bits(sampled[sa])
        self.samples = sa[sampled[sa]]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffixes in order; separators differ, the earlier one is smaller, so that no order is left open."""
        n = len(text)
        ends = text == 0
        rank = text.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(ends.sum())
        size = 1
        while True:
            next_ = np.zeros(n, np.int64)
            next_[: n - size] = rank[size:] + 1
            key = rank * (n + int(rank.max()) + 2) + next_
            sa = np.argsort(key, kind="stable")
            ordered = key[sa]
            new = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            rank = np.empty(n, np.int64)
            rank[sa] = new
            if new[-1] == n - 1:
                return sa
            size *= 2

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i of the transform."""
        at = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(self.bits):
            one = (c >> (self.levels - 1 - k)) & 1 == 1
            r, s = bits.rank(i), bits.rank(at)
            i, at = np.where(one, zeros + r, i - r), np.where(one, zeros + s, at - s)
        return i - at

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of the phrases that occur, and their ranges of suffixes. Numbers over the largest don't occur."""
        live = np.flatnonzero((phrases < len(self.first) - 1).all(axis=1))
        c = phrases[live, -1]
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            go = lo < hi
            live, lo, hi = live[go], lo[go], hi[go]
            c = phrases[live, k]
            lo, hi = self.first[c] + self._rank(c, lo), self.first[c] + self._rank(c, hi)
        go = lo < hi
        return live[go], lo[go], hi[go]

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, at, open_, steps = np.empty(len(suffix), np.int64), suffix.copy(), np.arange(len(suffix)), 0
        while len(open_):
            done = self.marked.get(at)
            out[open_[done]] = self.samples[self.marked.rank(at[done])] + steps
            open_, at = open_[~done], at[~done]
            i, c = at, np.zeros_like(at)
            for bits, zeros in self.bits:
                one, r = bits.get(i), bits.rank(i)
                c = c * 2 + one
                i = np.where(one, zeros + r, i - r)
            at = self.first[c] + self._rank(c, at)
            steps += 1
        return out


def shard_hits(texts: list[str | None], phrases: Phrases, rate: int = RATE):
    """For each text: words, merged spans of hit words (lists of starts and ends), item numbers."""
    get, tokens, counts = phrases.words.get, [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        tokens.append(np.fromiter([get(x, 0) for x in w], np.int64, len(w)))
        tokens.append(np.zeros(1, np.int64))  # the end of a document takes a place of its own
    starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[int]] = [[] for _ in texts]
    words = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    if not len(phrases.length) or not len(words):
        return counts, spans, items
    ends = np.flatnonzero(words == 0)
    begins = np.r_[0, ends[:-1] + 1]
    long = ends - begins >= phrases.shortest
    begins, lengths = begins[long], (ends - begins)[long] + 1  # with the separator
    if not len(begins):
        return counts, spans, items
    to = np.concatenate([[0], np.cumsum(lengths)])
    place = np.repeat(begins - to[:-1], lengths) + np.arange(to[-1])
    index = FmIndex(words[place], rate)
    at_phrase, at_word = [], []
    for rows, numbers in phrases.by_length:
        found, lo, hi = index.search(rows)
        n = hi - lo
        suffix = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at_phrase.append(np.repeat(numbers[found], n))
        at_word.append(place[index.locate(suffix)])
    phrase, word = np.concatenate(at_phrase), np.concatenate(at_word)
    if not len(phrase):
        return counts, spans, items
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + phrases.length[phrase], -1)
    hit = np.r_[False, np.cumsum(edge) > 0]
    first, last = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
    of = np.searchsorted(starts, first, "right") - 1
    for d, a, b in zip(of.tolist(), (first - starts[of]).tolist(), (last - starts[of]).tolist(), strict=True):
        spans[d].append({"start": a, "end": b})
    doc = np.searchsorted(starts, word, "right") - 1
    pairs = np.unique(doc * len(phrases.length) + phrase)
    doc, phrase = np.divmod(pairs, len(phrases.length))
    n = phrases.owner_at[phrase + 1] - phrases.owner_at[phrase]
    owner = phrases.owner_of[np.repeat(phrases.owner_at[phrase] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    pairs = np.unique(np.repeat(doc, n) * len(phrases.ids) + owner)
    for d, o in zip(*(x.tolist() for x in np.divmod(pairs, len(phrases.ids))), strict=True):
        items[d].append(o)
    return counts, spans, items


def hits_column(spark, text: Column, phrases: Phrases, shard_words: int = SHARD_WORDS) -> Column:
    """Struct column of one block: n_words, spans (array of start and end, in words), items (ids as strings)."""
    shared = spark.sparkContext.broadcast(phrases)

    def factory():
        p = shared.value

        def work(texts):
            out: list[list] = [[], [], []]
            some, n = [], 0
            for i, t in enumerate(texts):
                some.append(t)
                n += len(t or "") // 5
                if n >= shard_words or i == len(texts) - 1:
                    counts, spans, items = shard_hits(some, p)
                    out[0] += counts
                    out[1] += spans
                    out[2] += [[p.ids[k] for k in x] for x in items]
                    some, n = [], 0
            return out

        return work

    return text_column(text, "n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>", factory)


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int, window: int = WINDOW):
    """The benchmark's phrases, in blocks of whole items of at most about block_chars characters."""
    items, n = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        items.append((row[0], row[1]))
        n += len(row[1] or "")
        if n >= block_chars:
            yield Phrases(items, window)
            items, n = [], 0
    if items:
        yield Phrases(items, window)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "hits", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs and a struct column `out`: n_words, n_hit, n_items, items_sha256, contaminated, spans (hit words, merged)."""
    spark, keep, names = docs.sparkSession, [c for c in docs.columns if c.lower() != out.lower()], []
    blocks = chain(phrase_blocks(benchmark, item_col, item_text_col, block_chars), [None])
    phrases = next(blocks) or Phrases([])
    while phrases:
        names.append(name := fresh(docs, "hits_of_block"))
        docs = docs.withColumn(name, hits_column(spark, F.col(text_col), phrases))
        phrases = next(blocks, None)
        if phrases:
            docs = cut(docs)
    # spans of several blocks may overlap; the longest reach so far decides what a span adds
    spans = F.array_sort(F.concat(*[F.col(n)["spans"] for n in names])) if len(names) > 1 else F.col(names[0])["spans"]
    zero = F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("n"))
    n_hit = F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["reach"], s["end"]).alias("reach"),
            (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(acc["reach"], s["start"]))).alias("n"),
        ),
    )["n"]
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(n)["items"] for n in names])))
    n_words = F.col(names[0])["n_words"]
    return docs.select(
        *keep,
        F.struct(
            n_words.alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(items).cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
            spans.alias("spans"),
        ).alias(out),
    )


def without_spans(text: str | None, spans: list) -> str | None:
    """The text without the words of some spans (start, end), and without what stands between these."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "replace")
    plain = raw.translate(WORD_BYTES)
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", plain)]
    out, done = [], 0
    for start, end in spans:
        out.append(raw[done : at[start][0]])
        done = at[end - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW):
    """What shard_hits finds, by comparing every place with a set of phrases; for tests."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[i : i + window])].add(name)
    out = []
    for t in texts:
        w, hit, names = words_of(t), set(), set()
        for n in {len(p) for p in owners}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in owners:
                    hit |= set(range(i, i + n))
                    names |= owners[p]
        out.append((len(w), len(hit), sorted(names)))
    return out


__all__ = ["Bits", "FmIndex", "Phrases", "brute_force", "hits_column", "phrase_blocks", "shard_hits", "with_hits", "without_spans", "words_of"]
