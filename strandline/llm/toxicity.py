"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration.

Fit. Of the labelled rows, at most MAX_PER_CLASS of each label are used, those with the smallest hash of the id, and of rows
that share one of three min-hashes of their word 4-grams (copies and near copies) one. The tokens of a word are itself and
its beginnings of PREFIXES bytes, as some languages make many words of one stem; a word scores like its best token. Document
counts of each token give log-odds of the two labels under a Dirichlet prior that follows the tokens of both; a token scores what is
left after ERRORS standard errors if that is MIN_SCORE or more, every other word costs DRIFT. The scores of clean documents give lambda and K of
the extreme-value law of Karlin and Altschul.

Score. A linear scan (Ruzzo and Tompa) finds all maximal segments of a text. The chance that a clean text of this length
has a segment as good follows from the law; a segment is significant if it is under SIGNIFICANT. The evidence of a text
is the sum of -ln(chance) over its significant segments, and a logistic curve over it, fitted on the same rows weighted
back to the labels' true shares, gives the score.

The settings were picked from a regular grid by cross-validation within rows that may be learned from (tests/llm/choose_toxicity.py).

Null and empty texts have no segments and get the score of no evidence. Labels that are null, neither 0 nor 1, of documents that
don't exist or of an id whose labels disagree don't count; with no labels of one kind every score is the share of label 1 (0 if
there are none). Texts are read whole; repeated rows give repeated results; an empty table gives no rows; of the input only the
id and the text are read, so that further columns can't clash with the results.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, text_column
from strandline.llm.decontam import words_of

MAX_PER_CLASS = 8_000
PRIOR_DOCS = 25.0
ERRORS = 2.0
MIN_SCORE = 1.0
DRIFT = -2.0
PREFIXES = (4, 5, 6, 7, 8)
#: Words whose score a Python worker remembers before it starts afresh.
WORDS_KEPT = 300_000
SIGNIFICANT = 0.01


def tokens_of(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


class _WordScores(dict):
    """Scores of words as they come up; None: no token of it has one."""

    def __init__(self, scores: dict[bytes, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = [s for s in map(self.scores.get, tokens_of(word)) if s is not None]
        self[word] = best = max(found, default=None)
        return best


@dataclass
class ToxicModel:
    scores: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    weight: float = 0.0
    bias: float = -30.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments (start word, end word, score)."""
        words = words_of(text)
        known = self.__dict__.get("_known")
        if known is None:
            known = self._known = _WordScores(self.scores)
        got = [known[w] for w in words]
        at = [i for i, s in enumerate(got) if s is not None]
        return len(words), maximal_segments([(i, got[i]) for i in at], DRIFT)

    def surprise(self, score: float, n: int) -> float:
        """-ln of the chance that a clean text of n words has a segment of at least this score."""
        expected = math.log(self.k * max(n, 1)) - self.lam * score
        # for a small expected number the chance is that number
        return -expected if expected < -30 else -math.log(-math.expm1(-math.exp(expected)))

    def passages(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Evidence, and the significant passages (start word, end word, score, chance)."""
        n, found = self.segments(text)
        out, evidence = [], 0.0
        for a, b, s in found:
            e = self.surprise(s, n)
            if e > -math.log(SIGNIFICANT):
                out.append((a, b, s, math.exp(-e)))
                evidence += e
        return evidence, out

    def score_of(self, evidence: float) -> float:
        x = self.weight * math.log1p(evidence) + self.bias
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def maximal_segments(positive: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in which the given places have positive scores and all others cost
    `drift`, in time linear in the number of given places: candidates are kept with the totals before and after them,
    and a new one is merged back to the last candidate that began lower, if it ends higher."""
    stack: list[list] = []  # start, end, total before, total after, place of the last candidate that began lower
    total, at = 0.0, 0
    for i, s in positive:
        total += drift * (i - at)
        start, before = i, total
        total += s
        at = i + 1
        new = [start, at, before, total]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= new[3]:
                stack.append([*new, k])
                break
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def karlin_altschul(values: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """lambda and an upper estimate of K for independent scores with negative mean and some positive ones."""
    if values.max(initial=-1) <= 0 or (values * shares).sum() >= 0:
        return 1.0, 1.0
    lo, hi = 0.0, 1.0
    while (shares * np.exp(np.minimum(hi * values, 700))).sum() < 1:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (shares * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (lo, mid)
    # segments begin at a positive score only
    return hi, float(max(shares[values > 0].sum(), 1e-9))


def _word_documents(batches):
    """(text, y) to document counts of each word in a task, by label."""
    counts: dict[bytes, list[int]] = {}
    words = clean = 0
    for b in batches:
        for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
            w = words_of(text)
            uses: dict[bytes, int] = {}
            for x, n in Counter(w).items():
                for t in tokens_of(x):
                    uses[t] = uses.get(t, 0) + n
            for t, n in uses.items():
                c = counts.setdefault(t, [0, 0, 0])
                c[y] += 1
                c[2] += n * (not y)
            if not y:
                words, clean = words + len(w), clean + 1
        if len(counts) >= 200_000:
            yield _counted(counts)
            counts = {}
    counts[b""] = [clean, 0, words]  # no word is empty; this row holds the totals
    yield _counted(counts)


def _counted(counts) -> pa.RecordBatch:
    cols = list(zip(*counts.values(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *(pa.array(c, pa.int64()) for c in cols)], ["word", "clean", "toxic", "uses"])


def sketches(text: str | None) -> list[int]:
    """The smallest of the hashes of the word 4-grams, for three hash functions made of one."""
    w = words_of(text)
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))], np.uint64)
    return [int((h * np.uint64(k) + np.uint64(k >> 7)).min() >> np.uint64(1)) for k in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str, text_col: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of at most `most` labelled rows of each label, and what a row of each label weighs. usable: of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(usable)
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    chosen = {r["id"]: r["y"] for r in picked[0].unionByName(picked[1]).collect()}
    kind = dict(texts.dtypes)["id"]

    def rows_of(ids):
        # at most 2 * `most` ids, so that they can go to every executor
        return texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i, chosen[i]) for i in ids], f"id {kind}, y int")), "id")

    def work(some):
        return [[sketches(t) for t in some]]

    seen, keep = set(), []
    keys = rows_of(chosen).select("id", "y", text_column(F.col("text"), "keys:array<bigint>", lambda: work)["keys"].alias("keys"))
    for r in sorted(keys.collect(), key=lambda r: (r["y"], r["id"], r["keys"])):
        own = {(r["y"], k, x) for k, x in enumerate(r["keys"])}
        if not own & seen:
            keep.append(r["id"])
        seen |= own
    return cut(rows_of(keep).select("text", "y")), {y: n.get(y, 0) / max(1, min(most, n.get(y, 0))) for y in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_PER_CLASS) -> ToxicModel:
    """Learns from rows of docs for which `usable`, an expression over a column named id, holds."""
    rows, weigh = training_rows(docs, labels, label, usable, id_col, text_col, most)
    counted = rows.mapInArrow(_word_documents, "word binary, clean bigint, toxic bigint, uses bigint")
    counted = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "uses")])
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return ToxicModel(bias=30.0 if toxic else -30.0)
    share = F.col("clean") + F.col("toxic")
    a = F.col("toxic") + PRIOR_DOCS * share / (clean + toxic)
    b = F.col("clean") + PRIOR_DOCS * share / (clean + toxic)
    odds = F.log(a / (toxic + PRIOR_DOCS - a)) - F.log(b / (clean + PRIOR_DOCS - b))
    error = F.sqrt(1 / a + 1 / b)
    sure = odds - ERRORS * error
    # tokens of a bounded sample that tell the labels apart; over two errors by chance alone, one in forty
    telling = counted.where((F.length("word") > 0) & (sure >= MIN_SCORE)).select("word", sure.alias("s"), "uses").collect()
    total = counted.where(F.length("word") == 0).agg(F.sum("uses")).first()[0] or 0
    model = ToxicModel({bytes(r["word"]): r["s"] for r in telling})
    values = np.array([r["s"] for r in telling] + [DRIFT])
    uses = np.array([r["uses"] + 0.5 for r in telling], float)
    shares = np.append(uses, max(total - uses.sum(), 1.0)) / max(total, uses.sum() + 1.0)
    model.lam, model.k = karlin_altschul(values, shares)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches):
        m = shared.value
        for batch in batches:
            found = [m.passages(t)[0] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(found, pa.float64())], ["y", "x"])

    got = rows.mapInArrow(evidence, "y int, x double").groupBy("y", F.round("x", 1).alias("x")).agg(F.count("*").alias("n")).collect()
    y = np.array([r["y"] for r in got], float)
    x = np.log1p(np.array([r["x"] for r in got], float))
    w = np.array([r["n"] * weigh[r["y"]] for r in got], float)
    model.weight, model.bias = logistic(x, y, w)
    return model


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weight and bias of a one-dimensional logistic regression with a slight ridge, by Newton steps that are halved until
    the loss falls."""
    t, z = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    w = w / w.sum()
    ridge = np.diag([1e-4, 1e-6])

    def loss(t: np.ndarray) -> float:
        m = z @ t
        return float((w * (np.logaddexp(0, m) - y * m)).sum() + t @ ridge @ t / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -40, 40)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ t)
        size = 1.0
        while size > 1e-6 and loss(t + size * step) >= loss(t):
            size /= 2
        if size <= 1e-6:
            break
        t = t + size * step
    return max(0.0, float(t[0])), float(t[1])


def score_column(spark, text: Column, model: ToxicModel) -> Column:
    """Struct column: score, passages (array of start word, end word, score, chance)."""
    shared = spark.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def work(texts):
            got = [m.passages(t) for t in texts]
            return [
                [m.score_of(e) for e, _ in got],
                [[{"start": a, "end": b, "score": s, "chance": p} for a, b, s, p in found] for _, found in got],
            ]

        return work

    return text_column(text, "score:double,passages:array<struct<start:bigint,end:bigint,score:double,chance:double>>", factory)
