"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded as a vector of surface features and of
hashed byte trigrams; a hidden layer embeds it; gated attention (tanh times sigmoid, softmax over the passages of the document)
weighs the embeddings; a logistic unit scores the weighted sum. All layers are learned together, from document labels only.

Fit. At most MAX_PER_CLASS labelled rows of each label are used, those with the smallest hash of the id, and of these, by a hash
of the text, those that fit into half of MAX_PASSAGES passages for each label; one that doesn't fit keeps no other out, a row comes
with all its passages, and of a label of which no row fits the smallest one is used. Training is full-batch
Adam in numpy on the driver, with rows weighted back to the labels' true shares. Labels other than 0 and 1 and labels of an id
that disagree don't count.

Null texts and texts without a word are one passage without features. With labels of one kind only, every score is that label; with
none, as for an empty table, it is 0.5. Documents are read whole, passage by passage; repeated rows give repeated results; of the
input only the id and the text are read, so that further columns can't clash with the results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import text_column
from strandline.llm.toxicity import training_rows

PASSAGE_WORDS = 64
MAX_PER_CLASS = 2_000
HIDDEN, ATTENTION, STEPS, RATE, RIDGE = 16, 8, 150, 0.02, 3e-3
#: Passages of all training rows together; scoring has no such bound.
MAX_PASSAGES = 60_000
SURFACE, TRIGRAMS = 16, 64
N_FEATURES = SURFACE + TRIGRAMS

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 comma or full stop, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 10, 11, 12, 13]], _KIND[[44, 46]], _KIND[128:] = 1, 2, 3, 4, 5, 6


def encode_passages(text: str | None) -> np.ndarray:
    """A row of N_FEATURES for each passage; at least one row."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    n = len(words)
    starts = np.arange(0, n, PASSAGE_WORDS)
    size = np.diff(np.append(starts, n)).astype(np.float64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(lengths + 1)
    at = np.r_[0, ends[starts[1:] - 1]]
    kind = _KIND[joined]
    per = np.stack([np.add.reduceat(kind == k, at, dtype=np.int64) for k in (0, 1, 2, 3, 5, 6)], 1)
    chars = np.diff(np.append(at, len(joined))).astype(np.float64)
    distinct = np.array([len(set(words[a : a + PASSAGE_WORDS])) for a in starts.tolist()], np.float64)
    hashes = np.fromiter(map(hash, words), np.int64, n)
    same = np.r_[False, hashes[1:] == hashes[:-1]]
    repeats = np.add.reduceat(same, starts, dtype=np.int64) / size
    mean = np.add.reduceat(lengths, starts) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(lengths * lengths, starts) / size - mean**2, 0))
    short = np.add.reduceat(lengths <= 2, starts, dtype=np.int64) / size
    long = np.add.reduceat(lengths >= 14, starts, dtype=np.int64) / size
    whole = len(set(words)) / n
    share = per / chars[:, None]
    out = [*share.T, share[:, 0] > 0.08, share[:, 2] > 0.3, distinct / size, repeats, mean / 8, spread / 5, short, long]
    out += [np.full(len(starts), whole), np.full(len(starts), np.log1p(n) / 8)]
    grams = np.sqrt(trigrams(joined, np.diff(np.append(at, len(joined)))) / chars[:, None])
    return np.concatenate([np.stack([np.asarray(c, np.float32) for c in out], 1), grams.astype(np.float32)], 1)


def trigrams(joined: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many byte trigrams of each hash begin in each of the passages, which follow one another and have these lengths."""
    of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    counts = np.zeros(len(lengths) * TRIGRAMS, np.int64)
    for start in range(0, len(joined) - 2, 1 << 20):  # bounded memory for very long texts; two bytes carry over
        part = joined[start : start + (1 << 20) + 2].astype(np.uint32)
        three = (part[:-2] << np.uint32(16)) + (part[1:-1] << np.uint32(8)) + part[2:]
        h = three * np.uint32(2654435761) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)
        first = of[start : start + len(h)]
        lo, hi = int(first[0]), int(first[-1]) + 1
        counts[lo * TRIGRAMS : hi * TRIGRAMS] += np.bincount((first - lo).astype(np.int64) * TRIGRAMS + h, minlength=(hi - lo) * TRIGRAMS)
    return counts.reshape(-1, TRIGRAMS)


@dataclass
class MilModel:
    """Weights by name, or a constant score."""

    w: dict[str, np.ndarray] | None
    constant: float = 0.5

    def score(self, passages: np.ndarray) -> tuple[float, np.ndarray]:
        """Score of a bag, and the attention of each passage."""
        if self.w is None:
            return self.constant, np.full(len(passages), 1 / len(passages))
        h, att = self._embed(passages)
        e = np.exp(att - att.max())
        a = e / e.sum()
        z = float(a @ h @ self.w["c"] + self.w["b"][0])
        return 1 / (1 + float(np.exp(-np.clip(z, -60, 60)))), a

    def score_many(self, bags: list[np.ndarray]) -> np.ndarray:
        """Scores of many bags at once."""
        if self.w is None:
            return np.full(len(bags), self.constant)
        h, att = self._embed(np.concatenate(bags))
        at = np.r_[0, np.cumsum([len(x) for x in bags])[:-1]]
        rep = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
        e = np.exp(att - np.maximum.reduceat(att, at)[rep])
        top = np.add.reduceat(e[:, None] * h, at, axis=0) / np.add.reduceat(e, at)[:, None]
        z = top @ self.w["c"] + self.w["b"][0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60).astype(np.float64)))

    def _embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.w
        h = np.maximum((x - w["mean"]) / w["std"] @ w["e"] + w["eb"], 0)
        gate = np.tanh(h @ w["v"]) * (1 / (1 + np.exp(-(h @ w["u"]))))
        return h, gate @ w["a"]


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> MilModel:
    """Gated attention, trained by Adam on all bags at once."""
    x = np.concatenate(bags)
    of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    at = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
    mean, std = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3
    x = ((x - mean) / std).astype(np.float32)
    r = np.random.default_rng(seed)
    p = {
        "e": r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        "eb": np.zeros(HIDDEN),
        "v": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "u": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "a": r.normal(0, 0.3, ATTENTION),
        "c": r.normal(0, 0.3, HIDDEN),
        "b": np.zeros(1),
    }
    m, v = ({k: np.zeros(t.shape, np.float32) for k, t in p.items()} for _ in range(2))
    weight, y = (weight / weight.sum()).astype(np.float32), y.astype(np.float32)
    p = {k: t.astype(np.float32) for k, t in p.items()}
    for step in range(1, STEPS + 1):
        pre = x @ p["e"] + p["eb"]
        h = np.maximum(pre, 0)
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        att = (t * s) @ p["a"]
        e = np.exp(att - np.maximum.reduceat(att, at)[of])
        alpha = e / np.add.reduceat(e, at)[of]
        z = np.add.reduceat(alpha[:, None] * h, at, axis=0)
        out = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -40, 40)))
        d_out = weight * (out - y)
        d_z = d_out[:, None] * p["c"]
        d_alpha = (h * d_z[of]).sum(axis=1)
        d_att = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, at)[of])
        d_gate = d_att[:, None] * p["a"]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = alpha[:, None] * d_z[of] + d_t @ p["v"].T + d_s @ p["u"].T
        d_pre = d_h * (pre > 0)
        g = {"e": x.T @ d_pre, "eb": d_pre.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "a": (t * s).T @ d_att, "c": z.T @ d_out, "b": np.array([d_out.sum()])}
        for k in p:
            grad = g[k] + RIDGE * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel({k: t.astype(np.float32) for k, t in (p | {"mean": mean, "std": std}).items()})


def within(sizes: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]]:
    """(y, h) of the rows to learn from: of (y, h, passages), each label's in order of h as far as they fit into its half of `most`
    passages; one that doesn't fit is left out and later ones go on. Of a label of which none fits, the smallest row is taken."""
    out = []
    for y in sorted({y for y, *_ in sizes}):
        own, left = sorted((h, n) for k, h, n in sizes if k == y), most // 2
        if min(n for _, n in own) > left:
            h, _ = min(own, key=lambda r: (r[1], r[0]))
            out.append((y, h))
            continue
        for h, n in own:
            if n <= left:
                out.append((y, h))
                left -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_PER_CLASS) -> MilModel:
    """Learns from rows of docs for which `usable`, an expression over a column named id, holds."""
    rows, weigh = training_rows(docs, labels, label, usable, id_col, text_col, most)
    rows = rows.withColumn("h", F.xxhash64("text"))

    def bags(batches):
        for b in batches:
            got = [encode_passages(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array([x.tobytes() for x in got], pa.binary())], ["y", "x"])

    # passages of each training row, a few thousand numbers
    words = F.size(F.filter(F.split("text", "[ \t\n\u000b\f\r]+"), lambda w: w != ""))
    sizes = rows.select("y", "h", F.coalesce(words, F.lit(0)).alias("n")).collect()
    kept = within([(r["y"], r["h"], max(1, -(-r["n"] // PASSAGE_WORDS))) for r in sizes], MAX_PASSAGES)
    if len(kept) < len(sizes):
        few = docs.sparkSession.createDataFrame(kept, "y int, h bigint").distinct()
        rows = rows.join(F.broadcast(few), ["y", "h"], "left_semi")  # 2 * `most` rows at most
    found = sorted(((r["y"], bytes(r["x"])) for r in rows.select("text", "y").mapInArrow(bags, "y int, x binary").collect()))
    y = np.array([a for a, _ in found], float)
    if not len(y) or y.min() == y.max():
        return MilModel(None, float(y[0]) if len(y) else 0.5)
    return train([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, b in found], y, np.array([weigh[int(a)] for a in y]))


def quality_column(spark, text: Column, model: MilModel) -> Column:
    """Struct column: score, passages (how many), attention (the largest weight of one)."""
    shared = spark.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def work(texts):
            bags = [encode_passages(t) for t in texts]
            return [m.score_many(bags).tolist() if bags else [], [len(b) for b in bags]]

        return work

    return text_column(text, "score:double,passages:bigint", factory)
