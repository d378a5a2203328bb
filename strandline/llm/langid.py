"""Language identification in two steps: the family first, then one-versus-one linear SVMs between its languages.

Features are hashed byte n-grams (n = 1 to 3) of the letters of a text, case folded, with words set off by spaces, square
roots of counts, scaled to length one; a text of any length is counted whole. The family classifier is one linear SVM
for each family against the rest; within a family one SVM for each pair of languages, each adding its squashed margin to
the votes of its two languages. The score is the share of the winner at both steps.

Fit. About MAX_PER_LANGUAGE rows of each language are used, fewer where that would be over MAX_ROWS rows of all, so that what the
driver holds doesn't grow with the number of languages; those whose hashed id is under the threshold that leaves so many. Vectors
travel with 8 bits a feature. SVMs are trained on the driver by dual coordinate descent. Languages that FAMILIES doesn't know are
a family each. Each classifier has one row of weights, so that the model grows with the languages, not with the documents.

Null texts and texts without a letter are `und` with score 0; so is every text if nothing could be learned, as from an empty
table. Null languages are never learned. Ties go to the language that is first in order. Repeated rows are learned and judged
one by one, texts of any length are counted whole, and only the id, the text and the language are read, so that further columns
can't clash with the results.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import text_column

BITS = 13
MAX_PER_LANGUAGE = 1_500
MAX_ROWS = 9_000
ROUNDS = 12
COST = 4.0

# Languages of each family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
# ASCII: letters lower-cased, everything else a space
_ASCII = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def family_of(lang: str) -> str:
    return next((f for f, names in FAMILIES.items() if lang in names), lang)


def features(text: str | None) -> np.ndarray | None:
    """The scaled vector of a text, or null if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    if text.isascii():
        raw = text.encode().translate(_ASCII)
    else:
        raw = text.lower().encode("utf-8", "replace").translate(_ASCII)
        # Latin punctuation outside ASCII is rare and harmless; scripts without ASCII separators keep theirs
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    keep = np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]
    b = b[keep]
    counts = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(b), 1 << 20):  # bounded memory for very long texts; two bytes carry over
        part = b[start : start + (1 << 20) + 2]
        two = part[:-1] * np.uint32(256) + part[1:]
        three = two[:-1] * np.uint32(256) + part[2:]
        own = 1 << 20
        for k, grams in enumerate((part[:own], two[:own], three[:own])):
            h = (grams + np.uint32(k + 1)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
            counts += np.bincount(h, minlength=1 << BITS)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.sqrt(np.float32(counts.sum()))


def train_svm(z: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, cost: float = COST, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent over some rows of z, whose last column is 1
    and makes the bias. y: 1 or -1 for each row of z. Rows are used in place, as z is the largest thing on the driver."""
    rows = np.arange(len(z)) if rows is None else rows
    q = np.einsum("ij,ij->i", z, z) + 1 / (2 * cost)
    w, a = np.zeros(z.shape[1], np.float32), np.zeros(len(z))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(rows):
            step = max(0.0, a[i] - (y[i] * float(w @ z[i]) - 1 + a[i] / (2 * cost)) / q[i]) - a[i]
            if step:
                a[i] += step
                w += np.float32(step * y[i]) * z[i]
    return w


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None  # a row for each family, the bias last
    pairs: list[tuple[str, str]] = field(default_factory=list)
    pair_weights: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if self.langs else None
        if x is None:
            return UNKNOWN, 0.0
        score, family = 1.0, self.families[0]
        if len(self.families) > 1:
            margin = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
            p = 1 / (1 + np.exp(-3 * np.clip(margin, -20, 20)))
            best = int(np.argmax(p))
            family, score = self.families[best], float(p[best] / p.sum())
        names = [x for x in self.langs if family_of(x) == family]
        if len(names) == 1:
            return names[0], score
        votes = dict.fromkeys(names, 0.0)
        for k, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                w = self.pair_weights[k]
                p = float(1 / (1 + np.exp(-3 * np.clip(w[:-1] @ x + w[-1], -20, 20))))
                votes[a] += p
                votes[b] += 1 - p
        best = max(names, key=lambda n: votes[n])
        return best, score * votes[best] / sum(votes.values())


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_PER_LANGUAGE, most_rows: int = MAX_ROWS) -> LanguageModel:
    """Learns from rows with a language for which `usable`, an expression over columns of docs, holds."""
    rows = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    hash_ = F.xxhash64("id", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel()
    # hashes are even, so the share of them below a threshold is known
    most = min(most, most_rows / len(langs))
    limits = F.create_map(*[F.lit(x) for g in langs for x in (g, int(min(1.0, most / sizes[g]) * (1 << 30)))])
    keep = F.pmod(hash_, F.lit(1 << 30)) < limits[F.col("lang")]

    def vectors(batches):
        for b in batches:
            got = [(g, features(t)) for g, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True)]
            got = [(g, v) for g, v in got if v is not None]
            data = [(v * 255 / max(v.max(), 1e-9)).astype(np.uint8).tobytes() for _, v in got]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.string()), pa.array(data, pa.binary())], ["lang", "x"])

    found = rows.where(keep).mapInArrow(vectors, "lang string, x binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return LanguageModel()
    z = np.ones((len(found), (1 << BITS) + 1), np.float32)
    for row, r in zip(z, found, strict=True):
        row[:-1] = np.frombuffer(r["x"], np.uint8)
        row[:-1] /= np.sqrt(row[:-1] @ row[:-1])
    lang = np.array([r["lang"] for r in found])
    family = np.array([family_of(v) for v in lang])
    families = sorted(set(family.tolist()))
    model = LanguageModel(langs, families)
    if len(families) > 1:
        model.family_weights = np.stack([train_svm(z, np.where(family == f, 1, -1)) for f in families])
    del found
    model.pairs = [(a, b) for a, b in combinations(langs, 2) if family_of(a) == family_of(b)]
    if model.pairs:
        model.pair_weights = np.stack([train_svm(z, np.where(lang == a, 1, -1), np.flatnonzero((lang == a) | (lang == b))) for a, b in model.pairs])
    return model


def language_column(spark, text: Column, model: LanguageModel) -> Column:
    """Struct column: lang_pred, score."""
    shared = spark.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def work(texts):
            got = [m.predict(t) for t in texts]
            return [[a for a, _ in got], [float(b) for _, b in got]]

        return work

    return text_column(text, "lang_pred:string,score:double", factory)
