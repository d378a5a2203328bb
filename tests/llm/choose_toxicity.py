"""The toxicity operator without Spark, and its settings by cross-validation within the rows that may be learned from.

`python -m tests.llm.choose_toxicity DIR` prints the log loss and AUC of settings over FOLDS folds of the labelled rows of DIR whose
crc32(doc_id) mod 5 is not 0, and the one with the smallest loss. Held-out rows are never read. Copies and near copies share a fold. The
grid is regular, each number in steps of a factor; the search begins in its middle and goes through one setting after the other
until a whole sweep changes none.
"""

import sys
import zlib
from collections import Counter, defaultdict

import numpy as np

from strandline.llm import toxicity as T

FOLDS = 4
GRID = {
    "PREFIXES": ((), (4, 8), (4, 5, 6, 7, 8)),
    "ERRORS": (0.5, 1.0, 2.0, 4.0),
    "PRIOR_DOCS": (1.0, 5.0, 25.0),
    "MIN_SCORE": (0.25, 0.5, 1.0, 2.0),
    "DRIFT": (-0.25, -0.5, -1.0, -2.0),
}


def without_copies(rows):
    """Of (id, text, y), the rows that the operator learns from."""
    seen, keep = set(), []
    for i, t, y in sorted(rows, key=lambda r: (r[2], r[0])):
        own = {(y, k, x) for k, x in enumerate(T.sketches(t))}
        if not own & seen:
            keep.append((i, t, y))
        seen |= own
    return keep


def fit(texts, labels, weigh=None):
    """What toxicity.fit learns from rows without copies."""
    uses, docs = Counter(), defaultdict(lambda: [0, 0])
    total = 0
    for t, y in zip(texts, labels, strict=True):
        n = Counter()
        words = T.words_of(t)
        for w in words:
            n.update(T.tokens_of(w))
        for x, k in n.items():
            docs[x][y] += 1
            uses[x] += k * (y == 0)
        total += len(words) * (y == 0)
    toxic, clean = sum(labels), len(labels) - sum(labels)
    scores = {}
    for x, (b, a) in docs.items():
        prior = T.PRIOR_DOCS * (a + b) / (clean + toxic)
        p, q = a + prior, b + prior
        sure = np.log(p / (toxic + T.PRIOR_DOCS - p)) - np.log(q / (clean + T.PRIOR_DOCS - q)) - T.ERRORS * np.sqrt(1 / p + 1 / q)
        if sure >= T.MIN_SCORE:
            scores[x] = sure
    m = T.ToxicModel(scores)
    used = np.array([uses[x] + 0.5 for x in scores])
    m.lam, m.k = T.karlin_altschul(np.array([*scores.values(), T.DRIFT]), np.append(used, max(total - used.sum(), 1.0)) / max(total, used.sum() + 1.0))
    x = np.log1p([round(m.passages(t)[0], 1) for t in texts])
    y = np.array(labels, float)
    m.weight, m.bias = T.logistic(x, y, np.ones(len(y)) if weigh is None else np.array([weigh[k] for k in labels], float))
    return m


def auc(scores, labels):
    pos, neg = scores[labels == 1], np.sort(scores[labels == 0])
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / len(pos) / len(neg))


def cross_validate(rows):
    """(log loss, AUC) over all folds of (id, text, y)."""
    fold = np.array([zlib.crc32(b"fold%d" % i) % FOLDS for i, _, _ in rows])
    y = np.array([r[2] for r in rows])
    out = np.zeros(len(rows))
    for f in range(FOLDS):
        inner = [r for r, k in zip(rows, fold, strict=True) if k != f]
        m = fit([t for _, t, _ in inner], [k for *_, k in inner])
        for i in np.flatnonzero(fold == f):
            out[i] = m.score_of(m.passages(rows[i][1])[0])
    p = np.clip(out, 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))), auc(out, y)


def main(folder):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, toxic from '{folder}/documents.parquet' join '{folder}/labels.parquet' using (doc_id) where toxic in (0, 1)").fetchall()
    rows = without_copies([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0])
    print(len(rows), "rows,", sum(r[2] for r in rows), "toxic")
    at, seen = {k: len(v) // 2 for k, v in GRID.items()}, {}

    def loss(at):
        key = tuple(at.values())
        if key not in seen:
            for k, i in at.items():
                setattr(T, k, GRID[k][i])
            seen[key] = cross_validate(rows)
            print(*(f"{k}={GRID[k][i]}" for k, i in at.items()), *(round(x, 5) for x in seen[key]), flush=True)
        return seen[key][0]

    while True:
        before = dict(at)
        for k, values in GRID.items():
            at[k] = min(range(len(values)), key=lambda i: loss(at | {k: i}))
        if at == before:
            break
    print("picked", {k: GRID[k][i] for k, i in at.items()})


if __name__ == "__main__":
    main(sys.argv[1])
