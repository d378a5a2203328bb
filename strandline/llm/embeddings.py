"""Embedding near-duplicates: codes by iterative quantisation, multi-index Hamming tables, cosines of the original vectors.

Vectors of equal label link at a cosine of THRESHOLD or more. From a bounded sample, unit vectors are centred and turned by a rotation
that is learnt in rounds (signs of the turned vectors, then the rotation that brings the vectors nearest to those signs), so that the
signs are balanced codes of BITS bits. The codes are cut into GROUPS groups; every pair of groups is one table, whose cells hold the
vectors with equal bits in both. Near vectors meet in some table unless their codes differ in all groups but one.

Candidates differ in at most RADIUS bits and count in the first table in which they meet. The tables see codes only. A cell names those of
its vectors that have a candidate there; only these are joined with their vectors, which go to such cells alone. There, cosines in
double precision decide, and what leaves a task is each vector's number of links and a spanning forest of them, never all pairs. Cells
of more than CELL_ROWS vectors are dealt out as pairs of blocks.

Equal vectors of a label are one vector with a multiplicity from the start, so links between copies are counted and lose nothing.

Vectors that are null or zero or hold null or non-finite components, and rows without a label, link with nothing: they are their own
component. Vectors of another length than most have no code and meet in one table by label and length, so that no pair of theirs is lost.
Equal ids are judged row by row; a component is named by its smallest id that isn't null, and a row without an id is kept only where
the component has no name. An empty table gives no rows. Only id, vector and label are read, so that further columns can't clash.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.codebooks import COMMON_ROWS, COMMON_SHARE, usable
from strandline.llm.common import cut
from strandline.llm.simhash import forest
from strandline.operators.graph import connected_components

THRESHOLD = 0.98
BITS = 64
GROUPS = 8
#: Equal groups of a table.
EQUAL = 2
#: Bits in which the codes of candidates differ at most. Of two vectors with the smallest cosine that links, a bit differs with
#: probability acos(0.98) / pi = 0.064, so that 14 are passed once in 10^5 pairs.
RADIUS = 14
#: Vectors, by the order of a hash, that the rotation is learnt from at most.
SAMPLE = 8192
LEARNING_ROUNDS = 50
#: Vectors that a task compares with each other at most; larger cells are cut into blocks of about half as many.
CELL_ROWS = 2048
#: The table of vectors without a code.
UNCODED = -1


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision. A power of two keeps squares within range and changes no digit."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Rotation:
    """Codes of vectors of one length: signs after centring and turning."""

    def __init__(self, mean: np.ndarray, turns: np.ndarray):
        self.mean, self.turns = mean, turns

    @classmethod
    def learnt(cls, sample: np.ndarray, bits: int = BITS) -> Rotation:
        x = unit(sample)
        mean = x.mean(axis=0)
        x = x - mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1]  # most variance first
        made, rng = [], np.random.default_rng(7)
        while sum(t.shape[1] for t in made) < bits:  # short vectors take further rotations, which stay random so that they tell other things
            k = min(x.shape[1], bits - sum(t.shape[1] for t in made))
            low = x @ axes[:, :k]
            turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
            for _ in range(0 if made else LEARNING_ROUNDS):
                signs = np.where(low @ turn >= 0, 1.0, -1.0)
                a, _, b = np.linalg.svd(low.T @ signs)
                turn = a @ b
            made.append(axes[:, :k] @ turn)
        return cls(mean, np.concatenate(made, axis=1))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        bits = (unit(vectors) - self.mean) @ self.turns >= 0
        return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)


@functools.cache
def tables() -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(GROUPS), EQUAL))


def group_mask(g: int) -> int:
    wide = BITS // GROUPS
    return ((1 << wide) - 1) << wide * g


def table_mask(t: int) -> int:
    return sum(group_mask(g) for g in tables()[t])


@functools.cache
def first_table() -> np.ndarray:
    """For each set of equal groups, as bits, the first table made of such groups."""
    out = np.full(1 << GROUPS, 255, np.uint8)
    for equal in range(len(out)):
        out[equal] = next((t for t, gs in enumerate(tables()) if all(equal >> g & 1 for g in gs)), 255)
    return out


def candidates(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Which of the codes a and b (rows, columns) are candidates that meet first in a table."""
    if table == UNCODED:
        return np.ones((len(a), len(b)), bool)
    differ = a[:, None] ^ b[None, :]
    close = np.bitwise_count(differ) <= RADIUS
    i, j = np.nonzero(close)
    d = differ[i, j]
    equal = np.zeros(len(d), np.int64)
    for g in range(GROUPS):
        equal |= ((d & np.uint64(group_mask(g))) == 0).astype(np.int64) << g
    close[i, j] = first_table()[equal] == table
    return close


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, key: list[str], most: int = CELL_ROWS) -> DataFrame:
    """Rows with `i`, `j`, `b`, in order: the parts (i, j) of a key's rows are to be compared, those of block i with those of block j.
    A small key is one part. A row of block b of a large one goes to all (b, j) and (i, b)."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n_")).where(F.col("n_") > 1)
    rows = rows.join(sizes, key)
    of = F.when(F.col("n_") > most, F.ceil(F.col("n_") * 2 / most)).otherwise(1).cast("int")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("node"), of).cast("int")).withColumn("of_", of)
    rows = rows.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("of_") - 1)))
    rows = rows.withColumns({"i": F.least("b", "other_"), "j": F.greatest("b", "other_")}).drop("n_", "of_", "other_")
    return rows.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "b")


def _parts(batches, key: list[str]):
    """Arrow tables of the rows with equal key, i and j."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [*key, "i", "j"]
        new = np.zeros(batch.num_rows, bool)
        for c in names:
            x = batch[c].to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            new[0] |= not left or left[-1][c][-1] != batch[c][0]
        starts = np.flatnonzero(new).tolist()
        bounds = [*starts, batch.num_rows]
        if bounds[0]:
            left.append(batch.slice(0, bounds[0]))
        for lo, hi in itertools.pairwise(bounds):
            if left:
                yield pa.Table.from_batches(left).combine_chunks()
            left = [batch.slice(lo, hi - lo)]
    if left:
        yield pa.Table.from_batches(left).combine_chunks()


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two blocks, and whether they are the same."""
    i, j, b = (t[c].to_numpy() for c in ("i", "j", "b"))
    return np.flatnonzero(b == i), np.flatnonzero(b == j), bool(i[0] == j[0])


def with_candidates(cells: DataFrame) -> DataFrame:
    """The rows (label, width, tab, cell, node) of cells in which the node has a candidate that it meets there first."""
    key = ["label", "width", "tab", "cell"]

    def run(batches):
        for t in _parts(batches, key):
            code = t["code"].to_numpy().view(np.uint64)
            rows, columns, same = _sides(t)
            has = np.zeros(len(code), bool)
            for lo in range(0, len(rows), 256):
                some = rows[lo : lo + 256]
                found = candidates(code[some], code[columns], t["tab"][0].as_py())
                if same:
                    found &= some[:, None] != columns[None, :]
                has[some] |= found.any(axis=1)
                has[columns] |= found.any(axis=0)
            yield from t.select([*key, "node"]).filter(pa.array(has)).combine_chunks().to_batches()

    kinds = ", ".join(f"{c} {k}" for c, k in cells.select(*key, "node").dtypes)
    return dealt(cells, key).mapInArrow(run, kinds)


def near(cells: DataFrame, threshold: float) -> DataFrame:
    """(node, n, other): how many rows of the table the node links with in a part of a cell, other null; and the links (node, other) of
    a spanning forest of the part, n null. cells: also code, copies, vector."""
    key = ["label", "width", "tab", "cell"]

    def run(batches):
        for t in _parts(batches, key):
            code = t["code"].to_numpy().view(np.uint64)
            node, copies = (t[c].to_numpy() for c in ("node", "copies"))
            vectors = unit(t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1))
            rows, columns, same = _sides(t)
            n = np.zeros(len(node), np.int64)
            a, b = [], []
            for lo in range(0, len(rows), 256):
                some = rows[lo : lo + 256]
                linked = vectors[some] @ vectors[columns].T >= threshold
                linked &= candidates(code[some], code[columns], t["tab"][0].as_py())
                if same:
                    linked &= some[:, None] != columns[None, :]
                n[some] += linked @ copies[columns]
                if not same:
                    n[columns] += copies[some] @ linked
                i, j = np.nonzero(linked)
                x, y = forest(node[some[i]], node[columns[j]])
                a += x
                b += y
            a, b = forest(np.array(a, np.int64), np.array(b, np.int64))
            has = np.flatnonzero(n)
            ends = [node[has], np.array(a, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(ends)),
                    pa.concat_arrays([pa.array(n[has]), pa.nulls(len(a), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(b, pa.int64())]),
                ],
                ["node", "n", "other"],
            )

    return dealt(cells, key).mapInArrow(run, "node bigint, n bigint, other bigint")


def code_column(spark, vector: Column, model: Rotation | None) -> Column:
    """The code as a signed 64-bit integer; null of vectors of another length than the model's."""

    def run(vectors: pa.Array) -> pa.Array:
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        lengths = np.diff(vectors.offsets.to_numpy())
        fit = lengths == (len(model.mean) if model else -1)
        out = np.zeros(len(lengths), np.int64)
        if fit.any():
            some = vectors.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False)
            out[fit] = model.codes(some.reshape(fit.sum(), -1)).view(np.int64)
        return pa.array(out, mask=~fit)

    run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")(vector)


def learn(distinct: DataFrame) -> Rotation | None:
    """From the vectors of the length that most have (of equally many the smallest); None if there are none."""
    width = distinct.groupBy("width").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "width").first()
    if width is None:
        return None
    sample = distinct.where(F.col("width") == width.width).orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).select("vector").collect()
    return Rotation.learnt(np.array([r.vector for r in sample], np.float64))


def links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """near() over all tables. distinct: node, label, width, vector, copies."""
    model = learn(distinct)
    coded = cut(distinct.select("node", "label", "width", code_column(distinct.sparkSession, F.col("vector"), model).alias("code")))
    cell = lambda t: F.struct(F.lit(t).alias("tab"), F.col("code").bitwiseAND(F.lit(_signed(table_mask(t)))).alias("cell"))
    alone = F.struct(F.lit(UNCODED).alias("tab"), F.lit(0).cast("bigint").alias("cell"))
    at = F.when(F.col("code").isNull(), F.array(alone)).otherwise(F.array(*[cell(t) for t in range(len(tables()))]))
    cells = coded.select("node", "label", "width", F.coalesce("code", F.lit(0).cast("bigint")).alias("code"), F.explode(at).alias("at"))
    cells = cells.select("node", "label", "width", "code", "at.tab", "at.cell")
    met = with_candidates(cells).distinct()
    own = coded.select("node", F.coalesce("code", F.lit(0).cast("bigint")).alias("code")).join(distinct.select("node", "copies", "vector"), "node")
    return cut(near(met.join(own, "node"), threshold))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of the table: id_col, n_links, component_id, kept."""
    vector = F.col(vec_col)
    links_at_all = F.col(label_col).isNotNull() & usable(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    # equal vectors have equal digests: two hashes of 64 bits
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"), links_at_all.alias("ok"))
    keys = {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector", F.size("vector"))}
    rows = rows.withColumns(keys)
    distinct = rows.where("ok").groupBy("label", "h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("first"))
    distinct = cut(distinct.withColumns({"node": F.monotonically_increasing_id(), "width": F.size("vector")}))
    found = links(distinct, threshold)
    n = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    reach = connected_components(found.where("other is not null"), "node", "other")
    first = distinct.select("node", "first")
    name = reach.join(first, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    named = reach.join(name, "component").select("node", "component_id")
    out = distinct.select("node", "label", "h1", "h2", "copies", "first").join(n, "node", "left").join(named, "node", "left")
    out = cut(out.select("label", "h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")))
    # rows of a common vector stay where they are; what is left has no large group for the join by vector
    total = out.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") > max(COMMON_ROWS, total // COMMON_SHARE)
    same = ["label", "h1", "h2"]
    few = out.where(common).select(*same, F.col("n_links").alias("n_c"), F.col("component_id").alias("c_c"), F.lit(True).alias("common"))
    here = rows.where("ok").select("id", *same).join(F.broadcast(few), same, "left")  # fewer than COMMON_SHARE rows
    rare = here.where("common is null").select("id", *same).join(out.where(~common), same).select("id", "n_links", "component_id")
    both = rare.unionByName(here.where("common").select("id", F.col("n_c").alias("n_links"), F.col("c_c").alias("component_id")))
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    both = both.unionByName(alone)
    component = F.coalesce("component_id", "id")
    return both.select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
