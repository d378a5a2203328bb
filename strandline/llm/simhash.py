"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification, components.

Fingerprints are 64 bits, the majority of the XXH64 bits of a text's 4-word shingles. Two fingerprints link if they differ
in at most RADIUS bits. A fingerprint is embedded as the bit counts of its 32 two-bit segments; the Manhattan distance of
two embeddings never exceeds their Hamming distance. The segments form RADIUS + 3 groups, so that of a pair within the
radius at least three groups have equal counts: each choice of three groups is one grid, and its cells hold every such
pair. Within a cell, fingerprints are in order of their total bit counts, whose difference bounds the range; then the Manhattan
distance of the embeddings is checked as a lower bound, and the bits themselves only of pairs that it leaves. Counts are kept as
thermometer codes (0: 00, 1: 01, 2: 11), so that the Manhattan distance is the number of bits in which two codes differ. A pair
is reported by the first grid in which it meets, and a cell reports a spanning forest of its links only, so that large groups of
near copies don't become all their pairs.

Equal fingerprints are one vertex from the start. Cells of more than CELL_ROWS fingerprints are dealt out as pairs of
blocks, so that no task gets a whole large cell.

Null, empty and blank texts have fingerprint zero, which links like any other. Rows with equal ids are judged one by one; null ids
are no names of components; an empty table gives no rows. Of the input only the id and the text are read, so that further columns
can't clash with the results.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, text_column
from strandline.operators.graph import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Two-bit segments of each group, from the low bits on.
GROUPS = (5, 5, 5, 5, 4, 4, 4)
#: Fingerprints that a task compares with each other at most; larger cells are cut into blocks of about half as many.
CELL_ROWS = 2048
#: A fingerprint is common if it has more rows than this and than one in COMMON_SHARE of all; so there are fewer than COMMON_SHARE.
COMMON_ROWS = 1024
COMMON_SHARE = 10_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    if n == 1:
        shingles = [joined]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = lengths.cumsum() - 1
        starts = ends - lengths + 1
        shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = np.frombuffer(b"".join([digest(s, SEED) for s in shingles[i : i + 65536]]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    def work(texts):
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return text_column(text, "fp:bigint", lambda: work)["fp"]


def masks() -> list[int]:
    """The bits of each group's segments."""
    out, at = [], 0
    for n in GROUPS:
        out.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return out


@functools.cache
def grids() -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(len(GROUPS)), len(GROUPS) - RADIUS))


@functools.cache
def first_grid() -> np.ndarray:
    """For each set of groups with equal counts, as bits, the first grid made of such groups."""
    out = np.full(1 << len(GROUPS), 255, np.uint8)
    for equal in range(len(out)):
        out[equal] = next((i for i, g in enumerate(grids()) if all(equal >> k & 1 for k in g)), 255)
    return out


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, as thermometer codes of two bits each."""
    low, high = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (fp, F.shiftrightunsigned(fp, 1)))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def embeddings(fp: np.ndarray) -> np.ndarray:
    """The same of an array; two embeddings differ in as many bits as their Manhattan distance says."""
    even = np.uint64(0x5555555555555555)
    low, high = fp & even, fp >> np.uint64(1) & even
    return (low & high) << np.uint64(1) | low | high


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(grid: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal (grid, cell); the arrays are sorted by them. Indices of both ends."""
    order = np.lexsort((np.bitwise_count(fp), cell, grid))
    new = np.r_[True, (grid[order][1:] != grid[order][:-1]) | (cell[order][1:] != cell[order][:-1])]
    run = np.cumsum(new)
    f, g = fp[order], grid[order]
    e = embeddings(f)
    ones = np.bitwise_count(f).astype(np.int16)
    a_out, b_out = [], []
    at, shift = np.arange(len(f)), 1
    while True:
        at = at[at + shift < len(f)]
        near = at + shift
        # within a run, fingerprints are in order of their bit count: once too far, all later ones are
        at = at[(run[at] == run[near]) & (ones[near] - ones[at] <= RADIUS)]
        if not len(at):
            break
        near = at + shift
        differ = e[at] ^ e[near]
        close = np.flatnonzero(np.bitwise_count(differ) <= RADIUS)
        if len(close):
            close = close[np.bitwise_count(f[at[close]] ^ f[near[close]]) <= RADIUS]
            i, j, differ = at[close], near[close], differ[close]
            equal = sum((((differ & np.uint64(m)) == 0).astype(np.int64) << k) for k, m in enumerate(masks()))
            mine = first_grid()[equal] == g[i]
            a_out.append(i[mine])
            b_out.append(j[mine])
        shift += 1
    empty = np.zeros(0, np.int64)
    return (order[np.concatenate(a_out)], order[np.concatenate(b_out)]) if a_out else (empty, empty)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between values a and b."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept[0].append(x)
            kept[1].append(y)
    return kept


def _links_of(batches):
    """Arrow batches (grid, cell, fp), each cell's rows in a row, to links (src, dst)."""
    left: list[pa.RecordBatch] = []
    n = 0

    def flush(last: bool):
        nonlocal left, n
        t = pa.Table.from_batches(left)
        grid, cell = (t[c].to_numpy() for c in ("grid", "cell"))
        upto = len(grid)
        if not last:  # the last cell may go on in the next batch
            same = (grid != grid[-1]) | (cell != cell[-1])
            upto = int(np.flatnonzero(same)[-1]) + 1 if same.any() else 0
        fp = t["fp"].to_numpy().view(np.uint64)
        i, j = linked(grid[:upto], cell[:upto], fp[:upto])
        left = t.slice(upto).combine_chunks().to_batches()
        n = len(grid) - upto
        a, b = forest(fp[i].view(np.int64), fp[j].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    for batch in batches:
        left.append(batch)
        n += batch.num_rows
        if n >= 100_000:
            yield flush(False)
    if n:
        yield flush(True)


def near_links(prints: DataFrame) -> DataFrame:
    """Links (src, dst) whose components are those of all pairs within the radius. prints: distinct `fp`."""
    mask = [sum(masks()[k] for k in g) for g in grids()]
    # one exchange serves all three uses below, as each reads fp, and the plan knows that no column is null and needs no filter for it
    fp = F.coalesce("fp", F.lit(0).cast("bigint"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), embedding(F.col("fp")).bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(mask)]))
    rows = prints.select(fp.alias("fp")).select("fp", at.alias("at")).select("at.grid", "at.cell", "fp")
    rows = rows.repartition("grid", "cell")
    sizes = rows.groupBy("grid", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    heavy = sizes.where((F.col("n") > CELL_ROWS) & (F.col("low") < F.col("high"))).select("grid", "cell", "n")
    sized = rows.join(heavy, ["grid", "cell"], "left")  # an anti join would be moved below the exchange, which then had a twin
    small = sized.where("n is null").select("grid", "cell", "fp").sortWithinPartitions("grid", "cell")
    # two blocks meet in one task: block numbers i <= j; a row of block b goes to all (b, j) and (i, b)
    blocks = F.ceil(F.col("n") * 2 / CELL_ROWS).cast("int")
    large = sized.where("n is not null").select("grid", "cell", "fp", blocks.alias("of")).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    large = large.select("grid", "cell", "fp", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))
    large = large.repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j")
    schema = "src bigint, dst bigint"
    return small.mapInArrow(_links_of, schema).unionByName(large.select("grid", "cell", "fp", "i", "j").mapInArrow(_links_of_blocks, schema))


def _links_of_blocks(batches):
    """As _links_of, for the pairs of blocks of large cells: (grid, cell, i, j) is one run."""

    def keyed():
        for b in batches:
            if not b.num_rows:
                continue
            i, j = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j"))
            # a cell number of its own for each pair of blocks, so that adjacent runs stay apart
            mixed = (b["cell"].to_numpy() ^ (i << 32) ^ j * np.int64(0x9E3779B1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["grid"], pa.array(mixed), b["fp"]], ["grid", "cell", "fp"])

    yield from _links_of(keyed())


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, fp, component_id (smallest id that links lead to, the own one included), component (its
    smallest fingerprint, which tells components without or with equal ids apart)."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    first = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    links = cut(near_links(first.select("fp")).distinct())
    reach = connected_components(links, "src", "dst")  # node, component: the smallest node of it
    smallest = reach.join(first, reach["node"] == first["fp"]).groupBy("component").agg(F.min("first").alias("component_id"))
    named = reach.join(smallest, "component").select(F.col("node").alias("fp"), "component", "component_id")
    names = F.coalesce("component_id", "first").alias("component_id"), F.coalesce("component", "fp").alias("component")
    named = cut(first.join(named, "fp", "left").select("fp", "n", *names))
    # the rows of a common fingerprint stay where they are; what is left has no large group for the join by fingerprint
    total = first.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") > max(COMMON_ROWS, total // COMMON_SHARE)
    few = named.where(common).select("fp", F.col("component_id").alias("at"), F.col("component").alias("of"), F.lit(True).alias("found"))
    rows = prints.join(F.broadcast(few), "fp", "left")  # fewer than COMMON_SHARE rows
    out = [F.col("id").alias(id_col), "fp", "component_id", "component"]
    rare = rows.where("found is null").join(named.where(~common), "fp").select(*out)
    return rare.unionByName(rows.where("found").withColumn("component_id", F.col("at")).withColumn("component", F.col("of")).select(*out))
