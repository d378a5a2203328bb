"""Correlation clustering of site graphs: minimise repulsion inside clusters and edges between them.

The search runs in rounds of joins over all components and restarts at once; no component and no cluster is gathered. Balls around
pivots are the first clusters; balls with nearly the same members are one; nodes of several clusters stay in the one that
they fit best; pairs of clusters that are each other's best partner join; single nodes move, of neighbours that want to only the one
that gains most, so that gains add up. The best restart of each component is kept by a minimum.

A node belongs to one component. A search is told apart by (restart, node); equal seeds give equal results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import ranges_of
from strandline.operators import graph as H
from strandline.session import round_table


def cut_score(edges: DataFrame, members: DataFrame, penalty: float = 5.0) -> DataFrame:
    """(cut, internal_repulsion, leaving, score): repulsion inside, times penalty, plus edges that leave. edges: src, dst, sign;
    members: node, cut."""
    m = members.select("node", "cut")
    x = edges.join(m.select(F.col("node").alias("src"), F.col("cut").alias("a")), "src", "left")
    x = x.join(m.select(F.col("node").alias("dst"), F.col("cut").alias("b")), "dst", "left")
    inside = x.where("a = b and sign < 0").groupBy(F.col("a").alias("cut")).agg(F.count("*").alias("internal_repulsion"))
    out = x.where("sign > 0 and (a is null or b is null or a <> b)")
    ends = out.select(F.explode(F.array_compact(F.array("a", "b"))).alias("cut"))
    leaving = ends.groupBy("cut").agg(F.count("*").alias("leaving"))
    all_ = m.select("cut").distinct().join(inside, "cut", "left").join(leaving, "cut", "left").na.fill(0)
    return all_.withColumn("score", penalty * F.col("internal_repulsion") + F.col("leaving"))


def _ways(edges: DataFrame) -> DataFrame:
    """(a, b, sign), both ways."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "sign").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "sign"))


def _cost(penalty: float) -> Column:
    """What an edge into a cluster adds to the total score if its end joins: repulsion counts, an edge leaves no longer on both sides."""
    return F.when(F.col("sign") < 0, F.lit(float(penalty))).otherwise(F.lit(-2.0))


def alike(edges: DataFrame, least: int) -> DataFrame:
    """(a, b), both ways, of attracting edges whose ends have at least `least` common neighbours."""
    plus = edges.where("sign > 0").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    if least > 0:
        plus = H.common_neighbours(round_table(plus)).where(F.col("common") >= least)
    return H.both_ways(plus.select("src", "dst"))


def pivots(nodes: DataFrame, near: DataFrame, seed: int) -> DataFrame:
    """(restart, node) of nodes without a pivot among their neighbours, as many as go: in each round the nodes that come before all their
    undecided neighbours in a random order become pivots, and their neighbours go. The rounds grow with the logarithm of the nodes.
    nodes: restart, node; near: a, b, both ways."""
    left = round_table(nodes.select("restart", "node", F.xxhash64(F.lit(seed), "restart", "node").alias("place")))
    found = None
    while not left.isEmpty():
        other = left.select("restart", F.col("node").alias("b"), F.struct("place", F.col("node").alias("n")).alias("o"))
        first = left.join(near, left["node"] == near["a"]).join(other, ["restart", "b"]).groupBy("restart", "node").agg(F.min("o").alias("o"))
        new = left.join(first, ["restart", "node"], "left").where(F.col("o").isNull() | (F.struct("place", F.col("node").alias("n")) < F.col("o")))
        new = round_table(new.select("restart", "node"))
        gone = new.join(near, new["node"] == near["a"]).select("restart", F.col("b").alias("node")).unionByName(new).distinct()
        left = round_table(left.join(gone, ["restart", "node"], "left_anti"))
        found = new if found is None else found.unionByName(new)
    return nodes.select("restart", "node").limit(0) if found is None else found


def balls(centres: DataFrame, near: DataFrame) -> DataFrame:
    """(restart, cut, node): each centre, which names the cluster, and its neighbours."""
    own = centres.select("restart", F.col("node").alias("cut"), "node")
    return own.unionByName(centres.join(near, centres["node"] == near["a"]).select("restart", F.col("node").alias("cut"), F.col("b").alias("node")))


def merge_reciprocal(members: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Clusters of which two have more than a share of both in common are one, and so are chains of such. members: restart, cut, node.

    Two such clusters have a common node among the 1 - ratio of each that the fewest clusters have; only over these are pairs made, so
    that a node of very many clusters isn't one that they meet at."""
    m = round_table(members.distinct())
    n = m.groupBy("restart", "cut").agg(F.count("*").alias("n"))
    often = m.groupBy("restart", "node").agg(F.count("*").alias("often"))
    by = m.join(often, ["restart", "node"]).groupBy("restart", "cut").agg(F.array_sort(F.collect_list(F.struct("often", "node"))).alias("by"), F.count("*").alias("n"))
    most = F.floor((1 - ratio) * F.col("n")).cast("int") + 1
    rare = by.select("restart", "cut", F.explode(F.slice("by", 1, most)).alias("r")).select("restart", "cut", F.col("r.node").alias("node"))
    other = rare.select("restart", F.col("cut").alias("with"), "node")
    pairs = rare.join(other, ["restart", "node"]).where(F.col("cut") < F.col("with")).select("restart", "cut", "with").distinct()
    common = pairs.join(m, ["restart", "cut"]).join(m.select("restart", F.col("cut").alias("with"), "node"), ["restart", "with", "node"])
    common = common.groupBy("restart", "cut", "with").agg(F.count("*").alias("c"))
    sized = common.join(n, ["restart", "cut"]).join(n.select("restart", F.col("cut").alias("with"), F.col("n").alias("o")), ["restart", "with"])
    one = sized.where((F.col("c") > ratio * F.col("n")) & (F.col("c") > ratio * F.col("o")))
    at = lambda c: F.struct("restart", F.col(c).alias("cut"))
    to = H.connected_components(one.select(at("cut").alias("src"), at("with").alias("dst")))
    to = to.select(F.col("node.restart").alias("restart"), F.col("node.cut").alias("cut"), F.col("component.cut").alias("to"))
    return m.join(to, ["restart", "cut"], "left").select("restart", F.coalesce("to", "cut").alias("cut"), "node").distinct()


def gains(ways: DataFrame, members: DataFrame, penalty: float) -> DataFrame:
    """(restart, node, cut, cost) of nodes and the clusters of their neighbours: what the total score gets if the node joins."""
    m = members.select("restart", "cut", F.col("node").alias("b"))
    x = ways.join(m, "b").groupBy("restart", F.col("a").alias("node"), "cut")
    return x.agg(F.sum(_cost(penalty)).alias("cost"))


def unique_members(edges: DataFrame, members: DataFrame, penalty: float = 5.0) -> DataFrame:
    """Nodes of several clusters stay in the one where they cost least, of equals the smallest. members: restart, cut, node."""
    cost = gains(_ways(edges), members, penalty)
    x = members.join(cost, ["restart", "node", "cut"], "left")
    best = F.min(F.struct(F.coalesce("cost", F.lit(0.0)).alias("c"), "cut")).alias("b")
    return x.groupBy("restart", "node").agg(best).select("restart", F.col("b.cut").alias("cut"), "node")


def without_torn(edges: DataFrame, members: DataFrame, cutoff: int) -> DataFrame:
    """Members without the nodes that have more than `cutoff` attracting neighbours in each cluster that they have any in, if these are
    several. members: cut, node, one cluster for each node."""
    near = _ways(edges.where("sign > 0")).join(members.select("cut", F.col("node").alias("b")), "b").groupBy(F.col("a").alias("node"), "cut").agg(F.count("*").alias("n"))
    torn = near.groupBy("node").agg(F.count("*").alias("k"), F.min("n").alias("n")).where((F.col("k") > 1) & (F.col("n") > cutoff))
    return members.join(torn.select("node"), "node", "left_anti").select(members.columns)


def expansion_delta(edges: DataFrame, members: DataFrame, more: DataFrame, penalty: float = 5.0) -> DataFrame:
    """(cut, delta): change of each cluster's own score if the nodes of `more` (cut, node), which are outside, join it: their edges to the
    rest, and new repulsion times penalty, less their edges into the cluster and among themselves."""
    kind = members.select("cut", F.col("node").alias("b"), F.lit("in").alias("kind")).unionByName(more.select("cut", F.col("node").alias("b"), F.lit("new").alias("kind")))
    x = more.select("cut", F.col("node").alias("a")).join(_ways(edges), "a").join(kind, ["cut", "b"], "left")
    plus = F.when(F.col("kind").isNull(), 1.0).otherwise(-1.0)  # an edge among new nodes is there from both ends, as its two ends are
    return x.groupBy("cut").agg(F.sum(F.when(F.col("sign") > 0, plus).when(F.col("kind") == "in", float(penalty)).otherwise(0.0)).alias("delta"))


def merge_best(edges: DataFrame, members: DataFrame, penalty: float) -> DataFrame:
    """Pairs of clusters that lower the score by joining, and each other's best partner, join, round by round, until no pair does. The
    rounds work on one row for each pair of clusters with an edge between. members: restart, cut, node, one cluster for each node."""
    m = members.select("restart", "cut", "node")
    side = lambda n, c: m.select("restart", F.col("cut").alias(c), F.col("node").alias(n))
    x = edges.select("src", "dst", "sign").join(side("src", "x"), "src").join(side("dst", "y"), ["restart", "dst"]).where("x <> y")
    between = x.groupBy("restart", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.sum(_cost(penalty)).alias("delta"))
    between = round_table(between)
    name = m.select("restart", F.col("cut").alias("was"), "cut").distinct()
    while True:
        one = F.struct("delta", "lo", "hi").alias("p")
        good = between.where("delta < 0")
        ends = good.select("restart", F.col("lo").alias("at"), one).unionByName(good.select("restart", F.col("hi").alias("at"), one))
        best = ends.groupBy("restart", "at").agg(F.min("p").alias("p"))
        joined = round_table(best.groupBy("restart", "p").agg(F.count("*").alias("n")).where("n = 2").select("restart", "p.lo", "p.hi"))
        if joined.isEmpty():
            break
        to = joined.select("restart", F.col("hi").alias("cut"), F.col("lo").alias("to"))
        move = lambda d, c: d.join(to.withColumnRenamed("cut", c), ["restart", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        name = round_table(move(name, "cut"))
        moved = move(move(between, "lo"), "hi").where("lo <> hi")
        between = round_table(moved.groupBy("restart", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.sum("delta").alias("delta")))
    return m.withColumnRenamed("cut", "was").join(name, ["restart", "was"]).select("restart", "cut", "node")


def move_nodes(edges: DataFrame, members: DataFrame, near: DataFrame, penalty: float, rounds: int, min_gain: float) -> DataFrame:
    """Nodes move to the cluster of a neighbour (a, b of near) where they cost least, for a gain over min_gain; of neighbours that would
    move in one round only the one that gains most does, so that the score falls by the sum of the gains."""
    ways = round_table(_ways(edges))
    m = round_table(members.select("restart", "cut", "node"))
    for _ in range(rounds):
        cost = round_table(gains(ways, m, penalty))
        here = m.withColumnRenamed("cut", "own").join(cost.withColumnRenamed("cut", "own").withColumnRenamed("cost", "now"), ["restart", "node", "own"], "left")
        here = here.select("restart", "node", "own", F.coalesce("now", F.lit(0.0)).alias("now"))
        fits = near.join(m.withColumnRenamed("node", "b"), "b").select("restart", F.col("a").alias("node"), "cut").distinct()
        x = cost.join(fits, ["restart", "node", "cut"]).groupBy("restart", "node").agg(F.min(F.struct("cost", "cut")).alias("to")).join(here, ["restart", "node"])
        wish = x.select("restart", "node", F.col("to.cut").alias("cut"), (F.col("now") - F.col("to.cost")).alias("gain"), "own").where((F.col("gain") > min_gain) & (F.col("cut") != F.col("own")))
        wish = round_table(wish.select("restart", "node", "cut", "gain"))
        if wish.isEmpty():
            break
        rival = wish.select("restart", F.col("node").alias("b"), F.struct((-F.col("gain")).alias("g"), "node").alias("r"))
        first = wish.join(ways, wish["node"] == ways["a"]).join(rival, ["restart", "b"]).groupBy("restart", "node").agg(F.min("r").alias("r"))
        goes = wish.join(first, ["restart", "node"], "left").where(F.col("r").isNull() | (F.struct((-F.col("gain")).alias("g"), "node") < F.col("r")))
        m = round_table(m.join(goes.select("restart", "node", F.col("cut").alias("to")), ["restart", "node"], "left").select("restart", F.coalesce("to", "cut").alias("cut"), "node"))
    return m


def total_scores(edges: DataFrame, members: DataFrame, penalty: float) -> DataFrame:
    """(component, restart, score): twice the edges between clusters, plus repulsion inside times penalty. edges: component, src, dst, sign."""
    side = lambda n, c: members.select("restart", F.col("cut").alias(c), F.col("node").alias(n))
    x = edges.join(side("src", "x"), "src").join(side("dst", "y"), ["restart", "dst"])
    one = F.when((F.col("sign") > 0) & (F.col("x") != F.col("y")), 2.0).when((F.col("sign") < 0) & (F.col("x") == F.col("y")), float(penalty)).otherwise(0.0)
    return x.groupBy("component", "restart").agg(F.sum(one).alias("score"))


def correlation_clusters(
    edges: DataFrame, restarts: int = 10, penalty: float = 5.0, min_common: int = 3, min_size: int = 4, min_span: int = 0, swap_rounds: int = 20, seed: int = 1,
    overlap: float = 0.75, min_gain: float = 10.0, min_similar: int = 3, torn: int | None = None,
) -> DataFrame:
    """(component, cut, node, score) of the best of some restarts in each component. edges: component, src, dst, sign (1 or -1). `cut` is a
    cluster's smallest node.

    Balls hold neighbours with min_common common neighbours; balls that have more than `overlap` of each other in common are merged, nodes
    get one cluster each, clusters are joined as long as that lowers the score; then single nodes move, for a gain over min_gain, to a
    cluster with a neighbour that has min_similar neighbours in common with them. Clusters of fewer than min_size nodes or a span under
    min_span are dropped, and with `torn` the nodes with more neighbours than that in each of several clusters."""
    e = round_table(edges.select("component", "src", "dst", "sign").where("src <> dst").distinct())
    near = round_table(alike(e, min_common))
    nodes = e.select("component", F.explode(F.array("src", "dst")).alias("node")).distinct()
    tries = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
    m = merge_reciprocal(balls(pivots(tries, near, seed), near), overlap)
    m = round_table(unique_members(e, round_table(m), penalty))
    m = round_table(merge_best(e, m, penalty))
    m = move_nodes(e, m, near if min_similar == min_common else round_table(alike(e, min_similar)), penalty, swap_rounds, min_gain)
    best = round_table(total_scores(e, m, penalty)).groupBy("component").agg(F.min(F.struct("score", "restart")).alias("b"))
    kept = m.join(nodes, "node").join(best, "component").where("restart = b.restart").select("component", "cut", "node", F.col("b.score").alias("score"))
    if torn is not None:
        kept = without_torn(e, round_table(kept), torn)
    enough = kept.groupBy("component", "cut").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"))
    enough = enough.where((F.col("n") >= min_size) & (F.col("last") - F.col("first") >= min_span)).select("component", "cut", "first")
    return kept.join(enough, ["component", "cut"]).select("component", F.col("first").alias("cut"), "node", "score")


def clustered_sites(clusters: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a clustering is written as: (cut, sites, n), the sites of each cluster in one row, in order; and the graph of sites, as
    (node, color, degree), where those of no cluster have no colour. clusters: cut, node; edges: src, dst."""
    sites = clusters.groupBy("cut").agg(F.array_sort(F.collect_list("node")).alias("sites"), F.count("*").alias("n"))
    graph = H.colored(H.degrees(edges).select("node", "degree"), clusters.select("node", "cut"))
    return sites, graph.select("node", "color", "degree")


#: Letters of the first texts of the pairs that are aligned together, and by how much their lengths may differ.
LANES, SPREAD = 1 << 15, 1.4


def _together(sizes: list[tuple[int, int]], alone: bool) -> list[list[int]]:
    """Numbers of pairs in lots of similar lengths on both sides."""
    step = lambda n: round(np.log(n + 16) / np.log(SPREAD))
    lots: list[list[int]] = []
    key, room = None, 0
    for k in sorted(range(len(sizes)), key=lambda k: (step(sizes[k][0]), step(sizes[k][1]))):
        m = sizes[k][0] + 1
        now = step(sizes[k][0]), step(sizes[k][1])
        if alone or now != key or m > room:
            lots.append([])
            key, room = now, LANES
        lots[-1].append(k)
        room -= m
    return lots


def _aligned(pairs: list[tuple[bytes, bytes]], match: int, mismatch: int, gap: int) -> list[tuple[int, int, int]]:
    """(score, end_a, end_b) of each pair, the first row of the best score and its first column. All pairs go through their tables at once, one
    diagonal after the other; rows of an array are letters of a, columns pairs. Bytes 254 and 255, which no text has, fill up."""
    m, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    out = [(0, 0, 0)] * len(pairs)
    if not m or not n:
        return out
    most = max(abs(match), abs(mismatch), abs(gap), abs(match - mismatch))
    small = most <= 256 and most * (min(m, n) + 2) < 1 << 15
    kind = np.int16 if small else np.int64
    # different letters differ by at least the step between a match and a mismatch
    step, shift = match - mismatch, max(abs(match - mismatch), 1).bit_length()
    x, y = np.full((m, len(pairs)), 254, np.int64), np.full((n, len(pairs)), 255, np.int64)
    for k, (a, b) in enumerate(pairs):
        x[: len(a), k] = np.frombuffer(a, np.uint8)
        y[n - len(b) :, k] = np.frombuffer(b, np.uint8)[::-1]
    small = small and step >= 0 and shift <= 7
    x, y = (x << shift, y << shift) if step >= 0 else (x, y)
    x, y, kind = (x.astype(np.int16), y.astype(np.int16), kind) if small else (x, y, np.int64)
    h = [np.zeros((m + 1, len(pairs)), kind) for _ in range(3)]
    best, when = np.zeros((m + 1, len(pairs)), kind), np.zeros((m + 1, len(pairs)), np.int32)
    t, u, over = np.empty((m, len(pairs)), kind), np.empty((m, len(pairs)), kind), np.empty((m, len(pairs)), bool)
    # arrays, as numpy compares two of them faster than one with a number
    none, steps = np.zeros((m, len(pairs)), kind), np.full((m, len(pairs)), step, kind)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        w = hi - lo + 1
        two, one, new = h[(d - 2) % 3], h[(d - 1) % 3], h[d % 3]
        s, g = t[:w], u[:w]
        np.bitwise_xor(x[lo - 1 : hi], y[n - d + lo : n - d + hi + 1], out=s)
        if step >= 0:
            np.minimum(s, steps[:w], out=s)
        else:
            np.multiply(s != 0, step, out=s)
        np.subtract(two[lo - 1 : hi], s, out=s)
        np.add(s, match, out=s)
        np.maximum(one[lo - 1 : hi], one[lo : hi + 1], out=g)
        np.add(g, gap, out=g)
        np.maximum(s, g, out=s)
        np.maximum(s, none[:w], out=new[lo : hi + 1])
        np.greater(new[lo : hi + 1], best[lo : hi + 1], out=over[:w])
        np.maximum(new[lo : hi + 1], best[lo : hi + 1], out=best[lo : hi + 1])
        np.putmask(when[lo : hi + 1], over[:w], d)
    row = best.argmax(axis=0)
    return [(int(best[i, k]), int(i), int(when[i, k] - i)) if best[i, k] > 0 else (0, 0, 0) for k, i in enumerate(row)]


def smith_waterman(pairs: DataFrame, match: int = 1, mismatch: int = -1, gap: int = -1) -> DataFrame:
    """(id, score, end_a, end_b) of the best local alignment of columns a and b; linear gap costs. Pairs of similar lengths go through numpy
    together, diagonal by diagonal, so that memory grows with the lengths only."""

    def work(frames):
        for f in frames:
            texts = [((a or "").encode(), (b or "").encode()) for a, b in zip(f["a"], f["b"], strict=True)]
            got = [(0, 0, 0)] * len(texts)
            # what fills up must not raise a score
            for lot in _together([(len(a), len(b)) for a, b in texts], alone=max(mismatch, gap) > 0):
                for k, g in zip(lot, _aligned([texts[k] for k in lot], match, mismatch, gap), strict=True):
                    got[k] = g
            yield pd.DataFrame({"id": f["id"], "score": [g[0] for g in got], "end_a": [g[1] for g in got], "end_b": [g[2] for g in got]})

    # a few texts are hours of work, but one small partition
    dealt = pairs.select("id", "a", "b").repartition(ranges_of(pairs.sparkSession), "id")
    return dealt.mapInPandas(work, "id bigint, score bigint, end_a bigint, end_b bigint")


def traceback(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[str, str, int]:
    """The letters of both texts in the best local alignment, and its score; on the way back a gap in a goes before one in b, and these before
    a pair."""
    h = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, c in enumerate(a, 1):
        for j, d in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if c == d else mismatch), h[i - 1, j] + gap, h[i, j - 1] + gap)
    i, j = (int(k) for k in np.unravel_index(h.argmax(), h.shape))
    best, i_end, j_end = int(h[i, j]), i, j
    while h[i, j] > 0:
        if h[i, j] == h[i, j - 1] + gap:
            j -= 1
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
        else:
            i, j = i - 1, j - 1
    return a[i:i_end], b[j:j_end], best


def local_alignments(pairs: DataFrame) -> DataFrame:
    """(id, part_a, part_b, score) of columns a and b, by traceback; nulls count as empty. Memory grows with the product of the lengths."""

    def work(frames):
        for f in frames:
            got = [traceback(x or "", y or "") for x, y in zip(f["a"], f["b"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "part_a": [g[0] for g in got], "part_b": [g[1] for g in got], "score": [g[2] for g in got]})

    return pairs.select("id", "a", "b").mapInPandas(work, "id bigint, part_a string, part_b string, score bigint")
