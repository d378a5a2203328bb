"""Whole-graph algorithms in rounds of joins: spanning forests, contraction along triangles, parts of equal size, cliques.

Nothing is gathered but the neighbours that follow a node in an order in which few do; components of any size are many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import graph as H
from strandline.session import round_table


def _jumped(up: DataFrame) -> DataFrame:
    """(node, to) with every node at its root, whose `to` is itself. Each round leads on four steps of what the one before found, of which the
    last shows who has arrived."""
    up = round_table(up)
    while True:
        on = up
        for _ in range(3):
            on = on.join(up.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"), F.col("to").alias("was"))
        on = round_table(on)
        up = on.select("node", "to")
        if on.where("to <> was").isEmpty():
            return up


def _renamed(df: DataFrame, to: DataFrame, *names: str) -> DataFrame:
    """Columns of nodes become what `to` (node, to) says; others stay."""
    for c in names:
        df = df.join(to.select(F.col("node").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return df


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(component, src, dst, weight): the heaviest spanning tree of each component; of equal weights the smaller ends go first. edges:
    component, src, dst, weight.

    In each round every tree takes its heaviest leaving edge, and trees that these join are one; there are at most half as many after
    it. Of parallel edges between two trees one is left."""
    e = edges.select("component", "src", "dst", "weight").where("src <> dst").distinct()
    e = round_table(e.select("component", F.col("src").alias("a"), F.col("dst").alias("b"), F.struct((-F.col("weight")).alias("w"), "src", "dst").alias("k")))
    found = None
    while not e.isEmpty():
        ends = e.select("component", F.col("a").alias("node"), F.struct("k", F.col("b").alias("to")).alias("p"))
        ends = ends.unionByName(e.select("component", F.col("b").alias("node"), F.struct("k", F.col("a").alias("to")).alias("p")))
        best = round_table(ends.groupBy("component", "node").agg(F.min("p").alias("p")).select("component", "node", "p.k", "p.to"))
        new = best.select("component", "k.src", "k.dst", (-F.col("k.w")).alias("weight")).distinct()
        found = new if found is None else found.unionByName(new)
        # the order of edges is strict, so that only two trees that choose each other make a circle; the smaller one is the root
        back = best.select(F.col("node").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
        e = _renamed(e, _jumped(up), "a", "b").where("a <> b")
        e = round_table(e.groupBy("component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("k").alias("k")))
    return edges.select("component", "src", "dst", "weight").limit(0) if found is None else found


def condense_triangles(edges: DataFrame, triangles: DataFrame, max_nodes: int, max_edges: int = 1 << 62) -> DataFrame:
    """(component, node, root): nodes of each component joined along its triangles until it has at most max_nodes nodes and max_edges edges,
    or no triangle is left. edges: component, src, dst, cost; triangles: i, j, k, missing.

    Triangles are in order of missing neighbours, those of equally many in random order, so that rounds are few. In each round those that come first at all three of their corners contract
    at once, in a component with too many nodes only as many, in order, as bring it to max_nodes; corners become the smallest of them,
    parallel edges one. A triangle whose corners aren't three nodes any more is gone."""
    e = edges.select("component", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    e = round_table(e)
    at = round_table(e.select("component", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node")))
    of = at.select("component", F.col("node").alias("a"))
    tri = triangles.select(F.struct("missing", F.xxhash64("i", "j", "k").alias("place"), "i", "j", "k").alias("key"), F.col("i").alias("a"), F.col("j").alias("b"), F.col("k").alias("c")).join(of, "a")
    tri, edges_count = round_table(tri), max_edges < 1 << 62
    while True:
        n = at.where("node = root").groupBy("component").agg(F.count("*").alias("n"))
        n = n.join(e.groupBy("component").agg(F.count("*").alias("m")), "component", "left") if edges_count else n.withColumn("m", F.lit(0))
        large = n.where((F.col("n") > max_nodes) | (F.col("m") > max_edges))
        need = F.when(F.coalesce("m", F.lit(0)) > max_edges, F.col("n")).otherwise(F.ceil((F.col("n") - max_nodes) / 2))
        own = tri.join(large.select("component", need.alias("need")), "component")
        first = own.select(F.explode(F.array("a", "b", "c")).alias("at"), "key").groupBy("at").agg(F.min("key").alias("key"))
        ready = own.select("component", "need", "key", "a", "b", "c", F.explode(F.array("a", "b", "c")).alias("at")).join(first, ["at", "key"])
        ready = round_table(ready.groupBy("component", "need", "key", "a", "b", "c").agg(F.count("*").alias("k")).where("k = 3"))
        if ready.isEmpty():
            return at
        goes = ready
        if ready.groupBy("component").agg((F.count("*") > F.max("need")).alias("over")).where("over").count():
            goes = _placed(ready, ["component"], [F.col("key")], "place").where("place < need")
        to = goes.select(F.explode(F.array("a", "b", "c")).alias("node"), F.least("a", "b", "c").alias("to")).where("node <> to")
        at = round_table(_renamed(at, to, "root").select("component", "node", "root"))
        if edges_count:
            e = _renamed(e, to, "src", "dst").where("src <> dst")
            e = round_table(e.select("component", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        tri = round_table(_renamed(tri, to, "a", "b", "c").where("a <> b and b <> c and a <> c"))


def condensed_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, cost) of edges between joined nodes, whose costs add up. roots: node, root."""
    to = roots.select("node", F.col("root").alias("to"))
    x = _renamed(edges.select("src", "dst", "cost"), to, "src", "dst").where("src <> dst")
    return x.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("cost").alias("cost"))


def _placed(df: DataFrame, by: list[str], order: list, name: str, of: str = "_of") -> DataFrame:
    """Adds each row's place among those of equal `by`, from 0 on, and as `of` their number. Rows are dealt into ranges and numbered within
    range and group; what a group has in the ranges before, one row for each, is added."""
    x = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_p", F.spark_partition_id())
    # ranges come from a sample, so that they must not be drawn again for their sizes
    x = round_table(x.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1))
    group = Window.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = x.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*by, "_p", F.coalesce(before, F.lit(0)).alias("_s"), F.sum("_n").over(group).alias(of))
    return x.join(sizes, [*by, "_p"]).select(*df.columns, (F.col("_s") + F.col("_k")).alias(name), of)


def _cut_weight(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, score): the weights within parts less those between, both ways."""
    side = lambda n, p: parts.select(F.col("node").alias(n), F.col("part").alias(p))
    x = edges.join(side("src", "p"), "src").join(side("dst", "q"), "dst")
    return x.groupBy("component").agg((2 * F.sum(F.when(F.col("p") == F.col("q"), F.col("weight")).otherwise(-F.col("weight")))).cast("double").alias("score"))


def _leaning(ways: DataFrame, at: DataFrame) -> DataFrame:
    """(component, node, p, q, gain, least): nodes that another part q pulls more than their own one p; `least` is what rounding may add up to."""
    pull = ways.join(at.select(F.col("node").alias("b"), "part"), "b").groupBy("component", "node", "part").agg(F.sum("weight").alias("w"), F.sum(F.abs("weight")).alias("a"))
    best = pull.join(at.select("node", F.col("part").alias("p")), "node").groupBy("component", "node", "p")
    x = best.agg(F.min(F.struct((-F.col("w")).alias("w"), "part")).alias("to"), F.max(F.when(F.col("part") == F.col("p"), F.col("w"))).alias("now"), F.sum("a").alias("a"))
    x = x.where("to.part <> p").select("component", "node", "p", F.col("to.part").alias("q"), (-F.col("to.w") - F.coalesce("now", F.lit(0.0))).alias("gain"), (1e-12 * F.col("a")).alias("least"))
    return x.where("gain > least")


def _exchanged(edges: DataFrame, x: DataFrame, parts: int) -> DataFrame:
    """(node, to): pairs of equal place that want each other's part, of which each gains whatever those before it do. An edge whose ends both move
    changes the sum of their gains; a pair bears what the edges within it and to the pairs before it take away. x: what _leaning gives, with place."""
    mate = x.select("component", F.col("p").alias("q"), F.col("q").alias("p"), "place", F.col("gain").alias("g"), F.col("least").alias("l"))
    pair = (F.col("place") * parts + F.least("p", "q")) * parts + F.greatest("p", "q")
    x = x.join(mate, ["component", "p", "q", "place"])
    x = round_table(x.select("component", "node", "p", "q", pair.alias("pair"), (F.col("gain") + F.col("g")).alias("gain"), (F.col("least") + F.col("l")).alias("least")))
    side = lambda n, *names: x.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("p", "q", "pair")])
    same = lambda a, b: (F.col(f"src_{a}") == F.col(f"dst_{b}")).cast("int")
    inner = edges.join(side("src"), "src").join(side("dst"), "dst")
    inner = round_table(inner.select("component", "src_pair", "dst_pair", (F.col("weight") * (same("q", "q") - same("q", "p") - same("p", "q") + same("p", "p"))).alias("change")).where("change <> 0"))
    own = inner.where("src_pair = dst_pair").groupBy("component", F.col("src_pair").alias("pair")).agg(F.sum("change").alias("own"))
    good = x.where("p < q").join(own, ["component", "pair"], "left").select("component", "pair", (F.col("gain") + F.coalesce("own", F.lit(0.0))).alias("gain"), "least").where("gain > least")
    cost = inner.where("src_pair <> dst_pair and change < 0")
    for n in ("src_pair", "dst_pair"):
        cost = cost.join(good.select("component", F.col("pair").alias(n)), ["component", n], "left_semi")
    cost = cost.groupBy("component", F.greatest("src_pair", "dst_pair").alias("pair")).agg(F.sum("change").alias("cost"))
    kept = good.join(cost, ["component", "pair"], "left").where(F.col("gain") + F.coalesce("cost", F.lit(0.0)) > F.col("least"))
    return x.join(kept.select("component", "pair"), ["component", "pair"], "left_semi").select("node", F.col("q").alias("to"))


def _last_exchange(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(node, to): one exchange of each component in which any two nodes that want each other's part gain by it, whatever their places."""
    x = x.select("component", "node", "p", "q", "place", "gain", "least")
    up, down = (x.where(w).select("component", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), *[F.col(c).alias(f"{n}_{c}") for c in ("node", "place", "gain", "least")]) for n, w in (("u", "p < q"), ("d", "p > q")))
    group = ["component", "lo", "hi"]
    between = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("w"))
    ends = between.select(F.inline(F.array(F.struct(F.col("src").alias("u_node"), F.col("dst").alias("d_node"), "w"), F.struct(F.col("dst").alias("u_node"), F.col("src").alias("d_node"), "w"))))
    tied = ends.join(up, "u_node").join(down, [*group, "d_node"]).where(F.col("u_gain") + F.col("d_gain") - 2 * F.col("w") <= F.col("u_least") + F.col("d_least")).select(*group, "u_node", "d_node")
    # a node that isn't tied to all that want its part has a partner, the first of those that it isn't tied to
    many, held = down.groupBy(group).agg(F.count("*").alias("many")), tied.groupBy(*group, "u_node").agg(F.count("*").alias("held"))
    free = up.join(many, group).join(held, [*group, "u_node"], "left").where(F.coalesce("held", F.lit(0)) < F.col("many"))
    one = free.groupBy("component").agg(F.min(F.struct("lo", "hi", "u_place", "u_node")).alias("o")).select("component", "o.lo", "o.hi", "o.u_node")
    mate = one.join(down, group).join(tied, [*group, "u_node", "d_node"], "left_anti").groupBy(*group, "u_node").agg(F.min(F.struct("d_place", "d_node"))["d_node"].alias("d_node"))
    return mate.select(F.inline(F.array(F.struct(F.col("u_node").alias("node"), F.col("hi").alias("to")), F.struct(F.col("d_node").alias("node"), F.col("lo").alias("to")))))


def partition_graph(edges: DataFrame, parts: int, rounds: int | None = None, seed: int = 1) -> DataFrame:
    """(component, node, part, score): nodes of each component dealt into `parts` parts, whose sizes differ by one at most, at random; then
    nodes of two parts that each lean to the other one's change places, until no two such nodes are left whose exchange would raise the score (or for
    so many rounds): the weights within parts less those between, both ways. edges: component, src, dst, weight.

    Nodes that want from one part to another are placed by their gain and change with the one of equal place that wants the other way, so
    that sizes stay. Nodes of one round don't see each other move: a pair moves only if it gains whatever the pairs before it do, so that each round
    raises the score. Where no pair of equal place does, any two nodes that do change places, or the component is done."""
    e = round_table(edges.select("component", "src", "dst", "weight").where("src <> dst"))
    nodes = e.select("component", F.explode(F.array("src", "dst")).alias("node")).distinct()
    dealt = _placed(nodes, ["component"], [F.xxhash64(F.lit(seed), "node"), F.col("node")], "place")
    at = round_table(dealt.select("component", "node", F.pmod("place", F.lit(parts)).cast("int").alias("part")))
    ends = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("b"))
    ways = e.select("component", "weight", F.inline(F.array(ends("src", "dst"), ends("dst", "src"))))
    k = 0
    while rounds is None or k < rounds:
        x = _placed(_leaning(ways, at), ["component", "p", "q"], [F.desc("gain"), F.xxhash64(F.lit(seed), F.lit(k), "node"), F.col("node")], "place")
        moves = round_table(_exchanged(e, x, parts))
        if moves.isEmpty():
            moves = round_table(_last_exchange(e, x))
            if moves.isEmpty():
                break
        at = round_table(at.join(moves, "node", "left").select("component", "node", F.coalesce("to", "part").alias("part")))
        k += 1
    return at.join(_cut_weight(e, at), "component").select("component", "node", "part", "score")


def peeling(edges: DataFrame, slack: float = 0.5) -> DataFrame:
    """(node, layer): in each round the nodes with at most 1 + slack times the mean degree of what is left go. At least a share of
    slack / (1 + slack) goes each time, and a node has at most 2 * (1 + slack) times the largest density of neighbours in its own and
    later layers. edges: src, dst, each once."""
    e = round_table(edges.select("src", "dst").where("src <> dst"))
    found, layer = None, 0
    while True:
        d = round_table(H.degrees(e).select("node", "degree"))
        mean = d.agg(F.avg("degree")).first()[0]
        if mean is None:
            return edges.select(F.col("src").alias("node"), F.lit(0).alias("layer")).limit(0) if found is None else found
        low = d.where(F.col("degree") <= (1 + slack) * mean).select("node", F.lit(layer).alias("layer"))
        found = low if found is None else found.unionByName(low)
        gone = low.select("node")
        lonely = d  # nodes that lose all neighbours in this round come in the next layer
        e = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        e = round_table(e.select("src", "dst"))
        left = lonely.join(gone, "node", "left_anti").join(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti")
        found = round_table(found.unionByName(left.select("node", F.lit(layer + 1).alias("layer"))))
        layer += 1


def _largest_with(pairs: list[dict]) -> list[dict]:
    """For each node of a small graph the size of its largest clique; pairs are its edges."""
    near: dict[int, set[int]] = {}
    for p in pairs:
        near.setdefault(p["a"], set()).add(p["b"])
        near.setdefault(p["b"], set()).add(p["a"])
    best = dict.fromkeys(near, 2)
    stack = [(frozenset(), set(near), set())]
    while stack:
        clique, maybe, done = stack.pop()
        if not maybe:
            if not done:
                for n in clique:
                    best[n] = max(best[n], len(clique))
            continue
        pivot = max(maybe | done, key=lambda n: len(near[n] & maybe))
        for n in sorted(maybe - near[pivot]):
            stack.append((clique | {n}, maybe & near[n], done & near[n]))
            maybe = maybe - {n}
            done = done | {n}
    return [{"node": n, "size": k} for n, k in best.items()]


def clique_numbers(edges: DataFrame) -> DataFrame:
    """(component, node, clique): the size of the largest clique that each node is in. edges: component, src, dst.

    Every clique has one node that comes first in the order of peeling, and its others are among the few that follow this node: each
    node's followers and the edges between them, which come from the triangles, are one small search."""
    e = round_table(edges.select("component", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    layer = round_table(peeling(e))
    directed = round_table(H.directed(e, layer.select("node", F.col("layer").alias("rank"))))
    t = H.forward_triangles(directed)
    small = t.groupBy(F.col("low").alias("node")).agg(F.collect_list(F.struct(F.col("a"), F.col("b"))).alias("pairs"))

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("node", pa.int64()), ("size", pa.int64())]))
        for b in batches:
            yield pa.array([_largest_with(p) for p in b.to_pylist()], kind)

    search.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(search, "array<struct<node:bigint,size:bigint>>")
    pairs = F.transform("pairs", lambda p: F.struct(p["a"].cast("bigint").alias("a"), p["b"].cast("bigint").alias("b")))
    got = round_table(small.select("node", udf(pairs).alias("got")))
    sizes = got.select("node", (F.array_max(F.transform("got", lambda g: g["size"])) + 1).alias("size"))
    sizes = sizes.unionByName(got.select(F.explode("got").alias("g")).select("g.node", (F.col("g.size") + 1).alias("size")))
    all_ = e.select("component", F.explode(F.array("src", "dst")).alias("node")).distinct()
    most = sizes.groupBy("node").agg(F.max("size").alias("size"))
    return all_.join(most, "node", "left").select("component", "node", F.coalesce("size", F.lit(2)).cast("int").alias("clique"))
