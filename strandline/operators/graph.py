"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes, which takes a number of
    rounds that grows with the logarithm of the longest chain. Each step groups neighbours only by minimum, so hubs are
    pre-aggregated and never gathered; the pairs (node, minimum) join back on the node and stay as many as the edges.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    e = cut_lineage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = e.where("a = b").select("a")
    e = e.where("a <> b")
    stamp = None
    while True:
        # large-star: every neighbour above a node goes to the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: the node and its neighbours below go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut_lineage(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == stamp:
            break
        stamp = now
    # at the end every node but the smallest has one edge, to the smallest
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    alone = alone.join(stars.unionByName(roots).select("node"), "node", "left_anti")
    return stars.unionByName(roots).unionByName(alone)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge and its reverse."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, lo, hi): number of neighbours, the smallest and the largest."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.min("b").alias("lo"), F.max("b").alias("hi"))


def directed(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """(low, high, at, to): each edge from the end that comes first by (rank, node), with the places of both. rank: node, rank."""
    place = lambda n, p: rank.select(F.col("node").alias(n), F.struct("rank", "node").alias(p))
    x = edges.select("src", "dst").join(place("src", "x"), "src").join(place("dst", "y"), "dst")
    return x.select(F.least("x", "y").alias("at"), F.greatest("x", "y").alias("to")).select(F.col("at.node").alias("low"), F.col("to.node").alias("high"), "at", "to")


def forward_triangles(edges: DataFrame) -> DataFrame:
    """(low, a, b) of directed edges: two that follow one node and have an edge between, a before b."""
    x = edges.select("low", F.col("high").alias("a"), F.col("to").alias("p"))
    y = edges.select("low", F.col("high").alias("b"), F.col("to").alias("q"))
    return x.join(y, "low").where("p < q").join(edges.select(F.col("low").alias("a"), F.col("high").alias("b")), ["a", "b"], "left_semi").select("low", "a", "b")


def triangles(edges: DataFrame) -> DataFrame:
    """(i, j, k) with i < j < k and all three edges; edges have src < dst. Edges go from the end of smaller degree, so that no node has more
    than the root of twice the edges of followers, and a hub has next to none."""
    t = forward_triangles(directed(edges, degrees(edges).select("node", F.col("degree").alias("rank"))))
    s = F.array_sort(F.array("low", "a", "b"))
    return t.select(s[0].alias("i"), s[1].alias("j"), s[2].alias("k"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst, common) for each edge. Each triangle gives one to each of its sides, so wedges come from triangles alone."""
    t = triangles(edges)
    side = lambda a, b: t.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    n = side("i", "j").unionByName(side("j", "k")).unionByName(side("i", "k")).groupBy("src", "dst").agg(F.count("*").alias("common"))
    return edges.select("src", "dst").join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("common", F.lit(0)).cast("bigint").alias("common"))


def prune_to_fixpoint(edges: DataFrame, min_common: int) -> DataFrame:
    """Edges left after those with fewer than min_common common neighbours are removed again and again. edges: src, dst, src < dst. They are
    directed once; any order of the nodes finds all triangles of what is left."""
    e = cut_lineage(edges.select("src", "dst"))
    if min_common <= 0:
        return e
    d = cut_lineage(directed(e, degrees(e).select("node", F.col("degree").alias("rank"))))
    n = d.count()
    while True:
        t = forward_triangles(d)
        side = lambda x, y: t.select(F.col(x).alias("low"), F.col(y).alias("high"))  # noqa: B023, E731
        common = side("low", "a").unionByName(side("low", "b")).unionByName(side("a", "b")).groupBy("low", "high").agg(F.count("*").alias("n"))
        d = cut_lineage(d.join(common.where(F.col("n") >= min_common), ["low", "high"], "left_semi"))
        now = d.count()
        if now == n:
            return d.select(F.least("low", "high").alias("src"), F.greatest("low", "high").alias("dst"))
        n = now


def repulsion_within_radius(nodes: DataFrame, edges: DataFrame, radius: int, load: float | None = None) -> DataFrame:
    """(src, dst) of nodes of one component less than `radius` apart that no edge joins. nodes: node, component.

    load: from its nearest one on, a src (with at least one neighbour) takes partners until they are more than load times its degree."""
    cell = F.floor(F.col("node") / radius)
    a = nodes.select(F.col("node").alias("src"), "component", F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = nodes.select(F.col("node").alias("dst"), "component", cell.alias("cell"))
    pairs = a.join(b, ["component", "cell"]).where((F.col("src") < F.col("dst")) & (F.col("dst") - F.col("src") < radius)).select("src", "dst")
    out = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    if load is None:
        return out
    ranked = out.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    own = degrees(edges).select(F.col("node").alias("src"), "degree")
    return ranked.join(own, "src").where(F.col("_k") - 1 <= load * F.col("degree")).select("src", "dst")


def repulsion_in_span(edges: DataFrame, width: int) -> DataFrame:
    """(src, dst), src < dst, of nodes without an edge of which at least one lies strictly between the other's smallest and largest
    neighbour. Spans and nodes meet in bins of `width` positions."""
    span = degrees(edges).where("hi - lo > 1")
    bins = F.explode(F.sequence(F.floor((F.col("lo") + 1) / width), F.floor((F.col("hi") - 1) / width)))
    x = span.select("node", "lo", "hi", bins.alias("bin"))
    y = both_ways(edges).select(F.col("a").alias("other")).distinct().withColumn("bin", F.floor(F.col("other") / width))
    found = x.join(y, "bin").where("other > lo and other < hi and other <> node")
    pairs = found.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct()
    return pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def cut_neighbours(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cut, node) of nodes outside a cut with an edge into it. members: node, cut."""
    m = members.select(F.col("node").alias("a"), "cut")
    near = both_ways(edges).join(m, "a").select("cut", F.col("b").alias("node")).distinct()
    return near.join(members.select("cut", "node"), ["cut", "node"], "left_anti")


def tally_between(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(low, high, n): edges between each pair of different cuts. members: node, cut."""
    side = lambda n, c: members.select(F.col("node").alias(n), F.col("cut").alias(c))
    x = edges.select("src", "dst").join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a <> b")
    return x.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count("*").alias("n"))


def signed_degrees(edges: DataFrame) -> DataFrame:
    """(node, attract, repulse): neighbours by edges of positive and of negative sign. edges: src, dst, sign."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "sign")
    return ends.groupBy("node").agg(F.count_if(F.col("sign") > 0).alias("attract"), F.count_if(F.col("sign") < 0).alias("repulse"))


def heaviest_edges(edges: DataFrame, most: int) -> DataFrame:
    """Edges that are among the `most` heaviest of at least one end; of equal weights, the larger neighbour counts as heavier."""
    ends = edges.select("src", "dst", "weight", F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))).alias("e"))
    k = F.row_number().over(Window.partitionBy("e.at").orderBy(F.desc("weight"), F.desc("e.to")))
    return ends.withColumn("_k", k).where(F.col("_k") <= most).select("src", "dst", "weight").distinct()


def purity(members: DataFrame, edges: DataFrame, min_size: int = 10) -> DataFrame:
    """(component, size, node_purity, n_edges, edge_purity): share of the most frequent colour among the nodes, and among the edges,
    of each component of at least min_size nodes. members: node, component, color; edges: src, dst, color. Null colours are no
    colour, but count for the size; components without edges have a null edge purity."""

    def share(df: DataFrame, size: str, name: str) -> DataFrame:
        c = df.groupBy("component", "color").agg(F.count("*").alias("n"))
        top = F.coalesce(F.max(F.when(F.col("color").isNotNull(), F.col("n"))), F.lit(0))
        return c.groupBy("component").agg(F.sum("n").alias(size), (top / F.sum("n")).alias(name))

    nodes = share(members, "size", "node_purity").where(F.col("size") >= min_size)
    inner = share(edges.join(members.select(F.col("node").alias("src"), "component"), "src"), "n_edges", "edge_purity")
    return nodes.join(inner, "component", "left").select("component", "size", "node_purity", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "edge_purity")


def path_lengths(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, steps): the fewest edges from each source (column node) to every node within `most` steps. Each round goes on
    from the nodes found in the round before only."""
    nb = both_ways(edges)
    seen = front = cut_lineage(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("steps")).distinct())
    for k in range(1, most + 1):
        reached = front.join(nb.withColumnRenamed("a", "node"), "node").select("source", F.col("b").alias("node")).distinct()
        front = cut_lineage(reached.join(seen, ["source", "node"], "left_anti").withColumn("steps", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def prune_cut_tree(tree: DataFrame, min_cut: int, min_size: int = 0) -> DataFrame:
    """(node, component) after the edges of a cut tree with a cut under min_cut are gone; components of fewer than min_size nodes go
    too. tree: src, dst, cut."""
    nodes = tree.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    c = connected_components(tree.where(F.col("cut") >= min_cut))
    c = nodes.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    large = c.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("component")
    return c.join(large, "component", "left_semi").select("node", "component")


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column node) that are an end of some edge."""
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi")


def thin_repulsion(repulsion: DataFrame, edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """(node, other): of each node with more repulsion than `factor` times its edges, that many, evenly spread over the others in order;
    of other nodes all. Nodes without an edge are left out."""
    both = both_ways(repulsion).select(F.col("a").alias("node"), F.col("b").alias("other"))
    w = Window.partitionBy("node")
    x = both.withColumn("_i", F.row_number().over(w.orderBy("other")) - 1).withColumn("_n", F.count("*").over(w))
    x = x.join(degrees(edges).select("node", (F.col("degree") * factor).alias("_most")), "node")
    # the i-th of n stays where the number of kept ones, i * most / n, reaches the next whole number
    kept = lambda i: F.floor(i * F.col("_most") / F.col("_n"))
    return x.where((F.col("_n") <= F.col("_most")) | (kept(F.col("_i") + 1) > kept(F.col("_i")))).select("node", "other")


def triangle_scores(edges: DataFrame) -> DataFrame:
    """(i, j, k, missing, phase, repulsion) of the triangles of attracting edges: how many neighbours of each corner are not common to all
    three; pairs of corners times their common neighbours, both ways; and neighbours of one corner that repel another. edges: src, dst,
    sign, src < dst."""
    plus = edges.where("sign > 0").select("src", "dst")
    t = triangles(plus)
    nb = both_ways(plus)
    corners = t.select("i", "j", "k", F.explode(F.array("i", "j", "k")).alias("a"))
    near = corners.join(nb, "a").groupBy("i", "j", "k", "b").agg(F.count("*").alias("n"))
    # a node next to n corners is n - 1 common neighbours for each of them; next to all three it is missing from none
    each = near.groupBy("i", "j", "k").agg(F.sum(F.when(F.col("n") < 3, F.col("n")).otherwise(0)).alias("missing"), F.sum(F.col("n") * (F.col("n") - 1)).alias("phase"))
    minus = both_ways(edges.where("sign < 0"))
    away = corners.join(minus, "a").select("i", "j", "k", F.col("a").alias("c"), "b")
    # neighbours of one corner that repel another one
    both = corners.join(nb, "a").select("i", "j", "k", "a", "b").join(away, ["i", "j", "k", "b"]).where("a <> c")
    rep = both.groupBy("i", "j", "k").agg(F.count("*").alias("repulsion"))
    return each.join(rep, ["i", "j", "k"], "left").select("i", "j", "k", "missing", "phase", F.coalesce("repulsion", F.lit(0)).cast("bigint").alias("repulsion"))


def repulsion_detour(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, difference): by how many edges the shortest path is shorter if repelling edges count as edges, too, for nodes that
    attracting edges alone reach within `most` steps. edges: src, dst, sign."""
    with_all = path_lengths(edges, sources, most).withColumnRenamed("steps", "steps_all")
    without = path_lengths(edges.where("sign > 0"), sources, most)
    return without.join(with_all, ["source", "node"]).select("source", "node", (F.col("steps") - F.col("steps_all")).alias("difference"))


def colored(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with the number of their cut as `color`, null without one; of several cuts the smallest. Drop the column to clear it."""
    own = members.groupBy("node").agg(F.min("cut").alias("color"))
    return nodes.join(own, "node", "left")


def with_attribute(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Nodes with an attribute from a vector (node, value), null where it has none. A value of the name that nodes have already goes."""
    own = values.select("node", F.col("value").alias("_new"))
    return nodes.drop(name).join(own, "node", "left").withColumnRenamed("_new", name)


def without_solved(edges: DataFrame, solution: DataFrame, threshold: float) -> DataFrame:
    """Edges but those to which a solver's report gives more than a threshold. solution: src, dst, value."""
    gone = solution.where(F.col("value") > threshold).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    ends = edges.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    return ends.join(gone.select(F.col("src").alias("_a"), F.col("dst").alias("_b")), ["_a", "_b"], "left_anti").drop("_a", "_b")


def without_negative(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """Edges whose cost isn't negative; one without a cost has none."""
    return edges.where(F.coalesce(F.col(cost), F.lit(0)) >= 0)
