"""Operators that work in rounds or stitch bins, against plain versions; and what kept columns, nulls and equal rows do to others."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import cluster as C
from strandline.operators import gaps, intervals
from strandline.operators import graph as H
from strandline.operators import rounds as RO
from strandline.plans import reports
from strandline.session import round_table
from tests import plain_clusters as plain


def plain_islands(rows, distance):
    """{contig: [(start, end, n)]}"""
    out = {}
    for c, s, e in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        own = out.setdefault(c, [])
        if own and s <= own[-1][1] + distance:
            own[-1] = (own[-1][0], max(own[-1][1], e), own[-1][2] + 1)
        else:
            own.append((s, e, 1))
    return out


@pytest.mark.parametrize(("distance", "width"), [(0, 50), (-1, 7), (30, 1000), (5, 1)])
def test_merged_intervals_equal_one_sweep(spark, distance, width):
    rnd = random.Random(width)
    rows = [(rnd.choice(["a", "b", None]), s := rnd.randint(0, 3000), s + rnd.choice([1, 3, 40, 40, 500])) for _ in range(300)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "contig string, start0 bigint, end0 bigint")
    want = {(c, *x) for c, v in plain_islands(rows, distance).items() for x in v}
    assert {tuple(r) for r in intervals.merge(df, distance, width=width).collect()} == want
    spans = intervals.merge(df, distance, F.sum(F.col("end0") - F.col("start0")).alias("total"), width=width).collect()
    assert {tuple(r)[:4] for r in spans} == want and sum(r.total for r in spans) == sum(e - s for _, s, e in rows)
    numbers = {(r.contig, r.grp) for r in intervals.islands(df, distance, width).select("contig", "grp").distinct().collect()}
    assert numbers == {(c, k) for c, v in plain_islands(rows, distance).items() for k in range(1, len(v) + 1)}


def test_merging_reads_its_input_once(spark, tmp_path):
    spark.range(1000).selectExpr("'c' as contig", "id * 3 as start0", "id * 3 + 2 as end0").write.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.read.parquet(str(tmp_path / "in")).mapInArrow(count, "contig string, start0 bigint, end0 bigint")
    assert intervals.merge_spans(df, 0, 64).count() == 1000 and reads.value == 1000
    assert intervals.merge(df, 0, F.max("end0").alias("m"), width=64).count() == 1000 and reads.value == 2000


def test_left_overlap_keeps_equal_rows_apart(spark):
    a = spark.createDataFrame([("c", 0, 5, None), ("c", 0, 5, None), ("c", 90, 95, "x"), ("c", 90, 95, "x")], "contig string, start0 bigint, end0 bigint, name string")
    b = spark.createDataFrame([("c", 3, 20)], "contig string, start0 bigint, end0 bigint")
    got = intervals.overlap_join(a, b, 4, "left").collect()
    assert sorted((r.start0, r.ov, r.b_start0) for r in got) == [(0, 2, 3), (0, 2, 3), (90, 0, None), (90, 0, None)]


def test_starts_of_a_million_contigs_with_their_letters(spark):
    n, spacer = 1_000_000, 3
    contigs = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"), F.repeat(F.lit("A"), (F.col("id") % 5).cast("int")).alias("seq"))
    got = S.joined_contigs(contigs, spacer)
    assert got.columns == ["k", "seq", "start0"]
    # the start of each contig plus its length and the spacer is the start of the next one
    nxt = got.select((F.col("k") + 1).alias("k"), (F.col("start0") + F.length("seq") + spacer).alias("end"))
    assert got.count() == n and got.join(nxt, "k").where("start0 = end").count() == n - 1 and got.where("k = 0").first().start0 == 0


def test_alignments_without_a_score_lose(spark):
    df = spark.createDataFrame([("r", "a", None), ("r", "c", 3), ("r", "b", 3), ("q", "z", None), ("q", "y", None)], "qname string, rname string, s int")
    assert {tuple(r) for r in gaps.best_alignment(df, F.col("s")).collect()} == {("r", "b"), ("q", "y")}


def test_equal_gaps_stay_apart(spark):
    rows = spark.createDataFrame([("g", 1, 4), ("g", 1, 4), ("g", 6, 20), ("g", 3, 3), ("h", 0, 2)], "contig string, s int, e int")
    reference = spark.createDataFrame([("g", "ACGTACGTAC")], "contig string, seq string")
    got = gaps.with_reference_part(rows, reference, F.col("s"), F.col("e"), "part", chunk=3)
    assert sorted(tuple(r) for r in got.collect()) == [("g", 1, 4, "CGT"), ("g", 1, 4, "CGT"), ("g", 3, 3, ""), ("g", 6, 20, "GTAC"), ("h", 0, 2, "")]


# clustering


def table(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


SIGNED = "component bigint, src bigint, dst bigint, sign int"


def planted_graph(seed, groups, each, inside, between, repelled):
    """Edges (component 0, src, dst, sign) of groups that are dense inside and repel each other, with false edges between."""
    rnd = random.Random(seed)
    edges = []
    for a, b in itertools.combinations(range(groups * each), 2):
        same = a % groups == b % groups
        if rnd.random() < (inside if same else between):
            edges.append((0, a, b, 1))
        elif not same and rnd.random() < repelled:
            edges.append((0, a, b, -1))
    return edges


def score_of(edges, cut):
    return sum(2 for _, a, b, s in edges if s > 0 and cut.get(a, -a) != cut.get(b, -b)) + 5 * sum(1 for _, a, b, s in edges if s < 0 and cut.get(a, -a) == cut.get(b, -b))


GRAPHS = [(1, 4, 12, 0.7, 0.05, 0.3), (2, 3, 20, 0.5, 0.1, 0.2), (3, 6, 9, 0.9, 0.02, 0.5)]


def test_distributed_clusters_are_no_worse(spark):
    """The scores of three graphs at once are at most 5 % over those of the plain search, and planted groups are found."""
    graphs = [[(k, a + 1000 * k, b + 1000 * k, s) for _, a, b, s in planted_graph(*g)] for k, g in enumerate(GRAPHS)]
    got = C.correlation_clusters(table(spark, SIGNED, [e for g in graphs for e in g]), restarts=4, min_size=1).collect()
    for component, part in enumerate(graphs):
        groups = GRAPHS[component][1]
        cut = {r.node: r.cut for r in got if r.component == component}
        assert set(cut) == {n for _, a, b, _ in part for n in (a, b)}
        said = {r.score for r in got if r.component == component}
        assert said == {score_of(part, cut)}
        best = min(plain.clusters(*([e[k] for e in part] for k in (1, 2, 3)), seed=[r])[0] for r in range(4))
        assert said.pop() <= 1.05 * best + 1e-9
        groups_of = {}
        for n, c in cut.items():
            groups_of.setdefault(c, []).append(n % 1000 % groups)
        assert sum(max(map(v.count, set(v))) for v in groups_of.values()) >= 0.95 * len(cut)


def test_no_component_is_gathered(spark):
    import inspect

    assert not any(x in inspect.getsource(m) for m in (C, RO) for x in ("applyInPandas(", "cogroup(", "toPandas("))


def test_pivots_cover_and_dont_touch(spark):
    rnd = random.Random(4)
    near = {(a, b) for a, b in itertools.combinations(range(60), 2) if rnd.random() < 0.06} | {(0, k) for k in range(1, 40)}
    both = table(spark, "a bigint, b bigint", [p for a, b in near for p in ((a, b), (b, a))])
    nodes = table(spark, "restart int, node bigint", [(r, n) for r in range(2) for n in range(60)])
    rows = C.pivots(nodes, both, 3).collect()
    assert len({frozenset(x.node for x in rows if x.restart == r) for r in range(2)}) == 2
    for r in range(2):
        chosen = {x.node for x in rows if x.restart == r}
        assert not any(a in chosen and b in chosen for a, b in near)
        assert all(n in chosen or any((n in p) and (set(p) & chosen) for p in near) for n in range(60))


def members(spark, cuts, restart=0):
    return table(spark, "restart int, cut bigint, node bigint", [(restart, k, n) for k, c in cuts.items() for n in c])


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cut, set()).add(r.node)
    return sorted(map(sorted, out.values()))


def test_reciprocal_balls_are_one(spark):
    assert sets(C.merge_reciprocal(members(spark, {1: {1, 2, 3, 4}, 2: {1, 2, 3, 4, 5}, 3: {8}, 4: {5, 6}}), 0.75)) == [[1, 2, 3, 4, 5], [5, 6], [8]]
    rnd = random.Random(5)
    base = [set(rnd.sample(range(40), rnd.randint(2, 9))) for _ in range(15)]
    cuts = dict(enumerate([*base, *(b | {100} for b in base), *(b - {min(b)} for b in base)]))
    up = {k: k for k in cuts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(cuts, 2):
        if min(len(cuts[a] & cuts[b]) / len(c) for c in (cuts[a], cuts[b])) > 0.6:
            up[root(b)] = root(a)
    want = {}
    for k, c in cuts.items():
        want.setdefault(root(k), set()).update(c)
    assert sets(C.merge_reciprocal(members(spark, cuts), 0.6)) == sorted(map(sorted, want.values()))


def test_steps_of_the_clustering(spark):
    edges = table(spark, SIGNED, [(0, a, b, 1) for a, b in ((1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4))] + [(0, 2, 5, -1)])
    assert sets(C.unique_members(edges, members(spark, {1: {1, 2, 3}, 2: {3, 4, 5, 6}}))) == [[1, 2, 3], [4, 5, 6]]
    two = table(spark, "cut bigint, node bigint", [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)])
    assert sets(C.without_torn(edges, two, 0)) == [[1, 2], [5, 6]] and sets(C.without_torn(edges, two, 1)) == [[1, 2, 3], [4, 5, 6]]
    new = table(spark, "cut bigint, node bigint", [(1, 3), (1, 4), (2, 3)])
    # 3 and 4 into {1, 2}: two edges into it, one among the two from both ends, 4 to 5 and 6 leave; 3 into {4, 5}: one in, two out
    delta = C.expansion_delta(edges, table(spark, "cut bigint, node bigint", [(1, 1), (1, 2), (2, 4), (2, 5)]), new)
    assert {r.cut: r.delta for r in delta.collect()} == {1: 2 - 2 - 2, 2: 2 - 1}
    more = C.expansion_delta(edges, table(spark, "cut bigint, node bigint", [(1, 5)]), table(spark, "cut bigint, node bigint", [(1, 2)]))
    assert more.first().delta == 2 + 5
    sites, graph = C.clustered_sites(two, edges)
    assert {r.cut: (r.sites, r.n) for r in sites.collect()} == {1: ([1, 2, 3], 3), 2: ([4, 5, 6], 3)}
    assert {r.node: r.color for r in graph.collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}


def test_moves_and_merges_lower_the_score(spark):
    edges = planted_graph(9, 3, 12, 0.7, 0.15, 0.3)
    df = table(spark, SIGNED, edges)
    rnd = random.Random(6)
    nodes = sorted({n for _, a, b, _ in edges for n in (a, b)})
    start = {n: rnd.choice(nodes[:9]) for n in nodes}
    own = members(spark, {k: {n for n in nodes if start[n] == k} for k in set(start.values())})
    joined = C.merge_best(df, own, 5.0)
    after = {r.node: r.cut for r in joined.collect()}
    moved = {r.node: r.cut for r in C.move_nodes(df, joined, C.alike(df, 0), 5.0, 3, 0.0).collect()}
    assert score_of(edges, start) > score_of(edges, after) > score_of(edges, moved) and set(moved) == set(nodes)


# other algorithms in rounds


def random_edges(seed, n, p, components=2):
    rnd = random.Random(seed)
    return [(c, c * 1000 + a, c * 1000 + b, float(rnd.randint(0, 6))) for c in range(components) for a, b in itertools.combinations(range(n), 2) if rnd.random() < p]


def plain_forest(edges):
    up, out = {}, set()

    def root(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for c, a, b, w in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.add((c, a, b, w))
    return out


WEIGHTED = "component bigint, src bigint, dst bigint, weight double"


def test_forest_equals_one_edge_after_the_other(spark):
    edges = random_edges(3, 40, 0.1) + [(5, 5000 + k, 5001 + k, 1.0) for k in range(40)] + [(6, 6000, 6000 + k, 2.0) for k in range(1, 90)] + [(7, 7000, 7001, 1.0)] * 2
    assert {tuple(r) for r in RO.spanning_forest(table(spark, WEIGHTED, edges)).collect()} == plain_forest(edges)
    assert RO.spanning_forest(table(spark, WEIGHTED, [(0, 1, 1, 1.0)])).count() == 0


def plain_condensed(edges, triangles, places, max_nodes):
    root = {n: (c, n) for c, a, b, *_ in edges for n in (a, b)}
    tri = [x[1:] for x in sorted(((m, places[i, j, k]), i, j, k) for i, j, k, m in triangles)]
    while True:
        at = lambda n: root[n][1]
        alive = [(t, sorted({at(t[0]), at(t[1]), at(t[2])})) for t in tri]
        alive = [(t, c) for t, c in alive if len(c) == 3]
        size = {}
        for c, n in set(root.values()):
            size[c] = size.get(c, 0) + 1
        alive = [(t, c) for t, c in alive if size[root[t[0]][0]] > max_nodes]
        first = {}
        for t, corners in alive:
            for n in corners:
                first.setdefault(n, t)
        ready = [(t, c) for t, c in alive if all(first[n] == t for n in c)]
        if not ready:
            return {n: (c, r) for n, (c, r) in root.items()}
        used = {}
        for t, corners in ready:
            c = root[t[0]][0]
            used[c] = used.get(c, 0) + 1
            if used[c] <= math.ceil((size[c] - max_nodes) / 2):
                root = {n: (k, corners[0] if r in corners else r) for n, (k, r) in root.items()}


@pytest.mark.parametrize("most", [1, 11])
def test_contraction_equals_plain_rounds(spark, most):
    edges = random_edges(8, 18, 0.28)
    near = {}
    for _, a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rnd = random.Random(most)
    tri = [(i, j, k, rnd.randint(0, 4)) for i, j, k in itertools.combinations(sorted(near), 3) if j in near[i] and k in near[i] and k in near[j]]
    df = table(spark, "component bigint, src bigint, dst bigint, cost double", edges)
    triangles = table(spark, "i bigint, j bigint, k bigint, missing int", tri)
    places = {(r.i, r.j, r.k): r.h for r in triangles.select("i", "j", "k", F.xxhash64("i", "j", "k").alias("h")).collect()}
    got = RO.condense_triangles(df, triangles, most)
    roots = {r.node: (r.component, r.root) for r in got.collect()}
    assert roots == plain_condensed(edges, tri, places, most) and (most == 1 or min(sum(c == k for c, _ in set(roots.values())) for k in (0, 1)) <= most)
    cost = {}
    for _, a, b, w in edges:
        x, y = sorted((roots[a][1], roots[b][1]))
        if x != y:
            cost[x, y] = cost.get((x, y), 0) + w
    assert {(r.src, r.dst): r.cost for r in RO.condensed_edges(df, got).collect()} == cost


def test_parts_keep_their_sizes(spark):
    parts = 3
    edges = [(0, a, b, 3.0 if a % parts == b % parts else 1.0) for a, b in itertools.combinations(range(31), 2) if (a * b) % 3 or a % parts == b % parts]
    edges += [(1, 100 + a, 100 + b, float((a * b) % 5) - 1) for a, b in itertools.combinations(range(14), 2)]
    df = table(spark, WEIGHTED, edges)

    def score(part, c):
        return sum((2 if part[a] == part[b] else -2) * w for k, a, b, w in edges if k == c)

    results = []
    for rounds in (0, 2):
        rows = RO.partition_graph(df, parts, rounds=rounds).collect()
        part = {r.node: r.part for r in rows}
        for c in (0, 1):
            sizes = [sum(r.component == c and r.part == p for r in rows) for p in range(parts)]
            assert max(sizes) - min(sizes) <= 1 and {r.score for r in rows if r.component == c} == {score(part, c)}
        results.append([score(part, c) for c in (0, 1)])
    assert all(a <= b for a, b in zip(*results, strict=True))


def gaining(rows, edges):
    """Pairs of nodes that want each other's part and whose exchange would raise the score."""
    part, comp = {r.node: r.part for r in rows}, {r.node: r.component for r in rows}
    pull, both = {n: {} for n in part}, {}
    for _, a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            pull[x][part[y]] = pull[x].get(part[y], 0) + w
            both[x, y] = both.get((x, y), 0) + w
    wants = {n: min(p, key=lambda q, p=p: (-p[q], q)) for n, p in pull.items()}
    gain = {n: pull[n][q] - pull[n].get(part[n], 0) for n, q in wants.items() if pull[n][q] > pull[n].get(part[n], 0)}
    pairs = ((u, v) for u, v in itertools.combinations(gain, 2) if comp[u] == comp[v] and wants[u] == part[v] and wants[v] == part[u])
    return [(u, v) for u, v in pairs if gain[u] + gain[v] > 2 * both.get((u, v), 0)]


def test_parts_until_no_exchange_gains(spark, small):
    """Random edges, two cliques and a complete bipartite graph of heavy edges, where nodes of equal place never gain; and the query."""
    rnd = random.Random(21)
    edges = [(0, a, b, float(rnd.randint(-2, 9))) for a, b in itertools.combinations(range(60), 2) if rnd.random() < 0.08]
    edges += [(1, 100 + a, 100 + b, 1.0) for a, b in itertools.combinations(range(24), 2) if a % 2 == b % 2] + [(1, 100, 101, 0.5)]
    edges += [(2, 200 + a, 210 + b, 3.0) for a in range(6) for b in range(6)]
    for parts in (2, 3):
        rows = RO.partition_graph(table(spark, WEIGHTED, edges).repartition(5), parts).collect()
        part = {r.node: (r.component, r.part) for r in rows}
        score = {c: sum((2 if part[a] == part[b] else -2) * w for k, a, b, w in edges if k == c) for c in range(3)}
        assert {(r.component, r.score) for r in rows} == set(score.items()) and not gaining(rows, edges)
        sizes = [[sum(x == (c, p) for x in part.values()) for p in range(parts)] for c in range(3)]
        assert all(max(x) - min(x) <= 1 for x in sizes)
    e = [(r.component, r.src, r.dst, r.weight) for r in reports._with_component(spark, small).collect()]
    assert not gaining(reports.partition_graph(spark, small).collect(), e)


def test_last_exchange_of_tied_nodes(spark):
    """Nodes of equal place are tied to each other, so that only others gain; where all are tied, none do."""
    x = table(spark, "component bigint, node bigint, p int, q int, gain double, least double, place bigint", [(c, 10 * c + n, n // 2, 1 - n // 2, 1.0, 0.0, n % 2) for c in range(2) for n in range(4)])
    tied = [(0, 0, 2, 1.0), (0, 1, 3, 1.5), (0, 2, 1, 1.0), (0, 0, 1, 9.0)] + [(1, 10 + a, 12 + b, 1.0) for a in range(2) for b in range(2)]
    assert RO._exchanged(table(spark, WEIGHTED, tied), x, 2).count() == 0
    assert {tuple(r) for r in RO._last_exchange(table(spark, WEIGHTED, tied), x).collect()} == {(0, 1), (3, 0)}


def estimate(df):
    """Digits of the size in bytes that Spark expects of a table."""
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_rounds_forget_estimates(spark):
    """A table of a round has its own size, not the product of all that was joined in rounds before: the digits stay few."""
    edges = random_edges(4, 24, 0.3)
    df = table(spark, WEIGHTED, edges)
    x = df
    for _ in range(6):
        x = round_table(x.join(x.select("src", F.col("dst").alias("d")).distinct(), "src").groupBy("component", "src", "dst").agg(F.max("weight").alias("weight")))
    assert estimate(x) <= 6 and x.count() == len(edges)
    chain = table(spark, WEIGHTED, [(0, k, k + 1, float((k & -k).bit_length() % 7)) for k in range(1, 65)])
    assert estimate(RO.spanning_forest(chain)) <= 40
    assert estimate(RO.partition_graph(df, 2, rounds=2)) <= 40
    # four clusters in two pairs, of which two rounds make one
    members = table(spark, "restart int, cut bigint, node bigint", [(0, k // 2, k) for k in range(8)])
    signed = table(spark, SIGNED, [(0, a, b, 1) for a, b in itertools.combinations(range(8), 2)])
    assert estimate(C.move_nodes(signed, C.merge_best(signed, members, 5.0), C.alike(signed, 0), 5.0, 3, 0.0)) <= 40


def test_places_over_ranges(spark):
    """One group over many ranges, small groups within one, equal values of the first column of the order."""
    rnd = random.Random(11)
    rows = [(0, rnd.randint(0, 3), n) for n in range(3000)] + [(c, rnd.randint(0, 3), 5000 + 10 * c + k) for c in range(1, 40) for k in range(c % 4)]
    got = RO._placed(table(spark, "c bigint, v bigint, n bigint", rows).repartition(7), ["c"], [F.desc("v"), F.col("n")], "place", "of").collect()
    want, groups = {}, {}
    for c, v, n in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        groups.setdefault(c, []).append(n)
        want[n] = len(groups[c]) - 1
    assert {r.n: r.place for r in got} == want and len(got) == len(rows) and all(r["of"] == len(groups[r.c]) for r in got)


def test_pointers_reach_their_roots(spark):
    up = [(k, max(k - 1, 0)) for k in range(150)] + [(1000, 1000), (1001, 1000), (2000, 2000)]
    got = {r.node: r.to for r in RO._jumped(table(spark, "node bigint, to bigint", up)).collect()}
    assert got == {n: (n // 1000) * 1000 for n, _ in up}


def plain_cliques(near):
    def largest(clique, rest):
        return max([len(clique), *(largest(clique | {n}, rest & near[n]) for n in rest)])

    return {n: largest({n}, near[n]) for n in near}


def test_cliques_equal_brute_force(spark):
    edges = random_edges(12, 16, 0.5) + [(2, 2000, 2000 + k, 1.0) for k in range(1, 60)] + [(3, 3000 + k, 3001 + k, 1.0) for k in range(20)]
    near = {}
    for _, a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert {r.node: r.clique for r in RO.clique_numbers(table(spark, WEIGHTED, edges)).collect()} == plain_cliques(near)
    layer = {r.node: r.layer for r in RO.peeling(table(spark, WEIGHTED, edges)).collect()}
    assert set(layer) == set(near) and layer[2000] > layer[2001]
    order = lambda n: (layer[n], n)
    densest = max(len(near[n]) for n in near if n < 2000)
    assert max(sum(order(m) > order(n) for m in near[n]) for n in near) <= 2 * densest


def test_triangles_of_a_hub(spark):
    """A star of a million leaves around a node of middling number, and two triangles at it."""
    n = 1_000_000
    leaves = spark.range(n).select(F.least("id", F.lit(n // 2)).alias("src"), F.greatest("id", F.lit(n // 2)).alias("dst")).where("src <> dst")
    more = table(spark, "src bigint, dst bigint", [(0, 1), (7, n - 1)])
    assert {tuple(r) for r in H.triangles(leaves.unionByName(more)).collect()} == {(0, 1, n // 2), (7, n // 2, n - 1)}


# files in splits


def test_lines_of_split_files(spark, tmp_path):
    """Lines keep their numbers, and headers their rows, however many splits a file has."""
    from strandline.sources import formats

    rnd = random.Random(3)
    lines, want = ["program text", ""], []
    for k in range(40):
        name = f"contig{k}"
        lines.append(rnd.choice([f"@{name} more", f"Sequence: {name}"]))
        for _ in range(rnd.choice([0, 1, 30])):
            start = rnd.randint(1, 10**6)
            lines.append(" ".join(map(str, [start, start + 9, *[1] * 13])))
            want.append((name, start))
    path = tmp_path / "x.dat"
    path.write_text("\n".join(lines) + "\n")
    cuts = [[rnd.randint(0, 999) for _ in range(rnd.randint(0, 30))] for _ in range(60)]
    (tmp_path / "cuts").write_text("\n".join("\t".join(map(str, c)) for c in cuts) + "\n")
    (tmp_path / "parts").write_text("\n".join(str(k % 7) for k in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300b", old[0]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            numbered = formats._numbered(spark, str(path))
            assert [r.value for r in numbered.orderBy("line_no").collect()] == lines
            assert size == old[0] or numbered.select("block").distinct().count() > 4
            assert sorted((r.contig, r.start) for r in formats.trf(spark, str(path)).select("contig", "start").collect()) == sorted(want)
            assert sorted((r.cut, r.node) for r in formats.cuts(spark, str(tmp_path / "cuts")).collect()) == sorted((k, n) for k, c in enumerate(cuts) for n in c)
            assert {r.node: r.part for r in formats.partition_vector(spark, str(tmp_path / "parts")).collect()} == {k: k % 7 for k in range(500)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_node_attributes(spark):
    nodes = table(spark, "node bigint, color int", [(1, 5), (2, 6), (3, None)])
    got = H.with_attribute(nodes, table(spark, "node bigint, value int", [(1, 10), (3, 30), (9, 90)]), "color")
    assert {r.node: r.color for r in got.collect()} == {1: 10, 2: None, 3: 30}
