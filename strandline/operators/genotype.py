"""Genotype operators on the long form (read_id, site, allele): allele 0 is the reference, 1 the variant, no row is no signal.

Linkage counts come from a self-join on the read whose left side has only sites with a minor allele; the candidate pairs are
made from the site table, which is small, so that pairs without a common read stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.sequence import linkage_score, minor_allele
from strandline.operators.alignment import number_rows
from strandline.operators.graph import both_ways
from strandline.operators.pairs import best_of, block_pairs, ordered, picked, shared, tile_pairs
from strandline.session import round_table

#: Sites of a region that one key of a join of all pairs has on either side, about.
BLOCK = 1024


def site_counts(matrix: DataFrame) -> DataFrame:
    """(site, ref, alt)."""
    return matrix.groupBy("site").agg(F.count_if(F.col("allele") == 0).alias("ref"), F.count_if(F.col("allele") == 1).alias("alt"))


def minor_alleles(matrix: DataFrame, min_cov: int, max_cov: int) -> DataFrame:
    """(site, ref, alt, minor): `.` or `1`, null if neither allele is a minor one."""
    return site_counts(matrix).withColumn("minor", minor_allele(F.col("ref"), F.col("alt"), min_cov, max_cov))


def allele_ranks(counts: DataFrame) -> DataFrame:
    """(site, major, major_count, minor, minor_count); of equal counts the reference allele is major."""
    ref_first = F.col("ref") >= F.col("alt")
    two = lambda a, b: F.when(ref_first, a).otherwise(b)
    return counts.select(
        "site",
        two(F.lit("."), F.lit("1")).alias("major"),
        F.greatest("ref", "alt").alias("major_count"),
        two(F.lit("1"), F.lit(".")).alias("minor"),
        F.least("ref", "alt").alias("minor_count"),
    )


def minor_fraction(ref: Column, alt: Column) -> Column:
    return F.when(ref + alt > 0, F.least(ref, alt) / (ref + alt)).otherwise(F.lit(0.0))


def reference_decile(ref: Column, alt: Column) -> Column:
    """`0` to `10`, `n` without reads."""
    return F.when(ref + alt > 0, F.floor(10 * ref / (ref + alt)).cast("string")).otherwise(F.lit("n"))


def read_bounds(matrix: DataFrame) -> DataFrame:
    """(read_id, first, last) informative site; (0, 0) for reads with fewer than two."""
    out = matrix.groupBy("read_id").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.count("*").alias("n"))
    few = F.col("n") <= 1
    return out.select("read_id", F.when(few, 0).otherwise(F.col("a")).alias("first"), F.when(few, 0).otherwise(F.col("b")).alias("last"))


def linkage(matrix: DataFrame, min_cov: int, max_cov: int, min_shared: int = 5, accuracy: float = 0.8, order: str = "read_id", zero_pairs: bool = True) -> DataFrame:
    """For sites i < j where i has a minor allele: n_overlap (reads with both), n_i and n_j (of these, reads with the minor
    allele), n_shared (with both), lrt_i, lrt_j and lrt, the smaller one.

    The scores compare the shared reads of n_i (n_j) under linkage and by chance; with fewer than min_shared they are 0. A site j
    without a minor allele counts as having none in any read. `order` is the column with the order of the alignments: a pair
    is left out if the first read with j's minor allele comes after the last one with i's. Pairs without a common read stay."""
    sites = minor_alleles(matrix, min_cov, max_cov)
    sites = sites.select("site", F.when(F.col("minor") == ".", 0).when(F.col("minor") == "1", 1).alias("m"))
    reads = matrix.join(sites, "site").select("read_id", F.col(order).alias("place"), "site", F.coalesce((F.col("allele") == F.col("m")).cast("int"), F.lit(0)).alias("has"))
    ends = reads.where("has = 1").groupBy("site").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    # above 32 bits a site has the number of its region
    of = lambda c: F.shiftright(F.col(c).cast("bigint"), 32)
    region = of("i") == of("j")
    blocks = ends.groupBy(of("site").alias("region")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of"))
    left = ends.select(F.col("site").alias("i"), "last", of("site").alias("region")).join(blocks, "region")
    left = left.select("i", "last", "region", F.pmod(F.xxhash64("i"), F.col("of")).cast("int").alias("block"))
    right = sites.select("site").join(ends, "site", "left").select(F.col("site").alias("j"), "first", of("site").alias("region")).join(blocks, "region")
    right = right.select("j", "first", "region", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("block"))
    pairs = left.join(right, ["region", "block"]).where((F.col("i") < F.col("j")) & (F.col("first").isNull() | (F.col("first") <= F.col("last")))).select("i", "j")
    a = reads.join(ends, "site", "left_semi").select("read_id", F.col("site").alias("i"), F.col("has").alias("x"))
    b = reads.select("read_id", F.col("site").alias("j"), F.col("has").alias("y"))
    counts = a.join(b, "read_id").where(region & (F.col("i") < F.col("j"))).groupBy("i", "j").agg(
        F.count("*").alias("n_overlap"), F.sum("x").alias("n_i"), F.sum("y").alias("n_j"), F.sum(F.col("x") * F.col("y")).alias("n_shared")
    )
    out = pairs.join(counts, ["i", "j"], "left" if zero_pairs else "inner").select("i", "j", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_overlap", "n_i", "n_j", "n_shared")])
    score = lambda n: F.when(F.col("n_shared") >= min_shared, linkage_score(F.col("n_shared"), F.col(n), accuracy)).otherwise(F.lit(0.0))
    return out.withColumn("lrt_i", score("n_i")).withColumn("lrt_j", score("n_j")).withColumn("lrt", F.least("lrt_i", "lrt_j"))


def psv_edges(links: DataFrame, min_lrt: float) -> DataFrame:
    """(src, dst, weight) of pairs over min_lrt; weight is the shared part of i's reads."""
    return links.where(F.col("lrt") > min_lrt).select(F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("n_shared") / F.greatest(F.col("n_i"), F.lit(1))).alias("weight"))


def neighbour_span(edges: DataFrame) -> DataFrame:
    """(node, lo, hi): the smallest and largest neighbour."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))


def repulsion_edges(links: DataFrame, edges: DataFrame, components: DataFrame, max_shared: int) -> DataFrame:
    """(src, dst) of pairs in one component that lie inside each other's neighbour span and share at most max_shared reads."""
    nodes = components.join(neighbour_span(edges), "node")
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"))
    x = links.where(F.col("n_shared") <= max_shared).select("i", "j").join(side("i"), "i").join(side("j"), "j")
    inside = (F.col("i") > F.col("loj")) & (F.col("i") < F.col("hij")) & (F.col("j") > F.col("loi")) & (F.col("j") < F.col("hii"))
    return x.where((F.col("ci") == F.col("cj")) & inside).select(F.col("i").alias("src"), F.col("j").alias("dst"))


def read_scores(matrix: DataFrame, penalty: float = 1.0, least: float | None = None) -> DataFrame:
    """(a, b, matches, mismatches, score) of reads a < b with a common site, by blocks of reads; with `least`, of those with such a score only."""

    def work(left, right, same):
        for i, j, a, b in tile_pairs(left, right, same):
            both, known, equal = shared(a, b)
            other = known - equal
            where = both > 0
            if least is not None:
                where &= equal.astype(np.float64) - penalty * other.astype(np.float64) >= least
            yield picked(a, b, where, same and i == j, matches=equal, mismatches=other)

    kind = matrix.schema["read_id"].dataType
    out = block_pairs(matrix, work, [("a", kind), ("b", kind), ("matches", T.LongType()), ("mismatches", T.LongType())])
    return out.select(*ordered(), "matches", "mismatches").withColumn("score", F.col("matches") - penalty * F.col("mismatches"))


def top_neighbours(matrix: DataFrame, k: int, penalty: float = 1.0) -> DataFrame:
    """(read_id, other, score, rank): the k best partners of each read by read_scores, lower ids first among equals. Two blocks make k partners
    of each of their reads, of which the k best over all blocks stay."""

    def best(tiles, of, score, many):
        # ids are in order within a block, so that the first ones among equals have the lowest ids
        i, j = best_of(score, many)
        return {"read_id": tiles.ids.take(pa.array(i)), "other": of.take(pa.array(j)), "score": pa.array(score[i, j], pa.float64())}

    def work(left, right, same):
        ids = [pa.concat_arrays([t.ids for t in tiles]) for tiles in (left, right)]
        # a row of tiles at a time, in both directions
        for tiles, others, of in [(left, right, ids[1])] + ([] if same else [(right, left, ids[0])]):
            for i, a in enumerate(tiles):
                row = []
                for j, b in enumerate(others):
                    both, known, equal = shared(a, b)
                    score = np.where(both > 0, equal.astype(np.float64) - penalty * (known - equal).astype(np.float64), -np.inf)
                    if same and i == j:
                        np.fill_diagonal(score, -np.inf)
                    row.append(score)
                yield best(a, of, np.concatenate(row, axis=1), k)

    kind = matrix.schema["read_id"].dataType
    found = block_pairs(matrix, work, [("read_id", kind), ("other", kind), ("score", T.DoubleType())])
    w = Window.partitionBy("read_id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def consensus(matrix: DataFrame, groups: DataFrame, min_support: int = 10, min_fraction: float = 0.7) -> DataFrame:
    """(grp, site, call): `n` under min_support reads, `.` or `1` over min_fraction, else `u`."""
    n = F.count("*")
    alt = F.avg("allele")
    call = F.when(n < min_support, "n").when(alt > min_fraction, "1").when(1 - alt > min_fraction, ".").otherwise("u")
    return matrix.join(groups, "read_id").groupBy("grp", "site").agg(call.alias("call"), n.alias("n"))


def concordance(assigned: DataFrame) -> DataFrame:
    """(cluster, label, n, share) of (cluster, label) rows."""
    x = assigned.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))


def mec_assignment(matrix: DataFrame, cuts: DataFrame) -> DataFrame:
    """(read_id, cut, mec, matches): the cut with the fewest mismatches, then most variants in common, then the lowest number, of
    those with at least one variant in common; -1 for reads without. Sites of several cuts don't count. cuts: cut, site."""
    alone = cuts.groupBy("site").agg(F.min("cut").alias("own"), F.count("*").alias("n")).where("n = 1").select("site", "own")
    # at its own cut's sites a read should have the variant, at the others' the reference
    per = matrix.join(alone, "site").groupBy("read_id", "own").agg(F.count_if(F.col("allele") == 1).alias("alt"), F.count_if(F.col("allele") == 0).alias("ref"))
    total = F.sum("alt").over(Window.partitionBy("read_id"))
    s = per.withColumn("mec", F.col("ref") + total - F.col("alt")).where("alt > 0")
    best = s.groupBy("read_id").agg(F.min(F.struct("mec", (-F.col("alt")).alias("k"), F.col("own").alias("cut"))).alias("b"))
    out = matrix.select("read_id").distinct().join(best, "read_id", "left")
    return out.select("read_id", F.coalesce("b.cut", F.lit(-1)).alias("cut"), F.col("b.mec").alias("mec"), (-F.col("b.k")).alias("matches"))


def supports(matrix: DataFrame, cuts: DataFrame) -> DataFrame:
    """(read_id, cut, alt, ref): reads with at least one variant and more variants than references at a cut's sites."""
    x = matrix.join(cuts, "site").groupBy("read_id", "cut").agg(F.count_if(F.col("allele") == 1).alias("alt"), F.count_if(F.col("allele") == 0).alias("ref"))
    return x.where("alt >= 1 and alt > ref")


def inner_outer_scores(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """(read_id, inner_match, inner_mismatch, outer_match, outer_mismatch): means over reads of the same and of other groups. Two blocks make
    one row of sums for each of their reads."""

    def member(t, names):
        out = np.zeros((t.n, len(names)), np.float64)
        for i, g in enumerate(t.table["grp"].to_pylist()):
            for name in g:
                out[i, names[name]] += 1
        return out

    def work(left, right, same):
        sums = {}
        for i, j, a, b in tile_pairs(left, right, same):
            both, known, equal = shared(a, b)
            both = (both > 0).astype(np.float64)
            if same and i == j:
                np.fill_diagonal(both, 0)
            names = {n: k for k, n in enumerate(dict.fromkeys(n for t in (a, b) for g in t.table["grp"].to_pylist() for n in g))}
            x, y = member(a, names), member(b, names)
            every = both * np.outer(x.sum(axis=1), y.sum(axis=1))
            null = names.get(None)
            if null is not None:
                x, y = np.delete(x, null, axis=1), np.delete(y, null, axis=1)
            inner = both * (x @ y.T)
            outer = both * np.outer(x.sum(axis=1), y.sum(axis=1)) - inner
            values = [every, inner, inner * equal, inner * (known - equal), outer, outer * equal, outer * (known - equal)]
            for key, axis in [((0, i), 1)] + ([] if same and i == j else [((0 if same else 1, j), 0)]):
                got = np.stack([v.sum(axis=axis) for v in values])
                sums[key] = sums[key] + got if key in sums else got
        for (side, i), s in sums.items():
            ids = (left, right)[side][i].ids
            yield {"read_id": ids} | {n: pa.array(v) for n, v in zip(names_of, s, strict=True)}

    names_of = "every n_inner m_inner d_inner n_outer m_outer d_outer".split()
    per = groups.groupBy("read_id").agg(F.collect_list(F.struct("grp"))["grp"].alias("grp"))
    kind = matrix.schema["read_id"].dataType
    s = block_pairs(matrix, work, [("read_id", kind), *((n, T.DoubleType()) for n in names_of)], per)
    s = s.groupBy("read_id").agg(*[F.sum(n).alias(n) for n in names_of]).where("every > 0")
    mean = lambda v, n: F.try_divide(v, n)
    return s.select(
        "read_id", mean(F.col("m_inner"), F.col("n_inner")).alias("inner_match"), mean(F.col("d_inner"), F.col("n_inner")).alias("inner_mismatch"),
        mean(F.col("m_outer"), F.col("n_outer")).alias("outer_match"), mean(F.col("d_outer"), F.col("n_outer")).alias("outer_mismatch"),
    )


def cluster_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(p, r, n): common positions of each cluster p and contig r; positions of several contigs don't count. a: p, pos; b: r, pos."""
    one = b.groupBy("pos").agg(F.min("r").alias("r"), F.count_distinct("r").alias("k")).where("k = 1")
    return a.join(one, "pos").groupBy("p", "r").agg(F.count("*").alias("n"))


def conflicts(matrix: DataFrame, min_cov: int, max_cov: int) -> DataFrame:
    """(i, j, n_shared, n_conflict) of sites i < j that both have a minor allele in some common reads: reads with both minor alleles,
    and reads with the minor allele at one and the major allele at the other."""
    sites = minor_alleles(matrix, min_cov, max_cov).where("minor is not null").select("site", "minor")
    x = matrix.join(sites, "site").select("read_id", "site", (F.col("allele") == F.when(F.col("minor") == ".", 0).otherwise(1)).cast("int").alias("has"))
    pairs = x.select("read_id", F.col("site").alias("i"), F.col("has").alias("a")).join(x.select("read_id", F.col("site").alias("j"), F.col("has").alias("b")), "read_id").where("i < j")
    out = pairs.groupBy("i", "j").agg(F.sum("a").alias("n_i"), F.sum("b").alias("n_j"), F.sum(F.expr("a * b")).alias("n_shared"), F.count_if(F.col("a") != F.col("b")).alias("n_conflict"))
    return out.where("n_i > 0 and n_j > 0").select("i", "j", "n_shared", "n_conflict")


def similar_reads(scores: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """(src, dst, weight) of read pairs with a score of at least cutoff."""
    return scores.where(F.col("score") >= cutoff).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score").alias("weight"))


def fragment_cover(matrix: DataFrame, cuts: DataFrame) -> DataFrame:
    """(cut, read_id, n, first, last): how many sites of a cut a read has, and from where to where. cuts: cut, site."""
    return matrix.join(cuts, "site").groupBy("cut", "read_id").agg(F.count("*").alias("n"), F.min("site").alias("first"), F.max("site").alias("last"))


def best_contig(similarity: DataFrame) -> DataFrame:
    """(p, r, n): the contig with most positions in common with each cluster; the lowest one among equals."""
    best = F.max(F.struct("n", (-F.col("r")).alias("k"))).alias("b")
    return similarity.groupBy("p").agg(best).select("p", (-F.col("b.k")).alias("r"), F.col("b.n").alias("n"))


def compare_partitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grp, overlap, n_a, n_b, mean_only_a, mean_both): of each group of a, the reads that b puts into the group of the same number, the
    sizes, and in how many groups of a its reads are on average, for those that b lacks and those that it has. Rows: read_id, grp."""
    many = a.groupBy("read_id").agg(F.count("*").alias("times"))
    x = a.distinct().join(many, "read_id").join(b.select("read_id", "grp").distinct().withColumn("hit", F.lit(True)), ["read_id", "grp"], "left")
    hit = F.col("hit").isNotNull()
    out = x.groupBy("grp").agg(F.count_if(hit).alias("overlap"), F.avg(F.when(~hit, F.col("times"))).alias("mean_only_a"), F.avg(F.when(hit, F.col("times"))).alias("mean_both"))
    size = lambda d, n: d.groupBy("grp").agg(F.count("*").alias(n))
    out = out.join(size(a, "n_a"), "grp").join(size(b, "n_b"), "grp", "left")
    return out.select("grp", "overlap", "n_a", F.coalesce("n_b", F.lit(0)).alias("n_b"), "mean_only_a", "mean_both")


def smooth(matrix: DataFrame, edges: DataFrame, rounds: int = 10, min_changes: int = 1) -> DataFrame:
    """The matrix after every allele has become that of most neighbours (src, dst) with a signal at the site, again and again until
    fewer than min_changes change. All reads change at once in a round; ties and reads without neighbours keep their allele."""
    nb = both_ways(edges)
    m = round_table(matrix.select("read_id", "site", "allele"))
    for _ in range(rounds):
        votes = m.join(nb.withColumnRenamed("a", "read_id"), "read_id").groupBy(F.col("b").alias("read_id"), "site").agg(F.sum(F.col("allele") * 2 - 1).alias("vote"))
        said = F.when(F.col("vote") > 0, 1).when(F.col("vote") < 0, 0).otherwise(F.col("allele"))
        after = round_table(m.join(votes, ["read_id", "site"], "left").select("read_id", "site", said.alias("now"), "allele"))
        changed = after.where("now <> allele").count()
        m = after.select("read_id", "site", F.col("now").alias("allele"))
        if changed < min_changes:
            break
    return m


def fragment_overlaps(matrix: DataFrame, min_shared: int = 0, min_equal: float = 0.0) -> DataFrame:
    """(a, b, n_shared, n_equal) of reads a < b whose spans, from first to last site, share a position: common sites, and those with
    equal alleles. Reads with fewer than two different sites have no span. By blocks of reads, whose spans meet. With min_shared, only pairs with so
    many common sites, of which at least a share are equal: others don't leave their task."""

    def work(left, right, same):
        for i, j, a, b in tile_pairs(left, right, same):
            _, known, equal = shared(a, b)
            where = (a.first < a.last)[:, None] & (b.first < b.last)
            if min_shared > 0:  # reads with a common site meet
                where &= known >= min_shared
                if min_equal > 0:
                    # a little less first, as few are left for the division
                    where &= equal >= known * np.float32(min_equal - 1e-6)
                    some = np.nonzero(where)
                    where[some] = equal[some].astype(np.float64) / known[some] >= min_equal
            elif a.first.max() > b.last.min() or b.first.max() > a.last.min():
                where &= (a.first[:, None] <= b.last) & (b.first <= a.last[:, None])
            yield picked(a, b, where, same and i == j, n_shared=known, n_equal=equal)

    kind = matrix.schema["read_id"].dataType
    out = block_pairs(matrix, work, [("a", kind), ("b", kind), ("n_shared", T.LongType()), ("n_equal", T.LongType())])
    return out.select(*ordered(), "n_shared", "n_equal")


def overlap_graph(overlaps: DataFrame, min_shared: int = 1, min_equal: float = 0.0) -> DataFrame:
    """(src, dst, weight) of overlapping reads with enough common sites, of which at least a share are equal; weight is that share."""
    share = F.col("n_equal") / F.col("n_shared")
    return overlaps.where(F.col("n_shared") >= max(1, min_shared)).select(F.col("a").alias("src"), F.col("b").alias("dst"), share.alias("weight")).where(F.col("weight") >= min_equal)


def agreement_graph(matrix: DataFrame, coverage: int) -> DataFrame:
    """(src, dst, weight): each read with its k best partners, k the smaller one of `coverage` and its number of partners; an edge that both
    ends choose comes once."""
    best = top_neighbours(matrix, coverage)
    return best.select(F.least("read_id", "other").alias("src"), F.greatest("read_id", "other").alias("dst"), F.col("score").alias("weight")).distinct()


def site_triples(matrix: DataFrame, radius: int) -> DataFrame:
    """(i, j, k, n): triples of a read's sites, in order, from first to last fewer than `radius` places apart, and in how many reads."""
    place = F.row_number().over(Window.partitionBy("read_id").orderBy("site"))
    x = matrix.select("read_id", "site", place.alias("r"))
    side = lambda s, r: x.select("read_id", F.col("site").alias(s), F.col("r").alias(r))
    # a place meets those behind it by its number, so that a read with many sites is no key of all pairs
    near = lambda r, new: F.explode(F.sequence(F.col(r) + 1, F.col(r) + radius - 1)).alias(new)
    two = side("i", "ri").select("*", near("ri", "rj")).join(side("j", "rj"), ["read_id", "rj"])
    three = two.select("*", near("rj", "rk")).where(F.col("rk") - F.col("ri") < radius).join(side("k", "rk"), ["read_id", "rk"])
    return three.groupBy("i", "j", "k").agg(F.count("*").alias("n"))


def position_lookup(fragments: DataFrame, sites: DataFrame) -> DataFrame:
    """Fragments' positions with the site of the same number, whatever its contig; of several sites the last one in file order counts.
    fragments: ..., pos; sites: pos, line_no, ..."""
    keep = [c for c in sites.columns if c not in ("pos", "line_no")]
    last = sites.groupBy("pos").agg(F.max_by(F.struct(*keep), "line_no").alias("_s")).select("pos", "_s.*")
    return fragments.join(last, "pos")


def indexed_alleles(fragments: DataFrame, sites: DataFrame) -> DataFrame:
    """(read_id, snv, allele) of fragments' SNVs by the number of their site in order of position, from 0; of a repeated position the
    first one counts. fragments: read_id, k (place in the row), pos, allele; sites: pos."""
    number = number_rows(sites.select("pos").distinct(), ["pos"], "_n").select("pos", (F.col("_n") - 1).alias("snv"))
    first = fragments.groupBy("read_id", "pos").agg(F.min(F.struct("k", "allele"))["allele"].alias("allele"))
    return first.join(number, "pos").select("read_id", "snv", "allele")


def drop_last_site(matrix: DataFrame) -> DataFrame:
    """The matrix without the last site of all, which an old writer leaves without a signal in every read."""
    last = matrix.agg(F.max("site").alias("_last"))
    return matrix.crossJoin(F.broadcast(last)).where("site < _last").drop("_last")  # one row


def minor_read_groups(matrix: DataFrame, groups: DataFrame, min_cov: int, max_cov: int) -> DataFrame:
    """(site, minor, n, grp, share): of each site with a minor allele, how many reads have it, and the group that most of them are in,
    the smallest one among equals, with its share."""
    sites = minor_alleles(matrix, min_cov, max_cov).where("minor is not null").select("site", "minor")
    has = matrix.join(sites, "site").where(F.col("allele") == F.when(F.col("minor") == ".", 0).otherwise(1)).join(groups, "read_id")
    n = has.groupBy("site", "minor", "grp").agg(F.count("*").alias("k"))
    best = n.groupBy("site", "minor").agg(F.sum("k").alias("n"), F.max(F.struct("k", (-F.col("grp")).alias("g"))).alias("b"))
    return best.select("site", "minor", "n", (-F.col("b.g")).alias("grp"), (F.col("b.k") / F.col("n")).alias("share"))
