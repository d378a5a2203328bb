"""Resolving collapsed regions end to end: alignments to sites, linkage, clusters, phased reads and a summary.

All regions run as one job. A site is its contig's number times 2^32 plus its position, so that sites of different regions
never pair: candidate pairs meet by that number, components and clusters stay within a region.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import best_alternate, heterozygous, primary, reference_span
from strandline.operators import alignment as AL
from strandline.operators import cluster as C
from strandline.operators import genotype as G
from strandline.operators import graph as H
from strandline.operators.summary import read_uniqueness
from strandline.params import EmptyStageError, Params
from strandline.session import stage_table

BASES = ("A", "C", "G", "T")


@dataclass
class Resolved:
    sites: DataFrame
    matrix: DataFrame
    links: DataFrame
    edges: DataFrame
    repulsion: DataFrame
    cuts: DataFrame
    reads: DataFrame
    assigned: DataFrame
    summary: DataFrame


def nucleotide_counts(bases: DataFrame) -> DataFrame:
    """(contig, rpos, a, c, g, t) of (contig, rpos, base) rows."""
    return bases.groupBy("contig", "rpos").agg(*[F.count_if(F.col("base") == b).alias(b.lower()) for b in BASES])


def candidate_sites(counts: DataFrame, reference: DataFrame, p: Params) -> DataFrame:
    """(contig, rpos, ref, alt) of positions with exactly two bases over min_cov. reference: contig, seq."""
    lim = p.limits
    columns = {b: F.col(b.lower()) for b in BASES}
    found = counts.where(heterozygous(list(columns.values()), lim["min_cov"], lim["min_cov"], lim["min_total"]))
    x = AL.with_reference_base(found, reference).where(F.col("ref").isin(*BASES))
    return x.select("contig", "rpos", "ref", best_alternate(F.col("ref"), columns).alias("alt"))


def resolve(alignments: DataFrame, reference: DataFrame, contigs: DataFrame, params: Params) -> Resolved:
    """Clusters of sites that tell the copies of collapsed regions apart, with the reads of each.

    alignments: qname, rname, flag, pos0, ops, seq (one primary alignment for each name); reference: contig, seq; contigs: contig,
    contig_idx. Raises EmptyStageError if no site or no cluster is found. With params.keep the tables between the stages stay there."""
    p = params.for_platform()
    lim = p.limits
    reads = alignments.where(primary(F.col("flag")) & (reference_span(F.col("ops")) >= p.min_aln))
    sites = stage_table(candidate_sites(nucleotide_counts(AL.base_rows(reads)), reference, p), "sites", p.keep)
    if sites.isEmpty():
        raise EmptyStageError("no candidate sites")
    order = AL.number_rows(reads.select("rname", "pos0", "qname"), ["rname", "pos0", "qname"], "read_id").select("qname", "read_id")
    number = F.shiftleft(F.col("contig_idx").cast("bigint"), 32) + F.col("rpos")
    seen = AL.bases_at(reads, sites.join(contigs.select("contig", "contig_idx"), "contig")).join(order, "qname")
    matrix = stage_table(seen.select("read_id", "qname", number.alias("site"), (F.col("base") == F.col("alt")).cast("int").alias("allele")), "matrix", p.keep)
    links = stage_table(G.linkage(matrix, lim["min_cov"], lim["max_cov"], p.min_shared, p.accuracy), "links", p.keep)
    edges = stage_table(G.psv_edges(links, p.min_lrt), "edges", p.keep)
    comps = stage_table(H.connected_components(edges), "components", p.keep)
    repulsion = stage_table(G.repulsion_edges(links, edges, comps, p.max_pos_rep), "repulsion", p.keep)
    signed = edges.select("src", "dst", F.lit(1).alias("sign")).unionByName(repulsion.withColumn("sign", F.lit(-1)))
    signed = signed.join(comps.select(F.col("node").alias("src"), "component"), "src").select("component", "src", "dst", "sign")
    found = stage_table(C.correlation_clusters(signed, p.restarts, min_size=p.min_cut_size, min_span=p.min_cut_len), "clusters", p.keep)
    if found.isEmpty():
        raise EmptyStageError("no clusters of sites")
    sizes = found.groupBy("component", "cut").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    ranked = AL.number_rows(sizes, [F.desc("n"), F.asc("first")], "k").select("component", "cut", (F.col("k") - 1).cast("int").alias("id"))
    cuts = stage_table(found.join(ranked, ["component", "cut"]).select(F.col("id").alias("cut"), F.col("node").alias("site")), "cuts", p.keep)
    phased = read_uniqueness(G.supports(matrix, cuts).select(F.col("read_id").alias("readid"), "cut"))
    assigned = G.mec_assignment(matrix, cuts)
    psvs = cuts.groupBy("cut").agg(F.count("*").alias("n_psvs"), F.min("site").alias("first"), F.max("site").alias("last"))
    counts = phased.groupBy("cut").agg(F.count("*").alias("n_reads"), F.count_if("unique").alias("n_unique_reads"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    low = F.lit((1 << 32) - 1)
    summary = psvs.join(counts, "cut", "left").select(
        "cut", F.shiftright("first", 32).alias("contig_idx"), F.col("first").bitwiseAND(low).alias("first"), F.col("last").bitwiseAND(low).alias("last"), "n_psvs", zero("n_reads"), zero("n_unique_reads")
    )
    return Resolved(sites, matrix, links, edges, repulsion, cuts, phased, assigned, summary)
