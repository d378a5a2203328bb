"""The catalogue against DuckDB, hand-computed fixtures, planted clusters, sources and sinks."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import alignment as AL
from strandline.operators import cluster as C
from strandline.operators import rounds as RO
from strandline.operators import genotype as G
from strandline.operators import graph as H
from strandline.operators import intervals as I
from strandline.operators import summary as R
from strandline.plans import catalogue, reports  # noqa: F401
from strandline.plans.fixtures import TABLES
from strandline.sources import formats, sinks


def rounded(rows):
    return sorted(repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    got = catalogue.queries()[name](spark, small)
    want = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert rounded(tuple(r[c] for c in cols) for r in got.collect()) == rounded(tuple(r[i] for i in at) for r in want.fetchall())


WHOLE = "read_distance_matrix top_k_neighbours mec_assignment read_supports_cluster inner_outer_scores similar_reads fragment_cover read_bounds".split()


def test_read_queries_on_all_events(spark, small, duck):
    """Each has a twin that no event is kept from."""
    cells = {(a, b): c for a, b, c in duck.sql("select user_id, json_extract_string(props,'$.k')::int, max((event_type='purchase')::int) from events group by 1, 2").fetchall()}
    reads = sorted({a for a, _ in cells})
    want = set()
    for k, a in enumerate(reads):
        for b in reads[k + 1 :]:
            both = [x == cells[b, s] for (r, s), x in cells.items() if r == a and (b, s) in cells]
            if both:
                want.add((a, b, sum(both), len(both) - sum(both)))
    got = catalogue.queries()["read_distance_matrix_dense"](spark, small).select("a", "b", "matches", "mismatches").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert all("event_id % 6" not in catalogue.oracle_sql()[f"{n}_dense"] for n in WHOLE)
    assert {r.read_id for r in catalogue.queries()["read_bounds_dense"](spark, small).collect()} == set(reads)


def values(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


def one(spark, column, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_thresholds():
    assert S.thresholds(100) == {"min_cov": 60, "max_cov": 110, "min_total": 170, "min_reads": 30}
    assert S.thresholds(25) == {"min_cov": 12, "max_cov": 30, "min_total": 35, "min_reads": 6}


@pytest.mark.parametrize("k, n, p, want", [(3, 10, 0.5, 0.34375), (8, 10, 0.8, 1.0), (2, 18, 0.2, 0.5549880618), (0, 0, 0.8, 1.0), (10, 10, 0.3, 0.3**10)])
def test_binomial(spark, k, n, p, want):
    assert one(spark, S.binomial_test(F.col("k"), F.col("n"), p), k=k, n=n) == pytest.approx(want, rel=1e-9)


def test_linkage_score(spark):
    score = lambda k, n: one(spark, S.linkage_score(F.col("k"), F.col("n"), 0.8), k=k, n=n)
    assert score(1, 1) == pytest.approx(math.log10(6)) and score(0, 0) == pytest.approx(math.log10(2))
    assert score(2000, 2000) == math.inf and score(1000, 2000) > 0


def test_merge_distances(spark):
    df = values(spark, "contig string, start0 bigint, end0 bigint", [("a", 0, 10), ("a", 10, 20), ("a", 25, 30), ("b", 5, 6)])
    spans = lambda d: sorted((r.contig, r.start0, r.end0) for r in I.merge(df, d).collect())
    assert spans(0) == [("a", 0, 20), ("a", 25, 30), ("b", 5, 6)]
    assert len(spans(-1)) == 4 and spans(5) == [("a", 0, 30), ("b", 5, 6)]
    for d in (-1, 0, 5):
        assert sorted((r.contig, r.start0, r.end0) for r in I.merge_spans(df, d, 8).collect()) == spans(d)


def test_overlap_join_identical_and_touching(spark):
    a = values(spark, "contig string, start0 bigint, end0 bigint", [("a", 5, 9), ("a", 9, 12), ("b", 0, 1000)])
    b = values(spark, "contig string, start0 bigint, end0 bigint", [("a", 5, 9), ("b", 100, 300), ("b", 999, 1001)])
    for width in (1, 7, 64, 5000):
        got = sorted((r.contig, r.start0, r.b_start0, r.ov) for r in I.overlap_join(a, b, width).collect())
        assert got == [("a", 5, 5, 4), ("b", 0, 100, 200), ("b", 0, 999, 1)]
        assert I.overlap_join(a, b, width, "left").where("ov = 0").count() == 1


def test_regions(spark):
    r = one(spark, I.parse_region(F.col("t")), t="chr1:x:1,000-2,500")
    assert (r.contig, r.start0, r.end0) == ("chr1:x", 1000, 2500)
    assert one(spark, I.parse_region(F.col("t")), t="nothing") is None


def test_cigar_and_identity(spark):
    df = values(spark, "qname string, cigar string", [("r", "10S5=2X3I4D6M"), ("i", "90=10X5I5D"), ("u", "*")]).withColumn("ops", S.parse_cigar(F.col("cigar")))
    ops = {r.qname: r.ops for r in df.collect()}
    assert [(o.op, o.len) for o in ops["r"]] == [("S", 10), ("=", 5), ("X", 2), ("I", 3), ("D", 4), ("M", 6)] and ops["u"] is None
    got = {r.qname: r for r in df.select("qname", S.md_span(F.col("ops")).alias("md"), S.condense_cigar(F.col("ops")).alias("c"), S.soft_clip(F.col("ops")).alias("s")).collect()}
    assert got["r"].md == 10 and got["r"].s == 10 and "".join(f"{o.len}{o.op}" for o in got["r"].c) == "10S7M3I4D6M"
    i = S.identities(df.where("qname = 'i'")).first()
    assert (i.by_matches, i.by_events, i.by_all) == (90.0, pytest.approx(9000 / 102), pytest.approx(9000 / 110))


def test_cs_flank_and_masks(spark):
    ops = lambda c: S.parse_cigar(F.lit(c))
    counts = {"matches": 16, "mismatches": 2, "ins": 5, "del": 3, "ins_events": 2, "del_events": 1}
    assert one(spark, S.cs_counts(F.col("cs")), cs=":6*ag*ct:10-acg+tt+aaa").asDict() == counts
    both = values(spark, "cigar string, cs string", [("90=10X", None), ("90=10X", ":1*ag")]).withColumn("ops", S.parse_cigar(F.col("cigar")))
    assert sorted(r.by_matches for r in S.identities(both, cs=F.col("cs")).collect()) == [50.0, 90.0]
    assert one(spark, S.format_cigar(S.drop_opposite_indels(ops("5M4I3M4D6M")))) == "5M3M6M"
    assert one(spark, S.format_cigar(S.drop_opposite_indels(ops("4I2M4D2M4I4M4D3I3M2D")))) == "2M2M4I4M4D3I3M2D"
    for end, want in ((False, 5 / 9), (True, 8 / 10)):
        assert one(spark, S.flank_identity(ops("3S5=4I20=2X2D8="), 9, end)) == pytest.approx(want)
    assert one(spark, S.flank_identity(ops("3S"), 9)) == 0.0
    for lo, hi, want in ((1, 3, "ANNT"), (-5, 1, "NCGT"), (3, 99, "ACGN"), (9, 12, "ACGT"), (2, 1, "ACGT")):
        assert one(spark, S.hard_mask(F.col("s"), F.lit(lo), F.lit(hi)), s="ACGT") == want


def test_more_sources(spark, tmp_path):
    m5 = "q 9000 0 4000 + t 5000 900 4900 - -99 1 2 3 4 254 AC || AC\n"
    r = formats.blasr_m5(spark, write(tmp_path, "a.m5", m5)).first()
    assert (r.q_end, r.t_start, r.mapq, r.pattern) == (4000, 900, 254, "||")
    tree = formats.cut_tree(spark, write(tmp_path, "a.gh", "0 1 9\n1 2 1\n2 3 8\n3 4 7\n5 4 1\n"))
    assert sorted((r.node, r.component) for r in H.prune_cut_tree(tree, 2, 2).collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]
    assert H.prune_cut_tree(tree, 2).count() == 6
    assert [tuple(r) for r in formats.string_graph(spark, write(tmp_path, "a.sg", "a:B b:E x\nb:E c:B TR\n\n")).collect()] == [("a:B", "b:E")]
    assert [tuple(r) for r in formats.partition_vector(spark, write(tmp_path, "a.part", "1\n0\n1\n")).collect()] == [(0, 1), (1, 0), (2, 1)]
    one_, two = write(tmp_path, "1.fa", ">a\nAC\n"), write(tmp_path, "2.fa", ">b\nGT\n")
    both = formats.file_of_files(spark, write(tmp_path, "a.fofn", f"{one_}\n{two}\n"), formats.fasta)
    assert sorted((r.id, r.seq) for r in both.collect()) == [("a", "AC"), ("b", "GT")]
    assert formats.drop_repeated_headers(values(spark, "x string, y string", [("1", "2"), ("x", "y"), ("x", None)])).count() == 2


def test_het_filter_and_alleles(spark):
    df = values(spark, "a int, c int, g int, t int", [(30, 25, 1, 0), (30, 5, 1, 0), (30, 25, 22, 0)])
    assert [r.x for r in df.select(S.heterozygous([F.col(c) for c in "acgt"], 20, 20, 40).alias("x")).collect()] == [True, False, False]
    assert one(spark, S.reverse_complement(F.col("s")), s="ACGTN") == "NACGT"
    tie = S.best_alternate(F.lit("A"), {"A": F.lit(9), "C": F.lit(4), "G": F.lit(4), "T": F.lit(0)})
    assert one(spark, tie) == "C"
    assert one(spark, S.best_alternate(F.lit("A"), {b: F.lit(0) for b in "ACGT"})) == ""


def test_n50(spark):
    assert R.n50(values(spark, "x bigint", [(2,), (3,), (5,), (10,)]), "x").first().n50 == 5
    assert R.n50(values(spark, "x bigint", []), "x").first().n50 is None


def test_pileup(spark):
    for bases, want in (("AACCT*+2ACG", (2, 2, 1, 1, 1, 1)), ("^]AC", (1, 1, 0, 0, 0, 0)), ("A$CG", (1, 1, 1, 0, 0, 0)), ("A-2CGT", (1, 0, 0, 1, 0, 0)), (".,+10ACGTACGTACa", (1, 0, 2, 0, 0, 1))):
        r = one(spark, formats.pileup_counts(F.col("b"), F.lit("G")), b=bases)
        assert tuple(r) == want, bases
    for bases, want in (("A$CG", (1, 0, 1, 0, 0, 0)), ("A-2CGT", (1, 1, 1, 1, 0, 0)), ("AACCT*+2ACG$", (2, 2, 1, 1, 1, 1)), ("+10ACGTACGTACa", (1, 1, 0, 0, 0, 1))):
        r = one(spark, formats.pileup_counts(F.col("b"), F.lit("G"), compat=True), b=bases)
        assert tuple(r) == want, bases


def planted(spark, bridge=False):
    """Three groups of six linked sites, interleaved; every read covers every site."""
    rows = [(r, s, int(r % 3 == s % 3)) for r in range(60) for s in range(18)]
    return values(spark, "read_id bigint, site int, allele int", rows)


def test_planted_clusters(spark):
    m = planted(spark)
    links = H.cut_lineage(G.linkage(m, 10, 30))
    assert links.count() == 18 * 17 // 2
    edges = H.cut_lineage(G.psv_edges(links, 1.5))
    comps = H.connected_components(edges)
    assert comps.select("component").distinct().count() == 3
    signed = edges.select("src", "dst", F.lit(1).alias("sign")).join(comps.select(F.col("node").alias("src"), "component"), "src")
    signed = signed.select(*[F.col(c).cast("bigint").alias(c) for c in ("component", "src", "dst")], "sign")
    one_way = C.correlation_clusters(signed, restarts=3).collect()
    assert sorted(sorted(r.node for r in one_way if r.component == k) for k in range(3)) == [[k + 3 * i for i in range(6)] for k in range(3)]
    # a false bridge between two groups, with repulsion between all their other pairs, is cut again
    extra = [(0, a, b, -1) for a in range(0, 18, 3) for b in range(1, 18, 3) if (a, b) != (0, 1)] + [(0, 0, 1, 1)]
    both = [(0, r.src, r.dst, 1) for r in edges.collect() if r.src % 3 in (0, 1)] + extra
    got = C.correlation_clusters(values(spark, "component bigint, src bigint, dst bigint, sign int", both), restarts=5)
    found = {}
    for r in got.collect():
        found.setdefault(r.cut, set()).add(r.node % 3)
    assert len(found) == 2 and all(len(v) == 1 for v in found.values())
    again = C.correlation_clusters(values(spark, "component bigint, src bigint, dst bigint, sign int", both), restarts=5)
    assert rounded(got.collect()) == rounded(again.collect())


def test_clusters_are_disjoint(spark, small):
    rows = catalogue.queries()["correlation_clusters"](spark, small).collect()
    assert len({(r.component, r.node) for r in rows}) == len(rows)


def test_mec(spark):
    cuts = values(spark, "cut int, site int", [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5), (0, 9), (1, 9)])
    m = planted(spark).where("read_id < 6").unionByName(values(spark, "read_id bigint, site int, allele int", [(99, 9, 1)]))
    # without a variant in common with any cut there is no assignment; of equal mismatches, the more common variants win
    m = m.unionByName(values(spark, "read_id bigint, site int, allele int", [(50, 0, 0), (50, 1, 0), (60, 0, 1), (60, 1, 1), (60, 3, 0), (60, 4, 1), (60, 2, 0)]))
    got = {r.read_id: r.cut for r in G.mec_assignment(m, cuts).collect()}
    assert got == {**{r: r % 3 for r in range(6)}, 50: -1, 60: 1, 99: -1}


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5), (2000, 2000), (None, 3)]
    random.Random(1).shuffle(rows)
    got = {r.node: r.component for r in H.connected_components(values(spark, "src bigint, dst bigint", rows)).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 2000: 2000}
    assert H.connected_components(values(spark, "src bigint, dst bigint", [])).count() == 0


def test_graph_helpers(spark):
    k4 = values(spark, "src int, dst int", [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(3, 4), (4, 5)])
    assert H.triangles(k4).count() == 4
    assert sorted((r.src, r.dst) for r in H.prune_to_fixpoint(k4, 2).collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
    nodes = values(spark, "node bigint, component bigint", [(0, 0), (3, 0), (6, 0), (7, 1)])
    near = H.repulsion_within_radius(nodes, values(spark, "src bigint, dst bigint", [(0, 3)]), 4)
    assert [(r.src, r.dst) for r in near.collect()] == [(3, 6)]
    assert H.repulsion_within_radius(nodes, values(spark, "src bigint, dst bigint", [(0, 3)]), 3).count() == 0
    w = values(spark, "component bigint, src bigint, dst bigint, weight double", [(0, 0, 1, 5.0), (0, 1, 2, 1.0), (0, 0, 2, 4.0)])
    assert sorted((r.src, r.dst) for r in RO.spanning_forest(w).collect()) == [(0, 1), (0, 2)]


def test_repulsion_load(spark):
    """A node with one neighbour gets edges until the next would find more than load times its degree."""
    nodes = values(spark, "node bigint, component bigint", [(i, 0) for i in range(6)])
    edges = values(spark, "src bigint, dst bigint", [(0, 5), (4, 5)])
    got = H.repulsion_within_radius(nodes, edges, 10, load=1.0).collect()
    assert sorted((r.src, r.dst) for r in got) == [(0, 1), (0, 2)]


def test_tsd(spark):
    rnd = random.Random(9)
    text = lambda: "".join(rnd.choice("AC") for _ in range(rnd.randint(0, 12)))
    pairs = [(i, text(), text()) for i in range(40)] + [(40, None, "A"), (41, "GATTACA", "CATTAG")]
    got = {r.id: r for r in AL.common_run(values(spark, "id bigint, a string, b string", pairs)).collect()}
    for i, a, b in pairs:
        a, b = a or "", b or ""
        best = max((n for n in range(len(a) + 1) for k in range(len(a) - n + 1) if a[k : k + n] in b), default=0)
        assert got[i].length == best and len(got[i].run) == best and got[i].run in a and got[i].run in b
    assert got[41].run == "ATTA"


def test_overhang(spark):
    rows = [("head", 9000, 5000, 9000, 9000, 100, 4100), ("tail", 9000, 0, 4000, 5000, 900, 4900), ("in", 9000, 1000, 8000, 9000, 1000, 8000)]
    df = values(spark, "qname string, q_len bigint, q_start bigint, q_end bigint, t_len bigint, t_start bigint, t_end bigint", rows)
    got = {r.qname: (r.end, r.clip_start, r.clip_end) for r in AL.overhangs(df).collect()}
    assert got == {"head": ("head", 0, 4900), "tail": ("tail", 4100, 9000)}


def test_identity_band(spark):
    for per_id, want in ((100.0, "0,100,0"), (99.995, "0,150,0"), (99.8, "0,200,0"), (99.5, "192,192,192"), (96.0, "230,230,230"), (90.0, "255,255,0"), (None, None)):
        assert one(spark, R.identity_band(F.lit(per_id).cast("double"))) == want


def test_consensus_smoothing(spark):
    rows = [(r, s, int(r < 4)) for r in range(8) for s in range(3)]
    rows = [(r, s, 1 - a if (r, s) == (0, 1) else a) for r, s, a in rows]
    m = values(spark, "read_id bigint, site int, allele int", rows)
    near = [(a, b) for a in range(8) for b in range(a + 1, 8) if (a < 4) == (b < 4)]
    got = G.smooth(m, values(spark, "src bigint, dst bigint", near), rounds=5)
    assert {(r.read_id, r.site): r.allele for r in got.collect()} == {(r, s): int(r < 4) for r in range(8) for s in range(3)}


def test_smith_waterman(spark):
    rnd = random.Random(4)
    pairs = [(i, "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 25))), "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 25)))) for i in range(40)]

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    got = {r.id: r.score for r in C.smith_waterman(values(spark, "id bigint, a string, b string", pairs)).collect()}
    assert got == {i: plain(a, b) for i, a, b in pairs}


def test_alignment_pairs_and_snvs(spark):
    df = values(spark, "qname string, rname string, flag int, pos0 bigint, cigar string, seq string", [("r", "c", 0, 2, "1S2=1I1X1D1=", "TACGTA")]).withColumn("ops", S.parse_cigar(F.col("cigar")))
    assert sorted((r.qpos, r.rpos) for r in AL.aligned_pairs(df).collect()) == [(1, 2), (2, 3), (4, 4), (5, 6)]
    ref = values(spark, "contig string, seq string", [("c", "GGACCNA")])
    assert [(r.rpos, r.ref, r.alt) for r in AL.snvs(df, ref).collect()] == [(4, "C", "T")]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r.k == r.v + 1 for r in AL.number_rows(df, ["v"], "k").collect())


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_sources(spark, tmp_path):
    fa = formats.fasta(spark, write(tmp_path, "a.fa", ">c1 first one\nACGT\nNN\n>c2\nTT\n")).collect()
    assert [tuple(r) for r in fa] == [("c1", "first one", "ACGTNN"), ("c2", "", "TT")]
    assert [r.contig_idx for r in formats.fai(spark, write(tmp_path, "a.fai", "c1\t6\t14\t4\t5\nc2\t2\t26\t2\t3\n")).collect()] == [0, 1]
    sam = formats.sam(spark, write(tmp_path, "a.sam", "@SQ\tSN:c1\tLN:6\nq\t16\tc1\t3\t60\t2S4M\t*\t0\t0\tACGTAC\t*\tNM:i:1\tHP:i:2\n"))
    r = sam.first()
    assert (r.qname, r.pos0, r.tags, len(r.ops)) == ("q", 2, {"NM": "1", "HP": "2"}, 2)
    assert [tuple(x) for x in formats.sam_header(spark, str(tmp_path / "a.sam")).collect()] == [("c1", 6, 0)]
    b = formats.bed(spark, write(tmp_path, "a.bed", "#x\ntrack a\nc1\t0\t5\tname\t3.5\nc2\t1\t2\n")).collect()
    assert [(x.contig, x.start0, x.end0, x.rest) for x in b] == [("c1", 0, 5, ["name", "3.5"]), ("c2", 1, 2, [])]
    t = formats.trf(spark, write(tmp_path, "a.dat", "@c1 x\n1 9 3 3.0 3 100 0 18 30 30 30 0 1.5 ACG ACGACGACG\n@c2\nnoise\n5 8 2 2.0 2 90 0 8 50 50 0 0 1.0 AC ACAC\n"))
    assert [(x.contig, x.start, x.Motif) for x in t.orderBy("contig").collect()] == [("c1", 1, "ACG"), ("c2", 5, "AC")]
    rm = formats.repeatmasker(spark, write(tmp_path, "a.out", "SW perc\nscore div\n\n  463 1.3 0.6 1.7 chr1 10001 10468 (24) + (TAACCC)n Simple_repeat 1 471 (0) 1 *\n")).first()
    assert (rm.contig, rm.start, rm["class"]) == ("chr1", 10001, "Simple_repeat")
    fr = formats.fragments(spark, write(tmp_path, "a.frag", "r1 2 c 5,A,C,C,3,4 9,G,T,G,0,8\n"))
    assert sorted((x.site, x.allele) for x in formats.fragments_to_genotypes(fr).collect()) == [(5, 1), (9, 0)]
    assert formats.fragments_to_genotypes(fr, 1, 1).count() == 1
    assert formats.snv_lists(spark, write(tmp_path, "a.snv", "r1\t{3: 1, 8: 0, 3: 0}\n")).first().alleles == {3: 0, 8: 0}
    g = formats.genotype_matrix(spark, write(tmp_path, "a.mat", ".1n\tr1\tall\n")).collect()
    assert [(x.site, x.allele) for x in g] == [(0, 0), (1, 1)]
    assert [tuple(x) for x in formats.cuts(spark, write(tmp_path, "a.cuts", "1\t2\n7\n")).collect()] == [(0, 1), (0, 2), (1, 7)]
    assert [tuple(x) for x in formats.solution(spark, write(tmp_path, "a.sol", "Variable Name\nx_1_2 1.0\n")).collect()] == [(1, 2, 1.0)]
    nodes, edges = formats.gml(spark, write(tmp_path, "a.gml", 'graph [\n node [ id 1 label "a b" ]\n node [ id 2 ]\n edge [ source 1 target 2 weight 3 ]\n]'))
    assert sorted(r.id for r in nodes.collect()) == [1, 2] and edges.first().attrs["weight"] == "3"
    v = formats.simple_vcf(spark, write(tmp_path, "a.vcf", "#c\nc1\t5\tsnp1\tA\tC\t.\tPASS\t*\tGT:GQ\t0/1/1/1:100\n")).first()
    assert (v.pos1, v.alt) == (5, "C")
    parts = formats.subsequence(formats.fasta(spark, str(tmp_path / "a.fa")), values(spark, "contig string, start0 bigint, end0 bigint", [("c1", 1, 3), ("c2", -1, 9)]))
    assert sorted(r.part for r in parts.collect()) == ["CG", "TT"]


def test_sinks(spark, tmp_path):
    seqs = values(spark, "id string, seq string", [("a", "ACGTACGT"), ("b", "TT")])
    sinks.fasta(seqs, str(tmp_path / "fa"))
    assert sorted((r.id, r.seq) for r in formats.fasta(spark, str(tmp_path / "fa")).collect()) == [("a", "ACGTACGT"), ("b", "TT")]
    assert [r.value for r in sinks.fasta_lines(seqs, 3).orderBy("value").collect()] == [">a\nACG\nTAC\nGT", ">b\nTT"]
    sinks.bed(values(spark, "contig string, start0 bigint, end0 bigint, x double", [("b", 1, 2, 0.123456789), ("a", 3, 4, 1.0)]), str(tmp_path / "bed"))
    assert [(r.contig, r.rest) for r in formats.bed(spark, str(tmp_path / "bed")).collect()] == [("a", ["1.0"]), ("b", ["0.1234568"])]
    sinks.vcf_by_cut(values(spark, "cut int, contig string, pos1 bigint, ref string, alt string", [(0, "c", 9, "A", "C"), (0, "c", 2, "G", "T"), (1, "c", 5, "A", "G")]), values(spark, "contig string, len bigint", [("c", 10)]), str(tmp_path / "vcf"))
    lines = spark.read.text(str(tmp_path / "vcf" / "cut=0")).collect()
    assert [r.value.split("\t")[0:2] for r in lines][5:] == [["c", "2"], ["c", "9"]] and lines[3].value == "##contig=<ID=c,length=10>"
    assert lines[5].value == "c\t2\t.\tG\tT\t.\tPASS\tAN=2;AO=NA;RO=NA;AL=NA\tGT\t0|1:100" and lines[1].value.startswith("##INFO=<ID=AO")
    m = sinks.matrix_lines(values(spark, "read_id int, site int, allele int", [(1, 0, 0), (1, 2, 1)]), 4).first()
    assert m.row == ".n1n"
    metis = {r.node: r.value for r in sinks.metis_lines(values(spark, "src int, dst int, weight int", [(0, 1, 4), (1, 2, 6)]), 4).collect()}
    assert metis == {0: "2 4", 1: "1 4 3 6", 2: "2 6", 3: ""}
    lp = sinks.lp_lines(values(spark, "src int, dst int, cost double", [(0, 1, -1.0), (1, 2, 2.0), (0, 2, 1.0)]), values(spark, "i int, j int, k int", [(0, 1, 2)]))
    assert lp.groupBy("part").count().count() == 4 and lp.where("part = 1").count() == 3


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
