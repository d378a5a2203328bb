"""What has no SQL: gaps, aligned strings, clustering steps, writers and readers, against plain versions and hand-computed cases."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import alignment as AL
from strandline.operators import cluster as C
from strandline.operators import rounds as RO
from strandline.operators import gaps as P
from strandline.operators import genotype as G
from strandline.operators import graph as H
from strandline.operators import intervals as I
from strandline.operators import summary as R
from strandline.params import Params
from strandline.plans import reports
from strandline.session import checkpoint_folder
from strandline.sources import formats, sinks

ALN = "qname string, rname string, flag int, mapq int, pos0 bigint, cigar string, seq string"


def alignments(spark, rows):
    return spark.createDataFrame(rows, ALN).withColumn("ops", S.parse_cigar(F.col("cigar")))


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


# intervals


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_islands_by_bins(spark, width):
    """Bins of any width give what one pass over each contig gives."""
    rnd = random.Random(width)
    rows = [(c, s, s + rnd.randint(1, 12)) for c in (1, 2, None) for s in (rnd.randint(-20, 150) for _ in range(60))]
    df = spark.createDataFrame(rows, "contig bigint, start0 bigint, end0 bigint")
    for d in (-1, 0, 3):
        want = []
        for c in (1, 2, None):
            at = None
            for _, s, e in sorted((r for r in rows if r[0] == c), key=lambda r: r[1:]):
                if at and s <= at[2] + d:
                    at[2], at[3] = max(at[2], e), at[3] + 1
                else:
                    at = [c, s, e, 1]
                    want.append(at)
        got = [[r.contig, r.start0, r.end0, r.n] for r in I.merge(df, d, width=width).select("contig", "start0", "end0", "n").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), d


def test_islands_of_repeated_intervals(spark):
    """Equal intervals come in any order after a shuffle; the groups are the same."""
    rows = [(c, s, s + 4) for c in range(40) for s in (0, 10, 10, 20, 20, 20, 30) for _ in range(3)]
    df = spark.createDataFrame(rows, "contig bigint, start0 bigint, end0 bigint").repartition(7)
    for width in (8, 1 << 20):
        got = I.merge(df, -1, width=width).groupBy("start0", "end0", "n").count().collect()
        assert sorted(tuple(r) for r in got) == [(0, 4, 3, 40), (10, 14, 6, 40), (20, 24, 9, 40), (30, 34, 3, 40)]


def test_left_overlap_with_nulls_and_equal_rows(spark):
    a = spark.createDataFrame([("c", 0, 5, None), ("c", 0, 5, None), ("c", 50, 60, None), ("c", 50, 60, "x"), ("d", 0, 5, None)], "contig string, start0 bigint, end0 bigint, note string")
    b = spark.createDataFrame([("c", 3, 9), ("c", 4, 7)], "contig string, start0 bigint, end0 bigint")
    got = sorted((r.contig, r.start0, r.note or "", r.b_start0 or -1, r.ov) for r in I.overlap_join(a, b, 4, "left").collect())
    assert got == [("c", 0, "", 3, 2)] * 2 + [("c", 0, "", 4, 1)] * 2 + [("c", 50, "", -1, 0), ("c", 50, "x", -1, 0), ("d", 0, "", -1, 0)]


# gaps


@pytest.fixture(scope="module")
def small_case(spark):
    #             0         10        20        30
    ref = "ACGTACGTTGCATGCCAATTGGCCAAAAATTTACGTN"
    # ten letters, an insertion TGCA in front of the same in the reference, eight letters, AATT deleted, and on
    read = ref[:8] + "TGCA" + ref[8:16] + ref[20:36]
    rows = [("q1", "c", 0, 60, 0, "8M4I8M4D16M", read), ("q2", "c", 16, 3, 4, "5S12M", "GGGGG" + ref[4:16]), ("q3", "c", 4, 0, 0, "*", "")]
    return alignments(spark, rows), spark.createDataFrame([("c", ref)], "contig string, seq string"), ref


def test_gaps(spark, small_case):
    aln, reference, ref = small_case
    got = {r.svType: r for r in P.gaps(aln, reference, min_length=2, tsd=6, context=3).collect()}
    i, d = got["insertion"], got["deletion"]
    assert (i.tStart, i.tEnd, i.svLen, i.svSeq, i.qStart, i.qEnd, i.dist, i.tsd) == (8, 12, 4, "TGCA", 8, 12, 8, "TGCA")
    assert (d.tStart, d.tEnd, d.svLen, d.svSeq, d.qStart, d.qEnd, d.tsd) == (16, 20, 4, ref[16:20], 20, 20, "notsd")
    assert aln.first().seq[24:27] == "AAA" and d.homopolymer and not i.homopolymer  # the read's letters from the deletion's length on

    assert P.gaps(aln, reference, min_length=5).count() == 0 and P.gaps(aln, reference, 2, max_length=4).count() == 0
    assert P.gaps(aln, reference, 2, min_dist=9).count() == 1 and P.gaps(aln, reference, 2, max_masked=1).count() == 2
    runs = alignments(spark, [("h", "c", 0, 9, 0, "4M3I4M", "ACGTAAAACGT")])
    assert P.gaps(runs, reference, 2).count() == 1 and P.gaps(runs, reference, 2, ignore_homopolymers=True).count() == 0


def test_tsd_on_the_other_side(spark):
    """A duplicate that ends before the insertion is found, too, and the longer one wins."""
    reference = spark.createDataFrame([("c", "TTTTGATTACAGGGG")], "contig string, seq string")
    aln = alignments(spark, [("q", "c", 0, 9, 0, "11M9I4M", "TTTTGATTACA" + "CCGATTACA" + "GGGG")])
    assert [r.tsd for r in P.gaps(aln, reference, 2, tsd=8).collect()] == ["GATTACA"]


def test_parts_of_the_reference(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(50))
    rows = [("c", a, b) for a, b in ((0, 50), (-4, 7), (45, 99), (20, 20), (13, 29), (60, 70))]
    x = spark.createDataFrame(rows, "contig string, a bigint, b bigint")
    got = {(r.a, r.b): r.part for r in P.with_reference_part(x, spark.createDataFrame([("c", seq)], "contig string, seq string"), F.col("a"), F.col("b"), "part", chunk=8).collect()}
    assert got == {(a, b): seq[max(a, 0) : max(b, 0)] for _, a, b in rows}


def test_alignment_side_reports(spark, small_case):
    aln, reference, ref = small_case
    mapped = aln.where("cigar <> '*'")
    assert [r.qname for r in P.gap_free(mapped, 2).collect()] == ["q2"]
    assert {(r.contig, r.rpos) for r in P.unknown_letters(mapped, reference, 8).collect()} == set()
    assert {(r.contig, r.rpos) for r in P.unknown_letters(alignments(spark, [("n", "c", 0, 9, 30, "7M", "AAAAAAA")]), reference, 8).collect()} == {("c", 36)}
    snps = spark.createDataFrame([("c", 5, ref[5]), ("c", 6, "N"), ("c", 18, "A"), ("c", 30, ref[30])], "contig string, rpos bigint, alt string")
    assert sorted((r.qname, r.rpos) for r in P.supported_snps(mapped, snps).collect()) == [("q1", 5), ("q1", 30), ("q2", 5)]
    tagged = mapped.withColumn("tags", F.create_map(F.lit("HP"), F.when(F.col("qname") == "q1", "1").otherwise("2")))
    assert {k: [r.qname for r in v.collect()] for k, v in P.by_haplotype(tagged, "HP", ("1", "2")).items()} == {"1": ["q1"], "2": ["q2"]}
    assert {r.query_name for r in P.identity_table(mapped).collect()} == {"q1", "q2"} and len(P.identity_table(mapped).columns) == 16
    align = lambda r: r.select("qname", *[F.lit(v).cast("bigint").alias(n) for n, v in (("q_len", 9000), ("q_start", 3500), ("q_end", 9000), ("t_len", 20000), ("t_start", 10), ("t_end", 5510))])
    over = P.supporting_overhangs(mapped, spark.createDataFrame([("q1", 0)], "qname string, cut int"), align).collect()
    assert [(r.qname, r.end, r.clip_end) for r in over] == [("q1", "head", 3490)]


# strings


def test_condensed_indels(spark):
    cases = {"10M2I3M4I20M": "10M6I3M20M", "10M2D3=4D2X1D9M": "10M7D5M9M", "5M2I3M4D5M": "5M2I3M4D5M", "1I9M1I": "1I9M1I", "3S4I1M2I": "3S6I1M", "": "", "2I8M1I": "2I8M1I"}
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string").withColumn("out", S.condense_indels(F.col("c"), 8))
    assert {r.c: r.out for r in df.collect()} == cases | {None: None}
    line = "\t".join(["q", "0", "c", "1", "9", "10M2I3M4I20M", "*", "0", "0", "ACG", "*", "NM:i:1"])
    out = [r.value for r in sinks.condensed_sam(spark.createDataFrame([(line,), ("@SQ\tSN:c",)], "value string"), 8).collect()]
    assert sorted(out) == sorted([line.replace("10M2I3M4I20M", "10M6I3M20M"), "@SQ\tSN:c"])


def test_aligned_strings_and_accuracy(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(60):
        ops = [(rnd.randint(1, 6), rnd.choice("MID")) for _ in range(rnd.randint(1, 6))]
        cigar = "".join(f"{n}{o}" for n, o in [(2, "S"), *ops])
        q = 2 + sum(n for n, o in ops if o in "MI")
        t = sum(n for n, o in ops if o in "MD")
        rows.append((k, cigar, "".join(rnd.choice("AC") for _ in range(q)), "".join(rnd.choice("ac") for _ in range(t))))
    df = spark.createDataFrame(rows, "k int, cigar string, seq string, ref string")
    got = {r.k: r for r in df.select("k", S.aligned_strings(F.col("cigar"), F.col("seq")).alias("s"), S.accuracy(F.col("cigar"), F.col("seq"), F.col("ref")).alias("a")).collect()}
    for k, cigar, seq, ref in rows:
        q, t, query, target, match, bad = 0, 0, "", "", 0, 0
        for n, o in re.findall(r"(\d+)(.)", cigar):
            for _ in range(int(n)):
                if o in "MI":
                    query, target = query + seq[q], target + ("M" if o == "M" else "-")
                elif o == "D":
                    query, target = query + "-", target + "D"
                if o == "M":
                    match, bad = match + (seq[q] == ref[t].upper()), bad + (seq[q] != ref[t].upper())
                elif o in "ID":
                    bad += 1
                q, t = q + (o in "MIS"), t + (o in "MD")
        assert (got[k].s.query, got[k].s.target) == (query, target)
        assert got[k].a == (pytest.approx((match - bad) / match) if match else None)


def test_contigs_joined_and_padded(spark):
    x = spark.createDataFrame([(3, "ACG"), (1, "TT"), (9, "GGGG")], "k int, seq string")
    starts = {r.k: r.start0 for r in S.joined_contigs(x, 5).collect()}
    whole = "".join(r.value for r in S.joined_sequence(x, 5).orderBy("k").collect())
    assert whole == "TTNNNNNACGNNNNNGGGG" and {k: whole[s : s + 2] for k, s in starts.items()} == {1: "TT", 3: "AC", 9: "GG"}
    contigs = spark.createDataFrame([("a", "CCC"), ("b", "GGG"), ("c", "TTT")], "id string, seq string")
    tiling = spark.createDataFrame([("a", 0, "r1:B", "r2:E"), ("a", 1, "r2:E", "r3:E"), ("b", 0, "r3:E", "r4:E"), ("c", 0, "r5:E", "r6:B")], "id string, k int, v string, w string")
    reads = spark.createDataFrame([("r1", "AAC"), ("r5", "ACT"), ("r3", "GA")], "read string, seq string")
    assert {r.id: r.seq for r in S.padded_contigs(contigs, tiling, reads).collect()} == {"a_p": "GTTCCC", "b": "GGG", "c_p": "ACTTTT"}


def test_local_alignment_traceback(spark):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9)))) for k in range(80)] + [(99, None, "a")]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    score = {r.id: r.score for r in C.smith_waterman(df).collect()}
    for r in C.local_alignments(df).collect():
        a, b = next((x[1] or "", x[2] or "") for x in rows if x[0] == r.id)
        assert r.score == score[r.id] and r.part_a in a and r.part_b in b
        cost = list(range(len(r.part_b) + 1))
        # the parts align end to end with this score: edits by the plain recurrence
        best = [[-(i + j) for j in range(len(r.part_b) + 1)] for i in range(len(r.part_a) + 1)]
        for i, j in itertools.product(range(1, len(r.part_a) + 1), range(1, len(cost))):
            best[i][j] = max(best[i - 1][j] - 1, best[i][j - 1] - 1, best[i - 1][j - 1] + (1 if r.part_a[i - 1] == r.part_b[j - 1] else -1))
        assert best[-1][-1] == r.score


# genotypes


def test_last_snv_of_a_position_counts(spark, tmp_path):
    fr = formats.fragments(spark, write(tmp_path, "a.frag", "r1 3 c 5,A,C,C,3,4 5,A,C,A,3,4 9,G,T,T,0,8 9,G,T,-,1,1\n"))
    assert sorted((x.site, x.allele) for x in formats.fragments_to_genotypes(fr).collect()) == [(5, 0), (9, 1)]
    assert [[s.pos0 for s in r.snvs] for r in formats.non_reference(fr).collect()] == [[5, 9]]
    many = "r2 20000 c " + " ".join(f"{i},A,C,C,9,9" for i in range(20000)) + "\n"
    assert formats.fragments_to_genotypes(formats.fragments(spark, write(tmp_path, "b.frag", many))).count() == 20000


def test_long_rows_are_read_whole(spark, tmp_path):
    bed = "c\t1\t2\t" + "\t".join(str(i) for i in range(12000))
    assert len(formats.bed(spark, write(tmp_path, "a.bed", bed)).first().rest) == 12000
    sam = "\t".join(["q", "0", "c", "1", "9", "2M", "*", "0", "0", "AC", "*", *(f"{a}{b}:i:1" for a in "ABCDEFGHIJ" for b in "0123456789"), "XS:i:3", "XE:i:9", "XQ:i:77rq=0.5"])
    r = formats.query_bounds(formats.sam(spark, write(tmp_path, "a.sam", sam))).first()
    assert len(r.tags) == 103 and (r.q_start, r.q_end, r.full_length) == (3, 9, 77)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_pairs_in_blocks(spark, monkeypatch, block):
    """Linkage and read scores are the same however sites and reads are dealt."""
    rnd = random.Random(7)
    m = spark.createDataFrame([(r, (s % 2 << 32) + s, rnd.randint(0, 1)) for r in range(14) for s in range(8) if rnd.random() < 0.7], "read_id bigint, site bigint, allele int")
    want = sorted(map(tuple, G.read_scores(m).collect())), sorted(map(tuple, G.linkage(m, 1, 5, 1).collect()))
    monkeypatch.setattr(G, "BLOCK", block)
    assert (sorted(map(tuple, G.read_scores(m).collect())), sorted(map(tuple, G.linkage(m, 1, 5, 1).collect()))) == want
    with_zero = G.linkage(m, 1, 5, 1)
    assert sorted(map(tuple, G.linkage(m, 1, 5, 1, zero_pairs=False).collect())) == sorted(map(tuple, with_zero.where("n_overlap > 0").collect()))


# graphs and clusters


def test_prune_to_fixpoint_equals_plain(spark, small):
    e = reports.spark_view(spark, small, "v_edges_dense")
    edges = {(r.src, r.dst) for r in e.collect()}
    for least in (3, 5, 7):
        left = set(edges)
        while True:
            near = {}
            for a, b in left:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
            now = {(a, b) for a, b in left if len(near[a] & near[b]) >= least}
            if now == left:
                break
            left = now
        assert {(r.src, r.dst) for r in H.prune_to_fixpoint(e, least).collect()} == left


def test_forest_cliques_parts(spark, small):
    e = [(r.component, r.src, r.dst, r.weight) for r in reports._with_component(spark, small).collect()]
    got = [(r.component, r.src, r.dst, r.weight) for r in reports.spanning_forest(spark, small).collect()]
    nodes = {n for _, a, b, _ in e for n in (a, b)}
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    total = 0.0
    for _, a, b, w in sorted(e, key=lambda x: -x[3]):
        if root(a) != root(b):
            up[root(a)] = root(b)
            total += w
    assert sum(x[3] for x in got) == total and len(got) == len(nodes) - len({c for c, *_ in e}) and set(got) <= set(e)
    near = {n: {b for _, a, b, _ in e if a == n} | {a for _, a, b, _ in e if b == n} for n in nodes}

    def largest(clique, rest):
        return max([len(clique), *(largest(clique | {n}, rest & near[n]) for n in rest)])

    assert {r.node: r.clique for r in reports.clique_numbers(spark, small).collect()} == {n: largest({n}, near[n]) for n in nodes}
    part = {r.node: (r.component, r.part, r.score) for r in reports.partition_graph(spark, small).collect()}
    for c in {c for c, *_ in e}:
        sizes = [sum(x[:2] == (c, p) for x in part.values()) for p in (0, 1)]
        assert abs(sizes[0] - sizes[1]) <= 1
        score = sum((2 if part[a][1] == part[b][1] else -2) * w for k, a, b, w in e if k == c)
        assert {x[2] for x in part.values() if x[0] == c} == {score}


def test_condensed_triangles(spark):
    """Two triangles that share an edge, and a tail; the one with fewer missing neighbours goes first."""
    e = spark.createDataFrame([(0, a, b, 1.0) for a, b in ((1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5), (5, 6))], "component bigint, src bigint, dst bigint, cost double")
    t = H.triangle_scores(e.withColumn("sign", F.lit(1)))
    assert {(r.i, r.j, r.k): (r.missing, r.phase) for r in t.collect()} == {(1, 2, 3): (8, 8), (2, 3, 4): (9, 8)}
    roots = lambda n: {r.node: r.root for r in RO.condense_triangles(e, t, n).collect()}
    assert roots(6) == {n: n for n in range(1, 7)} and roots(4) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6} and roots(1) == roots(4)


def test_tests_have_known_p_values(spark):
    a = spark.createDataFrame([(float(x),) for x in range(40)], "v double")
    b = a.select((F.col("v") + 8).alias("v"))
    r = R.ks_test(a, b, "v").first()
    assert (r.n, r.m) == (40, 40) and r.statistic == pytest.approx(0.2) and r.p_value == pytest.approx(0.4005, abs=1e-3)
    same = R.ks_test(a, a, "v").first()
    assert same.statistic == 0 and same.p_value == 1.0
    for shift in (0.5, 3.0, 30.0):
        d = [((i * 37 % 41) - 20 + shift) for i in range(60)]
        pairs = spark.createDataFrame([(x, 0.0) for x in d], "a double, b double")
        r = R.signed_rank_test(pairs, "a", "b").first()
        size = sorted(abs(x) for x in d if x)
        rank = {s: size.index(s) + (size.count(s) + 1) / 2 for s in size}
        w, n = sum(rank[abs(x)] for x in d if x > 0), len(size)
        var = n * (n + 1) * (2 * n + 1) / 24 - sum(size.count(s) ** 3 - size.count(s) for s in set(size)) / 48
        assert r.n == n and r.statistic == w and r.p_value == pytest.approx(math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)), rel=1e-6)


def test_columns_and_unions(spark, tmp_path):
    x = spark.createDataFrame([(1, 2, 3)], "a int, `7` int, ab int")
    assert R.columns_like(x, drop_numbers=True).columns == ["a", "ab"] and R.columns_like(x, pattern="^a.").columns == ["ab"]
    x.write.parquet(str(tmp_path / "one"))
    got = sinks.appended(spark, [str(tmp_path / "none"), str(tmp_path / "one"), str(tmp_path / "one")], spark.read.parquet)
    assert got.count() == 2 and sinks.appended(spark, [str(tmp_path / "none")], spark.read.parquet) is None


# writers and readers


@pytest.mark.parametrize("kind", ["gml", "gexf", "graphml"])
def test_graph_files(spark, tmp_path, kind):
    nodes = spark.createDataFrame([(1,), (2,), (5,)], "id bigint")
    edges = spark.createDataFrame([(1, 2, 3.5), (2, 5, 1.0)], "src bigint, dst bigint, weight double")
    sinks.graph(nodes, edges, str(tmp_path / f"g.{kind}"))
    text = "\n".join((tmp_path / f"g.{kind}" / f).read_text().strip() for f in sorted(p.name for p in (tmp_path / f"g.{kind}").glob("part-*")))
    n, e = formats.graph(spark, write(tmp_path, f"one.{kind}", text))
    assert sorted(r.id for r in n.collect()) == [1, 2, 5]
    assert sorted((r.src, r.dst, float(r.attrs["weight"])) for r in e.collect()) == [(1, 2, 3.5), (2, 5, 1.0)]
    assert text.startswith(sinks.GRAPH_ENDS[kind][0]) and text.endswith(sinks.GRAPH_ENDS[kind][1])
    with pytest.raises(ValueError):
        formats.graph(spark, "x.txt")


def test_whole_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, -1.0), (1, 2, 2.0), (0, 2, 1.0)], "src int, dst int, cost double")
    lp = [r.value for r in sinks.lp_file(edges, H.triangles(edges)).orderBy("part", "k").collect()]
    assert lp[0] == "Minimize\nrepulsion:" and lp[-1] == "End" and lp.index("Subject To") < lp.index("Bounds") < lp.index("binary")
    assert sum(x.endswith(">= 0") and ": " in x for x in lp) == 3
    metis = [r.value for r in sinks.metis_file(edges.withColumn("weight", F.lit(4)), 3).orderBy("node").collect()]
    assert metis == ["3 3 1", "2 4 3 4", "1 4 3 4", "1 4 2 4"]
    seqs = spark.createDataFrame([("b", "ACGTACG"), ("a", "TT")], "id string, seq string")
    sinks.fasta(seqs, str(tmp_path / "fa"), shards=2, width=3)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "fa")).collect()) == sorted([">b", "ACG", "TAC", "G", ">a", "TT"])
    assert sorted((r.id, r.seq) for r in sinks.renamed(seqs, "contig_", 4).collect()) == [("contig_4", "TT"), ("contig_5", "ACGTACG")]
    sinks.fasta_by_record(seqs, str(tmp_path / "each"))
    assert sorted(p.name for p in (tmp_path / "each").glob("record=*")) == ["record=a", "record=b"]
    sinks.adjacency(edges.withColumn("weight", F.lit(1)), str(tmp_path / "adj"))
    assert spark.read.csv(str(tmp_path / "adj"), sep="\t", header=True).count() == 3
    sinks.scores(spark.createDataFrame([(1, 2, 0.5)], "a int, b int, score double"), str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).first().score == 0.5
    sinks.tsv(edges, str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).columns == ["src", "dst", "cost"]
    sinks.sam_by_group(spark.createDataFrame([("x\t0", 3)], "value string, grp int"), str(tmp_path / "groups"))
    assert [(r.value, r.grp) for r in spark.read.text(str(tmp_path / "groups")).collect()] == [("x\t0\tcc:i:3", 3)]


def test_further_readers(spark, tmp_path):
    head = formats.sam_header(spark, write(tmp_path, "h.sam", "@HD\tVN:1\n@SQ\tSN:b\tLN:9\n@SQ\tSN:a\tLN:7\n@PG\tID:x\tPN:y\n"))
    assert sorted((r.contig, r.len, r.contig_idx) for r in head.collect()) == [("a", 7, 1), ("b", 9, 0)]
    assert [r.id for r in formats.sam_programs(spark, str(tmp_path / "h.sam")).collect()] == ["x"]
    row = lambda n, p: "\t".join([n, "0", "c", str(p), "9", "5M", "*", "0", "0", "ACGTA", "*"])
    sam = write(tmp_path, "r.sam", "\n".join([row("a", 1), row("b", 6), row("c", 11)]))
    assert sorted(r.qname for r in formats.sam_region(spark, sam, "c", 4, 10).collect()) == ["a", "b"]
    sol = formats.solution(spark, write(tmp_path, "s.sol", "x_9_9 1\nfoo\nVariable Name   Solution Value\nx_1_2   1.0\n\nx_3_4 0.25\n"))
    assert sorted(map(tuple, sol.collect())) == [(1, 2, 1.0), (3, 4, 0.25)]
    lay = formats.gml_layout(spark, write(tmp_path, "l.gml", 'graph [ node [ id 0 label "3" graphics [ x 1.5 y -2 z 0 ] ] node [ id 1 label "no" graphics [ x 4 y 5 z 6 ] ] ]'))
    assert sorted((r.label, r.x, r.y, r.z) for r in lay.collect()) == [(0, 4.0, 5.0, 6.0), (3, 1.5, -2.0, 0.0)]
    m4 = formats.blasr_m4(spark, write(tmp_path, "a.m4", "qName tName score pctsimilarity qStrand qStart qEnd qLength tStrand tStart tEnd tLength mapQV\nq t -5 99.5 0 1 9 10 1 2 8 20 254\n")).collect()
    assert [(r.tname, r.identity, r.t_start, r.t_strand) for r in m4] == [("t", 99.5, 2, 1)]
    rm = formats.repeatmasker(spark, write(tmp_path, "a.out", "463 1.3 0.6 1.7 chr1 1 9 (24) + (T)n S 1 471 (0) 1 *\n463 1.3 0.6 1.7 chr1 1 9 (24) + (T)n S 1 471 (0) 1\n"))
    assert sorted(r.better for r in rm.collect()) == ["*", "."]
    bed, mat = formats.trf_tables(formats.trf(spark, write(tmp_path, "a.trf", "@c1 x\n1 9 3 3.0 3 100 0 18 33 33 33 0 1.58 ACG ACGACGACG\n")))
    assert tuple(bed.first()) == ("c1", 0, 9) and mat.columns == ["contig", *formats.TRF_NAMES]
    paths = [write(tmp_path, f"g.{k}.bed", f"c\t{k}\t9") for k in (3, 12)]
    got = formats.by_glob(spark, str(tmp_path / "g.*.bed"), r"g\.([0-9]+)\.bed$", lambda p: spark.read.csv(p, sep="\t", schema="contig string, start0 int, end0 int"))
    assert sorted((r.path_id, r.start0) for r in got.collect()) == [("12", 12), ("3", 3)] and paths
    assert formats.reads_source("x.bam") == "aligned" and formats.reads_source("x.fofn") == "reads" and formats.reads_source("x.fq.gz", "ont") == "reads"
    for path, platform in (("x.bam", "ont"), ("x.fofn", "ont"), ("x.txt", "ccs")):
        with pytest.raises(ValueError):
            formats.reads_source(path, platform)


def test_platform_names_and_checkpoints(spark, monkeypatch):
    assert Params(50, "CCS").for_platform().min_shared == 2 and Params(50, "ONT").platform == "ont"

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        checkpoint_folder(Session)
    assert checkpoint_folder(spark)


def test_psv_queries_on_whole_reads(spark):
    """Variants where contigs have them, and where reads and reference differ, letter by letter."""
    ref = "".join(random.Random(5).choice("ACGT") for _ in range(3000))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    read = "".join(other[c] if i in (100, 1500, 2047, 2048) else c for i, c in enumerate(ref[500:2900]))
    aln = alignments(spark, [("group.1_a", "c", 0, 9, 500, "2400M", read)])
    got = sorted((r.rpos, r.ref, r.alt) for r in AL.snvs(aln, spark.createDataFrame([("c", ref)], "contig string, seq string")).collect())
    assert got == [(500 + i, ref[500 + i], read[i]) for i in (100, 1500, 2047, 2048)]
    psvs = spark.createDataFrame([("c", 600, read[100], 1), ("c", 2000, read[1500], 2)], "contig string, rpos bigint, alt string, grp int")
    at = AL.psv_locations(aln, psvs)
    assert [(r.qpos, r.truealt) for r in at.collect()] == [(100, read[100])]
    assert AL.psv_mismatches(at, spark.createDataFrame([("group.1_a", read)], "id string, seq string")).count() == 0
