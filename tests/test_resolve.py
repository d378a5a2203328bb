"""Planted copies, from alignments to clusters and reads."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import alignment as AL
from strandline.operators import summary as R
from strandline.params import EmptyStageError, Params
from strandline.plans.resolve import resolve

ROWS = "qname string, rname string, flag int, pos0 bigint, cigar string, seq string"


def test_params():
    p = Params(100, platform="ccs", min_shared=7).for_platform()
    assert (p.min_shared, p.max_pos_rep, p.min_lrt, p.min_cut_size, p.accuracy) == (7, 1, 1.0, 2, 0.98)
    assert Params(100).for_platform() == Params(100) and Params(100, min_cov=8).limits["min_reads"] == 4
    for bad in ({"coverage": 0}, {"coverage": 9, "platform": "other"}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_bases_and_snvs_over_chunks(spark):
    rnd = random.Random(3)
    ref = "".join(rnd.choice("ACGTN") for _ in range(300))
    rows, want_bases, want = [], [], []
    for n in range(20):
        at, r, q, seq, cigar = rnd.randrange(50), 0, 0, "", ""
        r = at
        for op in rnd.choices("MIDS=XN", k=8):
            k = rnd.randint(1, 30)
            k = min(k, 300 - r) if op in "MDN=X" else k
            if k <= 0:
                continue
            cigar += f"{k}{op}"
            if op in "MIS=X":
                part = "".join(rnd.choice("ACGTNacgt") for _ in range(k))
                if op in "M=X":
                    for d, base in enumerate(part.upper()):
                        if base != "N":
                            want_bases.append((f"r{n}", r + d, base))
                            if ref[r + d] not in (base, "N"):
                                want.append((f"r{n}", r + d, ref[r + d], base))
                seq += part
            r += k if op in "MDN=X" else 0
        rows.append((f"r{n}", "c", 0, at, cigar or "*", seq))
    df = spark.createDataFrame(rows, ROWS).withColumn("ops", S.parse_cigar(F.col("cigar")))
    contig = spark.createDataFrame([("c", ref), ("empty", "")], "contig string, seq string")
    assert sorted((x.qname, x.rpos, x.base) for x in AL.base_rows(df, 16).collect()) == sorted(want_bases)
    assert sorted((x.qname, x.rpos, x.ref, x.alt) for x in AL.snvs(df, contig, 16).collect()) == sorted(want)


def test_psv_locations(spark):
    rows = [("group.0.a", "c", 0, 2, "1S6M", "TACGTAC"), ("group.1.b", "c", 16, 0, "4M1D4M", "GGATCGTA"), ("group.0.c", "c", 0, 4, "2M", "NN")]
    df = spark.createDataFrame(rows, ROWS).withColumn("ops", S.parse_cigar(F.col("cigar")))
    psvs = spark.createDataFrame([("c", 3, "C", 0), ("c", 3, "T", 1), ("c", 4, "G", 1), ("c", 4, "N", 0), ("c", 5, "C", 1), ("c", 5, "A", 0)], "contig string, rpos bigint, alt string, grp int")
    for chunk in (3, 1024):
        got = {(r.qname, r.rpos, r.qpos, r.base) for r in AL.bases_at(df, psvs.select("contig", "rpos").distinct(), chunk=chunk).collect()}
        assert got == {("group.0.a", 3, 2, "C"), ("group.0.a", 4, 3, "G"), ("group.0.a", 5, 4, "T"), ("group.1.b", 3, 3, "T"), ("group.1.b", 5, 4, "C")}
    found = AL.psv_locations(df, psvs)
    assert sorted(tuple(r) for r in found.collect()) == [("c", "group.0.a", 0, 2, "C"), ("c", "group.1.b", 1, 3, "G"), ("c", "group.1.b", 1, 4, "A")]
    seqs = spark.createDataFrame([("group.0.a", "TACGTAC"), ("group.1.b", "TACGATCA")], "id string, seq string")
    assert [(r.qpos, r.truealt, r.base) for r in AL.psv_mismatches(found, seqs).collect()] == []
    wrong = seqs.where("id <> 'group.1.b'").unionByName(spark.createDataFrame([("group.1.b", "TACGTTCA")], "id string, seq string"))
    assert [(r.qpos, r.truealt, r.base) for r in AL.psv_mismatches(found, wrong).collect()] == [(4, "A", "T")]


def test_most_frequent(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, "z"), (2, "z"), (2, "a")], "g int, name string")
    assert sorted(tuple(r) for r in R.most_frequent(df, "name", "g").collect()) == [(1, "a", 1), (2, "z", 2)]


def copies(n_reads=60, n_sites=18, gap=20):
    """Two contigs; on each, three copies that differ from the contig at every third site."""
    rows, refs, truth = [], [], {}
    swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
    for c in ("c1", "c2"):
        ref = "".join(random.Random(c).choice("ACGT") for _ in range(gap * (n_sites + 1)))
        refs.append((c, ref))
        for r in range(n_reads):
            seq = list(ref)
            for s in range(n_sites):
                if s % 3 == r % 3:
                    seq[gap * (s + 1)] = swap[seq[gap * (s + 1)]]
            rows.append((f"{c}/{r}", c, 16 * (r % 2), 0, f"{len(ref)}M", "".join(seq)))
            truth[f"{c}/{r}"] = (c, r % 3)
    return rows, refs, truth


def test_planted_copies(spark, tmp_path):
    rows, refs, truth = copies()
    al = spark.createDataFrame(rows, ROWS).withColumn("ops", S.parse_cigar(F.col("cigar")))
    ref = spark.createDataFrame(refs, "contig string, seq string")
    contigs = spark.createDataFrame([("c1", 0), ("c2", 1)], "contig string, contig_idx int")
    p = Params(20, min_aln=100, min_cut_len=50, restarts=2, keep=str(tmp_path))
    out = resolve(al, ref, contigs, p)
    assert out.sites.count() == 36
    kept = {x.name for x in tmp_path.iterdir()}
    assert kept == {"sites", "matrix", "links", "edges", "components", "repulsion", "clusters", "cuts"} and spark.read.parquet(f"{tmp_path}/sites").count() == 36
    rows = out.summary.collect()
    assert sorted((r.contig_idx, r["first"], r["last"], r.n_psvs, r.n_reads, r.n_unique_reads) for r in rows) == sorted(
        (c, 20 * (k + 1), 20 * (k + 16), 6, 20, 20) for c in range(2) for k in range(3)
    )
    names = out.matrix.select("read_id", "qname").distinct()
    groups = {}
    for r in out.assigned.join(names, "read_id").collect():
        groups.setdefault(r.cut, set()).add(truth[r.qname])
    assert len(groups) == 6 and all(len(v) == 1 for v in groups.values())
    with pytest.raises(EmptyStageError):
        resolve(al.where("qname = 'c1/0'"), ref, contigs, p)
