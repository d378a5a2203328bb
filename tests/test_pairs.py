"""Pairs of reads by blocks, against plain loops."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import alignment as AL
from strandline.operators import cluster as C
from strandline.operators import gaps as P
from strandline.operators import genotype as G
from strandline.operators import pairs
from strandline.plans import reports


def plain(rows):
    """(a, b): common rows, those with equal alleles, those with different ones."""
    out = {}
    for (a, s, x), (b, t, y) in itertools.product(rows, rows):
        if a is not None and b is not None and a < b and s is not None and s == t:
            n = out.setdefault((a, b), [0, 0, 0])
            n[0] += 1
            if x is not None and y is not None:
                n[1 if x == y else 2] += 1
    return out


def cells(seed, reads, sites):
    rnd = random.Random(seed)
    rows = [(r, s, rnd.choice([0, 1, 1, 2, None])) for r in reads for s in sites if rnd.random() < 0.4]
    return rows + rows[:9] + [(None, 3, 1), (reads[0], None, 0), ("zz", 10**12, 1), ("zy", -5, 0)]


@pytest.mark.parametrize("tile", [1024, 3])
def test_read_pairs_equal_plain_loops(spark, monkeypatch, tile):
    """Names as ids, null alleles, repeated cells, several alleles, sites beyond 32 bits."""
    monkeypatch.setattr(pairs, "TILE", tile)
    rows = cells(3, [f"r{i:02}" for i in range(23)], range(12))
    m = spark.createDataFrame(rows, "read_id string, site bigint, allele int")
    want = plain(rows)
    assert sorted(map(tuple, G.read_scores(m, 2.0).collect())) == sorted((a, b, e, d, e - 2.0 * d) for (a, b), (_, e, d) in want.items())
    spans = {r: [s for q, s, _ in rows if q == r and s is not None] for r in {r for r, _, _ in rows if r}}
    spans = {r: (min(s), max(s)) for r, s in spans.items() if min(s) < max(s)}
    meet = [(a, b) for a in spans for b in spans if a < b and spans[a][0] <= spans[b][1] and spans[b][0] <= spans[a][1]]
    over = sorted((a, b, sum(want.get((a, b), (0, 0, 0))[1:]), want.get((a, b), (0, 0, 0))[1]) for a, b in meet)
    assert sorted(map(tuple, G.fragment_overlaps(m).collect())) == over
    best = {}
    for (a, b), (_, e, d) in want.items():
        for x, y in ((a, b), (b, a)):
            best.setdefault(x, []).append((-(e - d), y))
    top = sorted((x, y, -s, k) for x, p in best.items() for k, (s, y) in enumerate(sorted(p)[:4], 1))
    assert sorted(map(tuple, G.top_neighbours(m, 4).collect())) == top
    # reads of two groups, of none, of a null one
    groups = [(f"r{i:02}", i % 3) for i in range(20)] + [("r01", 0), ("r02", None)]
    sums = {}
    for (a, b), (_, e, d) in want.items():
        for x, y in ((a, b), (b, a)):
            for _, g in (p for p in groups if p[0] == x):
                for _, h in (p for p in groups if p[0] == y):
                    s = sums.setdefault(x, ([], []))
                    if g is not None and h is not None:
                        s[g != h].append((e, d))
    mean = lambda v, k: sum(x[k] for x in v) / len(v) if v else None
    got = G.inner_outer_scores(m, spark.createDataFrame(groups, "read_id string, grp int")).collect()
    assert sorted(map(tuple, got)) == sorted((x, mean(i, 0), mean(i, 1), mean(o, 0), mean(o, 1)) for x, (i, o) in sums.items())


def test_many_sites_in_parts(monkeypatch):
    rnd = random.Random(5)
    table = pa.table({"read_id": range(7), "site": [rnd.sample(range(30), rnd.randint(1, 20)) for _ in range(7)]})
    table = table.append_column("allele", pa.array([[rnd.choice([0, 1, None]) for _ in s] for s in table["site"].to_pylist()], pa.list_(pa.int64())))
    a, b = pairs.Tile(table.slice(0, 4)), pairs.Tile(table.slice(4))
    want = pairs.shared(a, b)
    monkeypatch.setattr(pairs, "SITES", 3)
    assert all((x == y).all() for x, y in zip(pairs.shared(a, b), want, strict=True))


@pytest.mark.parametrize("sent", [16, 2])
def test_groups_of_blocks_give_the_same_pairs(spark, monkeypatch, sent):
    """Blocks that all meet, in groups of several blocks, and blocks that meet few others, some of which stay unpacked, some not."""
    monkeypatch.setattr(pairs, "TILE", 3)
    monkeypatch.setattr(pairs, "SENT", sent)
    monkeypatch.setattr(pairs, "CELLS", 40)
    rows = cells(4, [f"r{i:02}" for i in range(40)], range(9))
    rows += [(f"x{i:02}", 100 + 2 * i + k, (i + k) % 2) for i in range(40) for k in range(5)]
    m = spark.createDataFrame(rows, "read_id string, site bigint, allele int")
    want = sorted((a, b, e, d, e - d) for (a, b), (_, e, d) in plain(rows).items())
    assert sorted(map(tuple, G.read_scores(m).collect())) == want


def test_blocks_are_sent_a_few_times():
    """When all blocks meet, groups grow with them: a block is sent to about SENT units, not to as many as there are blocks."""
    for n in (10, 67, 1000):
        per = pairs.blocks_of_group(n, n * (n + 1) // 2, 650_000)
        assert per == 1 or -(-n // per) <= max(pairs.SENT, -(-n // max(1, pairs.HELD // 650_000)))
    assert pairs.blocks_of_group(67, 67 * 34, 650_000) > 1 and pairs.blocks_of_group(1000, 3000, 650_000) == 1
    assert pairs.blocks_of_group(10**6, 10**10, 10**9) == 1 and pairs.blocks_of_group(0, 0, 1) == 1


def test_pairs_below_limits_stay_in_their_task(spark):
    """With limits, fewer rows leave the tasks; they are those that the limits keep of all."""
    rows = cells(7, [f"r{i:02}" for i in range(30)], range(12))
    m = spark.createDataFrame(rows, "read_id string, site bigint, allele int")
    every = [tuple(r) for r in G.fragment_overlaps(m).collect()]
    for n, share in ((3, 0.75), (1, 0.5), (2, 0.0), (3, 1 / 3)):
        want = sorted(r for r in every if r[2] >= n and r[3] / r[2] >= share)
        assert sorted(map(tuple, G.fragment_overlaps(m, n, share).collect())) == want and 0 < len(want) < len(every)
    for penalty in (1.0, 0.7):
        scores = [tuple(r) for r in G.read_scores(m, penalty).collect()]
        want = sorted(r for r in scores if r[4] >= 1.3)
        assert sorted(map(tuple, G.read_scores(m, penalty, 1.3).collect())) == want and 0 < len(want) < len(scores)


def test_counts_of_tiles(monkeypatch):
    """One, two and more alleles, nulls, repeated cells, no common site; matrices that are kept and those that are not."""
    rnd = random.Random(15)

    def tile(n, sites, alleles):
        site = [[rnd.choice(sites) for _ in range(rnd.randint(1, 9))] for _ in range(n)]
        return pairs.Tile(pa.table({"read_id": range(n), "site": site, "allele": pa.array([[rnd.choice(alleles) for _ in s] for s in site], pa.list_(pa.int64()))}))

    def counted(a, b, i, j):
        x, y = ([(s, v) for s, v in zip(t.table["site"][k].as_py(), t.table["allele"][k].as_py(), strict=True)] for t, k in ((a, i), (b, j)))
        both = [(v, w) for s, v in x for t, w in y if s == t]
        known = [(v, w) for v, w in both if v is not None and w is not None]
        return len(both), len(known), sum(v == w for v, w in known)

    for kept in (512, 0):
        monkeypatch.setattr(pairs, "KEPT", kept)
        for left, right, far in (([0], [0], 0), ([0, 1], [0, 1], 0), ([0, 1], [1], 0), ([0], [5], 0), ([0, 1, None], [1, 2], 0), ([None], [None], 0), ([0, 1], [0, 1], 99)):
            a, b, c = tile(5, range(8), left), tile(4, range(far, far + 8), right), tile(3, range(6), right)
            for x, y in ((a, b), (a, c), (b, a), (a, b), (a, a)):
                got = pairs.shared(x, y)
                assert all(tuple(g[i, j] for g in got) == counted(x, y, i, j) for i in range(x.n) for j in range(y.n))


def test_shares_have_nine_digits(spark):
    """As `round` gives them, also halves and shares of many."""
    rows = [(q / n,) for n in (1, 3, 7, 64, 1000, 1024, 3072, 5120, 2**20, 10**6 + 3) for q in {0, 1, 5, n // 3, n - 1, n}] + [(None,)]
    df = spark.createDataFrame(rows, "weight double")
    assert df.where(~reports._share("weight").eqNullSafe(F.round("weight", 9))).count() == 0


def test_pairs_are_not_shuffled(spark):
    """A pair comes out of the two blocks that its reads are in; nothing is shuffled for each pair and site."""
    m = spark.createDataFrame([(r, s, 0) for r in range(6) for s in range(4)], "read_id bigint, site bigint, allele int")
    for df in (G.read_scores(m), G.fragment_overlaps(m), G.similar_reads(G.read_scores(m), 2.0)):
        above = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
        assert len(above) > 1 and "Exchange" not in above[0]
    assert G.read_scores(m.where(F.lit(False))).count() == 0 and G.top_neighbours(m.where(F.lit(False)), 2).count() == 0


def test_alignments_of_many_lengths(spark):
    """Score and end, the first row and then column of the best score, for pairs that go through their tables together; nulls are empty."""
    rnd = random.Random(8)
    text = lambda: rnd.choice(["", "A" * 40, None] + ["".join(rnd.choice("ACGTé") for _ in range(rnd.randint(0, 60))) for _ in range(9)])
    rows = [(k, text(), text()) for k in range(200)]

    def plain(a, b, match, mismatch, gap):
        above, best = [0] * (len(b) + 1), (0, 0, 0)
        for i, x in enumerate(a, 1):
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(max(0, above[j - 1] + (match if x == y else mismatch), above[j] + gap, row[-1] + gap))
                if row[-1] > best[0]:
                    best = (row[-1], i, j)
            above = row
        return best

    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    for costs in ((1, -1, -1), (300, -2, -1), (2, 1, -1), (1, 0, 0), (1, 2, -3)):
        got = {r.id: (r.score, r.end_a, r.end_b) for r in C.smith_waterman(df, *costs).collect()}
        assert got == {k: plain((a or "").encode(), (b or "").encode(), *costs) for k, a, b in rows}


def test_alignments_of_a_lot_take_little():
    """Texts of one length are one table: many pairs take no more calls of numpy than one."""
    texts = [(b"ACGT" * 100, b"AGCT" * 100)] * 64
    calls = sum(1 for lot in C._together([(len(a), len(b)) for a, b in texts], alone=False))
    assert calls == 1 and len(set(C._aligned(texts, 1, -1, -1))) == 1


def test_common_run_of_long_texts(spark):
    """A table of 200,000 by 200,000 places would not end; of several runs the one that ends last in a counts."""
    rnd = random.Random(9)
    a, b = ("".join(rnd.choice("ACGT") for _ in range(200_000)) for _ in range(2))
    run = "".join(rnd.choice("ACGT") for _ in range(5000))
    rows = [(1, a[:70_000] + run + a[70_000:], b + run), (2, "abxab", "ab"), (3, None, "a"), (4, "é\U0001f600x", "y\U0001f600x")]
    got = {r.id: (r.run, r.length) for r in AL.common_run(spark.createDataFrame(rows, "id bigint, a string, b string")).collect()}
    assert run in got[1][0] and got[1][1] == len(got[1][0]) < 5050 and got[2] == ("ab", 2) and got[3] == ("", 0) and got[4] == ("\U0001f600x", 2)


def test_reference_in_chunks_and_pair_sums(spark):
    """A reference that comes in chunks gives the same gaps as whole contigs; sums of pairs equal those over their rows."""
    rnd = random.Random(6)
    ref = {c: "".join(rnd.choice("ACGTn") for _ in range(n)) for c, n in (("c", 5000), ("d", 1024), ("e", 2100))}
    rows = [(f"q{k % 30}", c, 16 * (k % 2), rnd.randint(0, len(ref[c]) - 200), f"3S{rnd.randint(9, 40)}={rnd.randint(3, 9)}I20M{rnd.randint(3, 9)}D30=2X", "".join(rnd.choice("ACGT") for _ in range(140))) for k in range(60) for c in ref]
    aln = spark.createDataFrame(rows + [("none", "c", 4, 0, "*", "A"), ("clip", "c", 0, 0, "5S", "ACGTA")], "qname string, rname string, flag int, pos0 bigint, cigar string, seq string").withColumn("ops", S.parse_cigar(F.col("cigar")))
    whole = spark.createDataFrame(list(ref.items()), "contig string, seq string")
    parts = [(c, k, s[k * 1024 : (k + 1) * 1024]) for c, s in ref.items() for k in range(-(-len(s) // 1024))]
    chunks = spark.createDataFrame(parts, "contig string, bin bigint, part string")
    assert sorted(map(tuple, AL._chunks(whole, 1024).collect())) == sorted((c, k, p.upper()) for c, k, p in parts)
    got, want = (sorted(map(str, P.gaps(aln, r, 3, tsd=4, context=2).collect())) for r in (chunks, whole))
    assert got == want and len(got) == 360
    sums = AL.aligned_pairs(aln).groupBy("qname").agg(F.count("*"), F.sum("qpos"), F.sum("rpos"))
    assert sorted(map(tuple, AL.aligned_pair_sums(aln).collect())) == sorted(map(tuple, sums.collect()))
