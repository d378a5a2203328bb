"""Alignment operators over rows with parsed CIGARs (`ops`: array of op and len), and numbering of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import primary, ranges_of, reference_span, reverse_complement, reverse_strand
from strandline.operators.intervals import parse_region
from strandline.session import cut_lineage



def to_bed(alignments: DataFrame) -> DataFrame:
    """(contig, start0, end0, qname, strand) of primary alignments."""
    x = alignments.where(primary(F.col("flag")))
    strand = F.when(reverse_strand(F.col("flag")), "-").otherwise("+")
    return x.select(F.col("rname").alias("contig"), F.col("pos0").alias("start0"), (F.col("pos0") + reference_span(F.col("ops"))).alias("end0"), "qname", strand.alias("strand"))


def blocks(alignments: DataFrame, *keys: str) -> DataFrame:
    """One row per operation with where it begins: qname, k, op, len, q (query) and r (reference). qname, with further keys if
    given, tells alignments apart."""
    x = alignments.select("qname", F.col("pos0").alias("_pos0"), *keys, F.posexplode("ops").alias("k", "o")).select("qname", "_pos0", *keys, "k", "o.*")
    before = Window.partitionBy("qname", *keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("len"))).over(before), F.lit(0))
    return x.select("qname", "k", "op", "len", moved("MIS=X").alias("q"), (F.col("_pos0") + moved("MDN=X")).alias("r"))


def match_blocks(ops: Column, pos0: Column) -> Column:
    """Array of (q, r, len): where each match block begins on the read and on the reference. Within the row, without a shuffle."""
    kind = "array<struct<q:bigint,r:bigint,len:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("q"), pos0.cast("bigint").alias("r"), F.array().cast(kind).alias("out"))

    def step(a, x):
        moves = lambda k: F.when(x["op"].isin(*k), x["len"]).otherwise(0)
        one = F.struct(a["q"].alias("q"), a["r"].alias("r"), x["len"].alias("len"))
        out = F.when(x["op"].isin("M", "=", "X") & (x["len"] > 0), F.concat(a["out"], F.array(one))).otherwise(a["out"])
        return F.struct((a["q"] + moves("MIS=X")).alias("q"), (a["r"] + moves("MDN=X")).alias("r"), out.alias("out"))

    return F.aggregate(ops, start, step)["out"]


def aligned_pairs(alignments: DataFrame) -> DataFrame:
    """(qname, qpos, rpos) of every position in match blocks."""
    m = alignments.select("qname", F.explode(match_blocks(F.col("ops"), F.col("pos0"))).alias("m"))
    m = m.select("qname", "m.*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m.len") - 1)).alias("d"))
    return m.select("qname", (F.col("q") + F.col("d")).alias("qpos"), (F.col("r") + F.col("d")).alias("rpos"))


def aligned_pair_sums(alignments: DataFrame) -> DataFrame:
    """(qname, pairs, q_sum, r_sum): number and sums of the rows of aligned_pairs for each qname. Positions of a match block follow each
    other, so that its sums are those of a series and no position becomes a row."""
    m = alignments.select("qname", match_blocks(F.col("ops"), F.col("pos0")).alias("m"))
    zero = F.lit(0).cast("bigint")
    series = lambda at: F.aggregate("m", zero, lambda s, b: s + b["len"] * b[at] + F.shiftright(b["len"] * (b["len"] - 1), 1))
    x = m.where(F.size("m") > 0).select("qname", F.aggregate("m", zero, lambda s, b: s + b["len"]).alias("n"), series("q").alias("q"), series("r").alias("r"))
    return x.groupBy("qname").agg(F.sum("n").alias("pairs"), F.sum("q").alias("q_sum"), F.sum("r").alias("r_sum"))


def _pieces(alignments: DataFrame, chunk: int, *keep: str) -> DataFrame:
    """(qname, contig, bin, q, r, text): match blocks with the read's letters, cut where a chunk of the reference ends."""
    m = alignments.select("qname", F.col("rname").alias("contig"), "seq", *keep, F.explode(match_blocks(F.col("ops"), F.col("pos0"))).alias("m"))
    bins = F.explode(F.sequence(F.floor(F.col("m.r") / chunk), F.floor((F.col("m.r") + F.col("m.len") - 1) / chunk)))
    m = m.select("qname", "contig", "seq", *keep, "m.*", bins.alias("bin"))
    lo, hi = F.greatest("r", F.col("bin") * chunk), F.least(F.col("r") + F.col("len"), (F.col("bin") + 1) * chunk)
    q = F.col("q") + lo - F.col("r")
    return m.select("qname", "contig", *keep, "bin", q.alias("q"), lo.alias("r"), F.upper(F.substr("seq", (q + 1).cast("int"), (hi - lo).cast("int"))).alias("text"))


def _letters(text: str) -> Column:
    """The letters of a text with their numbers, as array elements."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct((i - 1).alias("d"), F.substr(F.col(text), i, F.lit(1)).alias("base")))


def base_rows(alignments: DataFrame, chunk: int = 1024) -> DataFrame:
    """(qname, contig, rpos, base) of every aligned letter but N. Only letters leave the row, never a copy of the read with each."""
    x = _pieces(alignments, chunk).where("text <> ''")
    x = x.select("qname", "contig", "r", F.explode(_letters("text")).alias("l"))
    return x.select("qname", "contig", (F.col("r") + F.col("l.d")).alias("rpos"), F.col("l.base").alias("base")).where("base <> 'N'")


def bases_at(alignments: DataFrame, positions: DataFrame, *keep: str, chunk: int = 1024) -> DataFrame:
    """(qname, qpos, base) of every alignment at some positions, with the columns of these and those of `keep` from alignments. Pieces
    of reads meet positions by chunk, so that only the letters asked for are taken. positions: contig, rpos, ..."""
    at = positions.withColumn("bin", F.floor(F.col("rpos") / chunk))
    x = _pieces(alignments, chunk, *keep).join(at, ["contig", "bin"]).where((F.col("rpos") >= F.col("r")) & (F.col("rpos") < F.col("r") + F.length("text")))
    d = F.col("rpos") - F.col("r")
    base = F.substr("text", (d + 1).cast("int"), F.lit(1))
    return x.select("qname", *keep, *positions.columns, (F.col("q") + d).alias("qpos"), base.alias("base")).where("base <> 'N'")


def psv_locations(alignments: DataFrame, psvs: DataFrame) -> DataFrame:
    """(collapse, ccid, grp, qpos, truealt): where assembled contigs have the variants of their own cluster, on the contig's strand. The
    name of a contig holds `group.N`. psvs: contig, rpos, alt, grp."""
    x = alignments.withColumn("q_len", F.length("seq")).withColumn("reverse", reverse_strand(F.col("flag")))
    x = bases_at(x, psvs.select("contig", "rpos", "alt", "grp"), "q_len", "reverse")
    own = F.regexp_extract("qname", r"group\.([0-9]+)", 1)
    x = x.where((own == F.col("grp").cast("string")) & (F.col("base") == F.col("alt")))
    qpos = F.when(F.col("reverse"), F.col("q_len") - F.col("qpos") - 1).otherwise(F.col("qpos"))
    true = F.when(F.col("reverse"), reverse_complement(F.col("base"))).otherwise(F.col("base"))
    return x.select(F.col("contig").alias("collapse"), F.col("qname").alias("ccid"), "grp", qpos.alias("qpos"), true.alias("truealt"))


def psv_mismatches(located: DataFrame, seqs: DataFrame) -> DataFrame:
    """Rows of psv_locations whose contig has another base there, with `base`; none in a right table. seqs: id, seq."""
    base = F.upper(F.substr("seq", (F.col("qpos") + 1).cast("int"), F.lit(1)))
    x = located.join(seqs.select(F.col("id").alias("ccid"), "seq"), "ccid")
    return x.select(*located.columns, base.alias("base")).where("base <> truealt")


def _chunks(reference: DataFrame, chunk: int) -> DataFrame:
    """(contig, bin, part): the reference in chunks, from one pass over each sequence: a part of a text is found by counting from its start.
    A reference that comes in chunks of this length, with columns bin and part, is taken as it is."""
    if "part" in reference.columns:
        return reference.select("contig", "bin", F.upper("part").alias("part"))
    parts = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("bin", "part")
    return reference.where("seq <> ''").select("contig", parts).select("contig", F.col("bin").cast("bigint").alias("bin"), F.upper("part").alias("part"))


def with_reference_base(positions: DataFrame, reference: DataFrame, chunk: int = 1024) -> DataFrame:
    """Adds `ref`, the base at (contig, rpos); positions outside of the reference go. reference: contig, seq."""
    x = positions.withColumn("bin", F.floor(F.col("rpos") / chunk)).join(_chunks(reference, chunk), ["contig", "bin"])
    ref = F.substr("part", (F.col("rpos") - F.col("bin") * chunk + 1).cast("int"), F.lit(1))
    return x.withColumn("ref", ref).where("ref <> ''").select(*positions.columns, "ref")


def snvs(alignments: DataFrame, reference: DataFrame, chunk: int = 1024) -> DataFrame:
    """(qname, contig, rpos, ref, alt) where read and reference differ and neither is N. alignments have rname and seq too;
    reference: contig, seq. Pieces of reads meet chunks of the reference; only pieces that differ are looked at by letter."""
    x = _pieces(alignments, chunk).join(_chunks(reference, chunk), ["contig", "bin"])
    x = x.withColumn("other", F.substr("part", (F.col("r") - F.col("bin") * chunk + 1).cast("int"), F.length("text"))).where("text <> other")
    x = x.select("qname", "contig", "r", "other", F.explode(_letters("text")).alias("l"))
    out = x.select("qname", "contig", (F.col("r") + F.col("l.d")).alias("rpos"), F.substr("other", F.col("l.d") + 1, F.lit(1)).alias("ref"), F.col("l.base").alias("alt"))
    return out.where("ref <> alt and ref <> 'N' and alt <> 'N' and ref <> ''")


def number_rows(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 1 on, without putting all rows into one task: rows are dealt into
    ranges, numbered within each, and shifted by the sizes of the ranges before."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    x = df.repartitionByRange(ranges_of(df.sparkSession), *cols).withColumn("_p", F.spark_partition_id())
    # ranges come from a sample, so that they must not be drawn again for their sizes
    x = cut_lineage(x.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*cols))))
    sizes = x.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row for each range
    shift = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = x.join(F.broadcast(shift.select("_p", "_s")), "_p")
    return out.select(*df.columns, (F.col("_s") + F.col("_k")).alias(name))


def overhangs(alignments: DataFrame, least: int = 2000) -> DataFrame:
    """(qname, end, clip_start, clip_end): the part of each read that hangs over the contig's head or tail by more than `least`, where
    it aligns less than `least` away from that end; the head goes first. Columns: qname, q_len, q_start, q_end, t_len, t_start, t_end."""
    rest = F.col("t_len") - F.col("t_end")
    head, tail = F.col("q_start") - F.col("t_start"), F.col("q_len") - F.col("q_end") - rest
    zero = F.lit(0).cast("bigint")
    at_head = F.when((F.col("t_start") < least) & (head > least), F.struct(F.lit("head").alias("end"), zero.alias("clip_start"), head.alias("clip_end")))
    at_tail = F.when((rest < least) & (tail > least), F.struct(F.lit("tail").alias("end"), (F.col("q_end") + rest).alias("clip_start"), F.col("q_len").alias("clip_end")))
    return alignments.select("qname", F.coalesce(at_head, at_tail).alias("_o")).where("_o is not null").select("qname", "_o.*")


def _longest(a: str, b: str) -> str:
    """The longest text in both, the one that ends last in a. Texts of one length at each place are numbered, equal ones alike: lengths double as
    long as a and b have a number in common, then halves of the last step are added where they still do."""
    m, n = len(a), len(b)
    points = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), "<u4")

    def numbered(keys: np.ndarray, k: int):
        """Numbers in a and in b, and which of those in a are in b, if any."""
        values, ids = np.unique(keys, return_inverse=True)
        has = np.zeros(len(values), bool)
        has[ids[k:]] = True
        both = has[ids[:k]]
        return (ids[:k], ids[k:], both, len(values)) if both.any() else None

    def longer(x, size: int, y, more: int):
        """What follows x by y's length; x and y are numbers of lengths size and more."""
        total = size + more
        if total > min(m, n):
            return None
        keys = [(u[: k - total + 1].astype(np.int64) * y[3] + v[size : size + k - total + 1]) for u, v, k in ((x[0], y[0], m), (x[1], y[1], n))]
        return numbered(np.concatenate(keys), m - total + 1)

    found = numbered(points, m) if m and n else None
    if found is None:
        return ""
    levels, size = [found], 1
    while (new := longer(levels[-1], size, levels[-1], size)) is not None:
        levels.append(new)
        size *= 2
    found = levels.pop()
    while levels:
        part = levels.pop()
        if (new := longer(found, size, part, 1 << len(levels))) is not None:
            found, size = new, size + (1 << len(levels))
    start = int(np.flatnonzero(found[2])[-1])
    return a[start : start + size]


def common_run(pairs: DataFrame) -> DataFrame:
    """(id, run, length): the longest text that occurs in both columns a and b; of several, the one that ends last in a. Null counts as
    empty. Time grows with the lengths, but for their logarithm, not with their product."""

    def work(frames):
        for f in frames:
            runs = [_longest(a or "", b or "") for a, b in zip(f["a"], f["b"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "run": pd.Series(runs, dtype=object), "length": pd.Series([len(r) for r in runs], dtype="int64")})

    dealt = pairs.select("id", "a", "b").repartition(ranges_of(pairs.sparkSession), "id")
    return dealt.mapInPandas(work, "id bigint, run string, length bigint")


def lift(local: DataFrame, region: str = "region") -> DataFrame:
    """Adds contig, start0 and end0 on the genome to rows of a `chr:start-end` region with offsets lo and hi in it; nulls where it
    doesn't parse."""
    r = parse_region(F.col(region))
    return local.select("*", r["contig"].alias("contig"), (r["start0"] + F.col("lo")).alias("start0"), (r["start0"] + F.col("hi")).alias("end0"))
