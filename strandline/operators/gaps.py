"""Reports on aligned contigs: gates, blacklists, targets, gaps with their sequences, alignments without gaps.

Alignments have qname, rname, flag, mapq, pos0, ops and seq; qname, rname and pos0 together tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import end_distance, homopolymer_around, identities, indels, n_fraction, one_base, query_span, reference_span, reverse_strand, soft_clip
from strandline.operators.alignment import _chunks, bases_at
from strandline.operators.intervals import parse_region
from strandline.session import cut_lineage

IDENTITY_COLUMNS = (
    "query_name query_start query_end query_length reference_name reference_start reference_end perID_by_matches perID_by_events perID_by_all "
    "matches mismatches insertions deletions insertion_events deletion_events"
).split()


def gate(alignments: DataFrame, min_mapq: int = 0, min_contig: int = 0, min_fraction: float = 0.0, min_aligned: int = 0) -> DataFrame:
    """Alignments of enough quality, of contigs that are long enough, with enough letters aligned: as a number, and as a share of the
    contig's letters but N (0 without any)."""
    aligned = query_span(F.col("ops"))
    letters = F.length(F.replace("seq", F.lit("N"), F.lit("")))
    share = F.when(letters > 0, aligned / letters).otherwise(F.lit(0.0))
    return alignments.where((F.col("mapq") >= min_mapq) & (F.length("seq") >= min_contig) & (share >= min_fraction) & (aligned >= min_aligned))


def not_listed(alignments: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Alignments that no row of a blacklist names: (qname, pos1), a null position for every alignment of the contig."""
    names = blacklist.where("pos1 is null").select("qname").distinct()
    places = blacklist.where("pos1 is not null").select("qname", (F.col("pos1") - 1).alias("pos0")).distinct()
    return alignments.join(names, "qname", "left_anti").join(places, ["qname", "pos0"], "left_anti")


def on_target(alignments: DataFrame) -> DataFrame:
    """Alignments that meet the region that their contig's name holds, `chr...start-end` with a dot before the start; those of other names
    stay."""
    pattern = r"^.*(chr.*)\.([0-9]+)-([0-9]+).*$"
    part = lambda k: F.regexp_extract("qname", pattern, k)
    start, end = part(2).try_cast("bigint"), part(3).try_cast("bigint")
    t_end = F.col("pos0") + reference_span(F.col("ops"))
    inside = lambda p: (p >= F.col("pos0")) & (p < t_end)
    meets = inside(start) | inside(end) | ((start < F.col("pos0")) & (end > t_end))
    return alignments.where(~F.col("qname").rlike(pattern) | ((part(1) == F.col("rname")) & meets))


def identity_table(alignments: DataFrame, cs: Column | None = None) -> DataFrame:
    """The 16 columns of IDENTITY_COLUMNS for every mapped alignment; identities without an aligned letter are 0."""
    x = alignments.where(F.col("flag").bitwiseAND(4) == 0)
    x = identities(x, cs=cs)
    before = soft_clip(F.col("ops"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = [
        "qname", before, before + query_span(F.col("ops")), query_span(F.col("ops")) + before + soft_clip(F.col("ops"), end=True), "rname", "pos0",
        F.col("pos0") + reference_span(F.col("ops")), zero("by_matches"), zero("by_events"), zero("by_all"), "matches", "mismatches", "ins", "del", "ins_events", "del_events",
    ]
    return x.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in zip(IDENTITY_COLUMNS, values, strict=True)])


def with_reference_part(rows: DataFrame, reference: DataFrame, start: Column, end: Column, name: str, chunk: int = 1024) -> DataFrame:
    """Rows with the letters of the reference from start to end of their `contig`, clipped at its ends. reference: contig, seq,
    or in chunks as _chunks makes them. Only pieces of the reference move to the rows, never a whole contig."""
    numbered = cut_lineage(rows.select("*", F.greatest(start, F.lit(0)).cast("bigint").alias("_s"), end.cast("bigint").alias("_e"), F.monotonically_increasing_id().alias("_row")))
    bins = F.explode(F.sequence(F.floor(F.col("_s") / chunk), F.floor((F.col("_e") - 1) / chunk)))
    x = numbered.where("_e > _s").select("_row", "contig", "_s", "_e", bins.alias("bin")).join(_chunks(reference, chunk), ["contig", "bin"])
    lo, hi = F.greatest("_s", F.col("bin") * chunk), F.least("_e", (F.col("bin") + 1) * chunk)
    piece = F.substr("part", (lo - F.col("bin") * chunk + 1).cast("int"), (hi - lo).cast("int"))
    pieces = x.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("bin", piece.alias("text")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("_t")
    return numbered.join(pieces.select("_row", text), "_row", "left").select(*rows.columns, F.coalesce("_t", F.lit("")).alias(name))


def anchored_run(a: Column, b: Column) -> Column:
    """The longest text that both end with."""
    x, y = F.reverse(a), F.reverse(b)
    sizes = F.filter(F.sequence(F.lit(0), F.least(F.length(x), F.length(y))), lambda n: F.substr(x, F.lit(1), n) == F.substr(y, F.lit(1), n))
    return F.reverse(F.substr(x, F.lit(1), F.array_max(sizes)))


def gaps(
    alignments: DataFrame, reference: DataFrame, min_length: int = 50, max_length: int | None = None, min_dist: int = 0, max_masked: int | None = None,
    ignore_homopolymers: bool = False, tsd: int = 0, context: int = 0,
) -> DataFrame:
    """Insertions and deletions of at least min_length, under max_length, at least min_dist from the contig's ends, with fewer than
    max_masked N and, if asked for, not of one letter only.

    Columns: qname, contig, tStart, tEnd, svType, svLen, svSeq, tsd (of insertions: the longest text of at most `tsd` letters that both the
    inserted letters and the reference before them end with, or that both the inserted letters and the reference behind begin with; the
    longer one, `notsd` without), qStart, qEnd, strand, qLen, dist, run (the homopolymer around), frac (share of N) and, with a context,
    homopolymer (the letters behind a deletion are all A or all T). reference: contig, seq."""
    one = F.explode(indels(F.col("ops"), F.col("pos0"), min_length))
    x = alignments.select("qname", F.col("rname").alias("contig"), "pos0", "seq", reverse_strand(F.col("flag")).alias("_r"), one.alias("g"))
    if max_length is not None:
        x = x.where(F.col("g.len") < max_length)
    ins, q, n = F.col("g.kind") == "I", F.col("g.query_pos"), F.col("g.len")
    letters = F.when(ins, F.substr("seq", (q + 1).cast("int"), n.cast("int")))
    behind = F.substr("seq", (q + n + 1).cast("int"), F.lit(context))
    x = x.select(
        "qname", "contig", "pos0", F.col("g.ref_pos").alias("tStart"), (F.col("g.ref_pos") + n).alias("tEnd"), F.when(ins, "insertion").otherwise("deletion").alias("svType"),
        n.alias("svLen"), letters.alias("_ins"), q.alias("qStart"), F.when(ins, q + n).otherwise(q).alias("qEnd"), F.when(F.col("_r"), "-").otherwise("+").alias("strand"),
        F.length("seq").cast("bigint").alias("qLen"), end_distance(q, F.length("seq")).alias("dist"), homopolymer_around(F.col("seq"), q).alias("run"), behind.alias("_behind"),
    ).where(F.col("dist") >= min_dist)
    # the deleted letters, or those on both sides of an insertion
    inserted = F.col("svType") == "insertion"
    start = F.when(inserted, F.col("tStart") - tsd).otherwise(F.col("tStart"))
    end = F.when(inserted, F.col("tStart") + tsd).otherwise(F.col("tEnd"))
    x = with_reference_part(x, reference, start, end, "_ref")
    before = F.least(F.lit(tsd).cast("bigint"), F.col("tStart")).cast("int")
    upper = F.upper("_ins")
    left = anchored_run(F.substr(upper, F.greatest(F.length(upper) - tsd, F.lit(0)) + 1), F.substr("_ref", F.lit(1), before))
    right = F.reverse(anchored_run(F.reverse(F.substr(upper, F.lit(1), F.lit(tsd))), F.reverse(F.substr("_ref", before + 1))))
    best = F.when(F.length(left) >= F.length(right), left).otherwise(right)
    x = x.withColumn("svSeq", F.when(inserted, F.col("_ins")).otherwise(F.col("_ref")))
    x = x.withColumn("tsd", F.when(inserted & (F.length(best) > 0), best).otherwise("notsd")).withColumn("frac", n_fraction(F.col("svSeq")))
    if max_masked is not None:
        x = x.where(F.length("svSeq") - F.length(F.translate("svSeq", "Nn", "")) < max_masked)
    if ignore_homopolymers:
        x = x.where(~one_base(F.col("svSeq")))
    if context:
        x = x.withColumn("homopolymer", ~inserted & F.col("_behind").rlike("^(A+|T+)$"))
    return x.drop("pos0", "_ins", "_ref", "_behind")


def by_haplotype(rows: DataFrame, tag: str, values: tuple[str, ...]) -> dict[str, DataFrame]:
    """The rows of each value of a tag. rows have `tags`, a map."""
    return {v: rows.where(F.col("tags")[tag] == v) for v in values}


def gap_free(alignments: DataFrame, min_length: int = 50) -> DataFrame:
    """(contig, start0, end0, qname) of alignments without an insertion or deletion of at least min_length."""
    none = F.size(F.filter("ops", lambda o: o["op"].isin("I", "D") & (o["len"] >= min_length))) == 0
    return contig_spans(alignments.where(none))


def contig_spans(alignments: DataFrame) -> DataFrame:
    """(contig, start0, end0, qname): where each alignment lies."""
    return alignments.select(F.col("rname").alias("contig"), F.col("pos0").alias("start0"), (F.col("pos0") + reference_span(F.col("ops"))).alias("end0"), "qname")


def unknown_letters(alignments: DataFrame, reference: DataFrame, chunk: int = 1024) -> DataFrame:
    """(contig, rpos) of aligned positions where the reference has N. reference: contig, seq."""
    x = contig_spans(alignments).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start0") / chunk), F.floor((F.col("end0") - 1) / chunk))))
    n = _chunks(reference, chunk).where(F.col("part").contains("N"))
    at = F.explode(F.filter(F.sequence(F.lit(1), F.length("part")), lambda i: F.substr(F.col("part"), i, F.lit(1)) == "N"))
    n = n.select("contig", "bin", at.alias("k")).select("contig", "bin", (F.col("bin") * chunk + F.col("k") - 1).alias("rpos"))
    return x.join(n, ["contig", "bin"]).where("rpos >= start0 and rpos < end0").select("contig", "rpos").distinct()


def supported_snps(alignments: DataFrame, snps: DataFrame) -> DataFrame:
    """(qname, contig, rpos): of each alignment the positions where it has the letter that a table of variants lists. snps: contig, rpos, alt."""
    x = bases_at(alignments, snps.select("contig", "rpos", "alt"))
    return x.where(F.col("base") == F.upper("alt")).select("qname", "contig", "rpos")


def rectangles(alignments: DataFrame) -> DataFrame:
    """(qname, op, x, width) of the deletions, matches and mismatches of an extended CIGAR, side by side from the alignment's start on."""
    kept = F.filter("ops", lambda o: o["op"].isin("D", "=", "X"))
    start = F.struct(F.col("pos0").cast("bigint").alias("x"), F.array().cast("array<struct<op:string,x:bigint,width:bigint>>").alias("out"))

    def step(a, o):
        one = F.struct(o["op"].alias("op"), a["x"].alias("x"), o["len"].alias("width"))
        return F.struct((a["x"] + o["len"]).alias("x"), F.concat(a["out"], F.array(one)).alias("out"))

    return alignments.select("qname", F.explode(F.aggregate(kept, start, step)["out"]).alias("r")).select("qname", "r.*")


def best_match(rows: DataFrame, region: str = "reference_name", start: str = "reference_start", end: str = "reference_end") -> DataFrame:
    """Adds bestChr, bestStart, bestEnd and bestMatch: offsets in a `chr:start-end` region on the genome; `noMatch` and zeros without one."""
    r = parse_region(F.col(region))
    x = rows.withColumn("bestChr", F.coalesce(r["contig"], F.lit("noMatch")))
    for c, at in (("bestStart", start), ("bestEnd", end)):
        x = x.withColumn(c, F.coalesce(r["start0"] + F.col(at), F.lit(0)).cast("bigint"))
    return x.withColumn("bestMatch", F.format_string("%s:%d-%d", "bestChr", "bestStart", "bestEnd"))


def best_alignment(alignments: DataFrame, score: Column) -> DataFrame:
    """(qname, label): the reference of each read's best alignment, the first in order among equals. An alignment without a score is
    worse than any with one."""
    best = F.min(F.struct(score.isNull().alias("none"), (-score).alias("s"), F.col("rname").alias("label"))).alias("b")
    return alignments.groupBy("qname").agg(best).select("qname", "b.label")


def other_reads(reads: DataFrame, *parts: DataFrame) -> DataFrame:
    """Reads that are in none of the parts. All have qname."""
    for p in parts:
        reads = reads.join(p.select("qname").distinct(), "qname", "left_anti")
    return reads


def restamped(alignments: DataFrame, sample: str) -> DataFrame:
    """tlen becomes the length on the reference, and the read group's sample a constant."""
    return alignments.withColumn("tlen", reference_span(F.col("ops"))).withColumn("sample", F.lit(sample))


def masked_targets(alignments: DataFrame, gone: DataFrame, min_identity: float = 95.0, min_length: int = 2000) -> DataFrame:
    """Alignments over both limits whose target isn't listed. Columns tname, identity, t_start, t_end; gone: tname."""
    x = alignments.where((F.col("identity") > min_identity) & (F.col("t_end") - F.col("t_start") > min_length))
    return x.join(gone.select("tname").distinct(), "tname", "left_anti")


def supporting_overhangs(reads: DataFrame, supports: DataFrame, align, least: int = 2000) -> DataFrame:
    """The parts of reads that support a cluster and hang over the ends of its contigs: the reads of `supports` (qname, cut) go through
    `align`, which returns their alignments to the contigs in the columns that overhangs needs."""
    from strandline.operators.alignment import overhangs

    return overhangs(align(reads.join(supports.select("qname").distinct(), "qname", "left_semi")), least)
