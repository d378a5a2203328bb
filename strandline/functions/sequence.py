"""Scalar functions on sequences, CIGARs, flags and nucleotide counts; all are column expressions."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut_lineage

BASES = ("A", "C", "G", "T")
#: unmapped, secondary, supplementary
EXCLUDE_FLAGS = 4 | 256 | 2048


def thresholds(coverage: float) -> dict[str, int]:
    """Limits that follow from the expected coverage, cut toward zero."""
    std = math.sqrt(coverage)
    low = int(max(coverage - 4 * std, coverage / 2))
    return {"min_cov": low, "max_cov": int(coverage + std), "min_total": int(2 * coverage - 3 * std), "min_reads": int(low / 2)}


def primary(flag: Column) -> Column:
    return flag.bitwiseAND(EXCLUDE_FLAGS) == 0


def reverse_strand(flag: Column) -> Column:
    return flag.bitwiseAND(16) != 0


def parse_cigar(cigar: Column) -> Column:
    """Array of (op, len). `*` and null give null."""
    one = lambda t: F.struct(F.substr(t, F.length(t), F.lit(1)).alias("op"), F.substr(t, F.lit(1), F.length(t) - 1).cast("bigint").alias("len"))
    return F.when(cigar != "*", F.transform(F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)), one))


def op_total(ops: Column, kinds: str) -> Column:
    """Total length of the operations of some kinds."""
    kept = F.filter(ops, lambda x: x["op"].isin(*kinds))
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x["len"])


def op_events(ops: Column, kinds: str) -> Column:
    return F.size(F.filter(ops, lambda x: x["op"].isin(*kinds))).cast("bigint")


def reference_span(ops: Column) -> Column:
    return op_total(ops, "MDN=X")


def md_span(ops: Column) -> Column:
    """Only M and D move on the reference, as an old parser has it."""
    return op_total(ops, "MD")


def query_span(ops: Column) -> Column:
    return op_total(ops, "MI=X")


def soft_clip(ops: Column, end: bool = False) -> Column:
    """Length of the soft clip at one end, a hard clip outside of it apart."""
    soft = F.filter(ops, lambda x: x["op"] != "H")
    one = F.element_at(soft, -1 if end else 1)
    return F.when((F.size(soft) > 0) & (one["op"] == "S"), one["len"]).otherwise(F.lit(0).cast("bigint"))


def identity_counts(ops: Column) -> Column:
    """Struct of matches, mismatches, ins, del, ins_events, del_events, in one pass over the operations."""
    names = {"matches": "=", "mismatches": "X", "ins": "I", "del": "D", "ins_events": "I", "del_events": "D"}
    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in names])

    def step(a, x):
        size = lambda n: F.lit(1) if n.endswith("events") else x["len"]
        return F.struct(*[(a[n] + F.when(x["op"] == k, size(n)).otherwise(0)).alias(n) for n, k in names.items()])

    return F.aggregate(ops, zero, step)


def cs_counts(cs: Column) -> Column:
    """The struct of identity_counts, from a short-form `cs` tag."""
    lens = lambda pattern: F.transform(F.regexp_extract_all(cs, F.lit(pattern), F.lit(1)), lambda x: F.length(x))
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    ins, dele = lens(r"\+([a-z]+)"), lens("-([a-z]+)")
    return F.struct(
        total(F.regexp_extract_all(cs, F.lit(":([0-9]+)"), F.lit(1))).alias("matches"),
        F.length(F.regexp_replace(cs, r"[^*]", "")).cast("bigint").alias("mismatches"),
        total(ins).alias("ins"), total(dele).alias("del"), F.size(ins).cast("bigint").alias("ins_events"), F.size(dele).cast("bigint").alias("del_events"),
    )


def identities(df: DataFrame, ops: str = "ops", cs: Column | None = None) -> DataFrame:
    """Adds the counts and the identity by matches, by events and by all bases, in percent. cs: a tag that goes before the
    operations where it isn't null."""
    counts = identity_counts(F.col(ops)) if cs is None else F.when(cs.isNotNull(), cs_counts(cs)).otherwise(identity_counts(F.col(ops)))
    out = df.withColumn("_i", counts).select(*df.columns, "_i.*")
    m = F.col("matches")
    share = lambda *more: F.when(sum(map(F.col, more), m) > 0, 100 * m / sum(map(F.col, more), m))
    return out.select(
        "*",
        share("mismatches").alias("by_matches"),
        share("mismatches", "ins_events", "del_events").alias("by_events"),
        share("mismatches", "ins", "del").alias("by_all"),
    )


def indels(ops: Column, pos0: Column, min_length: int = 1) -> Column:
    """Array of (kind, ref_pos, query_pos, len) of insertions and deletions of at least min_length."""
    start = F.struct(
        pos0.cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("q"),
        F.array().cast("array<struct<kind:string,ref_pos:bigint,query_pos:bigint,len:bigint>>").alias("out"),
    )

    def step(a, x):
        hit = x["op"].isin("I", "D") & (x["len"] >= min_length)
        one = F.struct(x["op"].alias("kind"), a["r"].alias("ref_pos"), a["q"].alias("query_pos"), x["len"].alias("len"))
        return F.struct(
            (a["r"] + F.when(x["op"].isin(*"MDN=X"), x["len"]).otherwise(0)).alias("r"),
            (a["q"] + F.when(x["op"].isin(*"MIS=X"), x["len"]).otherwise(0)).alias("q"),
            F.when(hit, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(ops, start, step)["out"]


def format_cigar(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def condense_cigar(ops: Column) -> Column:
    """Adjacent operations of one kind as one; = and X count as M."""
    plain = F.transform(ops, lambda x: F.struct(F.when(x["op"].isin("=", "X"), F.lit("M")).otherwise(x["op"]).alias("op"), x["len"].alias("len")))

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        same = F.coalesce(last["op"] == x["op"], F.lit(False))
        longer = F.array(F.struct(x["op"].alias("op"), (last["len"] + x["len"]).alias("len")))
        return F.when(same, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), longer)).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(plain, F.array().cast("array<struct<op:string,len:bigint>>"), step)


def drop_opposite_indels(ops: Column, below: int = 4) -> Column:
    """Operations without pairs of an insertion and a deletion of one length around a match block shorter than `below`; from left to
    right, so that an indel goes with its first partner."""
    kind = "array<struct<op:string,len:bigint>>"

    def step(a, x):
        match, first = F.try_element_at(a, F.lit(-1)), F.try_element_at(a, F.lit(-2))
        opposite = ((first["op"] == "I") & (x["op"] == "D")) | ((first["op"] == "D") & (x["op"] == "I"))
        hit = F.coalesce(opposite & (first["len"] == x["len"]) & (x["len"] > 0) & match["op"].isin("M", "=") & (match["len"] < below), F.lit(False))
        gone = lambda o: F.struct(o["op"].alias("op"), F.lit(0).cast("bigint").alias("len"))
        return F.when(hit, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))), F.array(gone(first), match, gone(x)))).otherwise(F.concat(a, F.array(x)))

    return F.filter(F.aggregate(ops, F.array().cast(kind), step), lambda x: x["len"] > 0)


def flank_identity(ops: Column, flank: int, end: bool = False) -> Column:
    """Matches as a share of the matched, mismatched, inserted and deleted bases at one end: whole operations until they sum to at
    least `flank`; 0 without any."""
    zero = F.struct(F.lit(0).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("n"))

    def step(a, x):
        more = a["n"] < flank
        add = lambda kinds: F.when(more & x["op"].isin(*kinds), x["len"]).otherwise(0)
        return F.struct((a["m"] + add("M=")).alias("m"), (a["n"] + add("M=XID")).alias("n"))

    c = F.aggregate(F.reverse(ops) if end else ops, zero, step)
    return F.when(c["n"] > 0, c["m"] / c["n"]).otherwise(F.lit(0.0))


def hard_mask(seq: Column, start0: Column, end0: Column) -> Column:
    """The sequence with N from start0 to end0, clipped at its ends."""
    lo = F.least(F.greatest(start0, F.lit(0)), F.length(seq)).cast("int")
    hi = F.greatest(lo, F.least(end0, F.length(seq)).cast("int"))
    return F.concat(F.substr(seq, F.lit(1), lo), F.repeat(F.lit("N"), hi - lo), F.substr(seq, hi + 1))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def strip_n(seq: Column) -> Column:
    return F.regexp_replace(seq, "^[Nn]+|[Nn]+$", "")


def n_fraction(seq: Column) -> Column:
    n = F.length(seq) - F.length(F.translate(seq, "Nn", ""))
    return F.when(F.length(seq) > 0, n / F.length(seq)).otherwise(F.lit(0.0))


def gc_fraction(seq: Column) -> Column:
    at = F.length(F.translate(seq, "GCgc", ""))
    return F.when(F.length(seq) > 0, (F.length(seq) - at) / F.length(seq)).otherwise(F.lit(0.0))


def longest_homopolymer(seq: Column) -> Column:
    """Length of the longest run of one base."""
    runs = F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+|N+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("bigint")


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of `width` characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def heterozygous(counts: list[Column], min_count: int, max_count: int, min_total: int) -> Column:
    """At least two bases over min_count, at most two over max_count, and a total of at least min_total."""
    arr = F.array(*counts)
    over = lambda m: F.size(F.filter(arr, lambda x: x > m))
    total = sum(counts[1:], counts[0])
    return (over(min_count) >= 2) & (over(max_count) <= 2) & (total >= min_total)


def best_alternate(ref: Column, counts: dict[str, Column]) -> Column:
    """The base other than ref with the highest count, the first one in order of the ties; empty if none was seen."""
    rows = [F.struct(F.when(ref == b, F.lit(-1).cast("bigint")).otherwise(c.cast("bigint")).alias("n"), F.lit(-i).alias("k"), F.lit(b).alias("base")) for i, (b, c) in enumerate(counts.items())]
    best = F.array_max(F.array(*rows))
    return F.when(best["n"] > 0, best["base"]).otherwise(F.lit(""))


def minor_allele(ref: Column, alt: Column, min_cov: int, max_cov: int) -> Column:
    """`.` if the reference allele is the minor one, `1` if the alternate is, else null."""
    return F.when((ref > 0) & ref.between(min_cov, max_cov) & (alt > max_cov), F.lit(".")).when((alt > 0) & alt.between(min_cov, max_cov) & (ref > max_cov), F.lit("1"))


def _log_choose(k: Column, n: Column) -> Column:
    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i))


def binomial_test(k: Column, n: Column, p: float) -> Column:
    """Two-sided exact p-value of k successes in n trials: the sum of all outcomes that are no likelier than k, where a relative
    1e-7 counts as equal. One pass over the outcomes, each term from the one before; 0 <= k <= n."""
    lp, lq = math.log(p), math.log1p(-p)
    # the accumulator carries the log-likelihood of k, which would be computed anew in each step otherwise
    start = F.struct((_log_choose(k, n) + k * F.lit(lp) + (n - k) * F.lit(lq)).alias("at"), (n * F.lit(lq)).alias("t"), F.lit(0.0).alias("s"))

    def step(a, i):
        more = F.when(a["t"] <= a["at"] + 1e-7, F.exp(a["t"])).otherwise(0.0)
        after = F.when(i < n, a["t"] + F.log((n - i) / (i + 1)) + F.lit(lp - lq)).otherwise(a["t"])
        return F.struct(a["at"].alias("at"), after.alias("t"), (a["s"] + more).alias("s"))

    return F.least(F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step)["s"], F.lit(1.0))


def linkage_score(k: Column, n: Column, accuracy: float) -> Column:
    """log10(1 + ratio) of the exact p-values of k of n under linkage (accuracy) and by chance (1 - accuracy). Where the second
    underflows to zero the score is infinite, where both do it is 0."""
    linked, chance = binomial_test(k, n, accuracy), binomial_test(k, n, 1 - accuracy)
    return F.when(chance > 0, F.log10(linked / F.nullif(chance, F.lit(0.0)) + 1)).when(linked > 0, F.lit(math.inf)).otherwise(F.lit(0.0))


def clips(ops: Column, flag: Column) -> Column:
    """Struct (start, end): the soft clips at the beginning and the end of the read as it was sequenced; a reverse alignment swaps them."""
    a, b, back = soft_clip(ops), soft_clip(ops, end=True), reverse_strand(flag)
    return F.struct(F.when(back, b).otherwise(a).alias("start"), F.when(back, a).otherwise(b).alias("end"))


def read_title(name: Column) -> Column:
    """Struct (movie, zmw, start, end) of `movie/zmw/start_end`; null if it has other parts."""
    pattern = r"^([^/]+)/([0-9]+)/([0-9]+)_([0-9]+)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("movie"), part(2).try_cast("bigint").alias("zmw"), part(3).try_cast("bigint").alias("start"), part(4).try_cast("bigint").alias("end")))


def first_with_prefix(values: Column, prefix: str, until: str | None = None) -> Column:
    """What follows a prefix in the first value that has it, up to a mark if one is given and there; null without such a value."""
    found = F.try_element_at(F.filter(values, lambda v: F.startswith(v, F.lit(prefix))), F.lit(1))
    found = F.substr(found, F.lit(len(prefix) + 1))
    return F.substring_index(found, until, 1) if until else found


def end_distance(pos: Column, length: Column) -> Column:
    """From a position to the nearer end."""
    return F.least(pos, length - pos)


def homopolymer_around(seq: Column, pos0: Column) -> Column:
    """Length of the run of one base that a position lies in; 0 outside of the sequence."""
    base = F.substr(seq, (pos0 + 1).cast("int"), F.lit(1))
    run = lambda s: F.length(s) - F.length(F.ltrim(s, base))
    before, behind = F.reverse(F.substr(seq, F.lit(1), pos0.cast("int"))), F.substr(seq, (pos0 + 1).cast("int"))
    return F.when((pos0 >= 0) & (pos0 < F.length(seq)), run(before) + run(behind)).otherwise(F.lit(0)).cast("bigint")


def one_base(seq: Column) -> Column:
    """Whether a sequence has letters, all of them the same."""
    return (F.length(seq) > 0) & (F.ltrim(seq, F.substr(seq, F.lit(1), F.lit(1))) == "")


def mask_strand(seq: Column, start0: Column, end0: Column, reverse: Column) -> Column:
    """hard_mask with coordinates that on the reverse strand count from the other end."""
    n = F.length(seq)
    return hard_mask(seq, F.when(reverse, n - end0).otherwise(start0), F.when(reverse, n - start0).otherwise(end0))


def with_genotype_phase(line: Column, sample: Column) -> Column:
    """A line of a VCF with a phase set: everywhere in it `GT` becomes `GT:PS` and `NA` becomes `0`; of the column names the last one
    becomes the sample's. The replacement is textual, as the tool has it whose files are read."""
    body = F.replace(F.replace(line, F.lit("GT"), F.lit("GT:PS")), F.lit("NA"), F.lit("0"))
    return F.when(F.startswith(line, F.lit("#CHROM")), F.concat(F.regexp_replace(line, r"[^\t]*$", ""), sample)).when(F.startswith(line, F.lit("##")), line).otherwise(body)


def scaled_identity(per_id: Column, kind: Column, kinds: tuple[str, ...]) -> Column:
    """The whole part of an identity plus its fraction in the part of [0, 1) that belongs to its kind, so that kinds lie apart in a plot."""
    place = F.array_position(F.array(*map(F.lit, kinds)), kind) - 1
    return F.floor(per_id) + (place + per_id - F.floor(per_id)) / len(kinds)


def regions_in(text: Column) -> Column:
    """Array of (contig, start, end, rest) of a list of regions with semicolons between, each `contig:start-end` and what follows;
    the contig goes to the last colon that numbers follow, and parts that are no region are left out."""
    pattern = r"^(.*):(.*)-([0-9]*)(.*)$"
    parts = F.filter(F.split(text, ";"), lambda p: F.regexp_like(p, F.lit(pattern)))
    part = lambda p, k: F.regexp_extract(p, pattern, k)
    return F.transform(parts, lambda p: F.struct(part(p, 1).alias("contig"), part(p, 2).try_cast("bigint").alias("start"), part(p, 3).try_cast("bigint").alias("end"), part(p, 4).alias("rest")))


def cluster_name(name: Column) -> Column:
    """Struct (prefix, grp, contigs, assembler, uid) of `prefix.P_grp.G_contigs.C_assembler.A_uid.U`, null if it is of another form."""
    pattern = r"^(.*)\.([^.]*)_([0-9]+)\.([0-9]+)_([0-9]+)\.([^_.]*)_([0-9]+)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    names = ("prefix", "grp", "contigs", "assembler", "uid")
    values = (part(1), part(3).try_cast("int"), part(5).try_cast("int"), part(6), part(7).try_cast("bigint"))
    return F.when(name.rlike(pattern), F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)]))


def condense_indels(cigar: Column, below: int) -> Column:
    """The CIGAR with indels of one kind as one where only match blocks shorter than `below` lie between; these come behind it as one M.

    An operation goes on with the group before it if it is an indel like the one two before, across a short match block, or that block."""
    ops = parse_cigar(cigar)
    at = lambda i: F.get(ops, i)
    like = lambda i: at(i)["op"].isin("I", "D") & (at(i - 2)["op"] == at(i)["op"]) & at(i - 1)["op"].isin("M", "=", "X") & (at(i - 1)["len"] < below)
    goes_on = lambda i: F.coalesce(like(i), F.lit(False)) | F.coalesce(like(i + 1), F.lit(False))
    places = F.when(F.size(ops) > 0, F.sequence(F.lit(0), F.size(ops) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.filter(places, lambda i: ~goes_on(i)), F.array(F.size(ops)))
    total = lambda part, kinds: F.aggregate(F.filter(part, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda n, x: n + x["len"])

    def text(start, k):
        part = F.slice(ops, start + 1, F.get(starts, k + 1) - start)
        whole = F.concat(total(part, "ID").cast("string"), at(start)["op"], total(part, "M=X").cast("string"), F.lit("M"))
        return F.when(F.size(part) == 1, F.concat(at(start)["len"].cast("string"), at(start)["op"])).otherwise(whole)

    # the last start is the end of the last group
    return F.when(ops.isNull(), cigar).otherwise(F.array_join(F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), text), ""))


class _Walked:
    """The operations of many alignments in one row each: of which alignment, kind, length, and where they begin on read and reference."""

    def __init__(self, ops: pa.Array):
        sizes = np.diff(ops.offsets.to_numpy())
        flat = ops.flatten()
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.kind = np.array(flat.field("op").to_pylist(), "U1") if len(flat) else np.zeros(0, "U1")
        self.len = flat.field("len").to_numpy(zero_copy_only=False).astype(np.int64)
        self.query, self.target = self._starts("MIS=X"), self._starts("MDN=X")

    def _starts(self, moves: str) -> np.ndarray:
        """Sum of what moves before an operation, within its alignment."""
        n = np.where(np.isin(self.kind, list(moves)), self.len, 0)
        before = np.cumsum(n) - n
        first = np.r_[True, self.row[1:] != self.row[:-1]] if len(n) else np.zeros(0, bool)
        return before - before[np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))] if len(n) else before

    def letters(self, kinds: str) -> tuple[np.ndarray, np.ndarray]:
        """(operation, offset in it) of each letter of the operations of some kinds."""
        own = np.flatnonzero(np.isin(self.kind, list(kinds)))
        of = np.repeat(own, self.len[own])
        ends = np.cumsum(self.len[own])
        return of, np.arange(len(of)) - np.repeat(ends - self.len[own], self.len[own])


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of texts as numbers, one after the other, where each text begins, and its length."""
    listed = [t or "" for t in texts.to_pylist()]
    size = np.array([len(t) for t in listed], np.int64)
    return np.frombuffer("".join(listed).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size


def _texts(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    whole = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(sizes)
    return pa.array([whole[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.string())


def aligned_strings(cigar: Column, seq: Column) -> Column:
    """Struct (query, target): the aligned letters of a read, `-` where one is deleted; below them `M`, `-` for an inserted letter, `D` for
    a deleted one. The letters of a whole batch of reads are laid out at once."""

    def run(ops: pa.Array, seqs: pa.Array) -> pa.Array:
        w = _Walked(ops)
        x, begin, size = _code_points(seqs)
        of, k = w.letters("M=XID")
        row, kind, at = w.row[of], w.kind[of], w.query[of] + k
        there = (kind == "D") | (at < size[row])
        row, kind, at = row[there], kind[there], at[there]
        query = np.full(len(row), ord("-"), np.uint32)
        read = kind != "D"
        query[read] = x[begin[row[read]] + at[read]]
        target = np.select([kind == "I", kind == "D"], [ord("-"), ord("D")], ord("M"))
        n = np.bincount(row, minlength=len(size))
        return pa.StructArray.from_arrays([_texts(query, n), _texts(target, n)], ["query", "target"])

    run.__annotations__ = {"ops": pa.Array, "seqs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<query:string,target:string>")(_some(parse_cigar(cigar)), seq)


def _some(ops: Column) -> Column:
    return F.coalesce(ops, F.array().cast("array<struct<op:string,len:bigint>>"))


def accuracy(cigar: Column, seq: Column, ref: Column) -> Column:
    """(matches - mismatches - inserted and deleted letters) / matches of a read against the reference letters from its first aligned one
    on; null without a match. The letters of a whole batch of reads are compared at once."""

    def run(ops: pa.Array, seqs: pa.Array, refs: pa.Array) -> pa.Array:
        w = _Walked(ops)
        (x, x0, nx), (y, y0, ny) = _code_points(seqs), _code_points(refs)
        of, k = w.letters("M=X")
        row, q, t = w.row[of], w.query[of] + k, w.target[of] + k
        there = (q < nx[row]) & (t < ny[row])
        row = row[there]
        same = x[x0[row] + q[there]] == y[y0[row] + t[there]]
        match = np.bincount(row, same, len(nx))
        indel = np.isin(w.kind, ["I", "D"])
        errors = np.bincount(row, ~same, len(nx)) + np.bincount(w.row[indel], w.len[indel], len(nx))
        return pa.array(np.divide(match - errors, match, out=np.zeros(len(nx)), where=match > 0), mask=match == 0)

    run.__annotations__ = {"ops": pa.Array, "seqs": pa.Array, "refs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(_some(parse_cigar(cigar)), F.upper(seq), F.upper(ref))


def joined_contigs(contigs: DataFrame, spacer: int = 5000) -> DataFrame:
    """Adds start0, where each contig begins in one sequence of all, in order of `k`, with `spacer` letters N between. contigs: k, seq. The
    sequence itself is what `joined_sequence` makes; a start is the sum of what stands before, from ranges of k and shifts."""
    return running_total(contigs.withColumn("_len", F.length("seq").cast("bigint") + spacer), "k", "_len", "start0").drop("_len")


def joined_sequence(contigs: DataFrame, spacer: int = 5000) -> DataFrame:
    """(k, value): the pieces of the joined sequence, in order of k: each contig with the spacer that stands before it, the first without."""
    first = contigs.agg(F.min("k").alias("_first"))
    x = contigs.crossJoin(F.broadcast(first))  # one row
    return x.select("k", F.concat(F.when(F.col("k") == F.col("_first"), "").otherwise(F.repeat(F.lit("N"), F.lit(spacer))), "seq").alias("value"))


def ranges_of(spark) -> int:
    """Into how many ranges rows are dealt that are to be put in order: as many as the session's shuffles have parts."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, order: str, **values: str) -> DataFrame:
    """(order, name, ...): for each value of a column the sum of others over all rows before, without putting all rows into one task. Values
    of `order` are different; values: name of the sum and of the column. Of the rows only these columns are moved and written."""
    narrow = df.select(F.col(order), *[F.col(c).alias(f"_v_{n}") for n, c in values.items()])
    x = narrow.repartitionByRange(ranges_of(df.sparkSession), order).withColumn("_p", F.spark_partition_id())
    before = lambda part: Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # ranges come from a sample, so that they must not be drawn again for their sizes
    x = cut_lineage(x.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(before("_p")), F.lit(0)).alias(f"_s_{n}") for n in values]))
    sizes = x.groupBy("_p").agg(*[F.sum(f"_v_{n}").alias(f"_n_{n}") for n in values])
    # one row for each range
    shift = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", *[F.coalesce(F.sum(f"_n_{n}").over(shift), F.lit(0)).alias(f"_t_{n}") for n in values])
    return x.join(F.broadcast(sizes), "_p").select(order, *[F.col(f"_v_{n}").alias(c) for n, c in values.items()], *[(F.col(f"_s_{n}") + F.col(f"_t_{n}")).alias(n) for n in values])


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of a whole-number column over all rows before, in order of a column of different values."""
    starts = running_totals(df, order, **{name: value}).select(F.col(order).alias("_o"), F.col(name).cast("bigint").alias(name))
    return df.join(starts, F.col(order).eqNullSafe(F.col("_o"))).drop("_o")


def padded_contigs(contigs: DataFrame, tiling: DataFrame, reads: DataFrame) -> DataFrame:
    """(id, seq): contigs whose 5' end no edge leads to get the read that they begin with in front, reverse-complemented if the end is `B`,
    and `_p` behind their id. contigs: id, seq; tiling: id, k (place), v, w (ends `read:E`); reads: read, seq."""
    first = tiling.groupBy("id").agg(F.min_by("v", "k").alias("v"))
    free = first.join(tiling.select(F.col("w").alias("v")).distinct(), "v", "left_anti")
    x = free.select("id", F.substring_index("v", ":", 1).alias("read"), F.substring_index("v", ":", -1).alias("end"))
    x = x.join(reads.select("read", F.col("seq").alias("pad")), "read")
    x = x.select("id", F.when(F.col("end") == "B", reverse_complement(F.col("pad"))).otherwise(F.col("pad")).alias("pad"))
    out = contigs.join(x, "id", "left")
    return out.select(F.concat("id", F.when(F.col("pad").isNotNull(), "_p").otherwise("")).alias("id"), F.concat(F.coalesce("pad", F.lit("")), "seq").alias("seq"))


def nearest_text(rows: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """Adds `nearest`, the name with the fewest edits, the first in order among equals. names is a short list of fixed names, one row each;
    it is collected and compared within each row."""
    known = [r[0] for r in names.select(name).distinct().orderBy(name).collect()]
    best = F.array_min(F.array(*[F.struct(F.levenshtein(F.col(text), F.lit(n)).alias("d"), F.lit(n).alias("n")) for n in known]))
    return rows.withColumn("nearest", best["n"])
