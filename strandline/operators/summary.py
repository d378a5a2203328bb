"""Report operators: statuses, tallies, distributions, set comparisons."""

from __future__ import annotations

import math
import re
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import running_totals
from strandline.session import cut_lineage

RESOLVED = 99.8


def counted(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(v, k, before): different values of a column with how many rows have them and how many have smaller ones, nulls left out; and one
    row `n`, how many there are. Values are put in order by ranges, never all in one task."""
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    c = cut_lineage(running_totals(c, "v", before="k"))
    return c, c.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def percentiles(df: DataFrame, column: str, *shares: float) -> DataFrame:
    """One row, p0, p1, ...: exact percentiles with linear interpolation between the neighbouring ranks; null without values."""
    c, n = counted(df, column)
    x = c.crossJoin(F.broadcast(n))  # one row
    aggs = []
    for k, p in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(float(p))
        here = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("k")), F.col("v").cast("double")))
        aggs += [here(F.floor(at)).alias(f"_lo{k}"), here(F.ceil(at)).alias(f"_hi{k}"), F.max(at).alias(f"_at{k}")]
    out = x.agg(*aggs)
    lo, hi, at = (lambda k, s=s: F.col(f"_{s}{k}") for s in ("lo", "hi", "at"))
    mix = lambda k: F.when(lo(k) == hi(k), lo(k)).otherwise((F.ceil(at(k)) - at(k)) * lo(k) + (at(k) - F.floor(at(k))) * hi(k))
    return out.select(*[mix(k).alias(f"p{k}") for k in range(len(shares))])


def describe(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """count, mean, std, min, quartiles and max, overall or per group. Overall, quartiles come from ranges of values; in a group, from its
    different values."""
    q = lambda p: F.percentile(column, F.lit(p))
    aggs = [F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min")]
    if keys:
        return df.groupBy(*keys).agg(*aggs, q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).alias("max"))
    out = df.agg(*aggs, F.max(column).alias("max")).crossJoin(F.broadcast(percentiles(df, column, 0.25, 0.5, 0.75)))  # one row each
    return out.select("count", "mean", "std", "min", F.col("p0").alias("q25"), F.col("p1").alias("q50"), F.col("p2").alias("q75"), "max")


def n50(df: DataFrame, length: str, *keys: str) -> DataFrame:
    """Length at which the running sum of ascending lengths reaches half of all. Lengths are counted before they are ordered; within a group
    the window has as many rows as it has different lengths, overall lengths are ordered by ranges."""
    c = df.groupBy(*keys, length).agg(F.sum(length).alias("bases"))
    if not keys:
        c = cut_lineage(running_totals(c.where(F.col(length).isNotNull()), length, run="bases"))
        hit = c.crossJoin(F.broadcast(c.agg(F.sum("bases").alias("total"))))  # one row
        return hit.where((F.col("run") + F.col("bases")) * 2 >= F.col("total")).agg(F.min(length).alias("n50"))
    run = Window.partitionBy(*keys).orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("run", F.sum("bases").over(run)).withColumn("total", F.sum("bases").over(Window.partitionBy(*keys)))
    return c.where(F.col("run") * 2 >= F.col("total")).groupBy(*keys).agg(F.min(length).alias("n50"))


def status(per_id: Column, rows: Column, has_assembly: Column) -> Column:
    """Of a cluster: several rows, none, diverged or resolved."""
    return F.when(~has_assembly, "Failed").when(rows > 1, "Multiple Assemblies").when(per_id < RESOLVED, "Diverged").otherwise("Resolved")


STATUSES = ("Failed", "Multiple Assemblies", "Diverged", "Resolved")


def classify(assemblies: DataFrame) -> DataFrame:
    """Adds `status` to rows of (collapse, cut, per_id, length)."""
    n = F.count("*").over(Window.partitionBy("collapse", "cut"))
    return assemblies.withColumn("status", status(F.col("per_id"), n, F.col("length").isNotNull()))


def status_pivot(classified: DataFrame) -> DataFrame:
    """(collapse, a column for each status): how many clusters."""
    names = {s: s.split(" ")[0].lower() for s in STATUSES}
    tally = [F.count_if(F.col("status") == s).alias(f"n_{k}") for s, k in names.items()]
    return classified.select("collapse", "cut", "status").distinct().groupBy("collapse").agg(*tally)


def first_success(rows: DataFrame, group: str, rank: str) -> DataFrame:
    """Rows of the lowest rank in each group, the others marked as unused."""
    return rows.withColumn("used", F.col(rank) == F.min(rank).over(Window.partitionBy(group)))


def ecdf(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """(value, share of rows, or of weight, up to it), one row per value, null first if there is one."""
    c = df.groupBy(F.col(column).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("w"))
    c = cut_lineage(running_totals(c, "value", before="w"))
    total = c.agg(F.sum("w").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("value", ((F.col("before") + F.col("w")) / F.col("total")).alias("ecdf"))  # one row


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) of all pairs, in one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def string_set(column: Column) -> Column:
    """Distinct values, in order, with commas between."""
    return F.array_join(F.sort_array(F.collect_set(column)), ", ")


def read_uniqueness(phase: DataFrame) -> DataFrame:
    """Adds `unique`: the read is in one cluster only. phase: readid, cut."""
    return phase.withColumn("unique", F.count("*").over(Window.partitionBy("readid")) == 1)


def multi_fraction(phase: DataFrame) -> DataFrame:
    """One row: reads, reads in several clusters, their share."""
    n = phase.groupBy("readid").agg(F.count("*").alias("k"))
    multi = F.count_if(F.col("k") > 1)
    return n.agg(F.count("*").alias("reads"), multi.alias("multi"), (multi / F.greatest(F.count("*"), F.lit(1))).alias("fraction"))


def key_comparison(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys of either side, marked `left`, `right` or `both`."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return x.join(y, list(keys), "full_outer").select(*keys, side.alias("side"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def collapse_count(df: DataFrame, *keys: str) -> DataFrame:
    """Bases of collapses and what they stand for at the mean coverage of all. df: start0, end0, mean_cov."""
    size = F.col("end0") - F.col("start0")
    base = df.agg(F.avg("mean_cov").alias("cov"))
    x = df.crossJoin(F.broadcast(base))  # one row
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("bases"), F.sum(size * F.col("mean_cov") / F.col("cov")).alias("true_bases"))


def rank_trim(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: the values at the ranks round(p * n) of the ordered column, not interpolated."""
    c, n = counted(df, column)
    at = lambda p: F.min(F.when(F.col("before") + F.col("k") >= F.greatest(F.lit(1), F.round(p * F.col("n"))), F.col("v")))
    return c.crossJoin(F.broadcast(n)).agg(at(low).alias("low"), at(high).alias("high"))  # one row


def identity_band(per_id: Column) -> Column:
    """Colour `r,g,b` of an identity in percent."""
    # fixed values: lower bound of the band and its colour
    bands = {100.0: "0,100,0", 99.99: "0,150,0", 99.8: "0,200,0", 99.0: "192,192,192", 95.0: "230,230,230"}
    out = F.when(per_id.isNull(), F.lit(None).cast("string"))
    for low, color in bands.items():
        out = out.when(per_id >= low, color)
    return out.otherwise("255,255,0")


def rescale_percent(df: DataFrame, column: str) -> DataFrame:
    """Fractions become percent if any value of the column is at most 1; what reaches 100 becomes 99.999999."""
    one = df.agg(F.coalesce(F.bool_or(F.col(column) <= 1.0), F.lit(False)).alias("_f"))  # one row
    x = df.crossJoin(F.broadcast(one))
    v = F.when(F.col("_f"), F.col(column) * 100).otherwise(F.col(column))
    return x.withColumn(column, F.when(v >= 100, F.lit(99.999999)).otherwise(v)).drop("_f")


def psv_density(df: DataFrame) -> DataFrame:
    """Adds `per_kb`, sites for each 1,000 bases of length; null for a length of zero."""
    return df.withColumn("per_kb", F.try_divide(F.col("n_psvs") * 1000, F.col("length")))


def second_depth_histogram(counts: DataFrame, width: int, below: int = 140) -> DataFrame:
    """(bin, n): positions by the depth of their second most common base, of those whose two most common ones sum to less than `below`.
    counts: a, c, g, t."""
    top = F.sort_array(F.array("a", "c", "g", "t"), asc=False)
    x = counts.select(top[0].alias("x"), top[1].alias("y")).where(F.col("x") + F.col("y") < below)
    return x.groupBy((F.floor(F.col("y") / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def totals(df: DataFrame) -> DataFrame:
    """One row: collapse_mbp, each collapse's length once, and assembled_mbp, all lengths. df: collapse, collapse_length, length."""
    once = df.groupBy("collapse").agg(F.max("collapse_length").alias("c"), F.sum("length").alias("l"))
    return once.agg((F.sum("c") / 1e6).alias("collapse_mbp"), (F.sum("l") / 1e6).alias("assembled_mbp"))


def most_frequent(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, name, n): the most frequent name of each group, the first in order among equals; nulls don't count."""
    c = df.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), name)
    return c.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def natural_full_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on all common columns, in which nulls are equal."""
    common = [c for c in a.columns if c in b.columns]
    x, y = a.alias("_a"), b.alias("_b")
    same = reduce(and_, [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in common], F.lit(True))
    keys = [F.coalesce(f"_a.{c}", f"_b.{c}").alias(c) for c in common]
    mine = [F.col(f"_a.{c}") for c in a.columns if c not in common]
    return x.join(y, same, "full_outer").select(*keys, *mine, *[F.col(f"_b.{c}") for c in b.columns if c not in common])


def in_all(*tables: DataFrame) -> DataFrame:
    """Rows that every table has, once."""
    return reduce(lambda x, y: x.intersect(y), tables)


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of tables with different columns; what a table lacks is null. Tables without columns are left out."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [t for t in tables if t.columns])


def reciprocal_members(a: DataFrame, b: DataFrame, fraction: float) -> DataFrame:
    """(x, y, common) of sets that have more than a fraction of both in common. a and b: set, member, each pair once."""
    size = lambda d, s, n: d.groupBy(F.col("set").alias(s)).agg(F.count("*").alias(n))
    both = a.select(F.col("set").alias("x"), "member").join(b.select(F.col("set").alias("y"), "member"), "member")
    both = both.groupBy("x", "y").agg(F.count("*").alias("common")).join(size(a, "x", "n"), "x").join(size(b, "y", "m"), "y")
    return both.where((F.col("common") > fraction * F.col("n")) & (F.col("common") > fraction * F.col("m"))).select("x", "y", "common")


def quantile_filter(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, log: bool = False) -> DataFrame:
    """Rows whose value lies within two percentiles, both included, with `value`, which is its logarithm to 10 if asked for."""
    q = percentiles(df, column, low, high).select(F.col("p0").alias("_p"), F.col("p1").alias("_q"))
    x = df.crossJoin(F.broadcast(q))  # one row
    x = x.where((F.col(column) >= F.col("_p")) & (F.col(column) <= F.col("_q"))).drop("_p", "_q")
    return x.withColumn("value", F.log10(column) if log else F.col(column).cast("double"))


def split_by_length(df: DataFrame, length: str, limit: int, identity: str | None = None, least: float = 90.0, shortest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows over and up to a length, of those that are long and like enough."""
    x = df.where(F.col(length) >= shortest)
    x = x if identity is None else x.where(F.col(identity) >= least)
    return x.where(F.col(length) > limit), x.where(F.col(length) <= limit)


def melt_filtered(df: DataFrame, size: int, most_repeats: float, near: int = 50_000) -> DataFrame:
    """All rows as `All`, and those of at least a size with at most some percent of repeats again as `Filtered`; near_end tells those that
    lie close to a contig's end. df: len, repeat_pct, end_distance."""
    x = df.withColumn("near_end", F.col("end_distance") < near)
    kept = x.where((F.col("len") >= size) & (F.col("repeat_pct") <= most_repeats))
    return x.withColumn("part", F.lit("All")).unionByName(kept.withColumn("part", F.lit("Filtered")))


def clone_validated(df: DataFrame) -> DataFrame:
    """Adds `validated`: like its clone, unlike the reference, and aligned nearly whole."""
    ok = (F.col("clone_per_id") >= RESOLVED) & (F.col("reference_per_id") <= RESOLVED) & (F.col("frac_in_aln") >= 0.9)
    return df.withColumn("validated", F.coalesce(ok, F.lit(False)))


def validated_fraction(df: DataFrame, total: float) -> DataFrame:
    """One row: the validated bases and their share of a total."""
    s = F.coalesce(F.sum(F.when(F.col("validated"), F.col("length"))), F.lit(0)).cast("bigint")
    return df.agg(s.alias("bases"), (s / F.lit(float(total))).alias("fraction"))


def named_genes(df: DataFrame, gene: str, unnamed: str = "LOC|LINC") -> DataFrame:
    """Rows whose gene has a name of its own."""
    return df.where(~F.col(gene).rlike(unnamed))


def gene_table(genes: DataFrame) -> DataFrame:
    """Different rows of named genes with length and status: over the limit assembled, else diverged. genes: start, end, per_id, gene, ..."""
    x = named_genes(genes, "gene").withColumn("length", F.col("end") - F.col("start"))
    return x.withColumn("status", F.when(F.col("per_id") > RESOLVED, "Assembled").otherwise("Diverged")).distinct()


def numbered_labels(df: DataFrame, order: list, label: str, most: int = 15, always: str | None = None) -> DataFrame:
    """Adds `label_id`: in order, the first rows with a label get numbers from 1 on, `most` of them, and later ones only if the label matches
    a pattern. Rows are numbered over all; the windows see ranges of rows and one row for each range."""
    from strandline.operators.alignment import number_rows

    x = number_rows(df, order, "_row")
    first = number_rows(x.where(F.col(label).isNotNull()), ["_row"], "_place")
    shown = F.col("_place") <= most
    if always:
        shown = shown | F.col(label).rlike(always)
    ids = number_rows(first.where(shown).select("_row"), ["_row"], "label_id")
    return x.join(ids, "_row", "left").drop("_row")


def relabelled(df: DataFrame) -> DataFrame:
    """Older statuses by today's names: a success is partially resolved, or resolved from the limit on; MultipleAsm is written out."""
    s = F.col("status")
    new = F.when(s == "Success", F.when(F.col("per_id") >= RESOLVED, "Resolved").otherwise("Partially Resolved")).when(s == "MultipleAsm", "Multiple Assemblies").otherwise(s)
    return df.withColumn("status", new)


def status_labels(df: DataFrame) -> DataFrame:
    """(status, n, mbp, label): rows of each status, millions of bases that they cover together, null for failed ones, and both as a
    text. df: status, contig, start0, end0."""
    from strandline.operators.intervals import merge_spans

    ok = df.where("start0 is not null and status <> 'Failed'")
    spans = merge_spans(ok.select(F.struct("status", "contig").alias("contig"), "start0", "end0"))
    mbp = spans.groupBy(F.col("contig.status").alias("status")).agg(F.round(F.sum(F.col("end0") - F.col("start0")) / 1e6, 1).alias("mbp"))
    n = df.groupBy("status").agg(F.count("*").alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(" / "), F.coalesce(F.concat(F.format_number("mbp", 1), F.lit(" Mbp")), F.lit("NA")))
    return n.join(mbp, "status", "left").select("status", "n", "mbp", text.alias("label"))


def genome_stats(df: DataFrame) -> DataFrame:
    """One row for each genome: rows, mean length, bases resolved, diverged and both, and of different collapses, in millions. df: genome,
    collapse, collapse_length, status, length."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("length"))), F.lit(0)) / 1e6
    x = df.groupBy("genome").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), of("Resolved").alias("resolved"), of("Diverged").alias("diverged"))
    once = df.groupBy("genome", "collapse").agg(F.max("collapse_length").alias("c")).groupBy("genome").agg((F.sum("c") / 1e6).alias("collapsed"))
    return x.withColumn("both", F.col("resolved") + F.col("diverged")).join(once, "genome")


def subset_sums(df: DataFrame, value: str, **subsets: Column) -> DataFrame:
    """One row: the sum of a column over each named condition, in one pass."""
    return df.agg(*[F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0)).alias(n) for n, c in subsets.items()])


def read_bases(phase: DataFrame) -> DataFrame:
    """One row: reads and bases of reads in one cluster and in several. phase: readid, cut, length."""
    x = phase.groupBy("readid").agg(F.count("*").alias("k"), F.max("length").alias("b"))
    many = F.col("k") > 1
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("b"))), F.lit(0))
    return x.agg(F.count_if(~many).alias("unique_reads"), total(~many).alias("unique_bases"), F.count_if(many).alias("multi_reads"), total(many).alias("multi_bases"))


def columns_like(df: DataFrame, drop_numbers: bool = False, pattern: str | None = None) -> DataFrame:
    """The columns whose names aren't numbers, or match a pattern."""
    names = [c for c in df.columns if not (drop_numbers and c.isdigit()) and (pattern is None or re.search(pattern, c))]
    return df.select(*[F.col(f"`{c}`") for c in names])


def region_table(regions: DataFrame) -> DataFrame:
    """One row: copies, the mean length, and the regions as a text, in order. regions: contig, start0, end0."""
    text = F.concat_ws("", F.col("contig").cast("string"), F.lit(":"), F.col("start0").cast("string"), F.lit("-"), F.col("end0").cast("string"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contig", "start0", "end0", text.alias("t")))), lambda r: r["t"]), ";")
    return regions.agg(F.count("*").alias("copies"), F.avg(F.col("end0") - F.col("start0")).alias("mean_length"), listed.alias("regions"))


def local_assembly_table(assemblies: DataFrame, names: DataFrame, reads: DataFrame, psvs: DataFrame) -> DataFrame:
    """The wide table of local assemblies: every named sequence with its alignment, best match, status, sites and reads of its cluster, and the
    totals of its collapse. assemblies: collapse, query_name, per_id, reference_name, reference_start, reference_end; names: collapse,
    cut, query_name, length (null: the cluster has no assembly); reads and psvs: collapse, cut, n_reads or n_psvs."""
    from strandline.operators.gaps import best_match

    x = best_match(names.join(assemblies, ["collapse", "query_name"], "full_outer"))
    x = classify(x).join(reads, ["collapse", "cut"], "left").join(psvs, ["collapse", "cut"], "left")
    n = lambda s: F.count_if(F.col("status") == s)
    once = x.groupBy("collapse", "cut", "status").agg(F.max("n_reads").alias("r"), F.max("n_psvs").alias("p"))
    whole = once.groupBy("collapse").agg(
        F.count("*").alias("n_groups"), n("Failed").alias("n_failed"), n("Multiple Assemblies").alias("n_multiple"), n("Diverged").alias("n_diverged"),
        n("Resolved").alias("n_resolved"), F.sum("r").alias("total_reads"), F.sum("p").alias("total_psvs"),
    )
    return x.join(whole, "collapse").withColumn("n_assemblies", F.col("n_diverged") + F.col("n_resolved"))


def summary_text(table: DataFrame) -> DataFrame:
    """(collapse, value): a text for each collapse of local_assembly_table with its regions, three in a line. table has `regions`, too."""
    listed = F.split("regions", ";")
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(listed) / 3).cast("int") - 1, F.lit(0))), lambda k: F.array_join(F.slice(listed, k * 3 + 1, 3), "  "))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("cut", "status", "per_id", "bestMatch", "length", "n_psvs", "query_name")]
    row = F.struct("cut", "query_name", F.concat_ws(" ", *cells).alias("line"))
    per = table.groupBy("collapse").agg(
        F.first("regions").alias("regions"), F.first("n_assemblies").alias("a"), F.first("n_groups").alias("g"), F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"]).alias("rows")
    )
    head = F.format_string("region: %s\nnumber of assemblies: %d\nnumber of groups: %d\nregions in reference:\n", F.col("collapse").cast("string"), "a", "g")
    return per.select("collapse", F.concat(head, F.array_join(lines, "\n"), F.lit("\ngroups:\n"), F.array_join("rows", "\n")).alias("value"))


def ks_test(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the two-sample Kolmogorov-Smirnov statistic, the largest distance of both distributions, and its asymptotic p-value. Equal
    values are counted first, so that the window sees different ones only."""
    side = lambda d, k: d.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.lit(k).alias("s"))
    c = side(a, 0).unionByName(side(b, 1)).groupBy("v").agg(F.count_if(F.col("s") == 0).alias("x"), F.count_if(F.col("s") == 1).alias("y"))
    c = cut_lineage(running_totals(c, "v", xs="x", ys="y"))
    whole = c.agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    d = F.abs((F.col("xs") + F.col("x")) / F.col("n") - (F.col("ys") + F.col("y")) / F.col("m"))
    out = c.crossJoin(F.broadcast(whole)).select(d.alias("d"), "n", "m")  # one row
    out = out.agg(F.max("d").alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))
    root = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("d")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * root * root))
    p = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return out.select("n", "m", F.col("d").alias("statistic"), F.when(root < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).alias("p_value"))


def signed_rank_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, the sum of the ranks of positive differences of two columns, and the two-sided p-value of Wilcoxon's test by the normal
    approximation with ties. Differences are counted by size first, so that the window sees different sizes only."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    c = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    c = cut_lineage(running_totals(c, "size", before="k", less="up"))
    c = c.select("k", "up", (F.col("before") + (F.col("k") + 1) / 2).alias("rank"))
    s = c.agg(F.sum("k").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(F.expr("k * k * k - k")).alias("ties"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.abs(F.col("w") - n * (n + 1) / 4) / F.sqrt(var)
    # the normal tail by the continued fraction of the error function's complement
    x = z / math.sqrt(2)
    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda f, k: x + k / (2.0 * f))
    near = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.struct(x.alias("t"), F.lit(0.0).alias("s")), lambda s, k: F.struct((s["t"] * -x * x / (k + 1)).alias("t"), (s["s"] + s["t"] / (2 * k + 1)).alias("s")))["s"]
    tail = F.when(x > 2, F.exp(-x * x) / (math.sqrt(math.pi) * frac)).otherwise(1 - 2 / math.sqrt(math.pi) * near)
    return s.select("n", F.col("w").alias("statistic"), tail.alias("p_value"))
