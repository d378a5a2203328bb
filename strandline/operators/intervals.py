"""Interval algebra on half-open, 0-based intervals (contig, start0, end0).

Joins on overlap are equi-joins on (contig, bin): an interval goes to every bin that it touches, and a pair counts in the bin
of its first common position only. Bins bound the rows of a key, so that a long or hot contig is spread over tasks. Merging works
within bins, too: what reaches a bin from those before comes from a table of one row for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.summary import percentiles
from strandline.session import cut_lineage


def _bins(start: str, end: str, width: int) -> Column:
    first = F.floor(F.col(start) / width)
    return F.explode(F.sequence(first, F.greatest(first, F.floor((F.col(end) - 1) / width))))


def overlap_join(a: DataFrame, b: DataFrame, width: int, how: str = "inner") -> DataFrame:
    """Pairs with at least one common position, with `ov`, the overlap length. Columns of b get the prefix `b_`, contig apart.
    how = "left": rows of a without a partner come once, with ov 0 and nulls; nulls in other columns and equal rows don't matter."""
    if how == "left":  # rows are told apart by a number, which is written so that it stays
        a = cut_lineage(a.withColumn("_row", F.monotonically_increasing_id()))
    right = b.select(*[F.col(c).alias("contig" if c == "contig" else f"b_{c}") for c in b.columns])
    x = a.withColumn("bin", _bins("start0", "end0", width))
    y = right.withColumn("bin", _bins("b_start0", "b_end0", width))
    start, end = F.greatest("start0", "b_start0"), F.least("end0", "b_end0")
    pairs = x.join(y, ["contig", "bin"]).where((start < end) & (F.col("bin") == F.floor(start / width)))
    pairs = pairs.withColumn("ov", end - start).select(*a.columns, *[c for c in right.columns if c != "contig"], "ov")
    if how == "inner":
        return pairs
    lonely = a.join(pairs.select("_row").distinct(), "_row", "left_anti").withColumn("ov", F.lit(0).cast("bigint"))
    return pairs.unionByName(lonely, allowMissingColumns=True).drop("_row")


def windows(contigs: DataFrame, width: int) -> DataFrame:
    """Windows of `width` that tile each contig from lo to hi; the last one is shorter."""
    starts = contigs.where("lo < hi").select("contig", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(width).cast("bigint"))).alias("start0"))
    return starts.select("contig", "start0", F.least(F.col("start0") + width, F.col("hi")).alias("end0"))


def window_coverage(wins: DataFrame, reads: DataFrame, width: int) -> DataFrame:
    """Mean depth of each window: covered positions over its length, 0 if nothing covers it."""
    y = reads.select("contig", F.col("start0").alias("rs"), F.col("end0").alias("re"))
    # windows may straddle two bins, so they are exploded like the reads; each pair adds its part within the bin
    x = wins.withColumn("bin", _bins("start0", "end0", width))
    y = y.withColumn("bin", _bins("rs", "re", width))
    part = F.least("end0", "re", (F.col("bin") + 1) * width) - F.greatest("start0", "rs", F.col("bin") * width)
    sums = x.join(y, ["contig", "bin"]).where(part > 0).groupBy("contig", "start0", "end0").agg(F.sum(part).alias("covered"))
    out = wins.join(sums, ["contig", "start0", "end0"], "left")
    return out.select("contig", "start0", "end0", (F.coalesce("covered", F.lit(0)) / (F.col("end0") - F.col("start0"))).alias("coverage"))


def _before(per: DataFrame, what: Column, name: str) -> DataFrame:
    """(contig, _bin, name): an aggregate over all earlier bins of the contig, from one row for each bin."""
    earlier = Window.partitionBy("contig").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(F.col("contig").alias("_c"), F.col("_bin").alias("_b"), what.over(earlier).alias(name))


def _with(x: DataFrame, per: DataFrame) -> DataFrame:
    return x.join(per, F.col("contig").eqNullSafe(F.col("_c")) & F.col("_bin").eqNullSafe(F.col("_b"))).drop("_c", "_b")


def _local(df: DataFrame, distance: int, width: int) -> DataFrame:
    """Adds `_bin` and `_k`: the bin in which an interval starts and which island of this bin alone it is in, from one sort."""
    w = Window.partitionBy("contig", "_bin").orderBy("start0", "end0")
    x = df.withColumn("_bin", F.floor(F.col("start0") / width))
    reach = F.max("end0").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start0") > reach + distance), 1).otherwise(0)
    # equal intervals lie next to each other, and only the first of them can begin an island: whatever their order, the count is the same
    return x.withColumn("_new", new).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _stitched(parts: DataFrame, distance: int) -> DataFrame:
    """Adds `grp` to the islands of bins (contig, _bin, _k, start0, end0, ...): those that an island of earlier bins reaches go on with its
    number. What comes from earlier bins is one row for each bin: how far they reach, and how many islands began in them."""
    reach = parts.groupBy("contig", "_bin").agg(F.max("end0").alias("end0"))
    x = _with(parts, _before(reach, F.max("end0"), "_reach"))
    x = x.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start0") > F.col("_reach") + distance), 1).otherwise(0)).drop("_reach")
    began = x.groupBy("contig", "_bin").agg(F.sum("_new").alias("n"))
    x = _with(x, _before(began, F.sum("n"), "_base"))
    w = Window.partitionBy("contig", "_bin").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("grp", F.coalesce("_base", F.lit(0)) + F.sum("_new").over(w)).drop("_new", "_base")


def islands(df: DataFrame, distance: int, width: int = 1 << 20) -> DataFrame:
    """Adds `grp`: intervals of a contig that overlap or lie at most `distance` apart share it (-1: one base in common). Intervals
    are in order within bins of `width` positions only, so that a hot contig is many tasks. The intervals are read and shuffled once, then
    written for the join with the numbers of their islands."""
    x = cut_lineage(_local(df, distance, width))
    parts = x.groupBy("contig", "_bin", "_k").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"))
    number = _stitched(parts, distance).select(F.col("contig").alias("_c"), F.col("_bin").alias("_b"), F.col("_k").alias("_i"), "grp")
    same = F.col("contig").eqNullSafe(F.col("_c")) & F.col("_bin").eqNullSafe(F.col("_b")) & (F.col("_k") == F.col("_i"))
    return x.join(number, same).select(*df.columns, "grp")


def merge(df: DataFrame, distance: int = 0, *aggs: Column, width: int = 1 << 20) -> DataFrame:
    """Merged intervals of each contig, with `n`, how many went in, and further aggregates over their rows. Without further ones the
    intervals become islands of bins as they are read, and only these are written and stitched."""
    ends = F.min("start0").alias("start0"), F.max("end0").alias("end0")
    if aggs:
        return islands(df, distance, width).groupBy("contig", "grp").agg(*ends, F.count("*").alias("n"), *aggs).drop("grp")
    parts = cut_lineage(_local(df.select("contig", "start0", "end0"), distance, width).groupBy("contig", "_bin", "_k").agg(*ends, F.count("*").alias("n")))
    return _stitched(parts, distance).groupBy("contig", "grp").agg(*ends, F.sum("n").alias("n")).drop("grp")


def merge_spans(df: DataFrame, distance: int = 0, width: int = 1 << 20) -> DataFrame:
    """As merge, without counts."""
    return merge(df.select("contig", "start0", "end0"), distance, width=width).drop("n")


def trimmed_stats(df: DataFrame, column: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """One row: mean and sample deviation of the values strictly between two percentiles, and their number."""
    x = df.select(column).crossJoin(F.broadcast(percentiles(df, column, low, high)))  # one row
    x = x.where((F.col(column) > F.col("p0")) & (F.col(column) < F.col("p1")))
    return x.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count("*").alias("n"))


def collapse_regions(reads: DataFrame, contigs: DataFrame, window: int, min_length: int, sigmas: float = 3.0) -> DataFrame:
    """Regions of too much depth: windows over mean + sigmas * sqrt(mean) of the trimmed depth, merged where they touch, if
    longer than min_length. Columns: contig, start0, end0, mean_cov, median_cov, n."""
    cov = window_coverage(windows(contigs, window), reads, window)
    mean = trimmed_stats(cov, "coverage").select(F.col("mean").alias("m"))
    high = cov.crossJoin(F.broadcast(mean)).where(F.col("coverage") > F.col("m") + sigmas * F.sqrt("m"))  # one row
    out = merge(high, 0, F.avg("coverage").alias("mean_cov"), F.median("coverage").alias("median_cov"))
    return out.where(F.col("end0") - F.col("start0") > min_length)


def gap_to_next(df: DataFrame) -> DataFrame:
    """Adds `gap`: the next interval's end in the contig less this one's start; null for the last."""
    w = Window.partitionBy("contig").orderBy("start0", "end0")
    return df.withColumn("gap", F.lead("end0").over(w) - F.col("start0"))


def high_runs(df: DataFrame, value: str, threshold: Column, gap: int, min_run: int) -> DataFrame:
    """Runs of windows over a threshold within a contig; runs at most `gap` windows apart are closed; shorter than min_run go.
    df: contig, idx (window number), value."""
    hits = df.where(F.col(value) > threshold).select("contig", F.col("idx").alias("start0"), (F.col("idx") + 1).alias("end0"))
    return merge(hits, gap).where(F.col("end0") - F.col("start0") >= min_run).select("contig", "start0", "end0", "n")


def slop(df: DataFrame, before: int, after: int, hi: str | None = None) -> DataFrame:
    """Intervals grown on both sides, clipped at 0 and, where given, at a column."""
    end = F.col("end0") + after
    return df.withColumn("start0", F.greatest(F.lit(0).cast("bigint"), F.col("start0") - before)).withColumn("end0", F.least(end, F.col(hi)) if hi else end)


def parse_region(text: Column) -> Column:
    """`chr:start-end` to a struct; commas in numbers are dropped, what doesn't parse is null."""
    clean = F.replace(text, F.lit(","), F.lit(""))
    pattern = r"^(.+):([0-9]+)-([0-9]+)$"
    part = lambda k: F.regexp_extract(clean, pattern, k)
    return F.when(clean.rlike(pattern), F.struct(part(1).alias("contig"), part(2).try_cast("bigint").alias("start0"), part(3).try_cast("bigint").alias("end0")))


def format_region(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def points_in_intervals(intervals: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points p with start0 <= p <= end0 of the same contig. points: contig, p, ...; intervals' other columns are kept."""
    x = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start0") / width), F.floor(F.col("end0") / width))))
    y = points.withColumn("bin", F.floor(F.col("p") / width))
    return x.join(y, ["contig", "bin"]).where("p >= start0 and p <= end0").drop("bin")


def gap_between(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Positions between two intervals, from the one that ends first; negative if they overlap."""
    return F.when(end < other_end, other_start - end).otherwise(start - other_end)


def overlap_length(start: Column, end: Column, other_start: Column, other_end: Column, compat: bool = False) -> Column:
    """Common positions, 0 if there are none. compat: as an old tool has it, from the end of the one that ends first back to the start
    of the other, also where one holds the other."""
    if not compat:
        return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start))
    first = end < other_end
    back = F.when(first, end - other_start).otherwise(other_end - start)
    return F.greatest(F.lit(0), back)


def reciprocal_overlap(a: DataFrame, b: DataFrame, width: int, fraction: float) -> DataFrame:
    """Pairs of overlap_join whose overlap is over `fraction` of both."""
    of = lambda s, e: F.col("ov") > fraction * (F.col(e) - F.col(s))
    return overlap_join(a, b, width).where(of("start0", "end0") & of("b_start0", "b_end0"))


def uncovered_fraction(part: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: `fraction`, one less the merged length of part over that of whole. Null without a length."""
    total = lambda d, n: merge_spans(d).agg(F.sum(F.col("end0") - F.col("start0")).alias(n))
    both = total(part, "p").crossJoin(F.broadcast(total(whole, "w")))  # one row each
    return both.select((1 - F.try_divide(F.coalesce("p", F.lit(0)), F.col("w"))).alias("fraction"))


def in_region(df: DataFrame, contig: str, start0: int, end0: int) -> DataFrame:
    """Intervals that share a position with a region; plain comparisons, so that Parquet's statistics skip the others."""
    return df.where((F.col("contig") == contig) & (F.col("start0") < end0) & (F.col("end0") > start0))
