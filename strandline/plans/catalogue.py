"""Named queries of the engine, each with the SQL that says the same, over the projections in fixtures.

`query` registers a function (spark, sf_dir) -> DataFrame under its name; `sql` gives its DuckDB text. Floating-point
results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import alignment as AL
from strandline.operators import cluster as C
from strandline.operators import genotype as G
from strandline.operators import graph as H
from strandline.operators import intervals as I
from strandline.operators import summary as R
from strandline.plans.fixtures import duck_views, spark_view

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

WINDOW = 24
BIN = 96


def _sql_text(sql: str, views: tuple[str, ...]) -> str:
    text = sql.strip()
    head = duck_views(*views) if views else ""
    if head and text.upper().startswith("WITH "):
        text = f"{head}, {text[5:]}"
    elif head:
        text = f"{head} {text}"
    return text


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _sql_text(sql, views)
        return f

    return keep


def thinned(sql: str, views: tuple[str, ...]):
    """Registers a query of the thinned matrix, and as NAME_dense the same on all events; f takes the matrix view as `view`."""

    def keep(f):
        query(sql, views)(f)
        name = f"{f.__name__}_dense"
        _QUERIES[name] = partial(f, view="v_matrix")
        _SQL[name] = _sql_text(sql.replace("v_matrix_sparse", "v_matrix"), ("v_matrix",))
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


# ---------------------------------------------------------------- intervals

COV = """
wins AS (SELECT contig, start0, end0 FROM v_windows),
cov AS (SELECT w.contig, w.start0, w.end0,
  sum(CASE WHEN r.start0 IS NULL THEN 0 ELSE least(w.end0, r.end0) - greatest(w.start0, r.start0) END) / (w.end0 - w.start0) AS coverage
  FROM wins w LEFT JOIN v_intervals r ON r.contig = w.contig AND r.start0 < w.end0 AND r.end0 > w.start0 GROUP BY 1, 2, 3)
"""

TRIM = """
q AS (SELECT quantile_cont(coverage, 0.1) AS lo, quantile_cont(coverage, 0.9) AS hi FROM cov),
t AS (SELECT avg(coverage) AS m, stddev_samp(coverage) AS sd, count(*) AS n FROM cov, q WHERE coverage > lo AND coverage < hi)
"""


def merged(source: str, distance: int, extra: str = "") -> str:
    return f"""
o AS (SELECT *, max(end0) OVER (PARTITION BY contig ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start0, end0, fresh DESC ROWS UNBOUNDED PRECEDING) AS grp
  FROM (SELECT *, CASE WHEN reach IS NULL OR start0 > reach + {distance} THEN 1 ELSE 0 END AS fresh FROM o) t),
m AS (SELECT contig, min(start0) AS start0, max(end0) AS end0, count(*) AS n {extra} FROM g GROUP BY contig, grp)
"""


@query(
    f"WITH {COV}, {TRIM}, h AS (SELECT cov.* FROM cov, t WHERE coverage > m + 0.5 * sqrt(m)), {merged('h', 0, ', avg(coverage) AS mean_cov, median(coverage) AS median_cov')} "
    "SELECT contig, start0, end0, round(mean_cov, 6) AS mean_cov, round(median_cov, 6) AS median_cov, n FROM m WHERE end0 - start0 > 24",
    ("v_windows", "v_intervals"),
)
def collapse_regions(spark, sf_dir):
    """The flagship: regions with too much depth. The tables are shallow, so the limit is half a deviation."""
    out = I.collapse_regions(spark_view(spark, sf_dir, "v_intervals"), spark_view(spark, sf_dir, "v_contigs"), WINDOW, 24, 0.5)
    return out.select("contig", "start0", "end0", _r("mean_cov"), _r("median_cov"), "n")


@query("SELECT contig, start0, end0 FROM v_windows", ("v_windows",))
def make_windows(spark, sf_dir):
    return I.windows(spark_view(spark, sf_dir, "v_contigs"), WINDOW)


@query(f"WITH {COV} SELECT contig, start0, end0, round(coverage, 6) AS coverage FROM cov", ("v_windows", "v_intervals"))
def window_mean_coverage(spark, sf_dir):
    out = I.window_coverage(spark_view(spark, sf_dir, "v_windows"), spark_view(spark, sf_dir, "v_intervals"), BIN)
    return out.select("contig", "start0", "end0", _r("coverage"))


@query("SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events, (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events) q WHERE value > lo AND value < hi")
def trimmed_stats(spark, sf_dir):
    out = I.trimmed_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")
    return out.select(_r("mean"), _r("std"), "n")


DESCRIBE = "count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max"


@query(f"SELECT event_type, {DESCRIBE.format(c='value')} FROM events GROUP BY event_type")
def describe_stats(spark, sf_dir):
    out = R.describe(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")
    return out.select("event_type", "count", _r("mean"), _r("std"), "min", _r("q25"), _r("q50"), _r("q75"), "max")


@query(f"SELECT {DESCRIBE.format(c='value')} FROM events")
def describe_all(spark, sf_dir):
    out = R.describe(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")
    return out.select("count", _r("mean"), _r("std"), "min", _r("q25"), _r("q50"), _r("q75"), "max")


def _merge_query(name: str, distance: int):
    def f(spark, sf_dir):
        return I.merge(spark_view(spark, sf_dir, "v_intervals"), distance)

    f.__name__ = name
    query(f"WITH {merged('v_intervals', distance)} SELECT * FROM m", ("v_intervals",))(f)


for _name, _d in (("merge_intervals_d0", 0), ("merge_intervals_dneg1", -1), ("merge_intervals_d2", 2), ("merge_intervals_d10", 10)):
    _merge_query(_name, _d)


@query(f"WITH {merged('v_intervals', 0)} SELECT contig, start0, end0 FROM m", ("v_intervals",))
def merge_spans_two_level(spark, sf_dir):
    return I.merge_spans(spark_view(spark, sf_dir, "v_intervals"), 0, 100)


@query(
    f"WITH {merged('v_intervals', 0, ', avg(value) AS mean, median(value) AS median, sum(value) AS total')} SELECT contig, start0, end0, n, round(mean, 6) AS mean, round(median, 6) AS median, round(total, 4) AS total FROM m",
    ("v_intervals",),
)
def merge_with_mean_median_sum(spark, sf_dir):
    out = I.merge(spark_view(spark, sf_dir, "v_intervals"), 0, F.avg("value").alias("mean"), F.median("value").alias("median"), F.sum("value").alias("total"))
    return out.select("contig", "start0", "end0", "n", _r("mean"), _r("median"), _r("total", 4))


_PURCHASES = "(SELECT contig, start0, end0, value FROM v_intervals WHERE event_type = 'purchase')"


def _purchases(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_intervals").where("event_type = 'purchase'").select("contig", "start0", "end0", "value")


@query(
    f"SELECT w.contig, w.start0, w.end0, b.start0 AS b_start0, b.end0 AS b_end0, b.value AS b_value, CASE WHEN b.start0 IS NULL THEN 0 ELSE least(w.end0, b.end0) - greatest(w.start0, b.start0) END AS ov FROM v_windows w LEFT JOIN {_PURCHASES} b ON b.contig = w.contig AND b.start0 < w.end0 AND b.end0 > w.start0",
    ("v_windows", "v_intervals"),
)
def intersect_wao(spark, sf_dir):
    return I.overlap_join(spark_view(spark, sf_dir, "v_windows"), _purchases(spark, sf_dir), BIN, "left")


@query(
    f"WITH {merged(_PURCHASES, 0)} SELECT w.contig, w.start0, w.end0, CAST(sum(CASE WHEN m.start0 IS NULL THEN 0 ELSE least(w.end0, m.end0) - greatest(w.start0, m.start0) END) AS BIGINT) AS repeat_bp FROM v_windows w LEFT JOIN m ON m.contig = w.contig AND m.start0 < w.end0 AND m.end0 > w.start0 GROUP BY 1, 2, 3",
    ("v_windows", "v_intervals"),
)
def repeat_bases_per_window(spark, sf_dir):
    rep = I.merge(_purchases(spark, sf_dir), 0).select("contig", "start0", "end0")
    out = I.overlap_join(spark_view(spark, sf_dir, "v_windows"), rep, BIN, "left")
    return out.groupBy("contig", "start0", "end0").agg(F.sum("ov").alias("repeat_bp"))


@query(
    f"SELECT DISTINCT a.f, w.contig, w.start0, w.end0 FROM v_windows w JOIN (SELECT contig, min(start0) AS start0, min(start0) + 60 AS end0 FROM {_PURCHASES} p GROUP BY contig) b ON b.contig = w.contig AND b.start0 < w.end0 AND b.end0 > w.start0 JOIN (SELECT i / 10.0::DOUBLE AS f FROM range(1, 11) r(i)) a ON (least(w.end0, b.end0) - greatest(w.start0, b.start0)) >= a.f * (w.end0 - w.start0)",
    ("v_windows", "v_intervals"),
)
def intersect_fraction(spark, sf_dir):
    b = _purchases(spark, sf_dir).groupBy("contig").agg(F.min("start0").alias("start0"), (F.min("start0") + 60).alias("end0"))
    out = I.overlap_join(spark_view(spark, sf_dir, "v_windows"), b, BIN)
    out = out.withColumn("f", F.explode(F.array(*[F.lit(i / 10.0) for i in range(1, 11)])))
    return out.where(F.col("ov") >= F.col("f") * (F.col("end0") - F.col("start0"))).select("f", "contig", "start0", "end0").distinct()


@query(
    f"SELECT w.contig, w.start0, w.end0, round(sum(b.value * (least(w.end0, b.end0) - greatest(w.start0, b.start0))) / sum(least(w.end0, b.end0) - greatest(w.start0, b.start0)), 6) AS identity FROM v_windows w JOIN {_PURCHASES} b ON b.contig = w.contig AND b.start0 < w.end0 AND b.end0 > w.start0 GROUP BY 1, 2, 3",
    ("v_windows", "v_intervals"),
)
def overlap_weighted_identity(spark, sf_dir):
    out = I.overlap_join(spark_view(spark, sf_dir, "v_windows"), _purchases(spark, sf_dir), BIN)
    mean = F.sum(F.col("b_value") * F.col("ov")) / F.sum("ov")
    return out.groupBy("contig", "start0", "end0").agg(F.round(mean, 6).alias("identity"))


@query(
    f"WITH c AS (SELECT w.contig, greatest(w.start0, b.start0) AS start0, least(w.end0, b.end0) AS end0 FROM v_windows w JOIN {_PURCHASES} b ON b.contig = w.contig AND b.start0 < w.end0 AND b.end0 > w.start0), {merged('c', -1)} SELECT * FROM m",
    ("v_windows", "v_intervals"),
)
def intersect_pairwise(spark, sf_dir):
    out = I.overlap_join(spark_view(spark, sf_dir, "v_windows"), _purchases(spark, sf_dir), BIN)
    return I.merge(out.select("contig", F.greatest("start0", "b_start0").alias("start0"), F.least("end0", "b_end0").alias("end0")), -1)


_STATUS = "CASE WHEN per_id < 99.8 THEN 'Diverged' ELSE 'Resolved' END"


@query(
    f"WITH s AS (SELECT concat(CAST(chr AS VARCHAR), '/', {_STATUS}) AS contig, start0, end0 FROM v_assembly), {merged('s', 0)} SELECT split_part(contig, '/', 2) AS status, CAST(sum(end0 - start0) AS BIGINT) AS bases FROM m GROUP BY 1",
    ("v_assembly",),
)
def union_length_by_status(spark, sf_dir):
    st = F.when(F.col("per_id") < R.RESOLVED, "Diverged").otherwise("Resolved")
    a = spark_view(spark, sf_dir, "v_assembly").select(F.concat(F.col("chr").cast("string"), F.lit("/"), st).alias("contig"), "start0", "end0")
    out = I.merge_spans(a, 0, 1_000_000)
    return out.groupBy(F.substring_index("contig", "/", -1).alias("status")).agg(F.sum(F.col("end0") - F.col("start0")).alias("bases"))


@query(
    "SELECT w.contig, w.start0, w.end0, count(*) FILTER (WHERE r.start0 BETWEEN w.start0 AND w.end0) AS starts, count(*) FILTER (WHERE r.end0 BETWEEN w.start0 AND w.end0) AS ends, greatest(count(*) FILTER (WHERE r.start0 BETWEEN w.start0 AND w.end0), count(*) FILTER (WHERE r.end0 BETWEEN w.start0 AND w.end0)) AS most FROM v_windows w JOIN v_intervals r ON r.contig = w.contig AND (r.start0 BETWEEN w.start0 AND w.end0 OR r.end0 BETWEEN w.start0 AND w.end0) GROUP BY 1, 2, 3",
    ("v_windows", "v_intervals"),
)
def starts_ends_in_region(spark, sf_dir):
    ends = F.explode(F.array(F.struct(F.col("start0").alias("p"), F.lit(True).alias("first")), F.struct(F.col("end0").alias("p"), F.lit(False).alias("first"))))
    points = spark_view(spark, sf_dir, "v_intervals").select("contig", ends.alias("e")).select("contig", "e.*")
    out = I.points_in_intervals(spark_view(spark, sf_dir, "v_windows"), points, BIN)
    a, b = F.count_if("first"), F.count_if(~F.col("first"))
    return out.groupBy("contig", "start0", "end0").agg(a.alias("starts"), b.alias("ends"), F.greatest(a, b).alias("most"))


@query("SELECT contig, start0, end0, lead(end0) OVER (PARTITION BY contig ORDER BY start0, end0) - start0 AS gap FROM v_windows", ("v_windows",))
def gap_to_next(spark, sf_dir):
    return I.gap_to_next(spark_view(spark, sf_dir, "v_windows"))


@query(
    f"WITH {COV}, lim AS (SELECT 2 * avg(coverage) - 0.1 * stddev_samp(coverage) AS t FROM cov), n AS (SELECT contig, CAST(row_number() OVER (PARTITION BY contig ORDER BY start0) - 1 AS BIGINT) AS idx, coverage FROM cov), h AS (SELECT contig, idx AS start0, idx + 1 AS end0 FROM n, lim WHERE coverage > t), {merged('h', 1)} SELECT * FROM m WHERE end0 - start0 >= 2",
    ("v_windows", "v_intervals"),
)
def high_cov_runs(spark, sf_dir):
    cov = I.window_coverage(spark_view(spark, sf_dir, "v_windows"), spark_view(spark, sf_dir, "v_intervals"), BIN)
    limit = cov.agg((2 * F.avg("coverage") - 0.1 * F.stddev_samp("coverage")).alias("t"))
    x = cov.withColumn("idx", (F.row_number().over(Window.partitionBy("contig").orderBy("start0")) - 1).cast("bigint"))
    return I.high_runs(x.crossJoin(F.broadcast(limit)), "coverage", F.col("t"), 1, 2)  # one row


@query("SELECT contig, start0, end0, mean_cov, repeat_bp, len FROM v_collapse WHERE len > 15000 AND repeat_bp * 100.0 / len <= 75", ("v_collapse",))
def repeat_content_filter(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_collapse").where((F.col("len") > 15000) & (F.col("repeat_bp") * 100.0 / F.col("len") <= 75))


@query("SELECT contig, count(*) AS n, CAST(sum(end0 - start0) AS BIGINT) AS bases, round(sum((end0 - start0) * mean_cov / cov), 2) AS true_bases FROM v_collapse, (SELECT avg(mean_cov) AS cov FROM v_collapse) a GROUP BY contig", ("v_collapse",))
def collapse_count(spark, sf_dir):
    return R.collapse_count(spark_view(spark, sf_dir, "v_collapse"), "contig").select("contig", "n", "bases", _r("true_bases", 2))


@query(
    "SELECT contig, greatest(CAST(0 AS BIGINT), start0 - 10) AS start0, end0 + 5 AS end0, concat(CAST(contig AS VARCHAR), ':', CAST(start0 AS VARCHAR), '-', CAST(end0 AS VARCHAR)) AS region FROM v_intervals",
    ("v_intervals",),
)
def region_slop(spark, sf_dir):
    x = spark_view(spark, sf_dir, "v_intervals").select("contig", "start0", "end0")
    x = x.withColumn("region", I.format_region(F.col("contig"), F.col("start0"), F.col("end0")))
    # what the text says is what comes back
    p = I.parse_region(F.col("region"))
    x = x.select(p["contig"].cast("bigint").alias("contig"), p["start0"].alias("start0"), p["end0"].alias("end0"), "region")
    return I.slop(x, 10, 5)


@query("SELECT coalesce(a.contig, b.contig) AS contig, coalesce(a.start0, b.start0) AS start0, CASE WHEN b.contig IS NULL THEN 'left' WHEN a.contig IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT contig, start0 FROM v_intervals WHERE event_type = 'purchase') a FULL JOIN (SELECT DISTINCT contig, start0 FROM v_intervals WHERE event_type = 'view' OR event_type = 'click') b ON a.contig = b.contig AND a.start0 = b.start0", ("v_intervals",))
def region_compare(spark, sf_dir):
    x = spark_view(spark, sf_dir, "v_intervals")
    return R.key_comparison(x.where("event_type = 'purchase'"), x.where("event_type in ('view', 'click')"), "contig", "start0")


# ---------------------------------------------------------------- summaries


@query(
    """WITH p AS (SELECT l_linenumber AS cut, count(*) AS n_psvs FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 6 GROUP BY 1),
    a AS (SELECT cut, asm_rank AS assembler, CAST(sum(length) AS BIGINT) AS length FROM v_assembly WHERE cut > 2 GROUP BY 1, 2),
    r AS (SELECT cut, count(*) AS n_reads, count(*) FILTER (WHERE k = 1) AS n_unique FROM (SELECT cut, count(*) OVER (PARTITION BY readid) AS k FROM v_phase) x GROUP BY cut)
    SELECT coalesce(p.cut, a.cut) AS cut, n_psvs, n_reads, n_unique, assembler, length, length IS NULL AS asm_failed, count(*) OVER (PARTITION BY coalesce(p.cut, a.cut)) > 1 AS multiple_asm
    FROM p FULL JOIN a ON p.cut = a.cut LEFT JOIN r ON r.cut = coalesce(p.cut, a.cut)""",
    ("v_assembly", "v_phase"),
)
def summary_outer_join(spark, sf_dir):
    psvs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R' and l_linenumber < 6").groupBy(F.col("l_linenumber").alias("cut")).agg(F.count("*").alias("n_psvs"))
    asm = spark_view(spark, sf_dir, "v_assembly").where("cut > 2").groupBy("cut", F.col("asm_rank").alias("assembler")).agg(F.sum("length").alias("length"))
    reads = R.read_uniqueness(spark_view(spark, sf_dir, "v_phase")).groupBy("cut").agg(F.count("*").alias("n_reads"), F.count_if("unique").alias("n_unique"))
    out = psvs.join(asm, "cut", "full_outer").join(reads, "cut", "left")
    out = out.withColumn("asm_failed", F.col("length").isNull()).withColumn("multiple_asm", F.count("*").over(Window.partitionBy("cut")) > 1)
    return out.select("cut", "n_psvs", "n_reads", "n_unique", "assembler", "length", "asm_failed", "multiple_asm")


@query("SELECT readid, cut, count(*) OVER (PARTITION BY readid) = 1 AS unique FROM v_phase".replace(" unique ", ' "unique" '), ("v_phase",))
def read_uniqueness(spark, sf_dir):
    return R.read_uniqueness(spark_view(spark, sf_dir, "v_phase"))


@query("SELECT count(*) AS reads, count(*) FILTER (WHERE k > 1) AS multi, round(count(*) FILTER (WHERE k > 1) / count(*), 6) AS fraction FROM (SELECT readid, count(*) AS k FROM v_phase GROUP BY 1) x", ("v_phase",))
def multi_fraction(spark, sf_dir):
    return R.multi_fraction(spark_view(spark, sf_dir, "v_phase")).select("reads", "multi", _r("fraction"))


CLASSIFIED = "c AS (SELECT *, CASE WHEN length IS NULL THEN 'Failed' WHEN count(*) OVER (PARTITION BY collapse, cut) > 1 THEN 'Multiple Assemblies' WHEN per_id < 99.8 THEN 'Diverged' ELSE 'Resolved' END AS status FROM a)"
_ASM = "a AS (SELECT collapse, cut, per_id, CASE WHEN asm_rank = 0 AND chr = 3 THEN NULL ELSE length END AS length FROM v_assembly)"


def _assemblies(spark, sf_dir):
    a = spark_view(spark, sf_dir, "v_assembly")
    return a.select("collapse", "cut", "per_id", F.when(~((F.col("asm_rank") == 0) & (F.col("chr") == 3)), F.col("length")).alias("length"))


@query(f"WITH {_ASM}, {CLASSIFIED} SELECT status, count(*) AS n FROM c GROUP BY status", ("v_assembly",))
def status_classify(spark, sf_dir):
    return R.classify(_assemblies(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"WITH {_ASM}, {CLASSIFIED}, d AS (SELECT DISTINCT collapse, cut, status FROM c) SELECT collapse, count(*) FILTER (WHERE status = 'Failed') AS n_failed, count(*) FILTER (WHERE status = 'Multiple Assemblies') AS n_multiple, count(*) FILTER (WHERE status = 'Diverged') AS n_diverged, count(*) FILTER (WHERE status = 'Resolved') AS n_resolved FROM d GROUP BY collapse",
    ("v_assembly",),
)
def status_pivot(spark, sf_dir):
    return R.status_pivot(R.classify(_assemblies(spark, sf_dir)))


@query("WITH r AS (SELECT n_chars, sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER () AS total FROM documents) SELECT min(n_chars) AS n50 FROM r WHERE run * 2 >= total")
def n50(spark, sf_dir):
    return R.n50(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars")


@query("SELECT lang, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM documents GROUP BY lang")
def length_stats(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("median"))


@query("SELECT round(corr(length, per_id), 6) AS r FROM v_assembly", ("v_assembly",))
def correlation_pair(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_assembly").agg(F.round(F.corr("length", "per_id"), 6).alias("r"))


@query(
    "SELECT * FROM (SELECT 'length' AS x, 'per_id' AS y, round(corr(length, per_id), 6) AS r FROM v_assembly UNION ALL SELECT 'length', 'start0', round(corr(length, start0), 6) FROM v_assembly UNION ALL SELECT 'per_id', 'start0', round(corr(per_id, start0), 6) FROM v_assembly) t",
    ("v_assembly",),
)
def corr_matrix(spark, sf_dir):
    return R.correlation_matrix(spark_view(spark, sf_dir, "v_assembly"), ["length", "per_id", "start0"]).select("x", "y", _r("r"))


@query("SELECT DISTINCT round(per_id, 6) AS value, round(cume_dist() OVER (ORDER BY round(per_id, 6)), 6) AS ecdf FROM v_assembly", ("v_assembly",))
def ecdf_identity(spark, sf_dir):
    return R.ecdf(spark_view(spark, sf_dir, "v_assembly").withColumn("per_id", F.round("per_id", 6)), "per_id").select("value", _r("ecdf"))


@query("WITH g AS (SELECT round(per_id, 6) AS value, CAST(sum(length) AS DOUBLE) AS w FROM v_assembly GROUP BY 1) SELECT value, round(sum(w) OVER (ORDER BY value) / sum(w) OVER (), 6) AS ecdf FROM g", ("v_assembly",))
def ecdf_by_bp(spark, sf_dir):
    return R.ecdf(spark_view(spark, sf_dir, "v_assembly").withColumn("per_id", F.round("per_id", 6)), "per_id", "length").select("value", _r("ecdf"))


@query("SELECT collapse, 'bases' AS name, CAST(sum(length) AS BIGINT) AS value FROM v_assembly GROUP BY 1 UNION ALL SELECT collapse, 'rows', count(*) FROM v_assembly GROUP BY 1", ("v_assembly",))
def unpivot_counts(spark, sf_dir):
    x = spark_view(spark, sf_dir, "v_assembly").groupBy("collapse").agg(F.sum("length").alias("bases"), F.count("*").alias("rows"))
    return x.unpivot("collapse", ["bases", "rows"], "name", "value")


@query("SELECT l_orderkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def gene_string_agg(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_orderkey").agg(R.string_set(F.col("p_brand")).alias("brands"))


@query("SELECT collapse, cut, asm_rank, l_orderkey, asm_rank = min(asm_rank) OVER (PARTITION BY collapse) AS used FROM v_assembly", ("v_assembly",))
def first_success_choice(spark, sf_dir):
    return R.first_success(spark_view(spark, sf_dir, "v_assembly").select("collapse", "cut", "asm_rank", "l_orderkey"), "collapse", "asm_rank")


@query("SELECT o_orderkey AS id, NULL::BIGINT AS length, 'Failed' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 30)")
def failed_ids_anti(spark, sf_dir):
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 30")
    lost = spark.read.parquet(f"{sf_dir}/orders.parquet").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return lost.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("bigint").alias("length"), F.lit("Failed").alias("status"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def overlapping_semi(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 45")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").join(some, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query(
    "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT min(CASE WHEN k = greatest(1, round(0.01 * n)) THEN value END) AS low, min(CASE WHEN k = greatest(1, round(0.99 * n)) THEN value END) AS high FROM r"
)
def rank_trim(spark, sf_dir):
    return R.rank_trim(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


@query("SELECT collapse, cut, length, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY collapse, cut ORDER BY length DESC, l_orderkey, start0) AS k FROM v_assembly) t WHERE k = 1", ("v_assembly",))
def distinct_keep_first(spark, sf_dir):
    return R.keep_first(spark_view(spark, sf_dir, "v_assembly"), ["collapse", "cut"], [F.desc("length"), "l_orderkey", "start0"]).select("collapse", "cut", "length", "l_orderkey")


# ---------------------------------------------------------------- sequences and alignments

_OPS = r"list_zip(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2), list_transform(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), lambda x: CAST(x AS BIGINT)))"
_EXPLODED = "e AS (SELECT rid, qname, rname, pos0, flag, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)) AS op, CAST(unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1)) AS BIGINT) AS len FROM (SELECT *, row_number() OVER () AS rid FROM v_cigar) v)"


def _ops(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_cigar").withColumn("ops", S.parse_cigar(F.col("cigar")))


@query(f"WITH {_EXPLODED} SELECT op, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM e GROUP BY op", ("v_cigar",))
def cigar_parse(spark, sf_dir):
    return _ops(spark, sf_dir).select(F.explode("ops").alias("o")).groupBy("o.op").agg(F.count("*").alias("n"), F.sum("o.len").alias("total"))


@query(
    f"WITH {_EXPLODED}, s AS (SELECT any_value(qname) AS qname, sum(CASE WHEN op = '=' THEN len ELSE 0 END) AS m, sum(CASE WHEN op = 'X' THEN len ELSE 0 END) AS x, sum(CASE WHEN op = 'I' THEN len ELSE 0 END) AS i, sum(CASE WHEN op = 'D' THEN len ELSE 0 END) AS d, count(*) FILTER (WHERE op = 'I') AS ie, count(*) FILTER (WHERE op = 'D') AS de FROM e WHERE (flag & 2308) = 0 GROUP BY rid) SELECT qname, CAST(m AS BIGINT) AS matches, CAST(x AS BIGINT) AS mismatches, CAST(i AS BIGINT) AS ins, CAST(d AS BIGINT) AS del, ie AS ins_events, de AS del_events, round(100 * m / (m + x), 6) AS by_matches, round(100 * m / (m + x + ie + de), 6) AS by_events, round(100 * m / (m + x + i + d), 6) AS by_all FROM s",
    ("v_cigar",),
)
def identity_by_cigar(spark, sf_dir):
    x = S.identities(_ops(spark, sf_dir).where(S.primary(F.col("flag"))).select("qname", "ops")).drop("ops")
    return x.select(*[c for c in x.columns if c[:3] != "by_"], _r("by_matches"), _r("by_events"), _r("by_all"))


@query(
    f"WITH {_EXPLODED} SELECT any_value(qname) AS qname, CAST(sum(CASE WHEN op = 'S' THEN len ELSE 0 END) AS BIGINT) AS clip, CAST(sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END) AS BIGINT) AS ref_span, CAST(sum(CASE WHEN op IN ('M','I','=','X') THEN len ELSE 0 END) AS BIGINT) AS query_span, CAST(sum(CASE WHEN op IN ('M','D') THEN len ELSE 0 END) AS BIGINT) AS md_span FROM e GROUP BY rid",
    ("v_cigar",),
)
def cigar_spans(spark, sf_dir):
    o = F.col("ops")
    return _ops(spark, sf_dir).select("qname", S.soft_clip(o).alias("clip"), S.reference_span(o).alias("ref_span"), S.query_span(o).alias("query_span"), S.md_span(o).alias("md_span"))


@query(
    """WITH p AS (SELECT qname, pos0, CAST(regexp_extract(cigar, '^([0-9]+)S', 1) AS BIGINT) AS s, CAST(regexp_extract(cigar, 'S([0-9]+)=', 1) AS BIGINT) AS a, CAST(regexp_extract(cigar, '=([0-9]+)X', 1) AS BIGINT) AS x, CAST(regexp_extract(cigar, 'X([0-9]+)I', 1) AS BIGINT) AS i, CAST(regexp_extract(cigar, 'I([0-9]+)=', 1) AS BIGINT) AS b, CAST(regexp_extract(cigar, '=([0-9]+)D', 1) AS BIGINT) AS d FROM v_cigar)
    SELECT qname, 'I' AS kind, pos0 + a + x AS ref_pos, s + a + x AS query_pos, i AS len FROM p WHERE i >= 3 UNION ALL SELECT qname, 'D', pos0 + a + x + b, s + a + x + i + b, d FROM p WHERE d >= 3""",
    ("v_cigar",),
)
def indel_extract(spark, sf_dir):
    x = _ops(spark, sf_dir).select("qname", F.explode(S.indels(F.col("ops"), F.col("pos0"), 3)).alias("i"))
    return x.select("qname", "i.kind", "i.ref_pos", "i.query_pos", "i.len")


@query(r"SELECT qname, regexp_replace(regexp_replace(cigar, '=|X', 'M', 'g'), 'x', '') AS condensed FROM v_cigar", ("v_cigar",))
def cigar_match_form(spark, sf_dir):
    """= and X as M, operations left apart."""
    plain = F.transform("ops", lambda x: F.struct(F.when(x["op"].isin("=", "X"), F.lit("M")).otherwise(x["op"]).alias("op"), x["len"].alias("len")))
    return _ops(spark, sf_dir).select("qname", S.format_cigar(plain).alias("condensed"))


@query("SELECT rname, qname, pos0, flag FROM (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY pos0, qname, flag) AS k FROM v_cigar) t WHERE k = 1", ("v_cigar",))
def dedup_read_names(spark, sf_dir):
    return R.keep_first(spark_view(spark, sf_dir, "v_cigar"), ["rname"], ["pos0", "qname", "flag"]).select("rname", "qname", "pos0", "flag")


@query(
    f"WITH {_EXPLODED}, s AS (SELECT rid, any_value(qname) AS qname, any_value(rname) AS rname, any_value(pos0) AS pos0, any_value(flag) AS flag, sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END) AS r FROM e GROUP BY rid) SELECT rname AS contig, pos0 AS start0, CAST(pos0 + r AS BIGINT) AS end0, qname, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand FROM s WHERE (flag & 2308) = 0",
    ("v_cigar",),
)
def alignments_to_bed(spark, sf_dir):
    return AL.to_bed(_ops(spark, sf_dir))


@query(
    """WITH p AS (SELECT DISTINCT qname, pos0, cigar, CAST(regexp_extract(cigar, '^([0-9]+)S', 1) AS BIGINT) AS s, CAST(regexp_extract(cigar, 'S([0-9]+)=', 1) AS BIGINT) + CAST(regexp_extract(cigar, '=([0-9]+)X', 1) AS BIGINT) AS a, CAST(regexp_extract(cigar, 'X([0-9]+)I', 1) AS BIGINT) AS i, CAST(regexp_extract(cigar, 'I([0-9]+)=', 1) AS BIGINT) AS b, CAST(regexp_extract(cigar, '=([0-9]+)D', 1) AS BIGINT) AS d, CAST(regexp_extract(cigar, 'D([0-9]+)=', 1) AS BIGINT) AS c FROM v_cigar WHERE (flag & 2308) = 0)
    SELECT qname, CAST(sum(a + b + c) AS BIGINT) AS pairs, CAST(sum(a * s + a * (a - 1) // 2 + b * (s + a + i) + b * (b - 1) // 2 + c * (s + a + i + b) + c * (c - 1) // 2) AS BIGINT) AS q_sum, CAST(sum(a * pos0 + a * (a - 1) // 2 + b * (pos0 + a) + b * (b - 1) // 2 + c * (pos0 + a + b + d) + c * (c - 1) // 2) AS BIGINT) AS r_sum FROM p GROUP BY qname""",
    ("v_cigar",),
)
def aligned_pairs(spark, sf_dir):
    """All pairs of all alignments, told by their number and sums for each name, from the match blocks."""
    x = _ops(spark, sf_dir).where(S.primary(F.col("flag"))).select("qname", "pos0", "cigar", "ops").dropDuplicates(["qname", "pos0", "cigar"])
    return AL.aligned_pair_sums(x)


@query(r"SELECT id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM v_seq", ("v_seq",))
def reverse_complement(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_seq").select("id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(r"SELECT id, regexp_replace(seq, '^[Nn]+|[Nn]+$', '', 'g') AS seq FROM v_seq", ("v_seq",))
def strip_n(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_seq").select("id", S.strip_n(F.col("seq")).alias("seq"))


@query("SELECT id, round(CASE WHEN length(seq) > 0 THEN (length(seq) - length(replace(seq, 'N', ''))) / length(seq) ELSE 0 END, 6) AS n_fraction, round(CASE WHEN length(seq) > 0 THEN (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) ELSE 0 END, 6) AS gc FROM v_seq", ("v_seq",))
def n_fraction(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_seq").select("id", F.round(S.n_fraction(F.col("seq")), 6).alias("n_fraction"), F.round(S.gc_fraction(F.col("seq")), 6).alias("gc"))


@query("SELECT id, CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, '(A+|C+|G+|T+|N+)', 1), lambda x: length(x))), 0) AS BIGINT) AS homopolymer FROM v_seq", ("v_seq",))
def homopolymer(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_seq").select("id", S.longest_homopolymer(F.col("seq")).alias("homopolymer"))


# ---------------------------------------------------------------- pileup and sites


@query("SELECT contig, pos1, CAST(a AS BIGINT) AS a, CAST(c AS BIGINT) AS c, CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t FROM v_pileup WHERE (a > 3)::INT + (c > 3)::INT + (g > 3)::INT + (t > 3)::INT >= 2 AND (a > 6)::INT + (c > 6)::INT + (g > 6)::INT + (t > 6)::INT <= 2 AND a + c + g + t >= 8", ("v_pileup",))
def het_filter(spark, sf_dir):
    cols = [F.col(c) for c in "acgt"]
    return spark_view(spark, sf_dir, "v_pileup").where(S.heterozygous(cols, 3, 6, 8))


@query(
    "WITH r AS (SELECT *, substr('ACGT', CAST(pos1 % 4 + 1 AS INT), 1) AS ref FROM v_pileup), l AS (SELECT contig, pos1, ref, unnest(['A','C','G','T']) AS b, unnest([a, c, g, t]) AS n, unnest([1,2,3,4]) AS k FROM r), b AS (SELECT contig, pos1, ref, b, n, row_number() OVER (PARTITION BY contig, pos1 ORDER BY n DESC, k) AS o FROM l WHERE b <> ref) SELECT contig, pos1, concat('snp', CAST(row_number() OVER (ORDER BY contig, pos1) AS VARCHAR)) AS id, ref, CASE WHEN n > 0 THEN b ELSE '' END AS alt FROM b WHERE o = 1",
    ("v_pileup",),
)
def freq_to_vcf(spark, sf_dir):
    x = spark_view(spark, sf_dir, "v_pileup").withColumn("ref", F.substr(F.lit("ACGT"), (F.col("pos1") % 4 + 1).cast("int"), F.lit(1)))
    alt = S.best_alternate(F.col("ref"), {b: F.col(b.lower()) for b in S.BASES})
    return AL.number_rows(x.select("contig", "pos1", "ref", alt.alias("alt")), ["contig", "pos1"], "k").select("contig", "pos1", F.concat(F.lit("snp"), F.col("k").cast("string")).alias("id"), "ref", "alt")


SITES = "s AS (SELECT site, count(*) FILTER (WHERE allele = 0) AS ref, count(*) FILTER (WHERE allele = 1) AS alt FROM {m} GROUP BY site)"


def minor_sql(lo: int, hi: int) -> str:
    return f"CASE WHEN ref > 0 AND ref BETWEEN {lo} AND {hi} AND alt > {hi} THEN '.' WHEN alt > 0 AND alt BETWEEN {lo} AND {hi} AND ref > {hi} THEN '1' END"


@query(f"WITH {SITES.format(m='v_matrix')} SELECT site, ref, alt, round(CASE WHEN ref + alt > 0 THEN least(ref, alt) / (ref + alt) ELSE 0 END, 6) AS minor_fraction, CASE WHEN ref + alt > 0 THEN CAST(CAST(floor(10 * ref / (ref + alt)) AS BIGINT) AS VARCHAR) ELSE 'n' END AS decile FROM s", ("v_matrix",))
def ref_alt_counts(spark, sf_dir):
    x = G.site_counts(spark_view(spark, sf_dir, "v_matrix"))
    return x.withColumn("minor_fraction", F.round(G.minor_fraction(F.col("ref"), F.col("alt")), 6)).withColumn("decile", G.reference_decile(F.col("ref"), F.col("alt")))


@query(f"WITH {SITES.format(m='v_matrix')} SELECT site, ref, alt, {minor_sql(12, 25)} AS minor FROM s", ("v_matrix",))
def minor_allele(spark, sf_dir):
    return G.minor_alleles(spark_view(spark, sf_dir, "v_matrix"), 12, 25)


@query(f"WITH {SITES.format(m='v_matrix')} SELECT site, CASE WHEN ref >= alt THEN '.' ELSE '1' END AS major, greatest(ref, alt) AS major_count, CASE WHEN ref >= alt THEN '1' ELSE '.' END AS minor, least(ref, alt) AS minor_count FROM s", ("v_matrix",))
def allele_rank(spark, sf_dir):
    return G.allele_ranks(G.site_counts(spark_view(spark, sf_dir, "v_matrix")))


@thinned('SELECT read_id, CASE WHEN count(*) <= 1 THEN 0 ELSE min(site) END AS "first", CASE WHEN count(*) <= 1 THEN 0 ELSE max(site) END AS "last" FROM v_matrix_sparse GROUP BY 1', ("v_matrix_sparse",))
def read_bounds(spark, sf_dir, view="v_matrix_sparse"):
    return G.read_bounds(spark_view(spark, sf_dir, view))


def test_sql(k: str, n: str, p: float) -> str:
    """The two-sided exact binomial p-value as a subquery over the outcomes."""
    term = lambda x: f"(lgamma({n} + 1) - lgamma({x} + 1) - lgamma({n} - {x} + 1) + {x} * ln({p}) + ({n} - {x}) * ln(1 - {p}))"
    return f"(SELECT least(1.0, sum(exp({term('o.x')}))) FROM outcomes o WHERE o.x <= {n} AND {term('o.x')} <= {term(k)} + 1e-7)"


def score_sql(n: str) -> str:
    """Scores of the different (n_shared, n)."""
    return f"SELECT n_shared, {n} AS n, log10({test_sql('n_shared', n, 0.8)} / {test_sql('n_shared', n, 0.2)} + 1) AS score FROM (SELECT DISTINCT n_shared, {n} FROM ln) t"


def link_sql(m: str, lo: int, hi: int, shared: int) -> str:
    return f"""
{SITES.format(m=m)}, k AS (SELECT site, CASE {minor_sql(lo, hi)} WHEN '.' THEN 0 WHEN '1' THEN 1 END AS m FROM s),
r AS (SELECT read_id, x.site, coalesce((allele = m)::INT, 0) AS has FROM {m} x JOIN k ON k.site = x.site),
e AS (SELECT site, min(read_id) AS first, max(read_id) AS last FROM r WHERE has = 1 GROUP BY 1),
pr AS (SELECT a.site AS i, b.site AS j FROM k a JOIN e x ON x.site = a.site JOIN k b ON a.site < b.site LEFT JOIN e y ON y.site = b.site WHERE a.m IS NOT NULL AND coalesce(y.first <= x.last, TRUE)),
ct AS (SELECT a.site AS i, b.site AS j, count(*) AS n_overlap, sum(a.has) AS n_i, sum(b.has) AS n_j, sum(a.has * b.has) AS n_shared FROM r a JOIN r b ON a.read_id = b.read_id AND a.site < b.site GROUP BY 1, 2),
ln AS (SELECT pr.i, pr.j, CAST(coalesce(n_overlap, 0) AS BIGINT) AS n_overlap, CAST(coalesce(n_i, 0) AS BIGINT) AS n_i, CAST(coalesce(n_j, 0) AS BIGINT) AS n_j, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared FROM pr LEFT JOIN ct ON ct.i = pr.i AND ct.j = pr.j),
outcomes AS (SELECT unnest(range(0, (SELECT max(greatest(n_i, n_j)) FROM ln) + 1)) AS x),
si AS ({score_sql('n_i')}), sj AS ({score_sql('n_j')}),
lk AS (SELECT ln.*, CASE WHEN ln.n_shared >= {shared} THEN si.score ELSE 0 END AS lrt_i, CASE WHEN ln.n_shared >= {shared} THEN sj.score ELSE 0 END AS lrt_j FROM ln JOIN si ON si.n_shared = ln.n_shared AND si.n = n_i JOIN sj ON sj.n_shared = ln.n_shared AND sj.n = n_j)
"""


SPARSE = link_sql("v_matrix_sparse", 2, 4, 1)


def _links(spark, sf_dir):
    return G.linkage(spark_view(spark, sf_dir, "v_matrix_sparse"), 2, 4, min_shared=1)


@query(f"WITH {SPARSE} SELECT i, j, n_overlap, n_i, n_j, n_shared FROM lk", ("v_matrix_sparse",))
def linkage_counts(spark, sf_dir):
    return _links(spark, sf_dir).select("i", "j", "n_overlap", "n_i", "n_j", "n_shared")


@query(f"WITH {SPARSE} SELECT i, j, round(lrt_i, 6) + 0 AS lrt_i, round(lrt_j, 6) + 0 AS lrt_j, round(least(lrt_i, lrt_j), 6) + 0 AS lrt FROM lk", ("v_matrix_sparse",))
def linkage_lrt(spark, sf_dir):
    z = lambda c: (F.round(F.col(c), 6) + 0).alias(c)
    return _links(spark, sf_dir).select("i", "j", z("lrt_i"), z("lrt_j"), z("lrt"))


@query(f"WITH {link_sql('v_matrix', 12, 25, 5)} SELECT i, j, n_overlap, n_i, n_j, n_shared, round(least(lrt_i, lrt_j), 6) + 0 AS lrt FROM lk", ("v_matrix",))
def linkage_dense(spark, sf_dir):
    out = G.linkage(spark_view(spark, sf_dir, "v_matrix"), 12, 25)
    return out.select("i", "j", "n_overlap", "n_i", "n_j", "n_shared", (F.round("lrt", 6) + 0).alias("lrt"))


PSV_EDGES = "ed AS (SELECT i AS src, j AS dst, n_shared / greatest(n_i, 1) AS weight FROM lk WHERE least(lrt_i, lrt_j) > 0.5)"


@query(f"WITH {SPARSE}, {PSV_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM ed", ("v_matrix_sparse",))
def psv_edges(spark, sf_dir):
    return G.psv_edges(_links(spark, sf_dir), 0.5).select("src", "dst", _r("weight"))


def components_sql(edges: str) -> str:
    return f"""
RECURSIVE bo AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
rc(node, other) AS (SELECT a, a FROM bo UNION SELECT rc.node, bo.b FROM rc JOIN bo ON bo.a = rc.other),
cc AS (SELECT node, min(other) AS component FROM rc GROUP BY node)
"""


def _recursive(head: str, body: str) -> str:
    return f"WITH RECURSIVE {head.removeprefix('WITH ')}, {body.replace('RECURSIVE ', '', 1).strip()}"


@query()
def repulsion_edges(spark, sf_dir):
    links = H.cut_lineage(_links(spark, sf_dir))
    edges = G.psv_edges(links, 0.5)
    return G.repulsion_edges(links, edges, H.connected_components(edges), 1)


_SQL["repulsion_edges"] = _recursive(
    duck_views("v_matrix_sparse") + f", {SPARSE.strip()}, {PSV_EDGES}",
    components_sql("ed").strip()
    + ", sp AS (SELECT a AS node, min(b) AS lo, max(b) AS hi FROM bo GROUP BY a), nd AS (SELECT cc.node, component, lo, hi FROM cc JOIN sp ON sp.node = cc.node) SELECT lk.i AS src, lk.j AS dst FROM lk JOIN nd x ON x.node = lk.i JOIN nd y ON y.node = lk.j WHERE n_shared <= 1 AND x.component = y.component AND lk.i > y.lo AND lk.i < y.hi AND lk.j > x.lo AND lk.j < x.hi",
)


# ---------------------------------------------------------------- graphs


@query()
def connected_components(spark, sf_dir):
    return H.connected_components(spark_view(spark, sf_dir, "v_edges"))


_SQL["connected_components"] = _recursive(duck_views("v_edges"), components_sql("v_edges").strip() + " SELECT node, component FROM cc")


@query()
def component_sizes(spark, sf_dir):
    c = H.connected_components(spark_view(spark, sf_dir, "v_edges")).groupBy("component").agg(F.count("*").alias("size"))
    return AL.number_rows(c, [F.desc("size"), F.asc("component")], "rank")


_SQL["component_sizes"] = _recursive(
    duck_views("v_edges"),
    components_sql("v_edges").strip() + " SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS rank FROM (SELECT component, count(*) AS size FROM cc GROUP BY 1) t",
)

_BOTH = "bo AS (SELECT src AS a, dst AS b FROM v_edges_dense UNION ALL SELECT dst, src FROM v_edges_dense)"


@query(f"WITH {_BOTH} SELECT e.src, e.dst, count(y.b) AS common FROM v_edges_dense e JOIN bo x ON x.a = e.src LEFT JOIN bo y ON y.a = e.dst AND y.b = x.b GROUP BY 1, 2", ("v_edges_dense",))
def common_neighbours(spark, sf_dir):
    return H.common_neighbours(spark_view(spark, sf_dir, "v_edges_dense"))


@query("SELECT a.src AS i, a.dst AS j, b.dst AS k FROM v_edges_dense a JOIN v_edges_dense b ON b.src = a.dst JOIN v_edges_dense c ON c.src = a.src AND c.dst = b.dst", ("v_edges_dense",))
def triangles(spark, sf_dir):
    return H.triangles(spark_view(spark, sf_dir, "v_edges_dense"))


@query(f"WITH {_BOTH} SELECT a AS node, count(*) AS degree, min(b) AS lo, max(b) AS hi FROM bo GROUP BY 1", ("v_edges_dense",))
def node_degrees(spark, sf_dir):
    return H.degrees(spark_view(spark, sf_dir, "v_edges_dense"))


@query(
    "WITH s AS (SELECT src, dst, CASE WHEN (src + dst) % 5 = 0 THEN -1 ELSE 1 END AS sign FROM v_edges_dense), x AS (SELECT sign, src % 4 AS a, dst % 4 AS b FROM s) SELECT c.cut, CAST((SELECT count(*) FROM x WHERE sign < 0 AND a = b AND a = c.cut) AS BIGINT) AS internal_repulsion, CAST((SELECT count(*) FROM x WHERE sign > 0 AND a <> b AND (a = c.cut OR b = c.cut)) AS BIGINT) AS leaving, CAST(5.0 * (SELECT count(*) FROM x WHERE sign < 0 AND a = b AND a = c.cut) + (SELECT count(*) FROM x WHERE sign > 0 AND a <> b AND (a = c.cut OR b = c.cut)) AS DOUBLE) AS score FROM (SELECT DISTINCT n % 4 AS cut FROM (SELECT src AS n FROM s UNION SELECT dst FROM s) t) c",
    ("v_edges_dense",),
)
def cut_score(spark, sf_dir):
    e = spark_view(spark, sf_dir, "v_edges_dense").withColumn("sign", F.when((F.col("src") + F.col("dst")) % 5 == 0, -1).otherwise(1))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return C.cut_score(e, nodes.withColumn("cut", F.col("node") % 4))


@query()
def correlation_clusters(spark, sf_dir):
    """Randomised: the tests check planted clusters and the invariants of the result."""
    links = H.cut_lineage(G.linkage(spark_view(spark, sf_dir, "v_matrix"), 12, 25))
    edges = H.cut_lineage(G.psv_edges(links, 0.01))
    comps = H.connected_components(edges)
    signed = edges.select("src", "dst", F.lit(1).alias("sign")).unionByName(G.repulsion_edges(links, edges, comps, 0).withColumn("sign", F.lit(-1)))
    signed = signed.join(comps.select(F.col("node").alias("src"), "component"), "src")
    return C.correlation_clusters(signed.select(*[F.col(c).cast("bigint").alias(c) for c in ("component", "src", "dst")], "sign"), restarts=4)


# ---------------------------------------------------------------- reads


@thinned(
    "SELECT x.read_id AS a, y.read_id AS b, count(*) FILTER (WHERE x.allele = y.allele) AS matches, count(*) FILTER (WHERE x.allele <> y.allele) AS mismatches, CAST(count(*) FILTER (WHERE x.allele = y.allele) - 1.0 * count(*) FILTER (WHERE x.allele <> y.allele) AS DOUBLE) AS score FROM v_matrix_sparse x JOIN v_matrix_sparse y ON x.site = y.site AND x.read_id < y.read_id GROUP BY 1, 2",
    ("v_matrix_sparse",),
)
def read_distance_matrix(spark, sf_dir, view="v_matrix_sparse"):
    return G.read_scores(spark_view(spark, sf_dir, view))


@thinned(
    "WITH s AS (SELECT x.read_id, y.read_id AS other, CAST(sum(CASE WHEN x.allele = y.allele THEN 1.0 ELSE -1.0 END) AS DOUBLE) AS score FROM v_matrix_sparse x JOIN v_matrix_sparse y ON x.site = y.site AND x.read_id <> y.read_id GROUP BY 1, 2) SELECT read_id, other, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY read_id ORDER BY score DESC, other) AS INT) AS rank FROM s) t WHERE rank <= 5",
    ("v_matrix_sparse",),
)
def top_k_neighbours(spark, sf_dir, view="v_matrix_sparse"):
    return G.top_neighbours(spark_view(spark, sf_dir, view), 5)


@query("SELECT read_id % 5 AS grp, site, CASE WHEN count(*) < 10 THEN 'n' WHEN avg(allele) > 0.7 THEN '1' WHEN 1 - avg(allele) > 0.7 THEN '.' ELSE 'u' END AS call, count(*) AS n FROM v_matrix GROUP BY 1, 2", ("v_matrix",))
def consensus_by_group(spark, sf_dir):
    m = spark_view(spark, sf_dir, "v_matrix")
    return G.consensus(m, m.select("read_id").distinct().withColumn("grp", F.col("read_id") % 5))


@query('SELECT cut AS cluster, readid % 3 AS "label", count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cut), 6) AS "share" FROM v_phase GROUP BY 1, 2', ("v_phase",))
def concordance(spark, sf_dir):
    x = spark_view(spark, sf_dir, "v_phase").select(F.col("cut").alias("cluster"), (F.col("readid") % 3).alias("label"))
    return G.concordance(x).select("cluster", "label", "n", _r("share"))


_CUTS = "ct AS (SELECT site % 6 AS cut, site FROM v_matrix GROUP BY site UNION ALL SELECT 1, site FROM v_matrix WHERE site % 12 = 0 GROUP BY site), al AS (SELECT site, min(cut) AS cut FROM ct GROUP BY site HAVING count(*) = 1)"


def _cuts(m):
    sites = m.select("site").distinct()
    return sites.select((F.col("site") % 6).alias("cut"), "site").unionByName(sites.where("site % 12 = 0").select(F.lit(1).alias("cut"), "site"))


@thinned(
    f"WITH {_CUTS}, x AS (SELECT read_id, al.cut, count(*) FILTER (WHERE allele = 1) AS alt, count(*) FILTER (WHERE allele = 0) AS ref FROM v_matrix_sparse v JOIN al ON al.site = v.site GROUP BY 1, 2), y AS (SELECT read_id, cut, ref + sum(alt) OVER (PARTITION BY read_id) - alt AS mec, alt AS matches FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY mec, matches DESC, cut) AS k FROM y WHERE matches > 0) SELECT r.read_id, coalesce(z.cut, -1) AS cut, CAST(mec AS BIGINT) AS mec, CAST(matches AS BIGINT) AS matches FROM (SELECT DISTINCT read_id FROM v_matrix_sparse) r LEFT JOIN z ON z.read_id = r.read_id AND k = 1",
    ("v_matrix", "v_matrix_sparse"),
)
def mec_assignment(spark, sf_dir, view="v_matrix_sparse"):
    return G.mec_assignment(spark_view(spark, sf_dir, view), _cuts(spark_view(spark, sf_dir, "v_matrix")))


@thinned(f"WITH {_CUTS} SELECT * FROM (SELECT read_id, cut, count(*) FILTER (WHERE allele = 1) AS alt, count(*) FILTER (WHERE allele = 0) AS ref FROM v_matrix_sparse v JOIN ct ON ct.site = v.site GROUP BY 1, 2) t WHERE alt >= 1 AND alt > ref", ("v_matrix", "v_matrix_sparse"))
def read_supports_cluster(spark, sf_dir, view="v_matrix_sparse"):
    return G.supports(spark_view(spark, sf_dir, view), _cuts(spark_view(spark, sf_dir, "v_matrix")))


@thinned(
    "WITH s AS (SELECT x.read_id, y.read_id AS other, count(*) FILTER (WHERE x.allele = y.allele) AS m, count(*) FILTER (WHERE x.allele <> y.allele) AS d FROM v_matrix_sparse x JOIN v_matrix_sparse y ON x.site = y.site AND x.read_id <> y.read_id GROUP BY 1, 2) SELECT read_id, round(avg(CASE WHEN read_id % 3 = other % 3 THEN m END), 6) AS inner_match, round(avg(CASE WHEN read_id % 3 = other % 3 THEN d END), 6) AS inner_mismatch, round(avg(CASE WHEN read_id % 3 <> other % 3 THEN m END), 6) AS outer_match, round(avg(CASE WHEN read_id % 3 <> other % 3 THEN d END), 6) AS outer_mismatch FROM s GROUP BY 1",
    ("v_matrix_sparse",),
)
def inner_outer_scores(spark, sf_dir, view="v_matrix_sparse"):
    m = spark_view(spark, sf_dir, view)
    out = G.inner_outer_scores(m, m.select("read_id").distinct().withColumn("grp", F.col("read_id") % 3))
    return out.select("read_id", *[_r(c) for c in out.columns[1:]])


@query("WITH one AS (SELECT cut AS pos, min(readid % 7) AS r FROM (SELECT DISTINCT readid, cut + readid AS cut FROM v_phase) p GROUP BY 1 HAVING count(DISTINCT readid % 7) = 1) SELECT a.p, one.r, count(*) AS n FROM (SELECT DISTINCT cut AS p, cut + readid AS pos FROM v_phase) a JOIN one ON one.pos = a.pos GROUP BY 1, 2", ("v_phase",))
def psv_cluster_similarity(spark, sf_dir):
    x = spark_view(spark, sf_dir, "v_phase")
    pos = F.col("cut") + F.col("readid")
    return G.cluster_similarity(x.select(F.col("cut").alias("p"), pos.alias("pos")).distinct(), x.select((F.col("readid") % 7).alias("r"), pos.alias("pos")))


@query()
def smith_waterman(spark, sf_dir):
    """Neighbouring texts against each other; the tests compare with the plain recurrence."""
    s = spark_view(spark, sf_dir, "v_seq")
    return C.smith_waterman(s.select("id", F.col("seq").alias("a")).join(s.select((F.col("id") + 1).alias("id"), F.col("seq").alias("b")), "id"))


@query()
def tsd_align(spark, sf_dir):
    """The longest exact run that neighbouring texts share; the tests compare with brute force."""
    s = spark_view(spark, sf_dir, "v_seq")
    return AL.common_run(s.select("id", F.col("seq").alias("a")).join(s.select((F.col("id") + 1).alias("id"), F.col("seq").alias("b")), "id"))


# ---------------------------------------------------------------- more of graphs, reads and reports


@query(
    f"WITH {_BOTH}, sp AS (SELECT a AS node, min(b) AS lo, max(b) AS hi FROM bo GROUP BY 1) SELECT DISTINCT least(x.node, y.node) AS src, greatest(x.node, y.node) AS dst FROM sp x JOIN sp y ON y.node > x.lo AND y.node < x.hi AND x.node <> y.node WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.a = x.node AND bo.b = y.node)",
    ("v_edges_dense",),
)
def span_repulsion(spark, sf_dir):
    return H.repulsion_in_span(spark_view(spark, sf_dir, "v_edges_dense"), 16)


@query()
def radius_repulsion(spark, sf_dir):
    e = H.cut_lineage(spark_view(spark, sf_dir, "v_edges"))
    return H.repulsion_within_radius(H.connected_components(e), e, 50, load=1.0)


_SQL["radius_repulsion"] = _recursive(
    duck_views("v_edges"),
    components_sql("v_edges").strip()
    + ", dg AS (SELECT a AS node, count(*) AS degree FROM bo GROUP BY 1), pr AS (SELECT x.node AS src, y.node AS dst, row_number() OVER (PARTITION BY x.node ORDER BY y.node) AS k FROM cc x JOIN cc y ON x.component = y.component AND x.node < y.node AND y.node - x.node < 50 WHERE NOT EXISTS (SELECT 1 FROM bo WHERE a = x.node AND b = y.node)) SELECT src, dst FROM pr JOIN dg ON dg.node = src WHERE k - 1 <= degree",
)


@query(f"WITH {_BOTH} SELECT DISTINCT a % 4 AS cut, b AS node FROM bo WHERE a % 4 <> b % 4", ("v_edges_dense",))
def cut_boundary(spark, sf_dir):
    e = spark_view(spark, sf_dir, "v_edges_dense")
    return H.cut_neighbours(e, _members(e))


def _members(e):
    return H.degrees(e).select("node", (F.col("node") % 4).alias("cut"))


@query("SELECT least(src % 4, dst % 4) AS low, greatest(src % 4, dst % 4) AS high, count(*) AS n FROM v_edges_dense WHERE src % 4 <> dst % 4 GROUP BY 1, 2", ("v_edges_dense",))
def repulsion_tally(spark, sf_dir):
    e = spark_view(spark, sf_dir, "v_edges_dense")
    return H.tally_between(e, _members(e))


@query(f"WITH s AS (SELECT src, dst, CASE WHEN (src + dst) % 5 = 0 THEN -1 ELSE 1 END AS sign FROM v_edges_dense), x AS (SELECT src AS node, sign FROM s UNION ALL SELECT dst, sign FROM s) SELECT node, count(*) FILTER (WHERE sign > 0) AS attract, count(*) FILTER (WHERE sign < 0) AS repulse FROM x GROUP BY 1", ("v_edges_dense",))
def signed_degrees(spark, sf_dir):
    e = spark_view(spark, sf_dir, "v_edges_dense").withColumn("sign", F.when((F.col("src") + F.col("dst")) % 5 == 0, -1).otherwise(1))
    return H.signed_degrees(e)


@query(
    "WITH s AS (SELECT src, dst, src * dst % 17 AS weight FROM v_edges_dense), x AS (SELECT src AS a, dst AS b, * FROM s UNION ALL SELECT dst, src, * FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b DESC) AS k FROM x) SELECT DISTINCT src, dst, weight FROM k WHERE k <= 5",
    ("v_edges_dense",),
)
def trim_edges(spark, sf_dir):
    return H.heaviest_edges(spark_view(spark, sf_dir, "v_edges_dense").withColumn("weight", F.expr("src * dst % 17")), 5)


@query()
def component_purity(spark, sf_dir):
    e = H.cut_lineage(spark_view(spark, sf_dir, "v_edges"))
    out = H.purity(H.connected_components(e).withColumn("color", F.col("node") % 3), e.withColumn("color", (F.col("src") + F.col("dst")) % 3), 4)
    return out.select("component", "size", _r("node_purity"), "n_edges", _r("edge_purity"))


_SQL["component_purity"] = _recursive(
    duck_views("v_edges"),
    components_sql("v_edges").strip()
    + ", nc AS (SELECT component, node % 3 AS color, count(*) AS n FROM cc GROUP BY 1, 2), ec AS (SELECT component, (src + dst) % 3 AS color, count(*) AS n FROM v_edges JOIN cc ON node = src GROUP BY 1, 2), n AS (SELECT component, CAST(sum(n) AS BIGINT) AS size, max(n) / sum(n) AS p FROM nc GROUP BY 1), e AS (SELECT component, CAST(sum(n) AS BIGINT) AS n, max(n) / sum(n) AS p FROM ec GROUP BY 1) SELECT component, size, round(n.p, 6) AS node_purity, e.n AS n_edges, round(e.p, 6) AS edge_purity FROM n JOIN e USING (component) WHERE size >= 4",
)


@query()
def path_lengths(spark, sf_dir):
    e = H.cut_lineage(spark_view(spark, sf_dir, "v_edges"))
    return H.path_lengths(e, H.degrees(e).where("node % 20 = 0").select("node"), 4)


_SQL["path_lengths"] = _recursive(
    duck_views("v_edges"),
    "RECURSIVE bo AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT dst, src FROM v_edges), w(source, node, steps) AS (SELECT DISTINCT a, a, 0 FROM bo WHERE a % 20 = 0 UNION SELECT source, b, steps + 1 FROM w JOIN bo ON a = node WHERE steps < 4) SELECT source, node, min(steps) AS steps FROM w GROUP BY 1, 2",
)


@query(
    f"WITH {SITES.format(m='v_matrix')}, k AS (SELECT site, CASE {minor_sql(12, 25)} WHEN '.' THEN 0 WHEN '1' THEN 1 END AS m FROM s), x AS (SELECT read_id, v.site, (allele = m)::INT AS has FROM v_matrix v JOIN k ON k.site = v.site WHERE m IS NOT NULL) SELECT a.site AS i, b.site AS j, CAST(sum(a.has * b.has) AS BIGINT) AS n_shared, count(*) FILTER (WHERE a.has <> b.has) AS n_conflict FROM x a JOIN x b ON a.read_id = b.read_id AND a.site < b.site GROUP BY 1, 2 HAVING sum(a.has) > 0 AND sum(b.has) > 0",
    ("v_matrix",),
)
def site_conflicts(spark, sf_dir):
    return G.conflicts(spark_view(spark, sf_dir, "v_matrix"), 12, 25)


@thinned(
    "SELECT x.read_id AS src, y.read_id AS dst, CAST(sum(CASE WHEN x.allele = y.allele THEN 1.0 ELSE -1.0 END) AS DOUBLE) AS weight FROM v_matrix_sparse x JOIN v_matrix_sparse y ON x.site = y.site AND x.read_id < y.read_id GROUP BY 1, 2 HAVING sum(CASE WHEN x.allele = y.allele THEN 1 ELSE -1 END) >= 2",
    ("v_matrix_sparse",),
)
def similar_reads(spark, sf_dir, view="v_matrix_sparse"):
    return G.similar_reads(G.read_scores(spark_view(spark, sf_dir, view), least=2.0), 2.0)


@thinned(f'WITH {_CUTS} SELECT cut, read_id, count(*) AS n, min(v.site) AS "first", max(v.site) AS "last" FROM v_matrix_sparse v JOIN ct ON ct.site = v.site GROUP BY 1, 2', ("v_matrix", "v_matrix_sparse"))
def fragment_cover(spark, sf_dir, view="v_matrix_sparse"):
    return G.fragment_cover(spark_view(spark, sf_dir, view), _cuts(spark_view(spark, sf_dir, "v_matrix")))


@query(
    "WITH a AS (SELECT readid, cut AS grp FROM v_phase), b AS (SELECT readid, min(cut) AS grp FROM v_phase GROUP BY 1), m AS (SELECT readid, count(*) AS times FROM a GROUP BY 1), x AS (SELECT a.grp, times, b.grp IS NOT NULL AS hit FROM a JOIN m ON m.readid = a.readid LEFT JOIN b ON b.readid = a.readid AND b.grp = a.grp) SELECT grp, count(*) FILTER (WHERE hit) AS overlap, count(*) AS n_a, (SELECT count(*) FROM b WHERE b.grp = x.grp) AS n_b, round(avg(times) FILTER (WHERE NOT hit), 6) AS mean_only_a, round(avg(times) FILTER (WHERE hit), 6) AS mean_both FROM x GROUP BY grp",
    ("v_phase",),
)
def partition_compare(spark, sf_dir):
    a = spark_view(spark, sf_dir, "v_phase").select(F.col("readid").alias("read_id"), F.col("cut").alias("grp"))
    out = G.compare_partitions(a, a.groupBy("read_id").agg(F.min("grp").alias("grp")))
    return out.select("grp", "overlap", "n_a", "n_b", _r("mean_only_a"), _r("mean_both"))


@query(
    "WITH n AS (SELECT o_custkey % 50 AS p, l_suppkey % 9 AS r, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT p, r, n FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, r) AS k FROM n) t WHERE k = 1",
)
def best_contig(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 50).alias("p"))
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_suppkey") % 9).alias("r")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.best_contig(x.groupBy("p", "r").agg(F.count("*").alias("n")))


@query("SELECT collapse, cut, CASE WHEN per_id >= 100 THEN '0,100,0' WHEN per_id >= 99.99 THEN '0,150,0' WHEN per_id >= 99.8 THEN '0,200,0' WHEN per_id >= 99 THEN '192,192,192' WHEN per_id >= 95 THEN '230,230,230' ELSE '255,255,0' END AS color, count(*) AS n FROM v_assembly GROUP BY 1, 2, 3", ("v_assembly",))
def identity_bands(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_assembly").groupBy("collapse", "cut", R.identity_band(F.col("per_id")).alias("color")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT list_sort([a, c, g, t], 'DESC') AS v FROM v_pileup) SELECT CAST(floor(v[2] / 3) * 3 AS BIGINT) AS bin, count(*) AS n FROM t WHERE v[1] + v[2] < 140 GROUP BY 1", ("v_pileup",))
def second_depth_histogram(spark, sf_dir):
    return R.second_depth_histogram(spark_view(spark, sf_dir, "v_pileup"), 3)


@query("SELECT round(sum(c) / 1e6, 6) AS collapse_mbp, round(sum(l) / 1e6, 6) AS assembled_mbp FROM (SELECT collapse, max(length) AS c, sum(length) AS l FROM v_assembly GROUP BY 1) t", ("v_assembly",))
def totals_bar(spark, sf_dir):
    x = spark_view(spark, sf_dir, "v_assembly")
    longest = x.groupBy("collapse").agg(F.max("length").alias("collapse_length"))
    return R.totals(x.join(longest, "collapse")).select(_r("collapse_mbp"), _r("assembled_mbp"))


@query(
    "WITH f AS (SELECT l_orderkey, l_linenumber, l_discount AS d, bool_or(l_discount <= 1.0) OVER () AS small FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN (CASE WHEN small THEN d * 100 ELSE d END) >= 100 THEN 99.999999 WHEN small THEN d * 100 ELSE d END, 6) AS d FROM f",
)
def rescale_percent(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("d"))
    return R.rescale_percent(x, "d").select("l_orderkey", "l_linenumber", _r("d"))


@query(
    "SELECT l_orderkey, l_linenumber, concat('chr', CAST(l_suppkey AS VARCHAR)) AS contig, l_partkey * 100 + l_linenumber AS start0, l_partkey * 100 + l_linenumber + CAST(l_quantity AS BIGINT) AS end0 FROM lineitem",
)
def region_lift(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    region = I.format_region(F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), F.col("l_partkey") * 100, F.col("l_partkey") * 100 + 90)
    x = x.select("l_orderkey", "l_linenumber", region.alias("region"), F.col("l_linenumber").cast("bigint").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity").cast("bigint")).alias("hi"))
    return AL.lift(x).select("l_orderkey", "l_linenumber", "contig", "start0", "end0")
