"""Interval operators on unbounded inputs.

Reads arrive as (contig, start0, end0) rows, say from a folder that a sequencer fills. Depth by fixed windows is a plain sum
over the part of each read in each window, so that Structured Streaming keeps one number for each window; with an event
time and a watermark, windows of time are closed and their state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVALS = "contig string, start0 bigint, end0 bigint"


def interval_stream(spark: SparkSession, folder: str, schema: str = INTERVALS) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def window_depth(reads: DataFrame, width: int) -> DataFrame:
    """(contig, start0, bases): covered bases of each window of `width` so far; for output modes update and complete."""
    first, last = F.floor(F.col("start0") / width), F.floor((F.col("end0") - 1) / width)
    x = reads.where("start0 < end0").withColumn("w", F.explode(F.sequence(first, last)))
    part = F.least("end0", (F.col("w") + 1) * width) - F.greatest("start0", F.col("w") * width)
    return x.groupBy("contig", (F.col("w") * width).alias("start0")).agg(F.sum(part).alias("bases"))


def bases_by_time(reads: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """(begin, contig, reads, bases) of each stretch of event time; rows later than the watermark are left out."""
    x = reads.withWatermark(time, late).groupBy(F.window(time, every).alias("t"), "contig")
    return x.agg(F.count("*").alias("reads"), F.sum(F.col("end0") - F.col("start0")).alias("bases")).select(F.col("t.start").alias("begin"), "contig", "reads", "bases")
