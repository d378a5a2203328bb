"""Spark sessions for local work, and checkpoints; on a cluster the caller brings the session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, memory: str = "8g", app: str = "strandline") -> SparkSession:
    n = cpus or min(8, os.cpu_count() or 1)
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder;
    elsewhere that is an error, as executors don't share local folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder of checkpoint_folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def round_table(df: DataFrame) -> DataFrame:
    """What a round of a loop hands to the next one: Parquet in the folder of checkpoint_folder, read back with its own size.

    A checkpoint keeps the size that was estimated for its plan. A join's estimate is the product of both sides', so that in a loop that joins
    its own tables the estimate gets digits by the million within a few rounds, and planning takes longer than all tasks. The files stay as
    those of checkpoints do."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_table(df: DataFrame, name: str, keep: str | None = None) -> DataFrame:
    """A table between two stages, without lineage: a checkpoint, which goes with the session's other temporary files, or with a folder to keep
    it in, Parquet of this name there. A file of an earlier run is replaced."""
    if keep is None:
        return cut_lineage(df)
    path = f"{keep.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
