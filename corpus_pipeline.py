"""Corpus pipeline: the documents, stage by stage, to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes what each stage returns
as Parquet into the shared checkpoint folder, reads it again for the next one and then removes the folder of the stage before;
that of the last stage stays, as its rows are the result. Nulls, empty texts and tables, repeated rows and ids and further
columns go through all stages, as each of them states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import queries as q
from strandline.session import checkpoint_folder

STAGES = [
    ("toxicity", q.stage_toxicity),
    ("simhash_near_dedup", q.stage_simhash),
    ("benchmark_decontamination", q.stage_decontamination),
    ("pii", q.stage_pii),
    ("bpe", q.stage_bpe),
]

#: Fitted models and components can't be said in SQL; the tests compare run() with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    base = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what a written stage was made of isn't needed again
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
