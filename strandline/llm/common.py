"""Helpers shared by the operators of this subpackage.

Every text operator is a column function: the text column goes to Python in Arrow batches, only the results come
back, and all other columns stay in the JVM. A factory builds the per-task state once; models travel as broadcasts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import cut_lineage

#: Characters that one call of a text function gets at most, unless a single text is longer.
CHUNK_CHARS = 4_000_000

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(ddl: str) -> pa.DataType:
    """Arrow type of a DDL type made of the primitives above, array<> and struct<>."""
    ddl = ddl.strip()
    if ddl.startswith("array<"):
        return pa.list_(arrow_type(ddl[6:-1]))
    if ddl.startswith("struct<"):
        return pa.struct([(n, arrow_type(t)) for n, t in fields(ddl[7:-1])])
    return _ARROW[ddl]


def fields(ddl: str) -> list[tuple[str, str]]:
    """Top-level (name, type) pairs of `a:bigint,b:array<string>`."""
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(ddl[last:i])
            last = i + 1
    parts.append(ddl[last:])
    return [(n.strip(), t.strip()) for n, _, t in (p.partition(":") for p in parts)]


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """Cuts a batch into runs of whole texts of about `most` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t) if t else 0
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


def text_column(text: Column, ddl: str, factory: Callable[[], Callable]) -> Column:
    """A struct column computed from a text column.

    factory() runs once per task and returns a function from a list of texts (null: None) to one list or Arrow array
    for each field of `ddl`, in order.
    """
    kinds = [(n, arrow_type(t)) for n, t in fields(ddl)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = factory()
        for batch in batches:
            parts = []
            for some in chunks(batch.to_pylist()):
                cols = work(some)
                parts.append(
                    pa.StructArray.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)],
                        fields=[pa.field(n, t) for n, t in kinds],
                    )
                )
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(kinds))

    # arrow_udf reads the kind of a function from its annotations, which would be strings here
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"struct<{ddl}>")(text)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Ends the lineage with a checkpoint in the folder that the cluster names in spark.checkpoint.dir.
cut = cut_lineage
