"""Projections of star-schema tables on to the engine's inputs, as SQL that Spark and DuckDB both run.

Each view is text with a few tokens that differ between the two dialects; `spark_view` and `duck_views` fill them in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_intervals": "SELECT user_id AS contig, CAST(floor({epoch}/3600) AS BIGINT) AS start0, CAST(floor({epoch}/3600) AS BIGINT)+4 AS end0, value, event_type FROM events",
    "v_contigs": "SELECT contig, min(start0) AS lo, max(end0) AS hi FROM v_intervals GROUP BY contig",
    "v_windows": "SELECT contig, ws AS start0, least(ws+24, hi) AS end0 FROM (SELECT contig, hi, {series} AS ws FROM v_contigs) t",
    "v_matrix": "SELECT user_id AS read_id, CAST({k} AS INT) AS site, max(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS allele FROM events GROUP BY 1, 2",
    "v_matrix_sparse": "SELECT user_id AS read_id, CAST({k} AS INT) AS site, max(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS allele FROM events WHERE event_id % 6 = 0 GROUP BY 1, 2",
    "v_pileup": "SELECT l_suppkey AS contig, l_partkey % 50 AS pos1, sum(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag='N' AND l_linestatus='O' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN l_returnflag='N' AND l_linestatus='F' THEN 1 ELSE 0 END) AS g, sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS t FROM lineitem GROUP BY 1, 2",
    "v_cigar": "SELECT concat(CAST(l_orderkey AS {string}),'/',CAST(l_linenumber AS {string})) AS qname, l_suppkey AS rname, l_partkey*10 AS pos0, CASE WHEN l_returnflag='R' THEN 16 WHEN l_partkey % 17 = 0 THEN 256 WHEN l_partkey % 19 = 0 THEN 4 ELSE 0 END AS flag, concat(CAST(l_linenumber AS {string}),'S',CAST(CAST(l_quantity AS INT)*10 AS {string}),'=',CAST(l_suppkey % 5 + 1 AS {string}),'X',CAST(l_partkey % 7 + 1 AS {string}),'I',CAST(CAST(l_quantity AS INT)*5 AS {string}),'=',CAST(l_partkey % 11 + 1 AS {string}),'D',CAST(CAST(l_quantity AS INT) AS {string}),'=') AS cigar FROM lineitem",
    "v_assembly": "SELECT o_custkey AS collapse, l_linenumber AS cut, l_suppkey % 3 AS asm_rank, CAST(floor(l_extendedprice) AS BIGINT) AS length, 100 - l_discount*4 AS per_id, l_suppkey % 22 AS chr, l_partkey*1000 AS start0, l_partkey*1000 + CAST(floor(l_extendedprice) AS BIGINT) AS end0, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "v_phase": "SELECT DISTINCT l_partkey AS readid, l_linenumber AS cut FROM lineitem WHERE l_quantity >= 48",
    "v_collapse": "SELECT l_suppkey AS contig, l_partkey*100 AS start0, l_partkey*100 + CAST(l_quantity AS BIGINT)*1000 AS end0, l_extendedprice/1000 AS mean_cov, CAST(floor(l_quantity*1000*l_tax*12) AS BIGINT) AS repeat_bp, CAST(l_quantity AS BIGINT)*1000 AS len FROM lineitem",
    "v_edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_partkey<b.l_partkey WHERE a.l_returnflag='R' AND b.l_returnflag='R' AND a.l_quantity>=40 AND b.l_quantity>=40",
    "v_edges_dense": "SELECT DISTINCT a.l_partkey % 60 AS src, b.l_partkey % 60 AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_partkey % 60 < b.l_partkey % 60 WHERE a.l_quantity>=42 AND b.l_quantity>=42",
    "v_seq": "SELECT doc_id AS id, {rx} AS seq FROM documents",
}

SPARK = {"epoch": "unix_seconds(CAST(ts AS TIMESTAMP))", "k": "get_json_object(props,'$.k')", "series": "explode(sequence(lo, hi-1, 24L))", "string": "STRING", "rx": "regexp_replace(translate(text,'acgtn','ACGTN'),'[^ACGTN]','')"}
DUCK = {"epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "k": "json_extract_string(props,'$.k')", "series": "unnest(generate_series(lo, hi-1, 24))", "string": "VARCHAR", "rx": "regexp_replace(translate(text,'acgtn','ACGTN'),'[^ACGTN]','','g')"}


def _needs(name: str) -> list[str]:
    """Views that a view reads, in order, itself last."""
    out: list[str] = []
    for v in VIEWS:
        if v != name and re.search(rf"\b{v}\b", VIEWS[name]):
            out += [x for x in _needs(v) if x not in out]
    return [*out, name]


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a directory; nothing is registered in the session."""
    args, clauses = {}, []
    for v in _needs(name):
        sql = VIEWS[v].format(**SPARK)
        for t in TABLES:
            if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
                args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        clauses.append(f"{v} AS ({sql})")
    return spark.sql(f"WITH {', '.join(clauses)} SELECT * FROM {name}", **args)


def duck_views(*names: str) -> str:
    """A WITH clause, to which the query is appended."""
    done: list[str] = []
    for n in names:
        done += [v for v in _needs(n) if v not in done]
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v].format(**DUCK)})" for v in done)
