"""Writers of the text formats; all write with Spark, one folder of part files for each result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import condense_indels, wrap
from strandline.operators.alignment import number_rows
from strandline.operators.summary import identity_band, stacked


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header, quote="", escape="", nullValue="NA")


def bed(df: DataFrame, path: str, digits: int = 7) -> None:
    """Sorted by contig and start; fractions are rounded."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).orderBy("contig", "start0", "end0").write.csv(path, sep="\t", header=False)


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """(value): records of (id, seq) with wrapped sequences."""
    return df.select(_record(width).alias("value"))


def _record(width: int) -> Column:
    return F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrap(F.col("seq"), width))


def fasta(df: DataFrame, path: str, shards: int | None = None, width: int = 60) -> None:
    """All records, or in `shards` folders by the hash of the id."""
    if shards is None:
        fasta_lines(df, width).write.text(path)
    else:
        shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
        df.select(shard, _record(width).alias("value")).write.partitionBy("shard").text(path)


def fasta_by_record(df: DataFrame, path: str, width: int = 60) -> None:
    """A folder for each record, named by its id."""
    df.select(F.col("id").alias("record"), _record(width).alias("value")).write.partitionBy("record").text(path)


def renamed(df: DataFrame, prefix: str, start: int = 0) -> DataFrame:
    """Records (id, seq) in order of their ids as `prefix` and a number from `start` on; the next call goes on from start plus the rows."""
    x = number_rows(df.select(F.col("id").alias("old"), "seq"), ["old", "seq"], "_k")
    return x.select(F.concat(F.lit(prefix), (F.col("_k") - 1 + start).cast("string")).alias("id"), "seq")


# Lines and fields of the VCF.
VCF_HEAD = (
    "##fileformat=VCFv4.1",
    '##INFO=<ID=AO,Number=A,Type=Integer,Description="Alternate allele observations">',
    '##INFO=<ID=RO,Number=1,Type=Integer,Description="Reference allele observations">',
)
VCF_COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample"
VCF_INFO, VCF_FORMAT, VCF_GENOTYPE = "AN=2;AO=NA;RO=NA;AL=NA", "GT", "0|1:100"


def vcf_lines(psvs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(cut, a, contig, pos1, value): a VCF of each cluster with header lines for its contigs, in order of a, contig and pos1. psvs: cut,
    contig, pos1, ref, alt; contigs: contig, len."""
    nothing = F.lit("").alias("contig"), F.lit(0).cast("bigint").alias("pos1")
    each = psvs.select("cut").distinct()
    heads = [each.select("cut", F.lit(k).alias("a"), *nothing, F.lit(v).alias("value")) for k, v in enumerate(VCF_HEAD)]
    at = len(VCF_HEAD)
    names = psvs.select("cut", "contig").distinct().join(contigs.select("contig", "len"), "contig")
    heads.append(names.select("cut", F.lit(at).alias("a"), "contig", nothing[1], F.format_string("##contig=<ID=%s,length=%d>", "contig", "len").alias("value")))
    heads.append(each.select("cut", F.lit(at + 1).alias("a"), *nothing, F.lit(VCF_COLUMNS).alias("value")))
    fixed = lambda *v: map(F.lit, v)
    line = F.concat_ws("\t", "contig", F.col("pos1").cast("string"), *fixed("."), "ref", "alt", *fixed(".", "PASS", VCF_INFO, VCF_FORMAT, VCF_GENOTYPE))
    rows = psvs.select("cut", F.lit(at + 2).alias("a"), "contig", "pos1", line.alias("value"))
    return reduce(DataFrame.unionByName, [*heads, rows])


def vcf_by_cut(psvs: DataFrame, contigs: DataFrame, path: str) -> None:
    """A folder for each cluster, lines in order."""
    x = vcf_lines(psvs, contigs).repartition("cut").sortWithinPartitions("cut", "a", "contig", "pos1")
    x.select("cut", "value").write.partitionBy("cut").text(path)


def cut_sizes(cuts: DataFrame) -> DataFrame:
    """(cut, n): sites of each cluster."""
    return cuts.groupBy("cut").agg(F.count("*").alias("n"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (value) in order of their other columns; the part files of the folder, one after the other, are the file."""
    order = [c for c in lines.columns if c != "value"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def matrix_lines(matrix: DataFrame, sites: int) -> DataFrame:
    """(read_id, row): genotypes as text, `n` where there is no signal."""
    m = matrix.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("site", "allele"))).alias("m"))
    char = lambda i: F.coalesce(F.when(F.col("m")[i] == 1, "1").when(F.col("m")[i] == 0, "."), F.lit("n"))
    return m.select("read_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(sites - 1)), char), "").alias("row"))


def metis_lines(edges: DataFrame, nodes: int) -> DataFrame:
    """(node, value): neighbours and weights of each node, numbered from 1. edges: src, dst, weight (whole numbers). A line of the file holds
    a node's neighbours, so a row does."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = both.groupBy("src").agg(F.sort_array(F.collect_list(F.struct((F.col("dst") + 1).alias("d"), F.col("weight").cast("bigint").alias("w")))).alias("n"))
    text = F.array_join(F.transform("n", lambda x: F.concat(x["d"].cast("string"), F.lit(" "), x["w"].cast("string"))), " ")
    ids = edges.sparkSession.range(nodes).select(F.col("id").alias("src"))
    return ids.join(near, "src", "left").select(F.col("src").alias("node"), F.coalesce(text, F.lit("")).alias("value"))


def metis_file(edges: DataFrame, nodes: int) -> DataFrame:
    """metis_lines with the file's first line under node -1: the numbers of nodes and edges, and `1` as edges have weights."""
    head = edges.agg(F.format_string("%d %d 1", F.lit(nodes), F.count("*")).alias("value")).select(F.lit(-1).cast("bigint").alias("node"), "value")
    return head.unionByName(metis_lines(edges, nodes))


def lp_lines(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """(part, value): objective terms, triangle constraints, bounds and binaries of the clustering program. edges: src, dst, cost; triangles:
    i, j, k."""
    x = F.format_string("x_%d_%d", "src", "dst")
    goal = edges.select(F.lit(0).alias("part"), F.concat(F.format_string("%+g ", F.col("cost").cast("double")), x).alias("value"))
    # no side of a triangle is longer than both others
    sides = [F.format_string("x_%d_%d", a, b) for a, b in (("i", "j"), ("j", "k"), ("i", "k"))]
    rows = F.explode(F.array(*[F.concat(sides[k - 2], F.lit(" + "), sides[k - 1], F.lit(" - "), sides[k], F.lit(" >= 0")) for k in range(3)]))
    limits = edges.select(F.lit(2).alias("part"), F.concat(F.lit("0 <= "), x, F.lit(" <= 1")).alias("value"))
    binary = edges.select(F.lit(3).alias("part"), x.alias("value"))
    return goal.unionByName(triangles.select(F.lit(1).alias("part"), rows.alias("value"))).unionByName(limits).unionByName(binary)


def lp_file(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """(part, k, value): lp_lines as a whole file in order of part and k, with names for the constraints and the lines between the parts."""
    body = lp_lines(edges, triangles)
    name = F.when(F.col("part") == 1, F.concat(F.lit("c"), F.regexp_replace("value", "[^0-9]+", "_"), F.lit(": ")))
    rows = body.select((F.col("part") * 2 + 1).alias("part"), F.col("value").alias("k"), F.concat(F.coalesce(name, F.lit("")), "value").alias("value"))
    # The lines that begin the sections of the format.
    marks = [(0, "Minimize\nrepulsion:"), (2, "Subject To"), (4, "Bounds"), (6, "binary"), (8, "End")]
    return edges.sparkSession.createDataFrame([(p, "", v) for p, v in marks], "part int, k string, value string").unionByName(rows)


# What opens and closes the file of each graph format.
GRAPH_ENDS = {
    "gml": ("graph [", "]"),
    "gexf": ('<gexf version="1.2"><graph defaultedgetype="undirected">', "</graph></gexf>"),
    "graphml": ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">', "</graph></graphml>"),
}


def graph_lines(nodes: DataFrame, edges: DataFrame, kind: str = "gml") -> DataFrame:
    """(part, a, b, value): nodes (id) and edges (src, dst, weight) as a whole file of a kind in GRAPH_ENDS, in order of part, a and b."""
    entries = {
        "gml": ('node [ id %1$d label "%1$d" ]', "edge [ source %2$d target %3$d weight %4$s ]"),
        "gexf": ('<node id="%1$d" label="%1$d"/>', '<edge id="%1$s" source="%2$d" target="%3$d" weight="%4$s"/>'),
        "graphml": ('<node id="%1$d"/>', '<edge id="%1$s" source="%2$d" target="%3$d"><data key="weight">%4$s</data></edge>'),
    }[kind]
    none = F.lit(0).cast("bigint")
    first, last = GRAPH_ENDS[kind]
    parts = [edges.sparkSession.range(1).select(F.lit(0).alias("part"), none.alias("a"), none.alias("b"), F.lit(first).alias("value"))]
    wrap_ = lambda x, open_, close: [parts[0].select(F.lit(k).alias("part"), "a", "b", F.lit(v).alias("value")) for k, v in ((x - 1, open_), (x + 1, close))]
    if kind == "gexf":
        parts += wrap_(2, "<nodes>", "</nodes>") + wrap_(5, "<edges>", "</edges>")
    name = F.concat_ws("_", F.col("src").cast("string"), F.col("dst").cast("string"))
    parts.append(nodes.select(F.lit(2).alias("part"), F.col("id").cast("bigint").alias("a"), none.alias("b"), F.format_string(entries[0], "id").alias("value")))
    line = F.format_string(entries[1], name, "src", "dst", F.col("weight").cast("double").cast("string"))
    parts.append(edges.select(F.lit(5).alias("part"), F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"), line.alias("value")))
    parts.append(parts[0].select(F.lit(7).alias("part"), "a", "b", F.lit(last).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph file whose kind its name tells."""
    kind = next((k for k in ("graphml", "gexf", "gml") if k in path), None)
    if kind is None:
        raise ValueError(f"{path}: no known kind of graph file")
    write_lines(graph_lines(nodes, edges, kind), path)


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the entries of a GML file, without what opens and closes it."""
    return graph_lines(nodes, edges).where("part in (2, 5)").select(F.when(F.col("part") == 2, 0).otherwise(1).alias("part"), "value")


def adjacency(edges: DataFrame, path: str) -> None:
    """Edges (src, dst, weight) as a tab-separated table in order."""
    edges.select("src", "dst", "weight").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.csv(path, sep="\t", header=True)


def condensed_sam(lines: DataFrame, below: int) -> DataFrame:
    """Lines (value) of a SAM file whose CIGARs have nearby indels of one kind as one; header lines stay."""
    f = F.split("value", "\t")
    new = F.concat_ws("\t", F.slice(f, 1, 5), F.array(condense_indels(F.get(f, F.lit(5)), below)), F.slice(f, 7, F.size(f)))
    return lines.withColumn("value", F.when(F.startswith("value", F.lit("@")) | (F.size(f) < 11), F.col("value")).otherwise(new))


def appended(spark: SparkSession, paths: list[str], reader) -> DataFrame | None:
    """All rows of what reader(path) makes of those of some paths that exist, with nulls for columns that one lacks; None without any."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(q)]
    return stacked(*[reader(p) for p in there]) if there else None


def bigbed_lines(rows: DataFrame) -> DataFrame:
    """(value): rows of successful assemblies for a browser, coloured by identity. rows: collapse, status, query_name, per_id, bestChr,
    bestStart, bestEnd, details."""
    ok = rows.where("status <> 'Failed'")
    at = [F.col(c).cast("string") for c in ("bestStart", "bestEnd")]
    return ok.select(F.concat_ws("\t", "bestChr", *at, F.col("collapse").cast("string"), F.lit("0"), F.lit("."), *at, identity_band(F.col("per_id")), "query_name", "details").alias("value"))


def scores(df: DataFrame, path: str) -> None:
    """Scores of read pairs (a, b, score), to be read again with spark.read.parquet."""
    df.select("a", "b", "score").write.parquet(path)


def job_lines(regions: DataFrame, template: str) -> DataFrame:
    """(value): one command for each region (contig, start0, end0, coverage), from a template with %1$s to %4$s."""
    return regions.select(F.format_string(template, *[F.col(c).cast("string") for c in ("contig", "start0", "end0", "coverage")]).alias("value"))


def sam_by_group(df: DataFrame, path: str, group: str = "grp") -> None:
    """A folder of SAM lines for each group, with the group as the tag cc. df: value (a SAM line) and the group."""
    df.select(group, F.concat("value", F.lit("\tcc:i:"), F.col(group).cast("string")).alias("value")).write.partitionBy(group).text(path)
