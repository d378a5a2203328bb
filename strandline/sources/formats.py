"""Readers of the text formats of the domain, each to a DataFrame with a fixed schema; nothing is inferred.

All read through Spark (spark.read.text and csv), so any store that Spark can open works, files split where their format
allows it, and filters and columns are pruned as usual. Formats whose rows depend on rows before them (FASTA, TRF sections)
use a record separator or a window within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import clips, parse_cigar, reference_span

FAI = "contig string, len bigint, offset bigint, linebases int, linewidth int"
PILEUP = "contig string, pos1 bigint, ref string, depth int, bases string, quals string"
SIMPLE_VCF = "contig string, pos1 bigint, id string, ref string, alt string, qual string, filter string, info string, format string, sample string"
COLLAPSE = "contig string, start0 bigint, end0 bigint, mean double, median double, repeat_bp bigint, len bigint"
M5 = (
    "qname string, q_len bigint, q_start bigint, q_end bigint, q_strand string, tname string, t_len bigint, t_start bigint, t_end bigint, t_strand string, score int, "
    "n_match bigint, n_mismatch bigint, n_ins bigint, n_del bigint, mapq int, q_aligned string, pattern string, t_aligned string"
)
M4 = (
    "qname string, tname string, score int, identity double, q_strand int, q_start bigint, q_end bigint, q_len bigint, t_strand int, t_start bigint, "
    "t_end bigint, t_len bigint, mapq int"
)
CUT_TREE = "src int, dst int, cut bigint"
# The column names of both formats.
TRF_NAMES = "start end PeriodSize CopyNumber ConsensusSize PercentMatches PercentIndels Score A C G T Entropy Motif Sequence".split()
RM_NAMES = "score div del ins contig start end q_left strand repeat class r_st r_en r_left id".split()


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, descr, seq): records begin with `>` at a line start; the id is the first word."""
    x = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.col("value"), "^>", "")
    head = F.substring_index(body, "\n", 1)
    seq = F.regexp_replace(F.substr(body, F.length(head) + 1), r"\s", "")
    return x.select(F.substring_index(head, " ", 1).alias("id"), F.trim(F.substr(head, F.length(F.substring_index(head, " ", 1)) + 1)).alias("descr"), seq.alias("seq")).where("id <> ''")


def fai(spark: SparkSession, path: str) -> DataFrame:
    """The index, with contig_idx, the place in the file."""
    x = spark.read.csv(path, sep="\t", schema=FAI)
    # offsets grow with the place in the file; an index has one short row for each contig
    return x.withColumn("contig_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("offset")) - 1)


def subsequence(seqs: DataFrame, regions: DataFrame) -> DataFrame:
    """Parts of sequences: regions (contig, start0, end0, ...) with `part`, clipped at the ends."""
    x = regions.join(seqs.select(F.col("id").alias("contig"), "seq"), "contig")
    start = F.greatest(F.col("start0"), F.lit(0))
    return x.withColumn("part", F.substr("seq", (start + 1).cast("int"), F.greatest(F.col("end0") - start, F.lit(0)).cast("int"))).drop("seq")


def _fields(df: DataFrame, pattern: str = "\t") -> DataFrame:
    return df.withColumn("f", F.split("value", pattern))


def sam(spark: SparkSession, path: str | list[str], keep: Column | None = None) -> DataFrame:
    """Alignment rows of SAM text with parsed CIGAR and tags (TAG to value, types dropped)."""
    x = _fields(spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")))
    f = lambda k: F.col("f")[k]
    tags = F.transform(F.slice("f", 12, F.size("f")), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)).alias("k"), F.substr(t, F.lit(6)).alias("v")))
    once = F.map_from_arrays(F.array_distinct(tags["k"]), F.transform(F.array_distinct(tags["k"]), lambda k: F.element_at(F.filter(tags, lambda t: t["k"] == k), -1)["v"]))
    out = x.select(
        f(0).alias("qname"), f(1).cast("int").alias("flag"), f(2).alias("rname"), f(3).cast("bigint").alias("pos1"), f(4).cast("int").alias("mapq"),
        f(5).alias("cigar"), f(6).alias("rnext"), f(7).cast("bigint").alias("pnext"), f(8).cast("bigint").alias("tlen"), f(9).alias("seq"), f(10).alias("qual"), once.alias("tags"),
    )
    out = out.withColumn("pos0", F.col("pos1") - 1).withColumn("ops", parse_cigar(F.col("cigar")))
    return out if keep is None else out.where(keep)


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(contig, len, contig_idx) of the @SQ lines; the number is the line's place among them. Headers are short."""
    x = _numbered_lines(spark, path).where(F.col("value").startswith("@SQ"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line_no")) - 1
    return x.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("bigint").alias("len"), place.alias("contig_idx"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the header lines of one file: their order is that of their places in it."""
    x = spark.read.text(path).where(F.col("value").startswith("@"))
    return x.select("value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("k")).alias("line_no"))


def sam_programs(spark: SparkSession, path: str) -> DataFrame:
    """(id, line) of the @PG lines."""
    x = spark.read.text(path).where(F.col("value").startswith("@PG"))
    return x.select(F.regexp_extract("value", r"\tID:([^\t]+)", 1).alias("id"), F.col("value").alias("line"))


def sam_region(spark: SparkSession, path: str | list[str], contig: str, start0: int, end0: int) -> DataFrame:
    """Alignments that share a position with a region."""
    x = sam(spark, path, (F.col("rname") == contig) & (F.col("pos0") < end0))
    return x.where(F.col("pos0") + reference_span(F.col("ops")) > start0)


def query_bounds(alignments: DataFrame) -> DataFrame:
    """Adds q_start, q_end and full_length: where the aligned part lies on the read as it was sequenced, by the tags XS and XE or the whole
    read, less its soft clips; and the tag XQ. The first match of a tag counts."""
    c = clips(F.col("ops"), F.col("flag"))
    start, end = F.coalesce(F.col("tags")["XS"].try_cast("bigint"), F.lit(0)), F.coalesce(F.col("tags")["XE"].try_cast("bigint"), F.length("seq").cast("bigint"))
    full = F.substring_index(F.col("tags")["XQ"], "rq", 1).try_cast("bigint")
    return alignments.withColumn("q_start", start + c["start"]).withColumn("q_end", end - c["end"]).withColumn("full_length", full)


def bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, start0, end0, rest): further columns as an array; comments and track lines are skipped."""
    x = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    x = _fields(x, r"[\t ]+")
    return x.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("bigint").alias("start0"), F.col("f")[2].cast("bigint").alias("end0"), F.slice("f", 4, F.size("f")).alias("rest"))


def pileup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=PILEUP, quote="", escape="")


def pileup_counts(bases: Column, ref: Column, compat: bool = False) -> Column:
    """Struct (A, C, G, T, del, ins) of a pileup string: `^` and the quality behind it, `$`, and the letters of an insertion or
    deletion are not bases; `.` and `,` are the reference; `*` is a deleted base; an insertion counts once.

    compat: as an old parser has it, `$` and `-` also take the next character with them, so that deleted bases count as bases, and
    of a longer length only the first digit is apart from the inserted letters."""
    clean = F.regexp_replace(bases, r"[\^$-].?", "") if compat else F.regexp_replace(F.regexp_replace(bases, r"\^.", ""), r"\$", "")
    ins = F.regexp_extract_all(clean, F.lit(r"(\+)[0-9]+"), F.lit(1))
    # an indel's letters go by its length: what follows the number is cut off piece by piece
    pieces = F.split(clean, r"[+-](?=[0-9])")
    first = F.element_at(pieces, 1)
    number = lambda p: F.regexp_extract(p, "^([0-9]+)", 1)
    digits = lambda p: F.lit(1) if compat else F.length(number(p))
    others = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.substr(p, digits(p) + number(p).cast("int") + 1))
    plain = F.upper(F.concat(first, F.array_join(others, "")))
    plain = F.replace(F.replace(plain, F.lit(","), F.lit(".")), F.lit("."), F.upper(ref))
    n = lambda b: (F.length(plain) - F.length(F.replace(plain, F.lit(b), F.lit("")))).cast("int")
    return F.struct(n("A").alias("A"), n("C").alias("C"), n("G").alias("G"), n("T").alias("T"), n("*").alias("del"), F.size(ins).alias("ins"))


def simple_vcf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SIMPLE_VCF, comment="#", quote="")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, target, snvs): ragged rows `name n target pos,ref,alt,read,pre,post ...`."""
    x = _fields(spark.read.text(path).where("value <> ''"), r"[\t ]+")
    parts = lambda t: F.split(t, ",")

    def snv(t):
        p = parts(t)
        return F.struct(p[0].cast("int").alias("pos0"), p[1].alias("ref"), p[2].alias("alt"), p[3].alias("read"), p[4].cast("smallint").alias("pre"), p[5].cast("smallint").alias("post"))

    return x.select(F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("n"), F.col("f")[2].alias("target"), F.transform(F.slice("f", 4, F.size("f")), snv).alias("snvs"))


def fragments_to_genotypes(frags: DataFrame, min_pre: int = 0, min_post: int = 0) -> DataFrame:
    """(read_id, site, allele) of SNVs with enough matching bases on both sides; gaps and other bases give no signal. Of a repeated
    position, the last one in the row counts."""
    x = frags.select(F.col("name").alias("read_id"), F.posexplode("snvs").alias("k", "s")).select("read_id", "k", "s.*")
    x = x.where((F.col("pre") >= min_pre) & (F.col("post") >= min_post) & F.col("read").isin(*"ACGTacgt"))
    allele = F.when(F.col("read") == F.col("alt"), 1).when(F.col("read") == F.col("ref"), 0)
    x = x.select("read_id", F.col("pos0").alias("site"), "k", allele.alias("allele")).where("allele is not null")
    return x.groupBy("read_id", "site").agg(F.max_by("allele", "k").alias("allele"))


def non_reference(frags: DataFrame) -> DataFrame:
    """Fragments with those of their SNVs whose base is neither the reference's nor a gap."""
    return frags.withColumn("snvs", F.filter("snvs", lambda s: (s["read"] != s["ref"]) & (s["read"] != "-")))


def snv_lists(spark: SparkSession, path: str) -> DataFrame:
    """(name, alleles): `name <tab> {pos: v, ...}` to a map; of a repeated position the last value counts."""
    x = _fields(spark.read.text(path).where("value <> ''"))
    body = F.col("f")[1]
    keys = F.transform(F.regexp_extract_all(body, F.lit("([0-9]+) *: *[01]"), F.lit(1)), lambda k: k.cast("int"))
    values = F.transform(F.regexp_extract_all(body, F.lit("[0-9]+ *: *([01])"), F.lit(1)), lambda v: v.cast("int"))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    once = F.array_distinct(keys)
    last = F.transform(once, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return x.select(F.col("f")[0].alias("name"), F.map_from_arrays(once, last).alias("alleles"))


def genotype_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, grp, site, allele) of a matrix of `.`, `1` and `n`; `n` makes no row."""
    x = _fields(spark.read.text(path).where("value <> ''"), r"[\t ]+")
    x = x.select(F.col("f")[1].alias("read_id"), F.col("f")[2].alias("grp"), F.posexplode(F.split(F.col("f")[0], "")).alias("site", "c"))
    return x.where("c in ('.', '1')").select("read_id", "grp", "site", (F.col("c") == "1").cast("int").alias("allele"))


def cuts(spark: SparkSession, path: str) -> DataFrame:
    """(cut, node): a line of numbers for each cluster, whose place in the file is its id."""
    x = _numbered(spark, path).select(F.col("line_no").cast("int").alias("cut"), F.explode(F.split("value", r"[\t ]+")).alias("n"))
    return x.where("n <> ''").select("cut", F.col("n").cast("int").alias("node"))


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line_no, value): lines with their place in the file, from 0 on. Files are read in splits; lines are counted within each
    split, and shifted by a table of one row for each."""
    x = spark.read.text(path)
    x = x.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_k"))
    x = x.withColumn("_at", F.row_number().over(Window.partitionBy("file", "block").orderBy("_k")) - 1)
    n = x.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return x.join(n, ["file", "block"]).select("file", "block", (F.col("_before") + F.col("_at")).alias("line_no"), "value")


def _carried(x: DataFrame, head: Column, name: str) -> DataFrame:
    """Adds the last value of `head` that isn't null in the lines of the file up to each one: that of its own split, or what a table of one
    row for each split brings from those before."""
    w = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_head", head)
    last = x.where(F.col("_head").isNotNull()).groupBy("file", "block").agg(F.max_by("_head", "line_no").alias("_last"))
    splits = x.select("file", "block").distinct().join(last, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.last("_last", ignorenulls=True).over(before).alias("_from"))
    x = x.withColumn("_own", F.last("_head", ignorenulls=True).over(w)).join(splits, ["file", "block"])
    return x.withColumn(name, F.coalesce("_own", "_from")).drop("_head", "_own", "_from")


def trf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tandem repeats: a header (`@name` or `Sequence: name`) names the sequence of the rows below it; rows that don't begin with
    a number are skipped."""
    head = F.when(F.col("value").startswith("@"), F.substr("value", F.lit(2))).when(F.col("value").startswith("Sequence:"), F.trim(F.substr("value", F.lit(10))))
    x = _carried(_numbered(spark, path), head, "head")
    x = x.withColumn("contig", F.substring_index("head", " ", 1)).withColumn("f", F.split("value", " "))
    x = x.where(F.col("f")[0].rlike("^[0-9]+$") & F.col("contig").isNotNull())
    kind = lambda n: "string" if n in ("Motif", "Sequence") else "bigint" if n in ("start", "end") else "double"
    return x.select("contig", *[F.get("f", F.lit(i)).cast(kind(n)).alias(n) for i, n in enumerate(TRF_NAMES)])


def repeatmasker(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows behind the header lines, white-space delimited; `better` is the trailing `*` of a row, or `.` without one."""
    x = _fields(spark.read.text(path).select(F.trim("value").alias("value")), r"\s+").where(F.col("f")[0].rlike("^[0-9]+$"))
    kind = lambda n: "bigint" if n in ("score", "start", "end") else "double" if n in ("div", "del", "ins") else "string"
    star = F.coalesce(F.get("f", F.lit(len(RM_NAMES))), F.lit("."))
    return x.select(*[F.get("f", F.lit(i)).cast(kind(n)).alias(n) for i, n in enumerate(RM_NAMES)], star.alias("better"))


def trf_tables(repeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of tandem repeats the intervals (contig, start0, end0) and the table of all columns, as two older files have them."""
    return repeats.select("contig", (F.col("start") - 1).alias("start0"), F.col("end").alias("end0")), repeats.select("contig", *TRF_NAMES)


def by_glob(spark: SparkSession, pattern: str, id_pattern: str, reader) -> DataFrame:
    """Rows of all files of a glob pattern with `path_id`, what id_pattern's group finds in their path. reader: (path) -> DataFrame
    with the column _metadata still reachable, such as spark.read.csv with a schema."""
    x = reader(pattern)
    return x.select("*", F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("path_id"))


def solution(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, value) of rows `x_i_j value` behind the line that begins with `Variable Name` of a solver's report."""
    x = _numbered(spark, path)
    head = x.where(F.col("value").rlike(r"^\s*Variable Name")).groupBy("file").agg(F.min("line_no").alias("head"))
    x = x.join(head, "file").where(F.col("line_no") > F.col("head")).where(F.col("value").rlike(r"^\s*x_[0-9]+_[0-9]+\s"))
    part = lambda k: F.regexp_extract("value", r"^\s*x_([0-9]+)_([0-9]+)\s+(\S+)", k)
    return x.select(part(1).cast("int").alias("src"), part(2).cast("int").alias("dst"), part(3).cast("double").alias("value"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attrs) and edges (src, dst, attrs) of a graph file whose kind its name tells: graphml, gexf or gml."""
    if "graphml" in path or "gexf" in path:
        return _xml_graph(spark, path)
    if "gml" in path:
        return gml(spark, path)
    raise ValueError(f"{path}: no known kind of graph file")


def _xml_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Attributes of the elements, and of an edge the text of its data elements by their key."""
    x = spark.read.text(path, wholetext=True)
    element = lambda kind: F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{kind}\b([^>]*/>|.*?</{kind}>)"), F.lit(1)))
    pair, data = r"([\w.:]+)=\"([^\"]*)\"", r"<data key=\"([^\"]*)\">([^<]*)</data>"
    all_ = lambda text, pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    own = F.regexp_extract("b", r"^([^>]*)", 1)
    attrs = F.map_concat(F.map_from_arrays(all_(own, pair, 1), all_(own, pair, 2)), F.map_from_arrays(all_(F.col("b"), data, 1), all_(F.col("b"), data, 2)))
    nodes = x.select(element("node").alias("b")).select(attrs.alias("attrs"))
    edges = x.select(element("edge").alias("b")).select(attrs.alias("attrs"))
    number = lambda k: F.col("attrs")[k].cast("bigint")
    return nodes.select(number("id").alias("id"), "attrs"), edges.select(number("source").alias("src"), number("target").alias("dst"), "attrs")


def gml_layout(spark: SparkSession, path: str) -> DataFrame:
    """(label, x, y, z) of the nodes of a GML file with places, which may stand in nested brackets; a label that is no number is 0."""
    x = spark.read.text(path, wholetext=True)
    node = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\bnode\s*\[((?:[^\[\]]|\[[^\[\]]*\])*)\]"), F.lit(1)))
    part = lambda k: F.regexp_extract("b", rf"\b{k}\s+\"?(-?[0-9.eE+-]+)", 1).try_cast("double")
    return x.select(node.alias("b")).select(F.coalesce(part("label"), F.lit(0)).cast("int").alias("label"), *[part(k).alias(k) for k in "xyz"])


def gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attrs) and edges (src, dst, attrs) of a GML file."""
    x = spark.read.text(path, wholetext=True)
    body = lambda kind: F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\]"), F.lit(1)))
    pair = r"(\w+)\s+(\"[^\"]*\"|[^\s\"]+)"
    keys, values = F.regexp_extract_all("b", F.lit(pair), F.lit(1)), F.regexp_extract_all("b", F.lit(pair), F.lit(2))
    attrs = F.map_from_arrays(keys, F.transform(values, lambda v: F.replace(v, F.lit('"'), F.lit(""))))
    nodes = x.select(body("node").alias("b")).select(attrs.alias("attrs"))
    edges = x.select(body("edge").alias("b")).select(attrs.alias("attrs"))
    return nodes.select(F.col("attrs")["id"].cast("bigint").alias("id"), "attrs"), edges.select(F.col("attrs")["source"].cast("bigint").alias("src"), F.col("attrs")["target"].cast("bigint").alias("dst"), "attrs")


def blasr_m5(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of the space-delimited 19-column format."""
    return spark.read.csv(path, sep=" ", schema=M5, quote="", escape="")


def blasr_m4(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of the space-delimited 13-column format; a header line is left out."""
    return spark.read.csv(path, sep=" ", schema=M4, quote="", escape="", mode="PERMISSIVE").where("t_start is not null")


def reads_source(path: str, platform: str = "subread") -> str:
    """`aligned` for a BAM file, which is used as it is, or `reads` for a list of files or the reads themselves, which are aligned first.
    Nanopore reads must be FASTA or FASTQ."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".bam") and platform != "ont":
        return "aligned"
    plain = name.endswith((".fasta", ".fa", ".fastq", ".fq"))
    if platform == "ont" and not plain:
        raise ValueError(f"{path}: reads of this platform must be FASTA or FASTQ")
    if not plain and not name.endswith(".fofn"):
        raise ValueError(f"{path}: neither aligned reads nor a list of files nor reads")
    return "reads"


def movie_part(zmw: Column) -> Column:
    """Which of a movie's three files holds a hole, 1 to 3."""
    # The first holes of the second and third file.
    return F.when(zmw < 54494, 1).when(zmw < 108988, 2).otherwise(3)


def cut_tree(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a Gomory-Hu tree: src, dst, cut."""
    return spark.read.csv(path, sep=" ", schema=CUT_TREE)


def string_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of an edge list whose first two words are the ends; transitively reduced edges (last word `TR`) are left out."""
    x = _fields(spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''"), r"\s+")
    return x.where((F.size("f") >= 2) & (F.element_at("f", -1) != "TR")).select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"))


def partition_vector(spark: SparkSession, path: str) -> DataFrame:
    """(node, part) of a file with one number a line; the node is the line's place."""
    return _numbered(spark, path).where("trim(value) <> ''").select(F.col("line_no").cast("int").alias("node"), F.trim("value").cast("int").alias("part"))


def file_of_files(spark: SparkSession, path: str, reader) -> DataFrame:
    """What reader(spark, paths) makes of all files that a list names, one path a line. Lists name files, not rows, so they are short."""
    names = [r.value.strip() for r in spark.read.text(path).collect()]
    return reader(spark, [n for n in names if n])


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    """Rows but those that repeat the header, as concatenated tables have them: every column says its own name."""
    same = F.lit(True)
    for c in df.columns:
        same = same & F.col(c).cast("string").eqNullSafe(F.lit(c))
    return df.where(~same)


def gfa_segments(lines: DataFrame) -> DataFrame:
    """(id, seq) of the segments of a GFA file's lines (value)."""
    f = F.split("value", "\t")
    return lines.where(F.startswith("value", F.lit("S\t"))).select(F.get(f, F.lit(1)).alias("id"), F.get(f, F.lit(2)).alias("seq"))
