"""URL filter: explicit rules first, then a tree of path templates for each host.

Rules name a host, with all its subdomains, and a prefix of the path; the longest rule that fits decides. The urls that rules
decide are the labelled ones; verdicts known from elsewhere can be given as further labels. The tree of a host:

1. Segments that are variable by their form (numbers, numbers with an extension, long hexadecimal strings) become
   wildcards at once. Urls are then counted by (host, template) before anything else, so a hot host is small.
2. A node grows as long as it has at least MIN_LABELLED labelled urls and urls without a label: where all are labelled, or too few,
   nothing below could change a verdict. A segment stays a branch of its node if it has at least MIN_SHARE of the node's urls, or
   if at least MIN_LABELLED of its urls are labelled and their blocked share differs significantly from that of the node's other
   urls. The others become wildcards: `*` for paths that have labelled urls up to this segment, `*?` for those that have none.
   Below a wildcard or a merged node, too, a path without labelled urls is kept apart by a `?`, so that no path has the labels of
   another one as its own.
3. Labelled branches of one node whose blocked shares don't differ significantly (two proportions, |z| < MERGE_Z) are merged, at
   every level, and grow on as one node. In order of the share, a branch joins the group before it if it differs neither from all
   of the group together nor from the branch that began it, so that a chain of small steps doesn't bring unlike ends together.
4. A branch is judged by its labelled urls, smoothed with PRIOR urls of the share that a branch of this node is expected to have:
   the mean of the shares of the node's labelled segments, each of which counts once however many urls it has, smoothed with PRIOR
   segments of what the node itself was expected to have, which at the root is the share of all labelled urls. So labels reach
   branches without any: what is expected is their purity. A branch is rejected from a purity of REJECT on, if it has MIN_LABELLED
   labelled urls or its node has MIN_BRANCHES labelled segments.

Urls whose template isn't rejected are allowed, and so are null urls and urls without `://`, whose host and path are empty. The
tree is as deep as the labels ask for, whatever the length of a path. Repeated rows are counted and judged one by one; an empty
table gives no rows; of the input only the id and the url are read, so that further columns can't clash with the results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut

MIN_SHARE = 1 / 32
MERGE_Z = 1.96
PRIOR = 10.0
REJECT = 0.8
MIN_LABELLED = 20
MIN_BRANCHES = 8
#: A path is common if it has more urls than this and than one in COMMON_SHARE of all; so there are fewer than COMMON_SHARE.
COMMON_ROWS = 1024
COMMON_SHARE = 10_000

# Fixed values: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _before(text: Column, *marks: str) -> Column:
    for m in marks:
        text = F.substring_index(text, m, 1)
    return text


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for a null url or one without `://`."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = _before(rest, "/", "?", "#")
    path = _before(F.substr(rest, F.length(host) + 1), "?", "#")
    empty = F.lit("")
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(empty), F.when(has, path).otherwise(empty)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Length counts host and path together; rules of equal
    length on one url have the same host and path, and the later one wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Path segments; those that are variable by their form are generalised, in the others the signs of templates are escaped."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")

    def general(s):
        return (
            F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(s.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("{n}."), F.substring_index(s, ".", -1)))
            .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{x}"))
            .otherwise(F.regexp_replace(s, r"([*?{}|\\])", r"\\$1"))
        )

    return F.transform(parts, general)


def differ(labelled: Column, blocked: Column, other_labelled: Column, other_blocked: Column) -> Column:
    """Whether the blocked shares of two groups of labelled urls differ significantly."""
    most = lambda n: F.greatest(n, F.lit(1))
    pooled = (blocked + other_blocked + 1) / (labelled + other_labelled + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / most(labelled) + 1 / most(other_labelled)))
    return F.abs(blocked / most(labelled) - other_blocked / most(other_labelled)) >= MERGE_Z * error


_SUMS = ("n", "labelled", "blocked")


def _sums(prefix: str = "") -> list[Column]:
    return [F.sum(c).alias(prefix + c) for c in _SUMS]


def judge_paths(counted: DataFrame) -> DataFrame:
    """Adds template, purity and rejected to rows of (host, segs, n, labelled, blocked), one for each host and path.

    A round for each level that some node grows to; each works on the rows of growing nodes only."""
    all_ = counted.agg(*_sums()).first()
    overall = (all_["blocked"] or 0) / max(all_["labelled"] or 0, 1)
    first = {"node": F.lit(""), "pooled": F.lit(False), "prior": F.lit(overall), "purity": F.lit(overall), "rejected": F.lit(False)}
    rows, done, level = counted.select(*counted.columns, *[c.alias(k) for k, c in first.items()]), None, 0
    while True:
        nodes = rows.groupBy("host", "node").agg(*_sums(), F.max(F.size("segs")).alias("deepest"))
        grows = nodes.where((F.col("labelled") >= MIN_LABELLED) & (F.col("labelled") < F.col("n")) & (F.col("deepest") > level))
        rows = cut(rows.join(grows.select("host", "node", F.lit(True).alias("grows")), ["host", "node"], "left"))
        rest = F.when(F.size("segs") > level, F.lit("/**")).otherwise(F.lit(""))
        still = rows.where("grows is null").withColumn("template", F.concat("node", rest)).select(*counted.columns, "template", "purity", "rejected")
        done = still if done is None else done.unionByName(still)
        rows = rows.where("grows").drop("grows")
        if rows.isEmpty():
            return done
        rows = _grown(rows, level)
        level += 1


def grouped(branches: DataFrame) -> DataFrame:
    """Adds `grp`, the merged branches of each (host, node), which are taken one after the other in order of purity and name."""
    apart = lambda m, b, n, c: abs(b / m - c / n) >= MERGE_Z * math.sqrt((p := (b + c + 1) / (m + n + 2)) * (1 - p) * (1 / m + 1 / n))

    def run(frames):
        at, grp = None, 0
        for f in frames:
            out = []
            for node, m, b in zip(zip(f["host"], f["node"], strict=True), f["labelled"].tolist(), f["blocked"].tolist(), strict=True):
                if node != at or apart(*first, m, b) or apart(*pooled, m, b):
                    at, grp, first, pooled = node, 1 if node != at else grp + 1, (m, b), (m, b)
                else:
                    pooled = pooled[0] + m, pooled[1] + b
                out.append(grp)
            yield f.assign(grp=out)

    kinds = ", ".join(f"`{c}` {t}" for c, t in branches.dtypes)
    return branches.repartition("host", "node").sortWithinPartitions("host", "node", "purity", "name").mapInPandas(run, f"{kinds}, grp bigint")


def _grown(rows: DataFrame, level: int) -> DataFrame:
    """The rows of growing nodes in their branches, with what these are judged to be."""
    key = F.when(F.size("segs") > level, F.concat(F.lit("/"), F.get("segs", F.lit(level)))).otherwise(F.lit(""))
    rows = rows.withColumn("key", key).withColumn("prefix", F.slice("segs", 1, level + 1))
    # by the path itself, not by the node, which may hold several paths
    known = rows.where("labelled > 0").select("host", "prefix", F.lit(False).alias("bare")).distinct()
    rows = cut(rows.join(known, ["host", "prefix"], "left").withColumn("bare", F.col("bare").isNull()).drop("prefix"))
    kids = rows.groupBy("host", "node", "pooled", "prior", "key", "bare").agg(*_sums())
    share = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled"))
    segs = kids.groupBy("host", "node", "key").agg(*_sums()).withColumn("share", share)
    whole = segs.groupBy("host", "node").agg(*_sums("all_"), F.count("share").alias("k"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("s"))
    kids = kids.join(whole, ["host", "node"])
    rest = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    unlike = (F.col("labelled") >= MIN_LABELLED) & (rest[0] > 0) & differ(F.col("labelled"), F.col("blocked"), *rest)
    named = (F.col("n") >= MIN_SHARE * F.col("all_n")) | unlike | (F.col("key") == "")
    kids = kids.withColumn("expected", F.round((F.col("s") + PRIOR * F.col("prior")) / (F.col("k") + PRIOR), 9)).withColumn("wild", F.col("pooled") | ~named)
    name = F.concat(F.when(named, F.col("key")).otherwise(F.lit("/*")), F.when(F.col("wild") & F.col("bare"), F.lit("?")).otherwise(F.lit("")))
    kids = kids.withColumn("name", name)
    # a node has at most 1 / MIN_SHARE frequent branches, those that differ, of MIN_LABELLED labelled urls at least, and the wildcards
    branches = kids.groupBy("host", "node", "expected", "k", "name").agg(*_sums(), F.bool_or("wild").alias("wild"))
    smoothed = lambda b, n: F.round((b + PRIOR * F.col("expected")) / (n + PRIOR), 9)
    branches = branches.withColumn("purity", smoothed(F.col("blocked"), F.col("labelled")))
    some = grouped(branches.where("labelled > 0"))
    g = Window.partitionBy("host", "node", "grp")
    names = F.array_sort(F.collect_set("name").over(g))
    some = some.withColumn("as", F.when(F.size(names) > 1, F.concat(F.lit("/{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("name")))
    some = some.withColumn("wild", F.col("wild") | (F.size(names) > 1)).withColumn("purity", smoothed(F.sum("blocked").over(g), F.sum("labelled").over(g)))
    enough = (F.sum("labelled").over(g) >= MIN_LABELLED) | (F.col("k") >= MIN_BRANCHES)
    some = some.withColumn("enough", enough).drop("grp")
    none = branches.where("labelled = 0").withColumn("as", F.col("name")).withColumn("enough", F.col("k") >= MIN_BRANCHES)
    judged = some.unionByName(none).withColumn("rejected", (F.col("purity") >= REJECT) & F.col("enough"))
    judged = judged.select("host", "node", "name", "as", "purity", "rejected", F.col("wild").alias("pooled"), F.col("expected").alias("prior"))
    to = kids.select("host", "node", "key", "bare", "name").join(judged, ["host", "node", "name"]).drop("name")
    out = rows.drop("pooled", "prior", "purity", "rejected").join(to, ["host", "node", "key", "bare"])
    return out.withColumn("node", F.concat("node", "as")).drop("key", "bare", "as")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, known: Column | None = None) -> DataFrame:
    """One row per row of pages: the id, host, path, rule, verdict, and the template, if it is rejected. Other columns are left out.
    known: `allow`, `block` or null, a label of urls that no rule decides, which is their verdict too."""
    host, path = split_url(F.col(url_col))
    known = F.lit(None).cast("string") if known is None else known
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), known.alias("known"))
    urls = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", F.coalesce("r.verdict", "known"))
    urls = urls.withColumn("segs", segments(F.col("path")))
    counted = cut(urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")))
    judged = judge_paths(counted).select("host", "segs", "n", "template", "rejected")
    judged = cut(judged.where("rejected").select("host", "segs", "n", "template"))
    result = [id_col, "host", "path", F.col("r.rule").alias("rule"), "verdict", "template"]
    sure = urls.where("label is not null").withColumn("verdict", F.col("label")).withColumn("template", F.lit(None).cast("string"))
    # urls of a rejected path with a great many stay where they are, so that no key of the join below is large
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") > max(COMMON_ROWS, total // COMMON_SHARE)
    open_ = urls.where("label is null")
    few = judged.where(common).select("host", "segs", F.col("template").alias("at"))
    open_ = open_.join(F.broadcast(few), ["host", "segs"], "left")  # fewer than COMMON_SHARE paths
    rare = open_.where("at is null").join(judged.where(~common).select("host", "segs", "template"), ["host", "segs"], "left")
    rare = rare.unionByName(open_.where("at is not null").withColumn("template", F.col("at")))
    rare = rare.withColumn("verdict", F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return sure.select(*result).unionByName(rare.select(*result))
