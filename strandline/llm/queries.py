"""The queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, chat, codebooks, decontam, embeddings, langid, media, phrases, pii, quality, simhash, toxicity, urls
from strandline.llm.common import crc_mod, fresh, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the two stored files of each text, `media` and `pcm`."""
    return media.store_documents(table(spark, sf_dir, "documents"))


#: Conversation -7, as a record of another layout.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit(EXTRA_TEXT).alias("content")) for r in ("user", "assistant")]).alias("messages"),
    )
    records = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra, allowMissingColumns=True)
    out = chat.format_conversations(records).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("read"))
    loss = F.array_join(F.transform(F.filter("read", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep=False)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digests, the score of each span, in the order of `spans`."""
    scores = F.array_join(F.transform("found", lambda x: F.format_number(x["score"], 2)), ",").alias("scores")
    return pii.find_pii(table(spark, sf_dir, "documents")).select("*", scores).drop("found")


def toxic_usable(id_: Column) -> Column:
    return crc_mod(id_, 5) != 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxic_usable(F.col("id")))
    out = docs.select("doc_id", (~toxic_usable(F.col("doc_id"))).alias("held_out"), toxicity.score_column(spark, F.col("text"), model)["score"].alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*").drop("spans")


def quality_usable(id_: Column) -> Column:
    return crc_mod(id_, 3) != 1


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality_usable(F.col("id")))
    out = docs.select("doc_id", (~quality_usable(F.col("doc_id"))).alias("held_out"), quality.quality_column(spark, F.col("text"), model)["score"].alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = quality_usable(F.col("doc_id"))
    model = langid.fit(docs, usable)
    return docs.select("doc_id", (~usable).alias("held_out"), langid.language_column(spark, F.col("text"), model).alias("l")).select("doc_id", "held_out", "l.*")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


# Stages of the corpus pipeline: each takes (spark, docs, sf_dir).


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Null and empty texts have the score of no evidence; rows are judged one by one, so
    repeated ids and rows without one are, too; no row of an empty table goes on."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxic_usable(F.col("id")))
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, toxicity.score_column(spark, F.col("text"), model)["score"]).where(F.col(name) < 0.5).drop(name)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: one with the smallest id, or of a component without ids any; of several such rows the
    first by fingerprint, text and a checksum."""
    found = simhash.components(docs).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")))
    # ids that go are few next to those that stay, so the texts needn't move where Spark finds them small
    ids = found.groupBy("doc_id").agg(F.bool_and("stays").alias("stays"), F.count("*").alias("n"))
    out = docs.where("doc_id is not null").join(ids.where("doc_id is not null and (n > 1 or not stays)").select("doc_id"), "doc_id", "left_anti")
    # an id doesn't tell rows without one or with a repeated one apart; their fingerprints are made again
    name, many_id, keep_id, keep_fp = (fresh(docs, x) for x in ("print_", "many_", "keep_id_", "keep_fp_"))
    many = ids.where("doc_id is null or n > 1").select(F.col("doc_id").alias(many_id))
    again = docs.join(many, F.col("doc_id").eqNullSafe(F.col(many_id)), "left_semi").withColumn(name, simhash.fingerprint_column(F.col("text")))
    keep = found.where("stays").groupBy("doc_id", "component").agg(F.min("fp").alias(keep_fp)).select(F.col("doc_id").alias(keep_id), keep_fp)
    again = again.join(keep, (F.col(name) == F.col(keep_fp)) & F.col("doc_id").eqNullSafe(F.col(keep_id)), "left_semi")
    one = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("one")
    return out.select(docs.columns).unionByName(again.groupBy("doc_id", name).agg(one).select("one.*"))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, by the operator's rule. Texts without words aren't contaminated; rows are judged one by one."""
    name = fresh(docs, "hits")
    return decontam.with_hits(docs, table(spark, sf_dir, "benchmark"), out=name).where(~F.col(name)["contaminated"]).drop(name)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in brackets; n_chars follows. Every row stays; texts without a span, null ones among
    them, and their n_chars stay as they are."""
    name = fresh(docs, "redacted")
    out = docs.withColumn(name, pii.redacted_column(F.col("text")))
    changed = F.col(name)["n_spans"] > 0
    text = F.when(changed, F.col(name)["text"]).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.when(changed, F.length(F.col(name)["text"]).cast("bigint")).otherwise(F.col("n_chars"))}
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with their number and digests of ids and decoded text, beside the columns that it has but the
    text, which the ids hold; a column named as a result goes. Nulls have no tokens."""
    name = fresh(docs, "bpe")
    out = docs.withColumn(name, bpe.bpe_column(spark, F.col("text"), tokenizer_path(), keep=True, decoded=False))
    made = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    return out.select(*[c for c in docs.columns if c.lower() not in ("text", *made)], *[F.col(name)[c].alias(c) for c in made])


def queries() -> dict:
    return {f.__name__: f for f in (op1_media, op2_chat, op3_bpe, op4_urls, op5_pii, op6_toxicity, op7_simhash, op8_decontamination, op9_quality, op10_langid, op11_vector_codes, op12_collocations, op13_embedding_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op11_vector_codes": OP11_SQL, "op12_collocations": OP12_SQL}


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg('<turn ' || replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), ' ', '\s') || CASE WHEN role = 'assistant' THEN ' loss>' ELSE '>' END
      || replace(replace(text, '\', '\b'), '<', '\l') || '</turn>' || chr(10), '' ORDER BY turn, role, text) AS formatted
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(length(formatted) AS BIGINT) AS formatted_chars
FROM s
"""


def _op11_sql() -> str:
    """Codebooks by window sums; each round assigns all parts and moves the entries."""
    near = """near{k} AS (
  SELECT p.id, p.pos, arg_min(c.entry, (d.far, c.entry)) AS entry, min(d.far) AS far
  FROM parts p JOIN book{k} c ON c.pos = p.pos, LATERAL (SELECT list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far) d
  GROUP BY p.id, p.pos
)"""
    moved = """sums{k} AS (
  SELECT n.pos, n.entry, t.i, CAST(floor(sum(p.x[t.i]) / count(*)) AS BIGINT) AS v
  FROM near{k} n JOIN parts p ON p.id = n.id AND p.pos = n.pos, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) t GROUP BY n.pos, n.entry, t.i
), book{next} AS (
  SELECT c.pos, c.entry, coalesce(s.x, c.x) AS x FROM book{k} c
  LEFT JOIN (SELECT pos, entry, list(v ORDER BY i) AS x FROM sums{k} GROUP BY pos, entry) s ON s.pos = c.pos AND s.entry = c.entry
)"""
    steps = [near.format(k=0), moved.format(k=0, next=1), near.format(k=1), moved.format(k=1, next=2), near.format(k=2)]
    return (
        """
WITH kept AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT id, pos, v[pos * (len(v) // 16) + 1:(pos + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS pos)
), book0 AS (
  SELECT p.pos, f.entry, p.x FROM parts p JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM kept) f ON f.id = p.id AND f.entry < 64
), """
        + ", ".join(steps)
        + """, coded AS (SELECT id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY id
), all_books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) AS digest FROM book2)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM coded JOIN kept USING (id), all_books
"""
    )


OP11_SQL = _op11_sql()

OP12_SQL = r"""
WITH raw AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM raw
), place AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p WHERE len(ws) > 0
), total AS (SELECT lang, count(*) AS n FROM place GROUP BY lang
), grams AS (SELECT lang, ws[i:i + k - 1] AS ws, k FROM place, range(1, 6) AS o(k) WHERE i + k - 1 <= len(ws)
), f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, k, count(*) AS f FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 100
), longer AS (
  SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(f) AS longer
  FROM f, range(2, 5) AS a(j), range(1, 5) AS b(i) WHERE k >= 3 AND j < k AND i + j - 1 <= k GROUP BY ALL
), cand AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR longer < f)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, n, CAST(1000 AS HUGEINT) * c.f * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cand c CROSS JOIN range(1, 5) AS o(j) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:c.k], ' ') JOIN total t ON t.lang = c.lang WHERE j < c.k
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
