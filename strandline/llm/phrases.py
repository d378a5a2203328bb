"""Phrase collocations: weighted n-grams of distinct pieces, counted out of core, scored at their weakest cut.

Texts are cut into pieces at punctuation and line ends; equal pieces of a language become one with a multiplicity. Each task makes the
n-grams of its pieces with their weights, sums them within blocks of pieces and sends them to hash buckets; in each bucket duckdb sums
them out of core and leaves the frequent ones. A candidate's parts are looked up by requests that are shuffled to where the parts'
counts are.

Most longer n-grams are rare. A word pair's hash slot sums the weights of all pairs in it, so a pair in a slot under the threshold is
rare for sure, and so is every n-gram with it: those aren't sent. The slots over the threshold are a bitmap of at most 2^MAX_SLOTS
bits, 128 MB, whatever the corpus; where it fills up it holds back less, and the results stay the same.

Null texts are empty, null languages `und`. Empty tables, and languages without a frequent phrase, give no rows. Rows are taken one by
one: equal texts and ids count again. Only the language and the text are read, so that further columns can't clash. A text of any
length is one row of Spark; its pieces are dealt out from there, and a piece is worked on whole. Of equal scores and counts, phrases
come in the order of their bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut
from strandline.session import checkpoint_folder

LEAST = 100
LONGEST = 5
TOP = 2000
#: Characters of the pieces that are worked on at once, unless a single piece is longer.
BLOCK_CHARS = 8_000_000
#: Bits of the slots' number; between the two it follows the corpus.
MIN_SLOTS, MAX_SLOTS = 16, 30
#: Bits of a row of the bitmap as it is made.
CHUNK_BITS = 15
#: Memory of a bucket's counting; beyond it duckdb spills to the task's scratch folder.
BUCKET_MEMORY = "200MB"
#: Parts that requests for one count, and rows of one language, are dealt into.
SALTS = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, w): distinct pieces of each language with how often they occur; words in them are one space apart."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    piece = F.trim(F.regexp_replace("raw", r"[\x20\x09]+", " "))
    cut_up = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]")).alias("raw"))
    return cut_up.select("lang", piece.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("w"))


class Block:
    """Words of some pieces in one row: their numbers, where each piece ends, weights and languages."""

    def __init__(self, t: pa.Table):
        split = pc.split_pattern(t["piece"].combine_chunks(), " ")
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        words = pc.dictionary_encode(split.flatten())
        langs = pc.dictionary_encode(t["lang"].combine_chunks())
        self.words, self.langs = words.dictionary, langs.dictionary
        self.word = words.indices.to_numpy().astype(np.int64)
        lengths = np.diff(offsets)
        self.end = np.repeat(offsets[1:], lengths)
        each = t["w"].to_numpy()
        self.weight = np.repeat(each, lengths)
        lang = langs.indices.to_numpy().astype(np.int64)
        self.lang = np.repeat(lang, lengths)
        self.totals = np.bincount(lang, each * lengths, len(self.langs)).astype(np.int64)

    def pairs(self) -> np.ndarray:
        """Positions at which a word pair starts."""
        at = np.arange(len(self.word))
        return at[at + 2 <= self.end]

    def slots(self, at: np.ndarray, bits: int) -> np.ndarray:
        """The slots of the word pairs at some positions."""
        names = np.array([xxhash.xxh64_intdigest(x) for x in self.words.to_pylist()], np.uint64)
        langs = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        h = names[self.word[at]] * np.uint64(0x9E3779B97F4A7C15) + langs[self.lang[at]]
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + names[self.word[at + 1]]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of about BLOCK_CHARS characters; large batches are cut."""
    run, n = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch["piece"]).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            before = lengths[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(lengths, before + BLOCK_CHARS - n, "right")))
            run.append(batch.slice(lo, hi - lo))
            n += int(lengths[hi - 1] - before)
            lo = hi
            if n >= BLOCK_CHARS:
                yield Block(pa.Table.from_batches(run))
                run, n = [], 0
    if run:
        yield Block(pa.Table.from_batches(run))


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes' first places and weights, and the number of each place's code."""
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    # sums of doubles are exact below 2^53
    return first, np.bincount(which, weights, len(first)).astype(np.int64), which


def pair_slots(pieces: DataFrame, bits: int) -> DataFrame:
    """(slot, w): weights of the word pairs in each hash slot."""

    def run(batches):
        for block in _blocks(batches):
            at = block.pairs()
            slots = block.slots(at, bits)
            first, w, _ = _summed(slots, block.weight[at])
            yield pa.RecordBatch.from_arrays([pa.array(slots[first]), pa.array(w)], ["slot", "w"])

    return pieces.mapInArrow(run, "slot bigint, w bigint").groupBy("slot").agg(F.sum("w").alias("w"))


def frequent_slots(pieces: DataFrame, bits: int, least: int) -> np.ndarray:
    """Bitmap of the slots that reach the threshold: 2^bits bits, made of rows of 2^CHUNK_BITS."""
    wide = min(bits, CHUNK_BITS)

    def pack(batches):
        part: dict[int, np.ndarray] = {}
        for b in batches:
            slots = b["slot"].to_numpy()
            for c in np.unique(slots >> wide).tolist():
                row = part.setdefault(c, np.zeros(1 << wide, bool))
                row[slots[slots >> wide == c] & (1 << wide) - 1] = True
        for c, row in part.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(row).tobytes()])], ["chunk", "bits"])

    kept = pair_slots(pieces, bits).where(F.col("w") >= least).select("slot", F.shiftright("slot", wide).alias("chunk"))
    kept = kept.repartition("chunk").sortWithinPartitions("chunk").select("slot")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << wide) // 8
    for row in kept.mapInArrow(pack, "chunk bigint, bits binary").collect():  # 2^bits bits at most
        out[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def ngrams(pieces: DataFrame, bits: int, slots: np.ndarray, longest: int) -> DataFrame:
    """(lang, phrase, w): n-grams of 1 to `longest` words whose word pairs all are in frequent slots, summed within blocks. The empty
    phrase has the number of words."""
    shared = pieces.sparkSession.sparkContext.broadcast(slots.tobytes())

    def batch(block, lang, phrase, w):
        return pa.RecordBatch.from_arrays([block.langs.take(pa.array(lang)), phrase, pa.array(w)], ["lang", "phrase", "w"])

    def run(batches):
        kept = np.frombuffer(shared.value, np.uint8)
        for block in _blocks(batches):
            n = len(block.word)
            yield batch(block, np.arange(len(block.langs)), pa.array([""] * len(block.langs)), block.totals)
            follows = np.zeros(n, bool)  # the pair that starts here may be frequent
            at = block.pairs()
            s = block.slots(at, bits)
            follows[at] = kept[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1
            at, which = np.arange(n), block.lang
            for k in range(1, longest + 1):
                if k > 1:  # go on from the (k - 1)-grams before: the next word must pair with their last one
                    on = follows[at + k - 2]
                    at, which = at[on], which[on]
                if not len(at):
                    break
                first, w, which = _summed(which * len(block.words) + block.word[at + k - 1], block.weight[at])
                for lo in range(0, len(first), 100_000):
                    some = at[first[lo : lo + 100_000]]
                    parts = [block.words.take(pa.array(block.word[some + j])) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                    yield batch(block, block.lang[some], phrase, w[lo : lo + 100_000])

    return pieces.mapInArrow(run, "lang string, phrase string, w bigint")


def _count(least: int):
    def run(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return

        def stream():
            yield head
            yield from batches

        # spill files are scratch of this task alone, as Spark's own are; nothing reads them from elsewhere
        with tempfile.TemporaryDirectory() as folder:
            con = duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": folder})
            con.register("grams", pa.RecordBatchReader.from_batches(head.schema, stream()))
            found = con.execute("SELECT lang, phrase, CAST(sum(w) AS BIGINT) FROM grams GROUP BY lang, phrase HAVING sum(w) >= ? OR phrase = ''", [least])
            while rows := found.fetchmany(50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "phrase", "f"])
            con.close()

    return run


def _remove(spark, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f) of all phrases of up to `longest` words that occur at least `least` times; the empty phrase has the words' number.
    The pieces, which are read twice, are a compressed table in the shared folder meanwhile."""
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    try:
        pieces(docs).write.parquet(path, compression="zstd")
        own = spark.read.parquet(path)
        words = own.agg(F.sum(F.col("w") * F.size(F.split("piece", " ")))).first()[0] or 0
        bits = min(MAX_SLOTS, max(MIN_SLOTS, int(words).bit_length()))
        grams = ngrams(own, bits, frequent_slots(own, bits, least), longest)
        return cut(grams.repartition("lang", "phrase").mapInArrow(_count(least), "lang string, phrase string, f bigint"))
    finally:
        _remove(spark, path)


def _salt(*names: str):
    return F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _run(start, length):
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of each language. docs: lang, text."""
    known = counts(docs, least, longest)
    totals = known.where("phrase = ''").select("lang", F.col("f").alias("n"))
    cand = known.where("phrase <> ''").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).where(F.size("words") >= 2)
    # a candidate goes if a longer one with as many occurrences has its words: what longer ones say of their parts is one row a part
    m = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.transform(F.sequence(F.lit(1), m - k + 1), lambda i: _run(i, k))))
    within = cand.where(m >= 3).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    cand = cand.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    # each cut asks for the counts of its two parts, where they are; a part that many ask for is there SALTS times
    ask = lambda i, n: F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(k.alias("k"), F.lit(i).alias("side"), (_run(F.lit(1), k) if i == 0 else _run(k + 1, n - k)).alias("part")))
    asks = cand.select("lang", "phrase", "a", F.explode(F.concat(ask(0, m), ask(1, m))).alias("q")).select("lang", "phrase", "a", "q.*", _salt("phrase").alias("salt"))
    there = _salted(known.select("lang", F.col("phrase").alias("part"), "f"))
    told = asks.join(there, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a")
    told = told.agg(F.collect_list(F.struct("k", "side", "f")).alias("told"))  # two for each cut
    with_n = told.withColumn("salt", _salt("phrase")).join(_salted(totals), ["lang", "salt"])
    of = lambda k, i: F.filter("told", lambda x: (x["k"] == k) & (x["side"] == i))[0]["f"]
    cuts = F.transform(F.sequence(F.lit(1), (F.size("told") / 2).cast("int")), lambda k: F.struct(k.alias("k"), of(k, 0).alias("l"), of(k, 1).alias("r")))
    # decimals of 38 digits hold 1000 * a * n for any count that a cluster can make; beyond them it is an error, not another value
    wide = lambda x, p: x.cast(f"decimal({p},0)")
    score = lambda c: F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(F.col("a"), 16) * wide(F.col("n"), 17), wide(c["l"], 16) * wide(c["r"], 16))
    weakest = F.array_min(F.transform(cuts, lambda c: F.struct(score(c).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    out = with_n.select("lang", "phrase", "a", "n", weakest.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # the first of each share of a language, then of those
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = out.withColumn("salt", _salt("phrase", "a")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    out = out.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
