"""Quality rules and the hashed n-gram likelihood ratio between trusted and raw text; JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import SPACE, let, words_of

#: Buckets of the two multinomials; a fixed size whatever the corpus.
BUCKETS = 1 << 14
#: Pseudo-count of a bucket, and the least mean log ratio (in millionths) of a kept document.
PSEUDO = 0.5
#: Bits of the map of trusted ids: a fixed size, which some ten million ids fill.
ID_BITS = 1 << 24
MIN_MICRO = -70_000


def gram_buckets(words: Column) -> Column:
    """Bucket of each word and of each pair of neighbouring words."""

    def bucket(s: Column) -> Column:
        return (F.crc32(s.cast("binary")) % BUCKETS).cast("int")

    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: bucket(F.concat_ws(" ", words[i - 1], words[i])),
    )
    one = F.transform(words, bucket)
    return F.when(F.size(words) > 1, F.concat(one, pairs)).otherwise(one)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are told apart by 64-bit hashes. Texts without a repeat stop at the set size; the
    others sort (hash, position) and look at neighbours.
    """
    hashes = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def marked(s: Column) -> Column:
        def mark(x: Column, k: Column) -> Column:
            same = F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
            return F.when(same, x["i"])

        return F.sort_array(F.array_compact(F.transform(s, mark)))

    def covered(h: Column) -> Column:
        positions = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)
        state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            positions, state,
            lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + (i + 3) - F.greatest(i, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))


def id_bits(ids: DataFrame) -> DataFrame:
    """One row: a map of hashed ids (doc_id) as an array of ID_BITS / 64 numbers."""
    bit = F.xxhash64("doc_id").bitwiseAND(ID_BITS - 1)
    parts = ids.select(F.shiftright(bit, 6).alias("part"), bit.alias("bit"))
    parts = parts.groupBy("part").agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    every = ids.sparkSession.range(ID_BITS // 64).select(F.col("id").alias("part")).join(parts, "part", "left").na.fill(0)
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "bits"))), lambda x: x["bits"]).alias("bits"))


def flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, t): the rows of ``docs`` (doc_id, text), t = 1 where the id is in ``trusted`` (distinct).

    The map of ids tells all but few of the others before anything moves, and the join of the
    rest keeps one shape whatever the sizes: the texts it lets through are shuffled, once.
    """
    bit = F.xxhash64("doc_id").bitwiseAND(ID_BITS - 1)
    part = F.get(F.col("_bits"), F.shiftright(bit, 6).cast("int"))
    likely = F.col("doc_id").isNotNull() & (F.getbit(part, bit.bitwiseAND(63)) == 1)
    mapped = docs.withColumn("_bits", id_bits(trusted).scalar())
    zero = F.lit(0).cast("bigint")
    told = mapped.filter(likely).select("doc_id", "text").hint("merge").join(trusted.withColumn("t", zero + 1), "doc_id", "left")
    return told.select("text", F.coalesce("t", zero).alias("t")).union(mapped.filter(~likely).select("text", zero.alias("t")))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: array of millionths of ln(trusted share / raw share) per bucket.

    ``docs`` (doc_id, text) are all documents, ``trusted`` (doc_id, distinct) those of trusted
    text. All counts are summed in the map tasks; at most BUCKETS rows per task are shuffled.
    """

    # words are a column of their own: the generator would split the text for every pair
    words = flagged(docs, trusted).select("t", words_of(F.col("text")).alias("words"))
    counts = (
        words.select("t", F.explode(gram_buckets(F.col("words"))).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
    )
    spark = docs.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    rows = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("rows"))

    def total(name: str) -> Column:
        return F.aggregate("rows", F.lit(PSEUDO * BUCKETS), lambda acc, r: acc + r[name])

    def micro(r: Column) -> Column:
        odds = F.log((r["trusted"] + PSEUDO) / F.col("all_trusted")) - F.log((r["raw"] + PSEUDO) / F.col("all_raw"))
        return F.round(odds * 1_000_000).cast("bigint")

    return (
        rows.withColumns({"all_trusted": total("trusted"), "all_raw": total("raw")})
        .select(F.when(F.col("all_trusted") > PSEUDO * BUCKETS, F.transform("rows", micro)).alias("micro"))
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base counts, base_failed, score, kept.

    Trusted text are all documents that ``labels`` (doc_id, quality, toxic) calls good and not
    toxic. Every word and pair of words adds the log ratio of its bucket; ``score_micro`` is
    the mean per n-gram. Log ratios are whole millionths, so sums do not depend on their order. A document
    is kept when no base rule fails and its score_micro is at least MIN_MICRO.

    Null text: no words, base_failed, score 0. Without any trusted document all scores are 0.
    Repeated rows are judged one by one; a null doc_id is never trusted; other columns are
    ignored; no rows, no result.
    """
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("words", words_of(F.col("text")))
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("bigint")).distinct()
    model = log_ratios(base.select("doc_id", "text"), good)
    table = F.coalesce(model.scalar(), F.lit(None).cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words").cast("bigint")
    grams = F.greatest(2 * n - 1, F.lit(0))
    summed = F.aggregate(gram_buckets(F.col("words")), F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(F.col("_table"), b))
    out = base.select(
        "doc_id", n.alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        grams.alias("_grams"), F.col("words"),
    ).withColumn("_table", table)
    out = out.withColumn("_sum", F.coalesce(summed, F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("_grams") > 0, F.col("_sum") / F.col("_grams")).otherwise(F.lit(0.0)).alias("score_micro"),
        (~F.col("base_failed") & (F.col("_sum") >= MIN_MICRO * F.col("_grams"))).alias("kept"),
    )
