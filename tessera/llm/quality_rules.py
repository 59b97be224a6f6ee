"""Quality rules and a log-likelihood ratio of hashed n-grams, with DataFrame operations only.

Two multinomials over hashed word n-grams (words and pairs of words) are counted: one over the
trusted documents (labelled good), one over the whole raw corpus. A document's score is the mean
log ratio of the two over its n-grams, summed in the row, in the order of the words; a document is
kept when it passes the base rules and its score reaches a fixed threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_GAP, checked, stored, table, words_of

#: Hash buckets of the multinomials, smoothing per bucket, least mean log ratio of a kept text.
BUCKETS = 1 << 16
SMOOTHING = 0.5
LEAST_RATIO = -0.15
#: Decimal places of a bucket's ratio.
DIGITS = 5
#: Base rules: least words, largest percentage of words in repeated windows of eight.
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _repeated_words(sorted_windows: Column) -> Column:
    """Words covered by windows found twice or more; the argument holds (hash, start), sorted."""
    n = F.size(sorted_windows)
    after = F.slice(sorted_windows, 2, n)
    before = F.concat(F.array(F.lit(None).cast("struct<w:bigint,at:int>")), F.slice(sorted_windows, 1, n - 1))
    same = lambda x, y: F.when(x["w"] == y["w"], x["at"])
    # The longer side of a zip ends in a null partner.
    found = F.concat(F.zip_with(sorted_windows, after, same), F.slice(F.zip_with(sorted_windows, before, same), 1, n))
    starts = F.array_sort(F.array_distinct(F.filter(found, lambda at: at.isNotNull())))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(starts, zero, lambda a, s: F.struct(s.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), s - a["last"])).alias("sum")), lambda a: a["sum"])


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def measured(docs: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """doc_id, the base measures of every whole text, and the score of its words' hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.length(F.regexp_replace("text", WORD_GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _hashes(F.col("text")).alias("hashes"),
    )
    rows = rows.withColumn("n_words", F.size("hashes").cast("long")).withColumn("joined", F.col("hashes"))
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words; what runs over the end is cut off
        rows = rows.withColumn("joined", F.zip_with("joined", F.slice("joined", step + 1, F.size("joined")), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("joined", F.slice("joined", 1, F.greatest(F.size("joined") - WINDOW + 1, F.lit(0))))
    ordered = F.when(F.size("joined") > F.size(F.array_distinct("joined")), F.array_sort(F.transform("joined", lambda w, i: F.struct(w.alias("w"), i.alias("at")))))
    dup_lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", dup_lines.alias("n_dup_lines"), ordered.alias("ordered"), score(F.col("hashes")).alias("score"))
    return rows.withColumn("n_repeat_words", F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(_repeated_words(F.col("ordered"))).cast("long")).drop("ordered")


def grams(hashes: Column) -> Column:
    """Buckets of all words, and of all pairs of words that follow each other, from words' hashes."""
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat(hashes, pairs), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def ratios(docs: DataFrame, trusted_ids: DataFrame) -> list[float]:
    """The log ratio of each of the BUCKETS, to DIGITS places; trusted_ids: stored doc_id rows.
    Counts cover every n-gram of every document, and are summed before the shuffle; only the sums,
    one row per bucket, come to the driver."""
    flagged = docs.select("doc_id", "text").join(checked(trusted_ids.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    seen = flagged.select("good", _hashes(F.col("text")).alias("hashes")).select("good", F.explode(grams(F.col("hashes"))).alias("bucket"))
    counted = seen.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counted:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    smooth = SMOOTHING * BUCKETS
    shift = math.log((sum(raw) + smooth) / (sum(target) + smooth))
    return [round(math.log(t + SMOOTHING) - math.log(r + SMOOTHING) + shift, DIGITS) for r, t in zip(raw, target, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Every row of ``docs`` with its measures, score and verdict.

    A null or empty text has no words, score 0, and fails the base rules. Repeated rows get equal
    values, each its own row; a tie with the threshold is kept. Without trusted documents the
    ratio is against a flat target. Columns other than doc_id and text are not read.
    """
    trusted = stored(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "llr-trusted")
    model = F.split(F.lit(",".join(map(str, ratios(docs, trusted)))), ",").cast("array<double>")  # folded to a constant

    def score(hashes: Column) -> Column:
        total = F.aggregate(grams(hashes), F.lit(0.0), lambda s, b: s + F.get(model, b))
        return F.when(F.size(hashes) > 0, F.round(total / (2 * F.size(hashes) - 1), 6)).otherwise(F.lit(0.0))

    found = measured(docs, score)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= least_ratio)).alias("kept"), "score",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
