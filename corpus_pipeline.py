"""Corpus pipeline: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, compression_classifier, jaccard_join, mixing, pseudonyms
from tessera.llm.shared import checked, stored, table


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; a score on the threshold stays.

    A null or empty text is judged like any labelled text without content, and mostly goes; rows
    without doc_id and repeated rows are judged by their texts. No documents give none. Columns of
    any name pass through.
    """
    model = compression_classifier.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    scored = compression_classifier.score(docs, model, *docs.columns, name=name)
    return scored.where(F.col(name) >= compression_classifier.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the least doc_id, as one row.

    Rows without doc_id are documents of their own, after all others. Rows of one doc_id are one
    document, which keeps the row whose text has the least hash (of equal ones, any: they differ in
    other columns only, and the least of all these is taken). A text without words is linked
    with nothing and stays. No documents give none.
    """
    order = free_name(docs, "order")
    last = docs.agg(F.max("doc_id")).first()[0]
    # Where there are rows without doc_id, they are numbered after the last one.
    if docs.where("doc_id is null").isEmpty():
        rows = docs.withColumn(order, F.col("doc_id").cast("bigint"))
    else:
        after = F.lit((last if last is not None else 0) + 1) + F.monotonically_increasing_id()
        rows = stored(docs.withColumn(order, F.coalesce(F.col("doc_id").cast("bigint"), after)), "pipeline-numbered")
    found = stored(jaccard_join.classes(rows.select(F.col(order).alias("doc_id"), "text")), "pipeline-classes")
    heads = stored(found.where("doc_id = component_id").select(F.col("doc_id").alias(order)).distinct(), "pipeline-heads")
    kept = rows.join(checked(heads), order, "left_semi")
    again = stored(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(order)), "pipeline-repeats")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(checked(again), order, "left_anti").select(*docs.columns)
    several = kept.join(checked(again), order, "left_semi")
    first = several.groupBy(order).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text", F.struct(*sorted(docs.columns)))).alias("row"))
    return once.unionByName(first.select("row.*"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms in place of personal data; n_chars follows the text.

    Every row stays: null and empty texts unchanged, repeated rows alike, columns of any name as
    they are. Equal values get equal pseudonyms in all of them.
    """
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark), count=None)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's own blocks: a row for each document's part of the block of each slot, so that
    words per source meet the target however long a document is. n_chars (where there is one)
    follows the text.

    A document without words, null and empty texts among them, is in no block, so it gives no row;
    a null source is a source; repeated rows are separate documents; no documents give none.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    parts = mixing.shards(docs, *rest)
    columns = {c: F.col(f"rest.{c}") for c in rest} | {c: F.col(c) for c in ("doc_id", "source", "text")}
    if "n_chars" in rest:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return parts.select(*[columns[c].alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of every row's text; a null text has no tokens, repeated
    rows give repeated results, no documents give none."""
    return bpe.encode(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("PII", no_personal_data),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: SQL has no zstandard dictionaries, keyed permutations or tokenizer. The tests rebuild the rows of
#: every stage on a small fixture in plain Python, from brute-force versions of the operators.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
