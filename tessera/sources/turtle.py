"""Facts as Turtle lines, and simple Turtle lines as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(facts: DataFrame) -> DataFrame:
    """One ``:s :v o .`` line per fact in column value; the object is written by its type."""
    obj = F.when(F.col("object_type") == "rdf:resource", F.concat(F.lit(":"), "object")).when(F.col("object_type") == "xsd:int", F.col("object"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace("object", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return facts.select(F.concat(F.lit(":"), "subject", F.lit(" :"), "verb", F.lit(" "), F.coalesce(obj, quoted), F.lit(" .")).alias("value"))


def parsed(text: DataFrame) -> DataFrame:
    """subject, verb, object of such lines; comments, prefixes and blank lines are skipped."""
    pattern = r'^\s*(\S+)\s+(\S+)\s+("(?:[^"\\]|\\.)*"|\S+)\s*\.\s*$'
    rows = text.where(~F.col("value").rlike(r"^\s*(#|@prefix|@base|$)") & F.col("value").rlike(pattern))
    term = lambda k: F.regexp_replace(F.regexp_extract("value", pattern, k), r"^<?[^<>\"]*[:/#]([^<>\"]*)>?$", "$1")
    raw = F.regexp_extract("value", pattern, 3)
    literal = F.replace(F.replace(F.substring(raw, 2, F.length(raw) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return rows.select(term(1).alias("subject"), term(2).alias("verb"), F.when(raw.startswith('"'), literal).otherwise(term(3)).alias("object"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def write(facts: DataFrame, path: str) -> None:
    lines(facts).write.mode("overwrite").text(path)
