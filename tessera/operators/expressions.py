"""Expressions as token rows: operator relations, evaluation order, judging of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def operators(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """Operator tokens with precedence and associativity."""
    return tokens.where("token_type = 'operator'").join(F.broadcast(table), "text").select("expr_id", "idx", "text", "precedence", "associativity")


def neighbours(ops: DataFrame) -> DataFrame:
    """Each operator with the next one to its right."""
    at = W.partitionBy("expr_id").orderBy("idx")
    named = ops.select("*", *[F.lead(c).over(at).alias(f"r_{c}") for c in ("idx", "precedence", "associativity")])
    return named.where("r_idx is not null")


def before_direct(ops: DataFrame) -> DataFrame:
    """Pairs of neighbouring operators, the one that is evaluated first as ``first``: higher
    precedence (a smaller number) first, and by associativity among equals."""
    n = neighbours(ops)
    left = (F.col("precedence") < F.col("r_precedence")) | (F.col("precedence") == F.col("r_precedence")) & (F.col("associativity") == "L")
    return n.select("expr_id", F.when(left, F.col("idx")).otherwise(F.col("r_idx")).alias("first"), F.when(left, F.col("r_idx")).otherwise(F.col("idx")).alias("then"))


def ready(ops: DataFrame, order: DataFrame, done: DataFrame) -> DataFrame:
    """Operators not done whose direct predecessors all are done."""
    pending = ops.join(done, ["expr_id", "idx"], "left_anti")
    blocked = order.join(pending.select("expr_id", F.col("idx").alias("first")), ["expr_id", "first"]).select("expr_id", F.col("then").alias("idx"))
    return pending.join(blocked, ["expr_id", "idx"], "left_anti")
