"""Facts (triples) as rows: pattern lookups, set operations, patches, chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import closure

TERMS = ["subject", "verb", "object"]


def matching(facts: DataFrame, subject: str | None = None, verb: str | None = None, obj: str | None = None) -> DataFrame:
    """Facts that agree with every term given; null is a wildcard."""
    for column, value in zip(TERMS, (subject, verb, obj), strict=True):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    return facts


def of_verbs(facts: DataFrame, verbs: list[str] | None) -> DataFrame:
    return facts.where(F.col("verb").isin(verbs)) if verbs else facts


def as_set(facts: DataFrame) -> DataFrame:
    return facts.select(*TERMS).dropDuplicates()


def minus(facts: DataFrame, others: DataFrame) -> DataFrame:
    """Facts whose triple is not among the others."""
    return facts.join(others.select(*TERMS), TERMS, "left_anti")


def without_like(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Remove facts that a pattern row matches; a null term of a pattern is a wildcard."""
    p = patterns.select(*[F.col(t).alias(f"_{t}") for t in TERMS])
    # Equal terms first: patterns with a subject or a verb join on it, the few others are filters.
    kept = facts
    shapes = [tuple(c) for c in p.select(*[F.col(f"_{t}").isNotNull() for t in TERMS]).distinct().collect()]
    for shape in shapes:
        have = [t for t, there in zip(TERMS, shape, strict=True) if there]
        rows = p.where(reduce(lambda a, b: a & b, [F.col(f"_{t}").isNotNull() if t in have else F.col(f"_{t}").isNull() for t in TERMS]))
        if not have:
            return kept.limit(0)
        kept = kept.join(rows.select(*[F.col(f"_{t}").alias(t) for t in have]).distinct(), have, "left_anti")
    return kept


def with_new(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Append only facts that are not there yet."""
    return facts.unionByName(minus(more, facts))


def retained(facts: DataFrame, others: DataFrame) -> DataFrame:
    return facts.join(others.select(*TERMS).distinct(), TERMS, "left_semi")


def replaced(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the object of (subject, verb) to that of ``changes``."""
    return facts.join(changes.select("subject", "verb"), ["subject", "verb"], "left_anti").select(*TERMS).unionByName(changes.select(*TERMS))


def patched(facts: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply (old triple, new triple) rows; a null new term keeps the old one."""
    olds = [F.col(f"old_{t}").alias(t) for t in TERMS]
    news = patches.select(*olds, *[f"new_{t}" for t in TERMS])
    return facts.join(news, TERMS, "left").select(*[F.coalesce(f"new_{t}", t).alias(t) for t in TERMS])


def chain(starts: DataFrame, facts: DataFrame, path: list[str]) -> DataFrame:
    """Nodes at the end of a property chain from ``node``; ^ inverts a hop; a set after each."""
    at = starts.select("node").distinct()
    for hop in path:
        inverse = hop.startswith("^")
        edge = facts.where(F.col("verb") == hop.lstrip("^"))
        a, b = ("object", "subject") if inverse else ("subject", "object")
        at = at.join(edge.select(F.col(a).alias("node"), F.col(b).alias("to")), "node").select(F.col("to").alias("node")).distinct()
    return at


def up_to_role(facts: DataFrame, role: int) -> DataFrame:
    """Union of the graphs of a question up to a role, as a set."""
    return facts.where(F.col("role_ord") <= role).select("graph_id", *TERMS).dropDuplicates()


def repeated(facts: DataFrame, verbs: list[str]) -> DataFrame:
    """node, reached: where one or more steps by any of ``verbs`` lead; a node leads to itself only by a cycle."""
    steps = facts.where(F.col("verb").isin(verbs)).select(F.col("subject").alias("parent"), F.col("object").alias("child")).distinct()
    on = closure(steps).select(F.col("ancestor").alias("child"), F.col("node").alias("reached"))
    return steps.join(on, "child").select(F.col("parent").alias("node"), "reached").distinct()
