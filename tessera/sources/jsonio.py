"""Question, rule and operator JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.closure import closure

#: Operators used by the fixtures: text, arity, precedence, associativity. Fixed values of C++.
OPERATORS = (("+", 2, 6, "L"), ("*", 2, 5, "L"), ("=", 2, 16, "R"), ("<", 2, 9, "L"), ("&&", 2, 14, "L"), ("-", 2, 6, "L"))


def questions(text: DataFrame) -> DataFrame:
    """Questions by their discriminator ``questionType``."""
    q = text.select(F.from_json("value", "id bigint, questionType string, steps bigint").alias("q"))
    return q.select("q.id", F.col("q.questionType").alias("kind"), "q.steps")


def transitions(text: DataFrame) -> DataFrame:
    """question, answer, ord, next_question, correct of a nested automaton."""
    state = "map<string, map<string, array<struct<next: string, correct: boolean>>>>"
    q = text.select(F.explode(F.from_json("value", state)).alias("question", "answers"))
    a = q.select("question", F.explode("answers").alias("answer", "steps"))
    t = a.select("question", "answer", F.posexplode("steps").alias("at", "t"))
    return t.select("question", "answer", (F.col("at") + 1).alias("ord"), F.col("t.next").alias("next_question"), "t.correct")


def operators(spark: SparkSession) -> DataFrame:
    text = json.dumps({"C++": [dict(zip(("text", "arity", "precedence", "associativity"), o, strict=True)) for o in OPERATORS]})
    rows = spark.createDataFrame([(text,)], "value string").select(F.explode(F.from_json("value", "map<string, array<struct<text: string, arity: int, precedence: int, associativity: string>>>")).alias("language", "ops"))
    return rows.select(F.explode("ops").alias("o")).select("o.*")


def nested(nodes: DataFrame, key: str) -> DataFrame:
    """``key``, nodes, tree: the nodes (``key``, node, parent, class) of each tree as nested JSON,
    children in order of their numbers.

    The ancestors of each node, from a closure of any depth, are its path; in the order of paths a
    node's children follow it, and the next one's level says how many brackets close. A tree is one
    value, so its nodes meet in one task. Nodes on a cycle are not in a tree and are left out.
    """
    edges = nodes.where("parent is not null").select(key, "parent", F.col("node").alias("child"))
    roots = nodes.where("parent is null").select(key, F.col("node").alias("ancestor"))
    pairs = closure(edges, [key])
    below = pairs.join(roots, [key, "ancestor"], "left_semi").select(key, "node").distinct()
    up = pairs.join(below, [key, "node"], "left_semi")
    way = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), "ancestor"))), lambda s: s["ancestor"])
    paths = up.groupBy(key, "node").agg(way.alias("path"))
    alone = nodes.join(paths, [key, "node"], "left").where("path is not null or parent is null")
    rows = alone.select(key, F.coalesce("path", F.array("node")).alias("path"), "node", "class")
    packed = rows.groupBy(key).agg(F.count("*").alias("nodes"), F.array_sort(F.collect_list(F.struct("path", "node", "class"))).alias("t"))

    def text(x: Column, i: Column) -> Column:
        level, after = F.size(x["path"]), F.size(F.get("t", i + 1)["path"])
        last = i + 1 == F.size("t")
        close = F.repeat(F.lit("]}"), level - F.when(last, 1).otherwise(after) + 1)
        start = F.concat(F.lit('{"node":'), x["node"].cast("string"), F.lit(',"class":'), F.to_json(F.array(x["class"])))
        named = F.concat(F.regexp_replace(start, r'"class":\[(.*)\]$', r'"class":$1'), F.lit(',"children":['))
        return F.concat(named, F.when(~last & (after > level), "").otherwise(F.concat(close, F.when(last, "").otherwise(","))))

    return packed.select(key, "nodes", F.array_join(F.transform("t", text), "").alias("tree"))
