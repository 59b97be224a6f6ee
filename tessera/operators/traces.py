"""Partial traces and their combination; loop counts; boolean generators; variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Loop iterations enumerated, traces kept for each set of mistakes.
MOST_ITERATIONS = 3
KEPT = 2


def generated(delay: int, active: int, safe: bool = False, length: int = 8) -> Column:
    """Values of a boolean generator: first ``delay`` false, then ``active`` true, then false."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i >= delay) & (i < delay + active)) != F.lit(safe))


def combined(a: Column, b: Column) -> Column:
    """One trace after another: lengths add up, depths do not, a shared joint act stands once."""
    joint = (F.size(a["acts"]) > 0) & (F.size(b["acts"]) > 0) & (F.element_at(a["acts"], -1) == F.get(b["acts"], 0))
    acts = F.concat(a["acts"], F.when(joint, F.slice(b["acts"], 2, F.size(b["acts"]))).otherwise(b["acts"]))
    return F.struct(
        (a["len"] + b["len"]).alias("len"), F.greatest(a["depth"], b["depth"]).alias("depth"), acts.alias("acts"),
        F.array_sort(F.array_union(a["mistakes"], b["mistakes"])).alias("mistakes"), (a["invalid"] | b["invalid"]).alias("invalid"),
    )


def pruned(ways: DataFrame, keys: list[str], share: float = 0.5, kept: int = KEPT) -> DataFrame:
    """Of each set of mistakes, at most ``kept`` of the shorter traces, in a dealt order."""
    of = W.partitionBy(*keys, F.col("way.mistakes"))
    n = F.col("way.len")
    cut = ways.withColumn("_lo", F.min(n).over(of)).withColumn("_hi", F.max(n).over(of)).where(n <= F.col("_lo") + share * (F.col("_hi") - F.col("_lo")))
    order = of.orderBy(F.xxhash64("way.acts"), F.col("way.acts"))
    return cut.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= kept).select(*keys, "way")


def product(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left trace with every right one of the same statement, pruned at once."""
    both = left.withColumnRenamed("way", "a").join(right.withColumnRenamed("way", "b"), keys)
    return pruned(both.select(*keys, combined(F.col("a"), F.col("b")).alias("way")).where("not way.invalid"), keys)


def loop_class(init: Column, stop: Column, step: Column) -> Column:
    """How often a counting loop ``for (i = init; i < stop; i += step)`` runs."""
    n = F.ceil((stop - init) / step)
    return F.when((step == 0) & (init < stop), "Infinite").when(init >= stop, "Zero").when(n == 1, "One").otherwise(F.concat(F.lit("["), init.cast("string"), F.lit(","), stop.cast("string"), F.lit(")")))


def loop_bounds(text: Column) -> tuple[Column, Column, Column]:
    """init, operator and bound back from a header text such as ``i = 0; i <= 7``."""
    get = lambda k: F.regexp_extract(text, r"=\s*(-?\d+)\s*;\s*\w+\s*([<>]=?|!=)\s*(-?\d+)", k)
    return get(1), get(2), get(3)


def variants(points: DataFrame, most: int | None = None) -> DataFrame:
    """Expression variants: a true and a false branch at each short-circuit operand in order,
    except behind one that ended the evaluation; names grow by t or f.

    ``points``: expr_id and ``n``, the number of operands; the first ``most`` by name stay, all
    where it is None. An expression of n operands has n + 1 variants, as its first false ends it.
    """
    ways = points.select("expr_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint"))).alias("k"))
    ended = F.when(F.col("k") < F.col("n"), "f").otherwise("")
    grown = ways.select("expr_id", F.concat(F.repeat(F.lit("t"), F.col("k").cast("int")), ended).alias("name"))
    if most is None:
        return grown
    return grown.withColumn("_n", F.row_number().over(W.partitionBy("expr_id").orderBy("name"))).where(F.col("_n") <= most).select("expr_id", "name")
