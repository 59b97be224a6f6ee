"""Exact near-duplicate join of word-shingle sets by Jaccard similarity, heavy and light.

Equal sets are one node. Small sets enumerate subsets of the one size that two linked sets of
their sizes must share, so that meeting on a subset is a link; the size up to which this is done
is that of least cost for the sizes at hand. Large sets are found through inverted lists of their
prefixes, in the order of the shingles' hashes. A prefix is so long that two linked sets share
K(n) of its shingles, K growing with the size.

* Light lists, of at most LIGHT nodes, give their pairs; a pair is compared only if it met as
  often as a linked one must.
* Heavy lists never give pairs. A set with fewer than K heavy shingles in its prefix meets all
  its partners in light lists already. The others are first compared with the hubs that they
  share most heavy lists with; then, where a heavy list still holds several components, its
  nodes outside the largest one are a query set, which is scanned in blocks against the inverted
  lists of all nodes of such lists. So every link between components is found, and no group is
  expanded into pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import checked, small, stored, table
from .words import shingle_sets

#: Words of a shingle; similarity as a fraction.
WIDTH = 5
NUM, DEN = 4, 5
#: Nodes of a light list; sizes that may enumerate subsets; cost of a list entry in subsets.
LIGHT = 24
SMALL_MOST = 10
ENTRY_COST = 4
#: Hubs a node of heavy lists is compared with; query sets scanned at once, and their shingles.
HUBS = 3
BLOCK = 2000
BLOCK_SHINGLES = 1_000_000


def overlap(n: int, m: int) -> int:
    """Shared shingles that sets of sizes n and m need."""
    return -(-NUM * (n + m) // (NUM + DEN))


def least_partner(n: int) -> int:
    return -(-NUM * n // DEN)


def extra(n: int) -> int:
    return 1 + n // 16


def prefix_length(n: int) -> int:
    return min(n, n - least_partner(n) + extra(n))


def subset_keys(tokens: np.ndarray, boundary: int) -> list[tuple[int, int, int]]:
    """(size, partner size, hash) of the subsets by which a small set meets its partners."""
    n, keys = len(tokens), []
    for m in range(least_partner(n), min(boundary, n * DEN // NUM) + 1):
        need = overlap(n, m)
        if need <= min(n, m):
            pair = (min(n, m), max(n, m))
            for part in combinations(tokens.view(np.uint64).tolist(), need):
                keys.append((*pair, int.from_bytes(hashlib.blake2b(np.array(part, np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True)))
    return keys


def subset_cost(n: int) -> int:
    return sum(math.comb(n, overlap(n, m)) for m in range(least_partner(n), n * DEN // NUM + 1) if overlap(n, m) <= min(n, m))


def boundary_by_cost(sizes: dict[int, int]) -> int:
    """The largest small size: subsets of all smaller sets and entries of all larger ones cost least."""
    cost = {0: sum(c * prefix_length(n) * ENTRY_COST for n, c in sizes.items())}
    for x in range(1, SMALL_MOST + 1):
        small = sum(c * subset_cost(n) for n, c in sizes.items() if n <= x)
        large = sum(c * prefix_length(n) * ENTRY_COST for n, c in sizes.items() if n > x or n * DEN // NUM > x)
        cost[x] = small + large
    return min(cost, key=lambda x: (cost[x], x))


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only


def _sets(docs: DataFrame, schema: str, row, *, ids: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Rows that ``row(id, set)`` yields, as columns of ``schema``, over the sets of all texts."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [{"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [_lower(t) for t in batch.column(1).to_pylist()]
            out: list[list] = [[] for _ in names]
            filled = 0
            for key, tokens in zip(batch.column(0).to_pylist(), shingle_sets(texts, width), strict=True):
                for values in row(key, tokens):
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    filled += 1 + len(tokens) // 8
                if filled > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                    out, filled = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return docs.select(F.col(ids).cast("bigint"), "text").mapInArrow(run, schema)


def _of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id and text of the given nodes."""
    return docs.select("doc_id", "text").join(checked(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets reach the similarity."""
    ends = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "jj-ends")
    sets = stored(_sets(_of(docs, ends), "node bigint, tokens array<bigint>", lambda key, tokens: [(key, tokens)]), "jj-sets")
    left = pairs.join(sets.withColumnsRenamed({"node": "a", "tokens": "ta"}), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "tokens": "tb"}), "b")
    same = F.size(F.array_intersect("ta", "tb"))
    links = both.withColumn("same", same).where(DEN * F.col("same") >= NUM * (F.size("ta") + F.size("tb") - F.col("same")))
    found = stored(links.select("a", "b").distinct(), "jj-links")
    return found


def _size_fits(a: str, b: str) -> F.Column:
    return (DEN * F.col(a) >= NUM * F.col(b)) & (DEN * F.col(b) >= NUM * F.col(a))


def _needed(n: F.Column) -> F.Column:
    return 1 + F.floor(n / 16)


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all components of ``nodes`` (node, n), stored."""
    spark = docs.sparkSession
    sizes = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= SMALL_MOST * 2).groupBy("n").count().collect()}
    edge = boundary_by_cost(sizes)
    reps = _of(docs, nodes)

    def keys(key: int, tokens: np.ndarray):
        return [(key, *k) for k in subset_keys(tokens, edge)] if 0 < len(tokens) <= edge else ()

    small = _sets(reps, "node bigint, s bigint, l bigint, h bigint", keys).distinct()
    met = small.join(nodes, "node").groupBy("s", "l", "h").agg(F.min("node").alias("hub"), F.min("n").alias("least"), F.max("n").alias("most"))
    met = met.where("least = s and most = l")  # both sizes are there, so all of one link with all of the other
    found = stored(small.join(met.select("s", "l", "h", "hub"), ["s", "l", "h"]).select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "jj-small")

    def prefix(key: int, tokens: np.ndarray):
        n = len(tokens)
        return [(key, n, tokens[: prefix_length(n)])] if n and n * DEN // NUM > edge else ()

    lists = _sets(reps, "node bigint, n int, p array<bigint>", prefix).select("node", "n", F.explode("p").alias("token"))
    counts = stored(lists.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "jj-counts")
    met = stored(lists.join(counts, "token"), "jj-met")

    heavy = met.where(F.col("c") > LIGHT)
    hit = stored(heavy.groupBy("node").agg(F.count("*").alias("heavy"), F.max("n").alias("n")), "jj-heavy")
    x, y = met.where(F.col("c") <= LIGHT).select("token", F.col("node").alias("a"), F.col("n").alias("na")), met.where(F.col("c") <= LIGHT).select("token", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, "token").where((F.col("a") < F.col("b")) & _size_fits("na", "nb"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.join(hit.select(F.col("node").alias("a"), F.col("heavy").alias("ha")), "a", "left").join(hit.select(F.col("node").alias("b"), F.col("heavy").alias("hb")), "b", "left").na.fill(0, ["ha", "hb"])
    pairs = pairs.where(F.col("met") + F.least("ha", "hb") >= _needed(F.least("na", "nb")))
    pairs = stored(pairs.select("a", "b"), "jj-pairs")
    found = found.unionByName(_verified(docs, pairs))
    if heavy.isEmpty():
        return found

    # Only sets with as many heavy shingles as they may share with a partner can lack a link.
    deep = stored(hit.where(F.col("heavy") >= _needed(F.ceil(F.col("n") * NUM / DEN))).select("node"), "jj-deep")
    heavy = stored(heavy.join(checked(deep), "node", "left_semi").select("token", "node", "n"), "jj-deep-lists")
    # Hubs: the first of each list, and of those that a node meets, the ones it meets most.
    # What is grouped by token is stored before it is joined: both sides are plain exchanges then, and
    # AQE splits a token that very many sets have.
    firsts = stored(heavy.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("far")), "jj-firsts")
    by = heavy.join(checked(firsts), "token").select("node", F.explode(F.array("hub", "far")).alias("hub")).where("node <> hub").groupBy("node", "hub").count()
    best = by.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "hub")), False), 1, HUBS).alias("hubs"))
    stars = best.select(F.explode("hubs.hub").alias("hub"), "node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    found = found.unionByName(_verified(docs, stored(stars, "jj-stars")))

    known = components(found)
    placed = heavy.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = stored(placed.groupBy("token", "component").agg(F.count("*").alias("c")), "jj-parts")
    main = parts.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("main")).where("parts > 1").select("token", F.col("main.component").alias("main"))
    main = stored(main, "jj-main")
    mixed_lists = stored(placed.join(checked(main), "token").groupBy("node", "component").agg(F.max((F.col("component") != F.col("main")).cast("int")).alias("asks")), "jj-mixed")
    asking = mixed_lists.where("asks = 1").count()
    if not asking:
        return found
    sets = stored(_sets(_of(docs, mixed_lists), "node bigint, tokens array<bigint>", lambda key, tokens: [(key, tokens)]).join(mixed_lists, "node"), "jj-scan")
    shingles = sets.where("asks = 1").agg(F.sum(F.size("tokens")).alias("n")).first()["n"]
    blocks = max(-(-asking // BLOCK), -(-shingles // BLOCK_SHINGLES))
    for k in range(blocks):
        block = sets.where((F.col("asks") == 1) & (F.pmod(F.xxhash64("node"), F.lit(blocks)) == k))
        found = found.unionByName(stored(_scan(sets, block), "jj-scanned"))
    return found


def _scan(sets: DataFrame, block: DataFrame) -> DataFrame:
    """Links of the query sets of ``block`` (about BLOCK of them) with all of ``sets`` in other
    components; of one set's links with one component, the first is enough."""
    spark = sets.sparkSession
    rows = block.select("node", "component", "tokens").collect()
    nodes, parts = np.array([r["node"] for r in rows], np.int64), np.array([r["component"] for r in rows], np.int64)
    lengths = np.array([len(r["tokens"]) for r in rows], np.int64)
    tokens = np.concatenate([np.array(r["tokens"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    index = spark.sparkContext.broadcast((tokens[order], np.repeat(np.arange(len(rows), dtype=np.int32), lengths)[order], nodes, parts, lengths))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, owner, node, part, length = index.value
        for batch in batches:
            a, b = [], []
            for key, own, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                mine = mine.values.to_numpy()
                lo, hi = np.searchsorted(token, mine), np.searchsorted(token, mine, "right")
                some = np.flatnonzero(hi > lo)
                if not len(some):
                    continue
                same = np.bincount(np.concatenate([owner[lo[i] : hi[i]] for i in some]), minlength=len(node))
                good = np.flatnonzero((part != own) & (node != key) & (same > 0) & (DEN * same >= NUM * (len(mine) + length - same)))
                _, first = np.unique(part[good], return_index=True)
                a += [key] * len(first)
                b += node[good[first]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sets.select("node", "component", "tokens").mapInArrow(scan, "a bigint, b bigint")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    A null text, an empty one, or one of white space has no shingles and is its own component. A
    doc_id that occurs more than once is one document with several texts, linked by any of them.
    A row without doc_id has component null where no document has its set. Empty input gives no
    rows; columns other than doc_id and text are not read.
    """

    def signed(key: int | None, tokens: np.ndarray):
        return [(key, len(tokens), hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())]

    members = stored(_sets(docs, "doc_id bigint, n bigint, sig binary", signed), "jj-members")
    groups = stored(members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("node"), F.min("n").alias("n")), "jj-groups")
    nodes = groups.where("node is not null").select("node", "n").distinct()
    edges = links(docs, stored(nodes, "jj-nodes"))
    twice = members.where("n > 0 and doc_id is not null").join(groups.select("sig", "node"), "sig").where("doc_id <> node")
    # A node that stands for another document's set, too, ties that document's other sets to it.
    tied = twice.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    found = components(edges.unionByName(tied))
    classed = groups.join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    out = members.join(classed, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
