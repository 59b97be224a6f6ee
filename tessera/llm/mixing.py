"""Mixing sources to target weights, with DataFrame operations only.

Documents of a source are laid end to end inside hash buckets and cut into blocks of a fixed
number of words. Output shards of a fixed number of slots draw how many slots each source gets
from the multinomial of the targets, conditioned on the sources' totals: a keyed permutation of all
slots gives each slot its draw, and a source owns as many draws as its target has slots. So shard
counts are random, totals are exact, and a slot's source and its number within the source follow
from the slot alone, without a count over others. Slot number j of a source reads block
perm(j mod blocks), where perm is a keyed permutation of the source's block numbers: a source is
read through once before any block repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checked, stored, table, word_count

#: Words of a block, slots of an output shard, documents that share a packing bucket (about).
BLOCK_WORDS = 256
SHARD_SLOTS = 256
BUCKET_DOCS = 512
#: Weights dealt to sources by code point, repeating; no source is read more often than this.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20817
#: Rounds of a permutation.
ROUNDS = 24


def source_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, repeats: int = MAX_REPEATS) -> list[tuple[str | None, int, float]]:
    """Targets in words. Sources by code point, null last; what a capped source can't take is
    shared again by weight until no target is above ``repeats`` times its source."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    total = float(sum(size.values()))
    target, open_ = {}, set(size)
    while open_:
        left = total - sum(target.values())
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / share > repeats * size[s]}
        if not over:
            target.update({s: left * weight[s] / share for s in open_})
            break
        target.update({s: float(repeats * size[s]) for s in over})
        open_ -= over
    return [(s, n, target[s]) for s, n in order]


def permuted(index: Column, count: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Keyed bijection of 0..count-1 for every count. Each round pairs x with k - x (mod count), k
    being the round's own, and a hash of the pair's larger member says whether the two swap; so
    each round is a bijection by itself, and none has to be walked again."""

    def step(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, i), count) + count - x, count)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED), key, i, F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), index.cast("long"), step)


def _cut(text: Column, start: Column, size: Column, block_words: int) -> Column:
    """The pieces of a text of ``size`` words that begins at word ``start`` of its bucket, one per
    block. White space goes with the word after it, at the end with the last, so that the pieces
    joined are the text."""
    low, high = F.floor(start / block_words), F.floor((start + size - 1) / block_words)

    def piece(words: Column, part: Column) -> Column:
        first = F.greatest(start, part * block_words)
        n = F.least(start + size, (part + 1) * block_words) - first
        held = F.slice(words, (first - start + 1).cast("int"), (n + F.when(part == high, 1).otherwise(0)).cast("int"))
        return F.struct(part.alias("part"), (part - low).alias("nth"), (first - part * block_words).alias("at"), n.alias("words"), F.array_join(held, "").alias("text"))

    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    # An array of one, so that the text is split once and not once per piece.
    return F.when(size > 0, F.transform(F.array(words), lambda w: F.transform(F.sequence(low, high), lambda p: piece(w, p)))[0])


def _mixed(docs: DataFrame, rest: tuple[str, ...], block_words: int, shard_slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces of all documents, the facts of sources, and the pieces in their slots."""
    spark = docs.sparkSession
    # The plan is made on the driver, of one row per source; texts and blocks never go there.
    docs_of = {r["source"]: int(r["docs"]) for r in docs.groupBy("source").agg(F.count("*").alias("docs")).collect()}
    order = sorted(docs_of, key=lambda s: (s is None, s or ""))
    ids = spark.createDataFrame([(i, s, -(-docs_of[s] // BUCKET_DOCS)) for i, s in enumerate(order)], "sid int, src string, buckets long")
    more = [F.struct(*rest).alias("rest")] if rest else []
    sized = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *more)
    keyed = sized.join(checked(stored(ids, "mix-ids")), F.col("source").eqNullSafe(F.col("src")))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "tie"), F.col("buckets"))).drop("src", "buckets")
    run = W.partitionBy("sid", "bucket").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn("start", F.sum("size").over(run) - F.col("size"))
    placed = placed.withColumn("piece", F.explode_outer(_cut(F.col("text"), F.col("start"), F.col("size"), block_words)))
    pieces = placed.select("doc_id", "source", "size", "tie", "sid", "bucket", "start", *(["rest"] if rest else []), "piece.*")
    pieces = stored(pieces.withColumn("nth", F.coalesce("nth", F.lit(0))), "mix-pieces")

    packed = pieces.groupBy("sid", "bucket").agg(F.coalesce(F.max(F.col("part") + 1), F.lit(0)).alias("blocks"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    packed = stored(packed, "mix-buckets")
    facts = {r["sid"]: (int(r["n"]), int(r["b"])) for r in packed.groupBy("sid").agg(F.sum("words").alias("n"), F.sum("blocks").alias("b")).collect()}
    plan = source_targets([(s, facts[i][0]) for i, s in enumerate(order)])
    held = {i: b for i, (_, b) in facts.items()}
    sources = stored(spark.createDataFrame([(i, n, t) for i, (_, n, t) in enumerate(plan)], "sid int, source_size long, target double"), "mix-sources")
    first = _running(packed.select("sid", F.col("bucket").alias("shard"), F.col("blocks").alias("n")))
    firsts = stored(first.select("sid", F.col("shard").alias("bucket"), F.col("before").alias("first_block")), "mix-firsts")

    # Slots a source has to get: its target over the mean words of its blocks.
    need = [(i, held.get(i, 0), min(MAX_REPEATS * held.get(i, 0), int(round(t * held.get(i, 0) / n))) if n else 0) for i, (_, n, t) in enumerate(plan)]
    drawn = stored(_slots(spark, need, shard_slots), "mix-read") if any(k for _, _, k in need) else spark.createDataFrame([], "shard long, slot long, sid int, block long")
    blocks = pieces.where("words > 0").join(checked(firsts), ["sid", "bucket"]).withColumn("block", F.col("first_block") + F.col("part"))
    dealt = blocks.join(checked(drawn), ["sid", "block"])
    return pieces, sources, dealt.select("shard", "slot", "source", "block", "at", "doc_id", "words", "text", *(["rest"] if rest else []), "sid", "bucket", "start")


def shards(docs: DataFrame, *rest: str, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mixed corpus: the block that stands in each slot of each shard, with its text.

    Returns shard, slot, source, block (number within the source), at, doc_id, words, text, and
    ``rest``, a struct of the document's columns of these names, where any are given. A block is
    the rows of its slot in the order of ``at``, the number of the row's first word in the block;
    each holds that document's part of the block, white space included. Slots are numbered
    through all shards. A document without words is in no block.
    """
    return _mixed(docs, rest, block_words, shard_slots)[2].drop("sid", "bucket", "start")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Rows of ``docs`` with how many of their words the mix takes, counted in its shards.

    Returns doc_id, size, source, source_size, target, taken, tie (hash of the text). A null text has size 0 and is never
    taken; null sources form one source; repeated rows are separate documents; empty input gives
    no rows; columns other than doc_id, text and source are not read.
    """
    pieces, sources, dealt = _mixed(docs, (), block_words, shard_slots)
    dealt = stored(dealt, "mix-shards")
    # A document of words is the only one to start where it does in its bucket.
    taken = dealt.groupBy("sid", "bucket", "start").agg(F.sum("words").alias("got"))
    whole = pieces.where("nth = 0").join(checked(sources), "sid")
    full = whole.where("size > 0").join(taken, ["sid", "bucket", "start"], "left").unionByName(whole.where("size = 0"), allowMissingColumns=True)
    return full.select("doc_id", "size", "source", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "tie")


def _slots(spark: SparkSession, need: list[tuple[int, int, int]], shard_slots: int) -> DataFrame:
    """The block that each slot of each shard reads: shard, slot, sid, block. ``need`` has sid,
    blocks and slots of each source. Sources meet slots on cells of equally many draws, so that
    a slot looks at the few sources of its cell, however many there are."""
    slots = sum(k for _, _, k in need)
    width = max(1, slots // (4 * len(need)))
    rows, at = [], 0
    for i, blocks, k in need:
        if k:
            rows.append((i, blocks, at, at + k))
        at += k
    bounds = spark.createDataFrame(rows, "sid int, blocks long, lo long, hi long")
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    bounds = stored(bounds, "mix-bounds")  # at most five rows a source and one more
    tasks = max(1, min(-(-slots // shard_slots), slots // 50_000 + 1))
    drawn = spark.range(0, slots, 1, tasks).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.col("id").alias("slot"))
    drawn = drawn.withColumn("draw", permuted(F.col("slot"), F.lit(slots).cast("long"), F.lit(-1)))
    drawn = drawn.withColumn("cell", F.floor(F.col("draw") / width)).join(checked(bounds), "cell").where("draw >= lo and draw < hi")
    block = permuted(F.pmod(F.col("draw") - F.col("lo"), F.col("blocks")), F.col("blocks"), F.col("sid"))
    return drawn.select("shard", "slot", "sid", block.alias("block"))


def _running(counts: DataFrame, span: int = 4096) -> DataFrame:
    """Sum of a source's n over earlier shards, in two levels so that no window holds them all."""
    grouped = counts.withColumn("group", F.floor(F.col("shard") / span))
    inner = W.partitionBy("sid", "group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    local = grouped.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    outer = W.partitionBy("sid").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = grouped.groupBy("sid", "group").agg(F.sum("n").alias("n")).withColumn("outside", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    joined = local.join(groups.select("sid", "group", "outside"), ["sid", "group"])
    return joined.select("shard", "sid", (F.col("inside") + F.col("outside")).alias("before"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
