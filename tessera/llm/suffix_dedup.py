"""Removal of long repeated byte strings across documents.

A document whose whole text an earlier one has is repeated as a whole, and adds no strings: only the
others are looked into. Every string of MATCH bytes is assigned to its anchor, the least-hashed gram in it, so equal
strings have equal anchors. The strings of one anchor are one run of bytes, its segment, at most
2 * MATCH - GRAM long. Anchors that only one document has are left out. Of the others, a segment that
an earlier document has just so is repeated as a whole; and segments of different content that share
an anchor and the bytes on one side of it form a collection of short texts. Its Burrows-Wheeler
transform and common prefixes are built column by column, one symbol of every segment a round, in
sequential files (``external_bwt``). In the finished order, strings with a common prefix of MATCH
bytes stand together, and all but those of the first document are repeated.

Building the transform over whole documents takes as many passes over all the data as the
longest document has bytes; segments bound the rounds and let blocks of anchors be built apart.
Anchors of up to HOT_ROWS segments are compared in windows. Of more frequent ones, such as a line
that a third of all documents have, the segments are counted by aggregates that sum before the
shuffle, joined by broadcasts of checked size or as plain exchanges, which AQE splits, and
compared string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import external_bwt
from .shared import checked, fits, freed, shared_dir, small, stored, table
from .words import _BASE, _UNDO, _VALUE, U, _power, groups, mixed

#: Bytes of a repeated string and of an anchor, and those beside the anchor that one side must share:
#: a common string has at least MATCH - GRAM bytes around the anchor, so half of them on one side.
MATCH, GRAM = 50, 16
NEAR = (MATCH - GRAM) // 2
#: Bytes of a symbol of the transform; MATCH is a multiple.
WIDTH = 10
#: Segments of a block (the anchor that fills it is always whole), and of an anchor that one
#: window may hold.
BLOCK_SEGMENTS = 4000
HOT_ROWS = 100_000
#: String starts hashed at once in a long text.
SLICE = 4 << 20
#: Bits of a place that hold the number of a segment's strings; at most MATCH - GRAM + 1.
COUNT_BITS = 6
#: Bits of the map of anchors that several documents have.
MAP_BITS = 27


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, start, strings, sides) of all segments of documents laid end to end;
    ``ends`` are the documents' ends. Two segments with a common string share the anchor and
    NEAR bytes on one side of it; ``sides`` holds a 32-bit hash of either side."""
    n = len(data) - MATCH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_VALUE[data] * _power(_BASE, len(data)), dtype=U)])
    undo = _power(_UNDO, len(data) + 1)
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * undo[: len(data) - GRAM + 1])
    low = U((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=U)  # by hash, then the leftmost
    span, width = 1, MATCH - GRAM + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:n], least[width - span : width - span + n])
    anchor = least[:n] & low
    # Strings that run over a document's end belong to no segment.
    whole_strings = np.ones(n, bool)
    for end in ends.tolist():
        whole_strings[max(0, end - MATCH + 1) : end] = False
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole_strings[1:] != whole_strings[:-1])) + 1
    begin = np.concatenate([[0], change])
    count = np.diff(np.append(begin, n))
    kept = whole_strings[begin]
    begin, count = begin[kept], count[kept]
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = anchor[begin].astype(np.int64)
    stop = begin + count + MATCH - 1
    whole = mixed((sums[stop] - sums[begin]) * undo[begin] + (stop - begin).astype(U))
    own = np.searchsorted(ends, begin, "right")
    opens = np.concatenate([[0], ends[:-1]])[own]

    def side(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
        """Hash of the bytes from a to b; of the content, where the document has no such bytes."""
        there = (a >= opens) & (b <= ends[own])
        a, b = np.where(there, a, begin), np.where(there, b, stop)
        h = mixed((sums[b] - sums[a]) * undo[a] + (b - a).astype(U) * U(2) + U(tag))
        return h & U(0xFFFFFFFF)

    sides = side(at - NEAR, at + GRAM, 0) << U(32) | side(at, at + GRAM + NEAR, 1)
    return gram[at].view(np.int64), whole.view(np.int64), begin, count, sides.view(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int]]:
    """(indexes of texts, bytes, ends, offset): short texts together, long ones in slices that
    overlap so that every string is whole in just one."""
    for a, b in groups(texts):
        if b - a == 1 and len(texts[a]) > SLICE:
            data = np.frombuffer(texts[a], np.uint8)
            for base in range(0, len(data) - MATCH + 1, SLICE):
                part = data[base : base + SLICE + MATCH - 1]
                yield [a], part, np.array([len(part)]), base
        else:
            data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
            yield list(range(a, b)), data, np.cumsum([len(t) for t in texts[a:b]]), 0


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _found(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, content, place, sides) of the segments of texts; place is start and count."""
    for index, data, ends, base in _pieces(texts):
        anchor, whole, begin, count, sides = segments(data, ends)
        if len(begin):
            own = np.searchsorted(ends, begin, "right")
            begins = np.concatenate([[0], ends[:-1]])
            yield np.array(index)[own], anchor, whole, ((begin - begins[own] + base) << COUNT_BITS) | count, sides


def _known(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, tie, text of all rows, and doc, tie, n of those whose whole text of n bytes an earlier
    document has. tie tells the texts of one doc_id apart, and is 0 where there is one."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    hashed = F.xxhash64("text")
    whole = F.when(F.octet_length("text") >= MATCH, F.unhex(F.sha2("text", 256)))
    digests = stored(rows.select("doc", hashed.alias("tie"), F.octet_length("text").cast("bigint").alias("n"), whole.alias("whole")), "sd-digests")
    several = digests.groupBy("doc").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a <> b").select("doc", F.lit(True).alias("several"))
    several = stored(several, "sd-several")
    first = digests.where("whole is not null").groupBy("whole").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("whole", "first")
    copies = digests.join(checked(stored(first, "sd-wholes")), "whole").where("doc > first").select("doc", "tie", "n").distinct()
    if several.isEmpty():
        known = rows.select("doc", F.lit(0).cast("bigint").alias("tie"), "text")
        return known, stored(copies.select("doc", F.lit(0).cast("bigint").alias("tie"), "n"), "sd-copies")
    tie = lambda h: F.when(F.col("several"), h).otherwise(F.lit(0)).alias("tie")
    known = rows.join(checked(several), "doc", "left").select("doc", tie(hashed), "text")
    return known, stored(copies.join(checked(several), "doc", "left").select("doc", tie(F.col("tie")), "n"), "sd-copies")


def _anchors(known: DataFrame) -> DataFrame:
    """h, n: the anchors that several documents have, and how many segments of theirs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), [_bytes(t) for t in batch.column(1).to_pylist()]
            for own, anchor, _, _, _ in _found(texts):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[own])], names=["h", "doc"])

    seen = known.select("doc", "text").mapInArrow(run, "h bigint, doc bigint")
    return stored(seen.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a <> b").select("h", "n"), "sd-anchors")


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """A map of 2 ** MAP_BITS bits of the anchors' low bits. One that is set by chance lets a row
    pass that comes to nothing later; none is missed."""
    low = F.pmod(F.col("h"), F.lit(1 << MAP_BITS)) + 1
    parts = anchors.select(F.bitmap_bucket_number(low).alias("part"), F.bitmap_bit_position(low).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    found = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    for row in parts:
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        found[(row["part"] - 1) * len(bits) : row["part"] * len(bits)] = bits
    return found


def _rows(known: DataFrame, anchors: DataFrame) -> DataFrame:
    """h, sig, sides, doc, tie, at: the segments of the anchors of several documents."""
    spark = known.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(anchors))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in small(batches):
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for own, anchor, whole, at, sides in _found([_bytes(t) for t in batch.column(2).to_pylist()]):
                low = anchor & ((1 << MAP_BITS) - 1)
                on = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                own = own[on]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[on], whole[on], sides[on], ids[own], ties[own], at[on])], names=["h", "sig", "sides", "doc", "tie", "at"])

    return known.mapInArrow(run, "h bigint, sig bigint, sides bigint, doc bigint, tie bigint, at bigint")


def _windows(rows: DataFrame) -> DataFrame:
    """h, doc, tie, at, copy of the segments that an earlier document has just so (copy), and of
    those that share their anchor and a side with a segment of another document."""
    rows = rows.repartition("h").withColumn("first", F.min("doc").over(W.partitionBy("h", "sig").orderBy("doc").rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("copy", F.col("first") < F.col("doc")).withColumn("left", F.shiftright("sides", 32)).withColumn("right", F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)))
    for side in ("left", "right"):
        near = W.partitionBy("h", side)
        rows = rows.withColumn(f"{side}_near", F.min("first").over(near) < F.max("first").over(near))
    return rows.where("copy or left_near or right_near").select("h", "doc", "tie", "at", "copy")


def _aggregates(rows: DataFrame) -> DataFrame:
    """The same for anchors of any number of segments, of which those of one content are counted as one."""
    rows = stored(rows, "sd-hot-rows")
    contents = stored(rows.groupBy("h", "sig").agg(F.min("doc").alias("first"), F.min("sides").alias("sides")), "sd-contents")
    side = F.explode(F.array(F.shiftright("sides", 32), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 40)))
    sides = contents.select("h", "sig", "first", side.alias("side"))
    met = stored(sides.groupBy("h", "side").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("h", "side"), "sd-sides")
    near = stored(sides.join(checked(met), ["h", "side"]).select("h", "sig").distinct().withColumn("near", F.lit(True)), "sd-near")
    facts = stored(contents.select("h", "sig", "first").join(checked(near), ["h", "sig"], "left"), "sd-facts")
    found = rows.join(checked(facts), ["h", "sig"]).withColumn("copy", F.col("first") < F.col("doc"))
    return found.where("copy or near").select("h", "doc", "tie", "at", "copy")


def _cut(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, hot, doc, tie, at, part: the bytes of the wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in small(batches):
            out: list[list] = [[] for _ in types]
            for doc, tie, text, listed in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, tie, data = doc.as_py(), tie.as_py(), _bytes(text.as_py())
                for h, hot, at in zip(*(listed.values.field(i).to_pylist() for i in range(3)), strict=True):
                    start, count = at >> COUNT_BITS, at & ((1 << COUNT_BITS) - 1)
                    for column, value in zip(out, (h, hot, doc, tie, at, data[start : start + count + MATCH - 1]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "hot", "doc", "tie", "at", "part"])

    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "hot", "at")).alias("wanted"))
    joined = known.join(stored(lists, "sd-wanted").hint("merge"), ["doc", "tie"])
    return joined.select("doc", "tie", "text", "wanted").mapInArrow(run, "h bigint, hot boolean, doc bigint, tie bigint, at bigint, part binary")


def repeated(texts: list[bytes], doc: np.ndarray, uri: str) -> np.ndarray:
    """For each text, the bits of those of its substrings of MATCH bytes that also start in a text
    with a smaller doc, from the collection's transform and common prefixes, built in files
    below ``uri``."""
    length = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    mask = np.zeros(len(texts), np.int64)
    symbols, end, opens, count = external_bwt.windows(data, np.cumsum(length) - length, length, WIDTH, MATCH // WIDTH)
    files = external_bwt.Files(uri, end)
    external_bwt.build(files, symbols, opens, count, MATCH // WIDTH, WIDTH)
    for member, size, group in external_bwt.groups(files, MATCH // WIDTH):
        own, start = member // WIDTH, member % WIDTH + WIDTH * (count[member] - size)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[own], begin), np.diff(np.append(begin, len(group))))
        later = doc[own] > least
        np.bitwise_or.at(mask, own[later], np.int64(1) << start[later])
    files.close()
    return mask


def _compared(parts: DataFrame, uri: str) -> DataFrame:
    """doc, tie, at, mask of the segments of anchors; the rows of one anchor are together."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        # A content that is no copy stands in one document only, there perhaps several times.
        place: dict[tuple[int, bytes], int] = {}
        own = np.array([place.setdefault((h, part), len(place)) for h, _, _, _, part in rows], np.int64)
        doc = np.zeros(len(place), np.int64)
        doc[own] = [row[1] for row in rows]
        mask = repeated([part for _, part in place], doc, uri)[own]
        some = np.flatnonzero(mask)
        columns = [np.array([rows[k][i] for k in some], np.int64) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(mask[some])], names=["doc", "tie", "at", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= BLOCK_SEGMENTS and rows[-1][0] != row[0]:
                    yield block(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield block(rows)
        freed()

    return parts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc bigint, tie bigint, at bigint, mask bigint")


def _by_string(parts: DataFrame) -> DataFrame:
    """The same for anchors of very many segments: each string on its own, by an aggregate."""
    each = F.transform(F.sequence(F.lit(1), F.length("part") - MATCH + 1), lambda k: F.substring("part", k, F.lit(MATCH)))
    strings = parts.select("h", "doc", "tie", "at", F.posexplode(each).alias("k", "s"))
    first = strings.groupBy("h", "s").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("h", "s", "least")
    later = strings.join(checked(stored(first, "sd-strings")), ["h", "s"]).where("doc > least")
    return later.groupBy("doc", "tie", "at").agg(F.expr("bit_or(shiftleft(1L, k))").alias("mask"))


def spans(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs from (at, mask) of a document's segments."""
    ranges = []
    for at, mask in places:
        start, k = at >> COUNT_BITS, 0
        while mask >> k:
            if mask >> k & 1:
                a = k
                while mask >> k & 1:
                    k += 1
                ranges.append((start + a, start + k - 1 + MATCH))
            else:
                k += 1
    ranges.sort()
    found: list[list[int]] = []
    for a, b in ranges:
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row.

    A null text is an empty one. doc_id identifies a document: rows without one lose nothing and
    make no other row lose anything; repeated rows give repeated results; a document with several
    texts has the strings of all of them, and each loses what it repeats itself from earlier
    documents. Texts shorter than MATCH bytes stay whole. No documents give none. Other columns are
    not read.
    """
    spark = docs.sparkSession
    every, copies = _known(docs)
    known = every.join(checked(copies), ["doc", "tie"], "left_anti")
    if not fits(copies):  # then texts are dealt out for the join, once
        known = stored(known, "sd-texts")
    anchors = _anchors(known)
    hot = stored(anchors.where(F.col("n") > HOT_ROWS).select("h", F.lit(True).alias("hot")), "sd-hot")
    rows = _rows(known, anchors)
    few = F.lit(False).alias("hot")
    if hot.isEmpty():
        found = _windows(rows).select("*", few)
    else:
        frequent = _aggregates(rows.join(checked(hot.select("h")), "h", "left_semi")).select("*", F.lit(True).alias("hot"))
        found = _windows(rows.join(checked(hot.select("h")), "h", "left_anti")).select("*", few).unionByName(frequent)
    found = stored(found, "sd-found")
    parts = stored(_cut(known, found.where("not copy")), "sd-parts")
    uri = f"{shared_dir(spark)}/tessera/sd-files"
    masks = _compared(parts.where("not hot").select("h", "doc", "tie", "at", "part"), uri)
    if not hot.isEmpty():
        masks = masks.unionByName(_by_string(parts.where("hot")))
    masks = stored(masks, "sd-masks")
    whole = F.expr(f"shiftleft(1L, cast(at & {(1 << COUNT_BITS) - 1} as int)) - 1")
    places = found.where("copy").select("doc", "tie", "at", whole.alias("mask")).unionByName(masks)
    places = stored(_merged(places.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "mask")).alias("places"))).unionByName(copies.select("doc", "tie", F.array(F.lit(0).cast("bigint"), "n").alias("runs"))), "sd-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[], [], [], [], []]
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                data, flat = _bytes(text.as_py()), runs.as_py() or []
                gone = list(zip(flat[::2], flat[1::2], strict=True))
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                values = (len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), flat)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    none = docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("doc"), "text", F.lit(None).cast("array<bigint>").alias("runs"))
    joined = every.join(checked(places, 4), ["doc", "tie"], "left").select("doc", "text", "runs").unionByName(none)
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")


def _merged(places: DataFrame) -> DataFrame:
    """doc, tie, runs: starts and ends of the removed spans in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for found in batch.column(2):
                at, mask = (found.values.field(i).to_pylist() for i in range(2))
                runs.append([x for s in spans(list(zip(at, mask, strict=True))) for x in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64()))], names=["doc", "tie", "runs"])

    return places.mapInArrow(run, "doc bigint, tie bigint, runs array<bigint>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("spans")
