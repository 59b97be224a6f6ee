"""Content-defined chunks and which texts share them.

A rolling gear hash cuts bytes where the last 32 of them say so. Spark counts the chunks' digests
over all texts; of a chunk that several texts hold, the text with the least key is the owner.
Texts are known by the MD5 of their bytes, so equal texts are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checked, small, stored

#: Least and most bytes of a chunk; a cut needs this many zero bits on top of the gear hash.
LEAST, MOST, CUT_BITS = 512, 16_384, 11
#: Bytes hashed at once, to bound memory whatever the batch.
SLICE = 4 << 20

_GEAR = np.array([int.from_bytes(hashlib.md5(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the last 32 bytes at every byte: the sum of gear values, each shifted by
    its distance, built by doubling the span five times."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        if len(h) > span:
            h = np.concatenate([h[:span], h[span:] + (h[:-span] << np.uint32(span))])
    return h


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of ``data``; equal content is cut alike wherever it stands."""
    ends, start, n = [], 0, len(data)
    for base in range(0, n, SLICE):
        lead = min(base, 31)
        piece = np.frombuffer(data, np.uint8, min(SLICE, n - base) + lead, base - lead)
        for at in np.flatnonzero(gear(piece)[lead:] >> np.uint32(32 - bits) == 0) + base + 1:
            while at - start > most:
                start += most
                ends.append(start)
            if at - start >= least:
                start = int(at)
                ends.append(start)
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def chunks(data: bytes, least: int = LEAST, most: int = MOST, bits: int = CUT_BITS, characters: bool = False) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order; with ``characters`` a cut inside a UTF-8 character
    moves to that character's end, which equal content does alike."""
    start, found = 0, []
    for end in cuts(data, least, most, bits):
        while characters and end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end <= start:
            continue
        part = data[start:end]
        found.append((digest(part), part))
        start = end
    return found


def text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def digests(docs: DataFrame, cut: Callable[[str | None], list[tuple[bytes, bytes]]]) -> DataFrame:
    """key, digest: the different chunks of each text; ``cut`` gives a text's (digest, bytes)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, parts = [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                own = {d for d, _ in cut(text.as_py())}
                keys += [key.as_py()] * len(own)
                parts += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(parts, pa.binary())], names=["key", "digest"])

    return docs.select(text_key().alias("key"), "text").mapInArrow(found, "key binary, digest binary")


def sharing(docs: DataFrame, cut: Callable[[str | None], list[tuple[bytes, bytes]]], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, held). held: key and the digests that a text takes from others and gives to them,
    for texts with shared chunks. rows: doc_id, key, copied, keeps, takes, gives, text, where
    copied marks texts that several rows have, and keeps, of those, that with the least doc_id.

    A digest of very many texts is counted with partial sums, and joined as a broadcast or by a
    sort-merge join of two plain exchanges, which AQE splits where one key is large."""
    all_digests = stored(digests(docs, cut), f"{name}-digests")
    seen = all_digests.groupBy("digest").agg(F.min("key").alias("owner"), F.max("key").alias("other"))
    shared = stored(seen.where("owner <> other").select("digest", "owner"), f"{name}-shared")
    mine = F.col("owner") == F.col("key")
    held = all_digests.join(checked(shared), "digest").groupBy("key").agg(
        F.collect_set(F.when(~mine, F.col("digest"))).alias("takes"), F.collect_set(F.when(mine, F.col("digest"))).alias("gives")
    )
    held = stored(held, f"{name}-held")
    copies = docs.groupBy(text_key().alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first", F.lit(True).alias("copied"))
    copies = stored(copies, f"{name}-copies")
    rows = docs.select("doc_id", text_key().alias("key"), "text").join(checked(held), "key", "left").join(checked(copies), "key", "left")
    copied = F.coalesce("copied", F.lit(False))
    keeps = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("doc_id"))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "key", copied.alias("copied"), keeps.alias("keeps"), "takes", "gives", "text"), held


def delivered(held: DataFrame, given: DataFrame, value: str, name: str) -> DataFrame:
    """key, parts: what each text takes, from the owners' (digest, ``value``) rows, which are
    stored first: then both sides of the join are plain exchanges."""
    wanted = held.select("key", F.explode("takes").alias("digest"))
    once = stored(given.dropDuplicates(["digest"]), f"{name}-given")
    return wanted.join(checked(once), "digest").groupBy("key").agg(F.collect_list(F.struct("digest", value)).alias("parts"))


def with_copies(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id and ``columns`` of every row. found (stored): doc_id, key, copied and the columns of
    the rows that keep their text; the other rows of a text get those of one that keeps it."""
    once = stored(found.where("copied").select("key", *columns).dropDuplicates(["key"]), "copied")
    others = rows.where("not keeps").select("doc_id", "key").join(checked(once), "key")
    return found.select("doc_id", *columns).unionByName(others.select("doc_id", *columns))
