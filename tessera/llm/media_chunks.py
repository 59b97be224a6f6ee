"""Media columns by content-defined payload chunking.

A text's payload is its UTF-8 bytes with zeros up to a multiple of 64. A rolling gear hash cuts
it into chunks; Spark counts the chunks' digests over all documents, and of a chunk that several
documents hold only one, the owner's, is stored. The stored form of a document is its ordered
chunk list, kept beside its own chunks. Reading joins the lists with the owners' chunks, puts
every payload together again, verifies it, and computes features of its 8-bit samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunking import chunks, delivered, digest, sharing, with_copies
from .shared import small, stored, table

PAD = 64
COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % PAD or (0 if data else PAD))


def features(samples: bytes) -> str:
    """Mean, spread, entropy in bits, and share of bytes that change sign about the middle."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / max(1, len(x))
    some = share[share > 0]
    mean = float(share @ np.arange(256))
    spread = float(max(0.0, share @ np.arange(256) ** 2 - mean * mean)) ** 0.5
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"mean={mean:.4f};std={spread:.4f};entropy={-float(some @ np.log2(some)) + 0.0:.4f};turns={turns}"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the media of all texts: (media, parts).

    media: doc_id, key, copied, keeps, n_bytes, list (digests and lengths in order), own (the text's own chunks,
    compressed), foreign (whether it needs other texts' chunks); of equal texts only that with
    the least doc_id has more than its key. parts: key and the foreign chunks of a text.
    """
    rows, held = sharing(docs, lambda text: chunks(payload(text)[1]), "media")
    schema = "doc_id bigint, key binary, copied boolean, keeps boolean, n_bytes bigint, list binary, own binary, foreign boolean, gives array<struct<digest:binary,chunk:binary>>"
    item = pa.list_(pa.struct([("digest", pa.binary()), ("chunk", pa.binary())]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in small(batches):
            out: list[list] = [[], [], [], [], []]
            for keeps, takes, gives, text in zip(*(batch.column(i) for i in range(3, 7)), strict=True):
                if not keeps.as_py():
                    for column, value in zip(out, (None, None, None, False, None), strict=True):
                        column.append(value)
                    continue
                n, data = payload(text.as_py())
                takes, gives = set(takes.as_py() or ()), set(gives.as_py() or ())
                parts = chunks(data)
                own = b"".join(p for d, p in parts if d not in takes)
                out[0].append(n)
                out[1].append(b"".join(d + len(p).to_bytes(4, "little") for d, p in parts))
                out[2].append(pack.compress(own))
                out[3].append(bool(takes))
                out[4].append([{"digest": d, "chunk": pack.compress(p)} for d, p in {d: p for d, p in parts if d in gives}.items()])
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.bool_(), item), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *arrays], names=["doc_id", "key", "copied", "keeps", "n_bytes", "list", "own", "foreign", "gives"])

    media = stored(rows.mapInArrow(write, schema), "media")
    given = media.where("size(gives) > 0").select(F.explode("gives").alias("g")).select("g.digest", "g.chunk")
    return media, delivered(held, given, "chunk", "media")


def read(media: DataFrame, parts: DataFrame) -> DataFrame:
    """Put every stored payload together, verify each chunk, and compute the result columns."""
    own = ["doc_id", "key", "copied", "n_bytes", "list", "own"]
    kept = media.where("list is not null").select(*own, "foreign")
    whole = kept.where("not foreign").select(*own, F.lit(None).cast("array<struct<digest:binary,chunk:binary>>").alias("parts"))
    joined = kept.where("foreign").join(parts, "key").select(*own, "parts")
    schema = "doc_id bigint, key binary, copied boolean, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in small(batches):
            out: list[list] = [[] for _ in range(6)]
            for listed, own, extra in zip(*(batch.column(i) for i in (4, 5, 6)), strict=True):
                listed, own = listed.as_py(), unpack.decompress(own.as_py())
                foreign = {x["digest"]: unpack.decompress(x["chunk"]) for x in extra.as_py() or ()}
                built, at = [], 0
                for k in range(0, len(listed), 20):
                    name, size = listed[k : k + 16], int.from_bytes(listed[k + 16 : k + 20], "little")
                    part = foreign.get(name)
                    if part is None:
                        part, at = own[at : at + size], at + size
                    if len(part) != size or digest(part) != name:
                        raise ValueError("a stored chunk does not match its digest")
                    built.append(part)
                data = b"".join(built)
                values = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(listed) + len(data), hashlib.sha256(listed + data).hexdigest(), features(data))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *arrays], names=["doc_id", "key", "copied", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return whole.unionByName(joined).mapInArrow(reads, schema)


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` from its stored media.

    A null text is an empty one: 64 zero bytes. Equal texts are stored once and get equal values;
    repeated rows give repeated results; columns other than doc_id and text are not read. The
    stored form of a text is its chunk list (16-byte digest and 4-byte length of each chunk)
    followed by its chunks.
    """
    media, parts = store(docs)
    found = stored(read(media, parts), "media-read")
    return with_copies(media, found, COLUMNS)


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
