"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut by a rolling hash, and Spark counts the chunks' digests over all texts. A chunk that
several texts share is encoded once, by its owner, and a join delivers its ids to the others.
A chunk's ids are right only inside: its first pieces depend on what stands before it and its last
ones on what follows. So a joint is repaired by re-encoding: from the last piece that is sure
before it, over a window that grows into the chunk, and on over later chunks if need be, until a
piece of the re-encoding begins where a piece of the chunk begins. From there on both agree exactly,
as the splitter reads from left to right and pieces are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunking import chunks, delivered, sharing, with_copies
from .shared import freed, small, stored, table

#: Least and most bytes of a chunk, and the zero bits of a cut: small chunks find more sharing.
LEAST, MOST, CUT_BITS = 64, 2048, 7
#: A piece is sure when so many bytes follow it: the splitter looks at most three characters ahead.
AHEAD = 12
#: Bytes of a chunk that the first window of a repair takes; text before it that is encoded at once.
WINDOW, PENDING = 48, 1024
#: Marks, in a chunk's ids, those that begin a piece.
FIRST = np.uint32(1 << 31)
#: How byte-level tokenizers split text into pieces. A fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COLUMNS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def token_bytes(config: dict) -> list[bytes]:
    """Bytes of each id. A token's characters stand for bytes: printable ones for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    size = max([*config["model"]["vocab"].values(), *(t["id"] for t in config["added_tokens"])]) + 1
    found = [b""] * size
    for token, i in config["model"]["vocab"].items():
        found[i] = bytes(byte_of[c] for c in token)
    for t in config["added_tokens"]:
        found[t["id"]] = t["content"].encode()
    return found


def check(values: dict) -> None:
    """Raise for a tokenizer that is not plain byte-level BPE with merges in the order of ids."""
    model, split = values["model"], values["pre_tokenizer"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not values.get("normalizer") and split == split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if not plain or any(model["vocab"].get("".join(pair)) != 256 + k for k, pair in enumerate(pairs)):
        raise ValueError("not a byte-level BPE tokenizer with merges in the order of ids")


class Encoder:
    """The byte-level BPE tokenizer of a JSON file. Made in a task and dropped at its end.

    The file's merges stand in the order of their ids, so ids are ranks, and a merger by ranks gives
    the same ids four times as fast; files of another kind are refused.
    """

    def __init__(self, config: str):
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        values = json.loads(config)
        check(values)
        self.bytes_of = token_bytes(values)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.added = {t["content"]: t["id"] for t in values["added_tokens"]}
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in self.added.values()}
        self.engine = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.added)
        self.splitter = ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        self.reused = self.total = 0  # bytes whose ids came from elsewhere, and all

    def ids(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)

    def marked(self, data: bytes) -> np.ndarray:
        """Ids of a text without added tokens; those that begin a piece carry FIRST."""
        text = data.decode()
        ids = np.array(self.engine.encode_ordinary(text), np.uint32)
        begin = np.array([a for _, (a, _) in self.splitter.pre_tokenize_str(text)], np.int64)
        if not text.isascii():
            point = np.frombuffer(text.encode("utf-32-le"), "<u4")
            size = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            begin = (np.cumsum(size) - size)[begin]
        ids[np.searchsorted(self.starts(ids), begin)] |= FIRST
        return ids

    def starts(self, marked: np.ndarray) -> np.ndarray:
        """Where each id begins, in bytes."""
        size = self.length[marked & ~FIRST]
        return np.cumsum(size) - size

    def joined(self, parts: list[tuple[bytes, bytes]], taken: dict[bytes, bytes]) -> list[np.ndarray]:
        """Ids of the chunks ``parts`` that follow each other, with the ids of those taken."""
        out: list[np.ndarray] = []
        pending = b""
        for name, part in parts:
            self.total += len(part)
            if name not in taken:
                pending += part
                continue
            own = np.frombuffer(taken[name], "<u4")
            at = self.starts(own)
            sure = at[(own & FIRST) != 0]
            sure = sure[sure <= len(part) - AHEAD]
            if len(pending) > PENDING:
                pending = self._settled(pending, out)
            met = self._met(pending, part, sure) if len(sure) else None
            if met is None or met[1] >= sure[-1]:  # nothing agrees yet: on to what follows
                pending += part
                continue
            out += [met[0], own[np.searchsorted(at, met[1]) : np.searchsorted(at, sure[-1])] & ~FIRST]
            self.reused += int(sure[-1]) - met[1]
            pending = part[int(sure[-1]) :]
        if pending:
            out.append(self.ids(pending.decode()))
        return out

    def _settled(self, pending: bytes, out: list[np.ndarray]) -> bytes:
        """Encode ``pending`` but for its last sure piece and what follows, which are returned."""
        ids = self.marked(pending)
        at = self.starts(ids)
        sure = at[((ids & FIRST) != 0) & (at <= len(pending) - AHEAD)]
        if not len(sure) or not sure[-1]:
            return pending
        out.append(ids[: np.searchsorted(at, sure[-1])] & ~FIRST)
        return pending[int(sure[-1]) :]

    def _met(self, pending: bytes, part: bytes, sure: np.ndarray) -> tuple[np.ndarray, int] | None:
        """(ids of pending and the part's first bytes, how many bytes): up to the first place where
        the re-encoding and the chunk both begin a piece."""
        if not pending:
            return np.zeros(0, np.uint32), int(sure[0])
        width = WINDOW
        while True:
            end = min(width, len(part))
            while end < len(part) and part[end] & 0xC0 == 0x80:
                end += 1
            ids = self.marked(pending + part[:end])
            at = self.starts(ids) - len(pending)
            begins = at[((ids & FIRST) != 0) & (at >= 0)]
            both = np.intersect1d(begins[begins <= end - AHEAD], sure)
            if len(both):
                return ids[: np.searchsorted(at, both[0])] & ~FIRST, int(both[0])
            if end == len(part):
                return None
            width *= 2

    def assembled(self, text: str, taken: dict[bytes, bytes]) -> np.ndarray:
        """Ids of a whole text, using those of its taken chunks."""
        out: list[np.ndarray] = []
        for special, parts in pieces(text, tuple(self.added)):
            if special is not None:
                out.append(np.array([self.added[special]], np.uint32))
            else:
                out += self.joined(parts, taken)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


def pieces(text: str, added: tuple[str, ...]) -> Iterator[tuple[str | None, list[tuple[bytes, bytes]]]]:
    """The text's added tokens (token, []) and the chunks of what stands between them."""
    between = re.split("(" + "|".join(map(re.escape, added)) + ")", text) if added else [text]
    for k, part in enumerate(between):
        if k % 2:
            yield part, []
        elif part:
            yield None, chunks(part.encode(), LEAST, MOST, CUT_BITS, characters=True)


def _results(ids: np.ndarray, encoder: Encoder) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    A null text is an empty one, with no ids; equal texts are encoded once; repeated rows give
    repeated results; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text_of = f.read()
    check(json.loads(text_of))
    config = spark.sparkContext.broadcast(text_of)  # the vocabulary file, of fixed size
    added = tuple(t["content"] for t in json.loads(text_of)["added_tokens"])

    def cut(text: str | None) -> list[tuple[bytes, bytes]]:
        return [c for _, parts in pieces(text or "", added) for c in parts]

    rows, held = sharing(docs, cut, "bpe")
    types = [pa.int64(), pa.string(), pa.string()]
    item = pa.list_(pa.struct([("digest", pa.binary()), ("ids", pa.binary())]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that take nothing, and the chunks that texts give."""
        encoder, pack = Encoder(config.value), zstandard.ZstdCompressor(level=1)
        for batch in small(batches):
            out: list[list] = [[], [], [], []]
            for takes, gives, text in zip(*(batch.column(i) for i in range(3, 6)), strict=True):
                text, values, given = text.as_py() or "", (None, None, None), []
                if not takes.as_py():
                    values = _results(encoder.ids(text), encoder)
                wanted = set(gives.as_py() or ())
                for name, part in cut(text) if wanted else ():
                    if name in wanted:
                        wanted.discard(name)
                        given.append({"digest": name, "ids": pack.compress(encoder.marked(part).astype("<u4").tobytes())})
                for column, value in zip(out, (*values, given), strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, [*types, item], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *arrays], names=["doc_id", "key", "copied", *COLUMNS, "gives"])
        del encoder
        freed()

    schema = "doc_id bigint, key binary, copied boolean, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    kept = rows.where("keeps").select("doc_id", "key", "copied", "takes", "gives", "text")
    done = stored(kept.mapInArrow(first, schema + ", gives array<struct<digest:binary,ids:binary>>"), "bpe-first")
    given = done.where("size(gives) > 0").select(F.explode("gives").alias("g")).select("g.digest", "g.ids")
    parts = delivered(held.where("size(takes) > 0"), given, "ids", "bpe")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that take chunks."""
        encoder, unpack = Encoder(config.value), zstandard.ZstdDecompressor()
        for batch in small(batches):
            out: list[list] = [[], [], []]
            for text, taken in zip(batch.column(3), batch.column(4), strict=True):
                ids = {x["digest"]: unpack.decompress(x["ids"]) for x in taken.as_py()}
                for column, value in zip(out, _results(encoder.assembled(text.as_py() or "", ids), encoder), strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *arrays], names=["doc_id", "key", "copied", *COLUMNS])
        del encoder
        freed()

    taking = rows.where("keeps and size(takes) > 0").join(parts, "key").select("doc_id", "key", "copied", "text", "parts")
    ready = done.where("n_tokens is not null").drop("gives")
    found = stored(ready.unionByName(taking.mapInArrow(second, schema)), "bpe-found")
    return with_copies(rows, found, COLUMNS)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
