"""Quality classifier by compression: two zstandard dictionaries, one trained on good and one on bad
labelled text. The normalised difference of a text's two compressed sizes is its signal; a logistic
curve, fitted on whole labelled texts that trained no dictionary, makes it a probability. Beside the
difference the curve has terms for the size itself and for the length, since a dictionary helps a
short or repetitive text differently; the difference alone is reported, too."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checked, small, stored, table

#: Rows with this remainder of crc32(doc_id) modulo FOLDS are held out from all learning;
#: those with CALIBRATION set the probability; the others train the dictionaries.
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
#: The bounded sample: labelled texts of each label and purpose. Calibration reads them whole. For a
#: dictionary at most PIECES pieces of PIECE_BYTES are taken from each, spread evenly over the whole
#: of it (all of it where it is no longer than that). Then bytes of a dictionary, and the level.
SAMPLE_ROWS = 1500
PIECES, PIECE_BYTES = 8, 2048
DICT_BYTES = 112_640
LEVEL = 3
#: How good a text without content is, before any such text was seen labelled, and the weight of that.
EMPTY_SCORE, EMPTY_WEIGHT = 0.1, 2.0
#: Weights where no labelled text is left to calibrate with: the size difference alone.
UNCALIBRATED = (60.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
#: A text is predicted good from this score on.
THRESHOLD = 0.3


def fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:]


def spread(text: bytes) -> list[bytes]:
    """Pieces of a text, spread evenly over the whole of it."""
    if len(text) <= PIECES * PIECE_BYTES:
        return [text[k : k + PIECE_BYTES] for k in range(0, len(text), PIECE_BYTES)]
    return [text[a : a + PIECE_BYTES] for a in ((len(text) - PIECE_BYTES) * k // (PIECES - 1) for k in range(PIECES))]


class Model:
    """Both dictionaries and the calibration; small enough to travel with the tasks."""

    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, ...] = UNCALIBRATED, empty: float = EMPTY_SCORE):
        self.good, self.bad, self.weights, self.empty = good, bad, weights, empty

    def compressors(self) -> tuple:
        return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) if d else None for d in (self.good, self.bad))

    @staticmethod
    def sizes(text: bytes, pair: tuple) -> tuple[float, ...]:
        """How much smaller the good dictionary makes a text than the bad one, per byte; the
        good one's size per byte and its square, as repetition hardly needs a dictionary; and,
        as a dictionary helps a short text more, both with the logarithm of the length."""
        if not text or None in pair:
            return (0.0,) * 7
        good, bad = (len(c.compress(text)) / len(text) for c in pair)
        long = math.log(len(text) + 30) - 7
        return bad - good, good, good * good, 1.0, long, (bad - good) * long, good * long

    def score(self, text: bytes, pair: tuple) -> float:
        if not text:
            return self.empty
        z = sum(w * x for w, x in zip(self.weights, self.sizes(text, pair), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _calibrated(sizes: list[tuple[float, ...]], labels: list[int]) -> tuple[float, ...]:
    """Weights of a logistic curve through labelled sizes, by Newton's method with a small
    penalty; both labels weigh alike."""
    if len(set(labels)) < 2:
        return UNCALIBRATED
    x, y = np.array(sizes), np.array(labels, float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - 1e-6 * w
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 20 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _picked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, use and text of the sample: SAMPLE_ROWS of each label and purpose, those
    with the least hash of their doc_id. A doc_id with several labels counts as good if any says
    so; of its texts, the one with the least hash stands for it."""
    wanted = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
    wanted = wanted.select("doc_id", "quality", (F.col("fold") == CALIBRATION).cast("int").alias("use"))
    chosen = []
    for quality in (0, 1):
        for use in (0, 1):
            chosen.append(wanted.where((F.col("quality") == quality) & (F.col("use") == use)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    picked = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).unionByName(chosen[3])
    picked = stored(picked.coalesce(1), "zstd-sample")  # at most 4 * SAMPLE_ROWS rows
    texts = docs.select("doc_id", "text").join(checked(picked), "doc_id")
    one = texts.groupBy("doc_id", "quality", "use").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return stored(one, "zstd-texts")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the bounded sample of labelled rows. Pieces are taken, and whole texts measured, on
    the executors; the driver gets the pieces and the sizes."""
    texts = _picked(docs, labels)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [spread((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "quality", "pieces"])

    train = texts.where("use = 0").select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"), "text")
    rows = sorted(train.mapInArrow(pieces, "doc_id bigint, quality int, pieces array<binary>").collect(), key=lambda r: r["doc_id"])
    take = lambda quality: [bytes(p) for r in rows if r["quality"] == quality for p in r["pieces"]]
    model = Model(_dictionary(take(1)), _dictionary(take(0)))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in small(batches):
            found = [list(Model.sizes(t, pair)) if t else None for t in ((t.as_py() or "").encode() for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "quality", "sizes"])

    check = texts.where("use = 1").select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"), "text")
    seen = sorted(check.mapInArrow(sizes, "doc_id bigint, quality int, sizes array<double>").collect(), key=lambda r: r["doc_id"])
    full, empty = [r for r in seen if r["sizes"]], [r["quality"] for r in seen if not r["sizes"]]
    model.weights = _calibrated([tuple(r["sizes"]) for r in full], [r["quality"] for r in full])
    model.empty = (sum(empty) + EMPTY_SCORE * EMPTY_WEIGHT) / (len(empty) + EMPTY_WEIGHT)
    return model


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """doc_id, the columns ``keep`` and the score, called ``name``, of every row of ``docs``.

    Whole texts are compressed. A null or empty text gets the share of good ones among labelled
    texts without content, EMPTY_SCORE where none was seen; equal texts get equal scores; no column
    but the text enters a score; a tie with a threshold is for the caller to decide.
    """
    kept = docs.select("doc_id", *[c for c in keep if c not in ("doc_id", "text")], "text")
    names = list(dict.fromkeys(["doc_id", *keep]))
    schema = kept.select(*names, F.lit(0.0).alias(name)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            found = [round(model.score(t.as_py() or b"", pair), 6) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*names, name])

    return kept.mapInArrow(scored, schema)


def difference(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the normalised size difference alone, uncalibrated; 0 for an empty text."""
    alone = Model(model.good, model.bad, (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), 0.5)
    return score(docs, alone, name="p").select("doc_id", F.log(F.col("p") / (1 - F.col("p"))).alias("difference"))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
