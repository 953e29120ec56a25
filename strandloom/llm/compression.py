"""Quality by compression: which of two dictionaries, of good and of bad text, shortens a text more.

Two zstandard dictionaries are built from segments of labelled good and bad texts. Every text is cut into
segments of ``SEGMENT`` bytes over its whole length, and each segment is compressed alone with
either dictionary, so that the dictionaries matter as much at the end of a long text as at its
start. The difference of the two sizes, divided by their sum, says which kind of text it is like; with the
logarithm of the compressed share (texts that repeat themselves shrink under both dictionaries) it is
calibrated into a score by a logistic regression on labelled texts that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import documents, scratch, text_of

SEGMENT = 256
# Labelled documents per label: one half for the dictionary, one half for the calibration.
SAMPLE = 2000
# Segments of a sampled text that go into the dictionary's training, spread over the text.
SEGMENTS_PER_TEXT = 16
DICTIONARY_BYTES = 32768
LEVEL = 9
ACCEPTED = 0.7
# Bytes of a frame around any segment, taken off.
FRAME = 5


def segments(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]


def spread_segments(text: str, most: int = SEGMENTS_PER_TEXT) -> list[bytes]:
    """At most ``most`` segments, evenly spread."""
    every = segments(text)
    return [every[i] for i in sorted({len(every) * k // most for k in range(most)})] if every else []


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; from too few samples to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, float]:
        """Normalised difference of the sizes (above 0: nearer to good text), log of the compressed share."""
        parts = segments(text)
        good, bad = (sum(max(len(c.compress(p)) - FRAME, 1) for p in parts) for c in self.compressors)
        raw = sum(map(len, parts))
        return (bad - good) / (good + bad + 20), float(np.log((good + bad + 20) / (2 * raw + 20)))


class Calibration:
    """Logistic regression on both features up to their squares, with a ridge of 1 on standardised features."""

    def __init__(self, features: np.ndarray, good: np.ndarray):
        self.mean, self.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
        rows, self.weights = self._terms(features), np.zeros(6)
        for _ in range(60):
            chance = self._chance(rows)
            curve = (rows * (chance * (1 - chance))[:, None]).T @ rows + np.eye(6)
            step = np.linalg.solve(curve, rows.T @ (good - chance) - self.weights)
            self.weights += step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))

    def _terms(self, features: np.ndarray) -> np.ndarray:
        a, r = np.clip((features - self.mean) / self.scale, -6, 6).T
        return np.stack([np.ones(len(a)), a, r, a * a, a * r, r * r], axis=1)

    def _chance(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))

    def score(self, features: np.ndarray) -> np.ndarray:
        return self._chance(self._terms(features))


class Model:
    """Both dictionaries and the calibration; without both labels a constant."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", calibration: Calibration | None = None, constant: float = 0.0):
        self.good, self.bad, self.calibration, self.constant = good, bad, calibration, constant

    def scores(self, sizes: Sizes, texts: Iterator[str]) -> np.ndarray:
        return self.calibration.score(np.array([sizes.features(t) for t in texts]).reshape(-1, 2))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """_id, _label, _half, _text of up to ``per_label`` documents of each label that are not held out; written to the shared folder.

    Taken in the order of a hash of the id; the halves are every other row of it. A document labelled twice is
    taken once, as good if any label is 1.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max("quality").cast("int").alias("_label"))
    rows = rows.withColumn("_half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)))
    order = [F.xxhash64("_id"), F.col("_id")]
    quarters = [rows.where((F.col("_label") == label) & (F.col("_half") == half)).orderBy(*order).limit(max(1, per_label // 2)) for label in (0, 1) for half in (0, 1)]
    chosen = quarters[0].unionByName(quarters[1]).unionByName(quarters[2]).unionByName(quarters[3])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), text_of().alias("_text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_label", "_half").agg(F.min("_text").alias("_text"))
    return scratch(found, "labelled")


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = [spread_segments(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.list_(pa.binary()))], names=["_id", "_label", "_segments"])


def _feature_batches(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            found = np.array([sizes.features(t.as_py()) for t in batch.column(2)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["_id", "_label", "_difference", "_share"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Model:
    """Dictionaries and calibration from at most ``per_label`` documents of each label.

    What reaches the driver is bounded: ``SEGMENTS_PER_TEXT`` segments per text of one half, two numbers per text of the other.
    """
    rows = sampled(docs, labels, per_label).select("_id", "_label", "_text", "_half")
    cut = rows.where("_half = 0").drop("_half").mapInArrow(_segment_batches, "_id bigint, _label int, _segments array<binary>").collect()
    cut.sort(key=lambda r: r["_id"])
    good, bad = ([bytes(s) for r in cut if r["_label"] == label for s in r["_segments"]] for label in (1, 0))
    if not good or not bad:
        return Model(constant=float(bool(good)))
    good, bad = dictionary(good), dictionary(bad)
    found = rows.where("_half = 1").drop("_half").mapInArrow(_feature_batches(good, bad), "_id bigint, _label int, _difference double, _share double").collect()
    found.sort(key=lambda r: r["_id"])
    if len({r["_label"] for r in found}) < 2:
        # Too few labels for a half of their own: a plain rise over the difference of the sizes.
        features, told = np.array([[0.1, 0.0], [-0.1, 0.0]]), np.array([1.0, 0.0])
    else:
        features, told = np.array([[r["_difference"], r["_share"]] for r in found]), np.array([float(r["_label"]) for r in found])
    return Model(good, bad, Calibration(features, told))


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.calibration else None
        for batch in batches:
            texts = batch.column(1)
            scores = model.scores(sizes, (t.as_py() for t in texts)) if sizes else np.full(len(texts), model.constant)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have no segment and get the calibrated score of the difference 0. Without labels of both kinds all
    scores are 1 (only good ones) or 0. A null doc_id is not held out. Repeated rows are scored alike. Other columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(_score_batches(model), "doc_id bigint, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
