"""Language identification: a byte convolutional network over fixed-length windows.

Bytes are embedded, filters of several widths slide over a window, each filter's
largest response is kept, and softmax over the learned languages follows. A text
is tiled into windows of ``WINDOW`` bytes that share the widest filter's overlap; the
prediction is the mean of the windows' probabilities, weighted by their bytes.

Training runs in numpy on a bounded sample of labelled documents that are not
held out (``SAMPLE`` per language, ``WINDOWS`` windows of each). For scoring, embedding
and filters are folded into tables of responses to single bytes and byte pairs, so that
a filter costs one or two look-ups per position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.llm.common import documents
from strandloom.llm.nets import Adam, Parameters
from strandloom.llm.toxicity import held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
# Labelled documents per language, and windows of each, that the network is fitted on.
SAMPLE, WINDOWS = 400, 4
EPOCHS, BATCH, RATE = 6, 64, 0.005
SLICES = 64
# Bytes of text scored at once.
AT_ONCE = 1_000_000
SEED = 11


def tiled(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as rows of bytes (zero behind the end), their lengths and their texts."""
    step = WINDOW - max(WIDTHS) + 1
    counts = np.where(sizes > 0, np.maximum(-(-(sizes - WINDOW) // step), 0) + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(WINDOW, sizes[text] - nth * step)
    inside = np.arange(WINDOW)[None, :] < length[:, None]
    at = (begins[text] + nth * step)[:, None] + np.arange(WINDOW)[None, :]
    return np.where(inside, data[np.where(inside, at, 0)] if len(data) else 0, 0).astype(np.uint8), length, text


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 of all texts, and where each begins and how long it is."""
    lowered = pc.cast(pc.utf8_lower(texts), pa.large_string())
    _, offsets, data = lowered.buffers()
    ends = np.frombuffer(offsets, np.int64, len(lowered) + 1, lowered.offset * 8)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(windows: np.ndarray, language: np.ndarray, languages: int) -> Parameters:
    """Fit the network on windows of bytes and the index of each one's language."""
    rng = np.random.default_rng(SEED)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"embed": normal(256, EMBEDDING, scale=0.5), "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32), "out": normal(len(WIDTHS) * FILTERS, languages, scale=0.2), "out_bias": np.zeros(languages, np.float32)}
    p |= {f"filter{w}": normal(w, EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS}
    adam = Adam(p, RATE)
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            x = windows[at]
            vectors, peaks, places = p["embed"][x], [], []
            for w in WIDTHS:
                room = WINDOW - w + 1
                response = sum(vectors[:, k : k + room] @ p[f"filter{w}"][k] for k in range(w))
                places.append(response.argmax(axis=1))
                peaks.append(np.take_along_axis(response, places[-1][:, None], axis=1)[:, 0])
            pooled = np.maximum(np.concatenate(peaks, axis=1) + p["bias"], 0)
            error = softmax(pooled @ p["out"] + p["out_bias"])
            error[np.arange(len(at)), language[at]] -= 1
            error /= len(at)
            back = (error @ p["out"].T * (pooled > 0)).astype(np.float32)
            gradients = {"out": pooled.T @ error, "out_bias": error.sum(axis=0), "bias": back.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                gradients[f"filter{w}"] = np.zeros_like(p[f"filter{w}"])
                for k in range(w):
                    seen = np.take_along_axis(x, places[i] + k, axis=1)
                    gradients[f"filter{w}"][k] = np.einsum("nf,nfd->df", g, p["embed"][seen])
                    np.add.at(gradients["embed"], seen.ravel(), (g[:, :, None] * p[f"filter{w}"][k].T[None]).reshape(-1, EMBEDDING))
            adam.update(gradients)
    return p


class Scorer:
    """The trained network with embedding and filters folded into tables."""

    def __init__(self, p: Parameters, languages: list[str]):
        self.p, self.languages = p, languages
        self.parts: list[list[tuple[int, int, np.ndarray]]] = []
        for w in WIDTHS:
            single = [(p["embed"] @ p[f"filter{w}"][k]).astype(np.float32) for k in range(w)]
            tables = [(k, 2, (single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
            self.parts.append(tables + ([(w - 1, 1, single[-1])] if w % 2 else []))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window."""
        pairs = x[:, :-1].astype(np.int64) << 8 | x[:, 1:]
        peaks = []
        for w, tables in zip(WIDTHS, self.parts):
            room = WINDOW - w + 1
            response = None
            for k, width, table in tables:
                found = table[(pairs if width == 2 else x)[:, k : k + room]]
                response = found if response is None else np.add(response, found, out=response)
            peaks.append(response.max(axis=1))
        pooled = np.maximum(np.concatenate(peaks, axis=1) + self.p["bias"], 0)
        return softmax(pooled @ self.p["out"] + self.p["out_bias"])

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Predicted language and its score for each text (no nulls)."""
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        data, begins, sizes = bytes_of(texts)
        total = np.zeros((len(texts), len(self.languages)))
        parts = np.cumsum(sizes) // AT_ONCE
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(parts)) + 1):
            x, length, text = tiled(data, begins[at], sizes[at])
            for k in range(0, len(x), 256):
                s = slice(k, k + 256)
                np.add.at(total, at[text[s]], self.windows(x[s]) * length[s, None])
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
        best = share.argmax(axis=1)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
        return names, np.where(lettered, share[np.arange(len(best)), best], 0.0)


def fitted(docs: DataFrame, per_language: int = SAMPLE) -> Scorer | None:
    """Train on up to ``per_language`` documents of each language, in the order of a hash of their id; None without any."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    chosen = known.where(~held_out(F.col("doc_id"))).withColumn("_slice", F.pmod(F.hash("doc_id"), F.lit(SLICES)))
    for keys in (["lang", "_slice"], ["lang"]):  # a language held by most rows is thinned in slices first
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
        chosen = chosen.withColumn("_place", place).where(F.col("_place") <= per_language)
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("lang").cast("string").alias("_own"), F.col("text").cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), (F.col("_doc") == F.col("_id")) & (F.col("_own") == F.col("_lang"))).where(F.col("_text").rlike(r"\p{L}"))
    rows = rows.select("_id", "_lang", "_text").orderBy("_id", "_text").collect()
    if not rows:
        return None
    languages = sorted({r["_lang"] for r in rows})
    x, _, text = tiled(*bytes_of(pa.array([r["_text"] for r in rows], pa.string())))
    nth = np.arange(len(text)) - np.searchsorted(text, text)
    order = np.random.default_rng(SEED).permutation(len(text))
    order = order[np.argsort(text[order], kind="stable")]
    used = order[nth < WINDOWS]
    return Scorer(train(x[used], np.array([languages.index(rows[i]["_lang"]) for i in text[used]]), len(languages)), languages)


def _predict_batches(scorer: Scorer | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scorer.texts(batch.column(1)) if scorer else (["und"] * len(batch), np.zeros(len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    ``und`` with score 0 where the text is null or has no letter, and for all rows
    where nothing could be learned. Ties go to the first language in order. A null doc_id
    is not held out. Repeated rows are predicted alike. Other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = narrow.mapInArrow(_predict_batches(scorer), "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identified(docs, fitted(docs))
