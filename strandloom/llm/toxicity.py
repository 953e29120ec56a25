"""Toxicity: a bidirectional gated recurrent network with attention pooling, over characters and words.

Every word enters as two vectors: one made of all its characters at their
positions, one of the word itself (hashed). The network reads overlapping windows of
``WINDOW`` words, half a window apart, over the whole text; attention pools the
states of a window into one logit. A document scores as its worst window.

Training needs only document labels: the windows of a document are combined by
noisy-or, so that one bad window makes a document toxic and a clean document
makes all its windows clean. It runs in numpy on a bounded sample of the labelled
rows that are not held out (``SAMPLE`` per label); scoring runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandloom.llm.common import documents, text_of
from strandloom.llm.nets import Adam, Parameters, sigmoid, summed

WINDOW = 32
STRIDE = WINDOW // 2
# Labelled documents per label that the network is fitted on.
SAMPLE = 800
# Steps of training, whatever the size of the sample, and documents per step.
STEPS = 400
DOCS_PER_STEP = 32
RATE = 0.01
# Characters: code points below CHARS - 128 as they are, others folded; positions from the word's start, the last shared.
CHARS, POSITIONS = 512, 12
CHAR_DIM, WORD_DIM, WORD_BUCKETS, HIDDEN = 24, 8, 4096, 8
# Windows that run through the network at once, and characters of text read at once.
BATCH = 2048
AT_ONCE = 2_000_000
SEED = 7


class Words:
    """The words of some texts: distinct ones with their features, and every text's words as indices."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\p{M}]+")
        coded = lists.flatten().dictionary_encode()
        lengths = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
        index = coded.indices.to_numpy()
        real = lengths[index] > 0
        self.stops = np.r_[0, np.cumsum(real)][np.cumsum(lists.value_lengths().to_numpy())] if len(texts) else np.zeros(0, np.int64)
        renumber = np.cumsum(lengths > 0) - 1
        self.index = renumber[index[real]]
        lengths = lengths[lengths > 0]
        points = np.frombuffer("".join(coded.dictionary.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.starts = np.cumsum(lengths) - lengths
        place = np.arange(len(points)) - np.repeat(self.starts, lengths)
        folded = np.where(points < CHARS - 128, points, CHARS - 128 + points % 128)
        self.chars = np.minimum(place, POSITIONS - 1) * CHARS + folded
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x100000001B3, np.uint64))
        mixed = np.add.reduceat(powers[place] * (points + 1).astype(np.uint64), self.starts) if len(lengths) else np.zeros(0, np.uint64)
        self.buckets = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64)

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and number of words of every window, and the text it belongs to; an empty text has none."""
        begins = np.r_[0, self.stops[:-1]].astype(np.int64)
        sizes = self.stops - begins
        counts = np.where(sizes > 0, np.maximum(-(-(sizes - WINDOW) // stride), 0) + 1, 0)
        text = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = begins[text] + nth * stride
        return first, np.minimum(WINDOW, self.stops[text] - first), text


def initial(rng: np.random.Generator) -> Parameters:
    width, h = CHAR_DIM + WORD_DIM, HIDDEN
    shapes = {"char": (POSITIONS * CHARS, CHAR_DIM), "char_bias": (CHAR_DIM,), "word": (WORD_BUCKETS, WORD_DIM), "input": (width, 6 * h), "gate_bias": (6 * h,), "state": (2, h, 3 * h), "attend": (2 * h,), "out": (2 * h,), "out_bias": (1,)}
    scale = {"char": 0.3, "word": 0.1, "char_bias": 0, "gate_bias": 0, "out_bias": 0, "attend": 0.3, "out": 0.3}
    made = {k: (rng.standard_normal(s) * scale.get(k, s[-2] ** -0.5 if len(s) > 1 else 0.3)).astype(np.float32) for k, s in shapes.items()}
    made["out_bias"] -= 3
    return made


def _inputs(p: Parameters, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Input vector of every distinct word, and what it gives to the gates of both directions."""
    if not len(words.starts):
        return np.zeros((0, CHAR_DIM + WORD_DIM), np.float32), np.zeros((0, 6 * HIDDEN), np.float32)
    chars = np.concatenate([np.add.reduceat(p["char"][part], starts, axis=0) for part, starts in _parts(words)])
    vectors = np.concatenate([np.tanh(chars + p["char_bias"]), p["word"][words.buckets]], axis=1)
    return vectors, vectors @ p["input"] + p["gate_bias"]


def _parts(words: Words, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Characters and word starts, some whole words at a time."""
    ends = np.r_[words.starts[1:], len(words.chars)]
    groups = np.flatnonzero(np.diff(ends // most)) + 1
    for at in np.split(np.arange(len(ends)), groups):
        begin = words.starts[at[0]]
        yield words.chars[begin : ends[at[-1]]], words.starts[at] - begin


def _forward(p: Parameters, gates: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray, keep: bool):
    """Logits of windows; with ``keep`` also what the gradient needs."""
    h, n, steps = HIDDEN, len(first), int(size.max(initial=1))
    at = first[None, :] + np.minimum(np.arange(steps)[:, None], size[None, :] - 1)
    there = np.arange(steps)[:, None] < size[None, :]
    word = index[at]
    given = gates[word].reshape(steps, n, 2, 3 * h)
    state, states, kept = np.zeros((2, n, h), np.float32), np.empty((steps, n, 2 * h), np.float32), []
    for t in range(steps):
        back = steps - 1 - t
        x = np.stack([given[t, :, 0], given[back, :, 1]])
        m = np.stack([there[t], there[back]])[:, :, None]
        a = state @ p["state"]
        g = sigmoid(x[..., : 2 * h] + a[..., : 2 * h])
        r, z = g[..., :h], g[..., h:]
        c = np.tanh(x[..., 2 * h :] + r * a[..., 2 * h :])
        after = np.where(m, c + z * (state - c), state)
        if keep:
            kept.append((state, a, r, z, c, m))
        state = after
        states[t, :, :h], states[back, :, h:] = state[0], state[1]
    score = np.where(there, states @ p["attend"], -1e9)
    share = np.exp(score - score.max(axis=0))
    share = (share * there / (share * there).sum(axis=0)).astype(np.float32)
    pooled = np.einsum("tb,tbh->bh", share, states)
    logit = pooled @ p["out"] + p["out_bias"][0]
    return logit, (word, there, states, share, pooled, kept)


def _backward(p: Parameters, words: Words, vectors: np.ndarray, cache, grad: np.ndarray) -> Parameters:
    """Gradients of all parameters from the gradient of the logits."""
    word, there, states, share, pooled, kept = cache
    h, steps, n = HIDDEN, *share.shape
    g_pooled = grad[:, None] * p["out"]
    g_share = np.einsum("bh,tbh->tb", g_pooled, states)
    g_score = share * (g_share - (share * g_share).sum(axis=0))
    g_states = share[:, :, None] * g_pooled + g_score[:, :, None] * p["attend"]
    out = {"out": grad @ pooled, "out_bias": np.array([grad.sum()], np.float32), "attend": np.einsum("tb,tbh->h", g_score, states)}
    g_given, g_state, g_matrix = np.zeros((steps, n, 2, 3 * h), np.float32), np.zeros((2, n, h), np.float32), np.zeros_like(p["state"])
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        g = g_state + np.stack([g_states[t, :, :h], g_states[back, :, h:]])
        before, a, r, z, c, m = kept[t]
        live = np.where(m, g, 0)
        g_c = live * (1 - z) * (1 - c * c)
        g_r = g_c * a[..., 2 * h :] * r * (1 - r)
        g_z = live * (before - c) * z * (1 - z)
        g_a = np.concatenate([g_r, g_z, g_c * r], axis=-1)
        g_x = np.concatenate([g_r, g_z, g_c], axis=-1)
        g_matrix += before.transpose(0, 2, 1) @ g_a
        g_state = np.where(m, g * z, g) + g_a @ p["state"].transpose(0, 2, 1)
        g_given[t, :, 0] += g_x[0]
        g_given[back, :, 1] += g_x[1]
    g_gates = summed(word.ravel(), g_given.reshape(steps * n, 6 * h), len(vectors))
    g_vectors = g_gates @ p["input"].T
    g_chars = g_vectors[:, :CHAR_DIM] * (1 - vectors[:, :CHAR_DIM] ** 2)
    lengths = np.diff(np.r_[words.starts, len(words.chars)])
    return out | {
        "state": g_matrix,
        "input": vectors.T @ g_gates,
        "gate_bias": g_gates.sum(axis=0),
        "word": summed(words.buckets, g_vectors[:, CHAR_DIM:], WORD_BUCKETS),
        "char": summed(words.chars, np.repeat(g_chars, lengths, axis=0), POSITIONS * CHARS),
        "char_bias": g_chars.sum(axis=0),
    }


def train(texts: list[str], toxic: np.ndarray, steps: int = STEPS) -> Parameters | None:
    """Fit the network; None if the sample does not show both labels."""
    if len(set(toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    p = initial(rng)
    adam = Adam(p, RATE)
    epochs = -(-steps // max(1, len(texts) // DOCS_PER_STEP))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in np.array_split(order, max(1, len(order) // DOCS_PER_STEP)):
            words = Words(pa.array([texts[i] for i in at], pa.string()))
            first, size, text = words.windows(WINDOW)
            if not len(first):
                continue
            vectors, gates = _inputs(p, words)
            logit, cache = _forward(p, gates, words.index, first, size, True)
            chance = sigmoid(logit)
            # log of the chance that all windows of a document are clean
            clean = np.bincount(text, -np.logaddexp(0, logit), len(at))
            y = toxic[at].astype(float)
            weight = np.where(y > 0, -1 / np.maximum(np.expm1(-clean), 1e-6), 1.0) / len(at)
            adam.update(_backward(p, words, vectors, cache, (chance * weight[text]).astype(np.float32)))
    return p


def score_texts(p: Parameters, texts: pa.Array) -> np.ndarray:
    """Chance of toxicity of each text: that of its worst window."""
    words = Words(texts)
    first, size, text = words.windows()
    best = np.full(len(texts), p["out_bias"][0], np.float64)
    best[np.unique(text)] = -np.inf
    _, gates = _inputs(p, words)
    for at in range(0, len(first), BATCH):
        part = slice(at, at + BATCH)
        logit, _ = _forward(p, gates, words.index, first[part], size[part], False)
        np.maximum.at(best, text[part], logit)
    return sigmoid(best)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of up to ``per_label`` labelled documents of each label that are not held out.

    Documents are taken in the order of a hash of their id. A document labelled twice is
    taken once, as 1 if any label is 1.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = rows.where("_label = 1").orderBy(*order).limit(per_label).unionByName(rows.where("_label = 0").orderBy(*order).limit(per_label))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), text_of().alias("_text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_label").agg(F.min("_text").alias("_text")).orderBy("_id").collect()
    return [r["_text"] for r in found], np.array([r["_label"] for r in found], np.int64)


def _score_batches(p: Parameters | None, text: int, kept: int):
    """Function for ``mapInArrow``: the first ``kept`` columns and ``_score`` of the text at place ``text`` (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text).cast(pa.string()), "")
            parts = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
            scores = [score_texts(p, texts.slice(a, b - a)) if p else np.zeros(b - a) for a, b in zip(cuts, cuts[1:])]
            columns = [batch.column(i) for i in range(kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(scores), pa.float64())], names=[*batch.schema.names[:kept], "_score"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Parameters | None:
    return train(*sampled(docs, labels, "toxic", per_label))


def scored(docs: DataFrame, p: Parameters | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts get the score of no words at all, near 0. Without labels of
    both kinds every score is 0. A null doc_id is not held out. Repeated rows are scored
    alike. Other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("_text"))
    found = narrow.mapInArrow(_score_batches(p, 1, 1), "doc_id bigint, _score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts are scored as texts without words and stay, repeated rows are judged alike and all stay or go, an
    empty table stays empty, and without labels of both kinds every document stays. Columns of any type and name pass through.
    """
    p = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fields = docs.schema.fields
    text = next(i for i, f in enumerate(fields) if f.name.lower() == "text")
    kept = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)])
    schema = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)], StructField("_score", DoubleType())])
    clean = kept.mapInArrow(_score_batches(p, text, len(fields)), schema).where("_score < 0.5")
    return clean.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)])
