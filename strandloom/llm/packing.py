"""Packing token pieces into sequences: configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits into one sequence. The linear
program asks for the least total of configuration counts that covers the number of
pieces of every length. It is solved by multiplicative weights: every length has a
weight, its dual price times its pieces. Each step takes the configuration that is worth most at these
prices, as often as its scarcest length allows, and lowers the weights of the lengths it covers,
each by its covered share. Every few steps a knapsack dynamic program over the capacity prices all configurations and adds the
best to those at hand; its best value also gives a lower bound on the number of sequences. The
counts are rounded to whole numbers; what does not come out even is packed by longest piece
first and the fullest rest that subset sums reach. Where that rule alone, or best fit decreasing, needs fewer
sequences than the rounded program, as can be with few pieces of very many lengths, it is taken instead.

Only the histogram (at most ``capacity`` rows) is solved on the driver. Pieces get
their rank within their length from counts per (length, hash slice), so no length
goes through one task, and find sequence and offset from the rank by a
table of configurations whose size does not depend on the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.llm.common import documents, scratch, text_of
from strandloom.llm.tokens import word_ids

CAPACITY = 2048
# Steps of the multiplicative weights, steps between two pricings, and configurations that one pricing adds at most.
STEPS, PRICED, ADDED = 20_000, 200, 32
# A weight falls by at most this rate in one step: less with few lengths, where more steps fall on each.
RATES = (0.05, 0.5)
# Hash slices within a length for ranking: at least so many, and one for so many pieces in all.
SLICES, PIECES_PER_SLICE = 256, 50_000
# Characters of text tokenized at once.
AT_ONCE = 4_000_000


def knapsack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity: the best value of a multiset of lengths that fits, and one length to take (0: leave a unit).

    ``values[length]`` is what a piece of that length is worth; lengths not worth anything are never taken.
    """
    capacity = len(values) - 1
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = best[room - 1 :: -1] + values[1 : room + 1]
        top = int(gain.argmax())
        take = gain[top] > best[room - 1] and values[top + 1] > 0
        best[room], choice[room] = (gain[top], top + 1) if take else (best[room - 1], 0)
    return best, choice


def filled(choice: np.ndarray, room: int) -> list[int]:
    """The lengths that ``knapsack`` takes into ``room``."""
    taken = []
    while room:
        if choice[room]:
            taken.append(int(choice[room]))
        room -= max(int(choice[room]), 1)
    return taken


class Program:
    """The covering program's multiplicative weights, over the configurations at hand.

    ``amounts`` counts how often each configuration (lengths, ascending) was taken, ``covered`` how
    often that covers each length's pieces, ``bound`` is the least number of sequences by the best prices so far.
    """

    def __init__(self, histogram: np.ndarray):
        self.capacity = len(histogram) - 1
        self.lengths = np.flatnonzero(histogram)
        self.demand = histogram[self.lengths].astype(float)
        self.place = np.full(self.capacity + 1, -1)
        self.place[self.lengths] = np.arange(len(self.lengths))
        # Weights of equal prices per unit of length, in logarithms.
        self.weight = np.log(self.lengths * self.demand)
        self.weight -= self.weight.max()
        self.patterns: dict[tuple[int, ...], int] = {}
        self.used: list[tuple[np.ndarray, np.ndarray]] = []
        self.table = np.zeros((len(self.lengths), len(self.lengths) + 256), np.float32)
        self.amounts: list[float] = []
        self.covered = np.zeros(len(self.lengths))
        self.bound = float(np.ceil((self.lengths * self.demand).sum() / self.capacity))

    def prices(self) -> np.ndarray:
        return np.exp(self.weight - self.weight.max()) / self.demand

    def price(self, most: int) -> None:
        """Price all configurations; the best that hold each length, best first, come to those at hand."""
        prices = self.prices()
        values = np.full(self.capacity + 1, -1.0)
        values[self.lengths] = prices
        best, choice = knapsack(values)
        self.bound = max(self.bound, float((prices * self.demand).sum() / best[self.capacity]))
        worth = prices + best[self.capacity - self.lengths]
        added = 0
        for i in np.argsort(-worth, kind="stable").tolist():
            length = int(self.lengths[i])
            pattern = (*sorted([*filled(choice, self.capacity - length), length]),)
            if pattern not in self.patterns:
                self._add(pattern)
                added += 1
                if added >= most:
                    break

    def _add(self, pattern: tuple[int, ...]) -> None:
        column = len(self.used)
        self.patterns[pattern] = column
        used, times = np.unique(self.place[list(pattern)], return_counts=True)
        self.used.append((used, times.astype(float)))
        self.amounts.append(0.0)
        if column == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros((len(self.lengths), 1024), np.float32)], axis=1)
        self.table[used, column] = times

    def run(self, steps: int) -> None:
        m = len(self.lengths)
        rate = float(np.clip(np.sqrt(m * np.log(m + 1) / steps), *RATES))
        for step in range(steps):
            if step % PRICED == 0:
                self.price(m if step == 0 else ADDED)
                prices = self.prices()
                worth = (prices.astype(np.float32) @ self.table[:, : len(self.used)]).astype(float)
            column = int(worth.argmax())
            used, times = self.used[column]
            amount = float((self.demand[used] / times).min())
            share = amount * times / self.demand[used]
            self.amounts[column] += amount
            self.covered[used] += share
            self.weight[used] -= rate * share
            fallen = prices[used] * (1 - np.exp(-rate * share))
            prices[used] -= fallen
            worth -= fallen @ self.table[used, : len(self.used)]

    def solution(self) -> dict[tuple[int, ...], float]:
        """Counts scaled so that the mean piece is covered once."""
        mean = float((self.covered * self.lengths * self.demand).sum() / (self.lengths * self.demand).sum())
        return {p: self.amounts[c] / mean for p, c in self.patterns.items() if self.amounts[c] > 0}


def rounded(histogram: np.ndarray, counts: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations that hold every piece exactly once.

    The configurations of ``counts`` are taken rounded down, then up, most used first,
    while their pieces are there. What remains is packed by the longest piece and the fullest sum of
    others, taken as often as it goes: each step uses up a length, or brings it below
    the number of times it fits into a sequence, so the number of steps is bounded by the capacity alone.
    """
    capacity, left, chosen = len(histogram) - 1, histogram.copy(), []

    def take(pattern: tuple[int, ...], most: int) -> int:
        used, times = np.unique(pattern, return_counts=True)
        n = min(most, int((left[used] // times).min()))
        if n > 0:
            left[used] -= n * times
            chosen.append((pattern, n))
        return max(n, 0)

    order = sorted(counts.items(), key=lambda c: (-c[1], c[0]))
    taken = {pattern: take(pattern, int(amount + 1e-9)) for pattern, amount in order}
    for pattern, amount in order:
        if sum(pattern) >= capacity - int(np.flatnonzero(histogram)[0]):  # nothing more would fit
            take(pattern, int(np.ceil(amount - 1e-9)) - taken[pattern])
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        rest = fullest(left, capacity - longest)
        left[longest] += 1
        take((*sorted(rest), longest), int(left[longest]))
    return chosen


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing, all sequences with the same content at once."""
    capacity = len(histogram) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    for length in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[length])
        for room in sorted(r for r in open_ if r >= length):
            each, groups = room // length, open_.get(room, []) if room < capacity else []
            while left and groups:
                pattern, n = groups.pop()
                full = min(n, left // each)
                if full:
                    open_.setdefault(room - each * length, []).append(((length,) * each + pattern, full))
                    left -= full * each
                elif left:
                    open_.setdefault(room - left * length, []).append(((length,) * left + pattern, 1))
                    full, left = 1, 0
                if n > full:
                    groups.append((pattern, n - full))
        if left:
            each = capacity // length
            for n, times in ((left // each, each), (1 if left % each else 0, left % each)):
                if n:
                    open_.setdefault(capacity - times * length, []).append(((length,) * times, n))
    return [(tuple(sorted(pattern)), n) for groups in open_.values() for pattern, n in groups]


def configurations(histogram: np.ndarray, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """The fewest sequences found for the histogram: (lengths, how many sequences hold them)."""
    if not histogram.any():
        return []
    program = Program(histogram)
    program.run(steps)
    tries = [rounded(histogram, program.solution()), rounded(histogram, {}), best_fit(histogram)]
    return min(tries, key=lambda t: sum(n for _, n in t))


def fullest(left: np.ndarray, room: int) -> list[int]:
    """Pieces, each at most as often as ``left`` has it, whose sum is the largest up to ``room``; long ones come first."""
    mask, sums, states = (1 << room + 1) - 1, 1, []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        for _ in range(min(int(left[length]), room // length)):
            grown = (sums | sums << length) & mask
            if grown == sums:
                break
            states.append((length, sums))
            sums = grown
        if sums >> room & 1:
            break
    total, taken = sums.bit_length() - 1, []
    for length, before in reversed(states):
        if not before >> total & 1:
            taken.append(length)
            total -= length
    return taken


def _piece_batches(path: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy()
            parts = np.cumsum(sizes) // AT_ONCE
            for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(parts)) + 1):
                if not len(at):
                    continue
                part = batch.slice(int(at[0]), len(at))
                ids, stops = words.of(part.column(1))
                ids = np.insert(ids, stops, 0).astype("<u4")
                stops = stops + np.arange(1, len(stops) + 1)
                rows = []
                for doc, begin, end in zip(part.column(0).to_pylist(), np.r_[0, stops[:-1]].tolist(), stops.tolist()):
                    for k, start in enumerate(range(begin, end, capacity)):
                        piece = ids[start : min(start + capacity, end)]
                        rows.append((doc, k, start - begin, len(piece), zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every whole text, id 0 at its end: doc_id, piece, start, length, ids_crc32."""
    narrow = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return narrow.mapInArrow(_piece_batches(path, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _ranked(found: DataFrame) -> DataFrame:
    """``rank`` from 0 among the pieces of the same length, without bringing a length into one task."""
    slices = max(SLICES, -(-found.count() // PIECES_PER_SLICE))
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    counts = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    numbered = sliced.withColumn("row", F.row_number().over(order) - 1)
    return numbered.join(bases, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("row")).drop("slice", "base", "row")


def _placer(chosen: list[tuple[tuple[int, ...], int]]):
    """Function from (length, rank) to (sequence_id, offset)."""
    taken: dict[int, int] = {}
    rows, sequences = [], 0
    for pattern, n in chosen:
        offset = 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            rows.append((length, taken.get(length, 0), times, sequences, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += length * times
        sequences += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, length << 48 | rank, "right") - 1
        inside = rank - table[at, 1]
        return table[at, 3] + inside // table[at, 2], table[at, 4] + inside % table[at, 2] * length

    return place


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Texts longer than
    the capacity with their end mark are cut into pieces of the capacity, the last may be
    shorter. Null and empty texts are the end mark alone. Repeated rows are
    documents of their own. No documents give no rows. Other columns are ignored.
    ``path`` is the file of the tokenizer.
    """
    found = scratch(pieces(docs, path, capacity), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    place = _placer(configurations(histogram))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = place(length, rank)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return _ranked(found).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placed pieces of all documents; the last stage."""
    return pack(docs, tokenizer_path())
