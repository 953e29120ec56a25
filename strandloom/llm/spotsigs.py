"""Document fingerprints by SpotSigs.

A signature starts at a common word (the anchor) and chains the next content words
behind it. A text's fingerprint is its set of signatures, as 32-bit hashes. A text
without any anchor that has a full chain behind it takes the chains of all its words
instead, and one shorter than a chain takes its words as the only chain, so that only
texts without a word have an empty fingerprint. Likeness is the Jaccard similarity of
two sets; two empty sets are alike.

``near_classes`` finds all classes of equal fingerprints that are alike: sets are partitioned by length so
that alike sets lie in the same or the next partition, and meet there on one of their rarest signatures. Pairs that
length, the place of the shared signature or a 64-bit digest of both sets rule out are pruned. What is left of the pairs
never becomes rows: a signature's group leaves as links that span it, and the sets of a connected component meet
whole in one cell, or in a grid of cells by blocks, where all pairs are judged and counted. A signature that very many sets head
is split into a grid of blocks as well. The query tells every document its class and how many classes are near.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import components, documents, maybe_member, scratch, text_of

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its not of on or she that the they this to was we were which with you "
    "als am auf aus bei das dem den der des die ein eine einer für ich im ist mit nicht sich sie sind und von war wie zu "
    "au aux avec ce dans de des du elle en est et il je la le les mais ne on ou par pas pour que qui se son sur un une vous "
    "al como con del el ella en es esta este la las lo los más no para pero por que se sin su sus un una y"
).split()
CHAIN = 3
THRESHOLD = 0.8
AT_ONCE = 2_000_000
# Signatures are ranked by the frequency of so many hash buckets; sets of one length partition differ by at most this factor.
BUCKETS, WIDTH = 1 << 16, THRESHOLD**-3
# Rows under one signature that are compared in one go, and sets per block when whole sets are compared: fewer, down to
# ``SPREAD``, where that gives every task a cell. A block has at most ``HELD`` signatures, and ``SHARED`` of two blocks' are matched at once.
GROUP, BLOCK, SPREAD, HELD, SHARED = 4096, 2048, 96, 1 << 21, 1 << 21
FIRST = -(1 << 63)  # null ids come first


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Next value of a chain of 64-bit word hashes."""
    h = (h ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words' bytes, 8 of which are mixed in at a time for all words."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    held = words.buffers()[2]
    data = np.concatenate([np.frombuffer(held, np.uint8)[: offsets[-1]] if held is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the 8 bytes from each place on
    size = np.diff(offsets)
    value = _mixed(np.zeros(len(words), np.uint64), size.astype(np.uint64))
    left, done = np.flatnonzero(size), 0
    while len(left):
        rest = np.minimum(size[left] - done, 8).astype(np.uint64)
        value[left] = _mixed(value[left], eight[offsets[left] + done] << (np.uint64(64) - np.uint64(8) * rest))
        done += 8
        left = left[size[left] > done]
    return _mixed(value, value >> np.uint64(32))


class Signer:
    """Signature sets of texts: ``sets`` gives sorted keys (text number << 32 | signature)."""

    def __init__(self, anchors: tuple[str, ...] | list[str] = tuple(ANCHORS), chain: int = CHAIN):
        self.anchors, self.chain = pa.array(sorted(set(anchors)), pa.string()), chain

    def sets(self, texts: list[str]) -> np.ndarray:
        lists = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.string())), r"[^\p{L}\p{N}\p{M}]+")
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        common = pc.is_in(words, self.anchors).to_numpy(zero_copy_only=False)
        hashes = _word_hashes(words)
        text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        real = filled[index] if len(index) else np.zeros(0, bool)
        text, index = text[real], index[real]
        keys = self._chains(hashes[index], text, common[index])
        bare = np.setdiff1d(np.unique(text), keys >> np.uint64(32))
        if len(bare):
            at = np.isin(text, bare)
            keys = np.concatenate([keys, self._all_chains(hashes[index[at]], text[at])])
        return np.unique(keys)

    def _chains(self, word: np.ndarray, text: np.ndarray, common: np.ndarray) -> np.ndarray:
        content = np.flatnonzero(~common)
        anchor = np.flatnonzero(common)
        following = np.cumsum(~common)[anchor]  # number of the first content word behind the anchor
        fits = following + self.chain <= len(content)
        anchor, following = anchor[fits], following[fits]
        fits = text[content[following + self.chain - 1]] == text[anchor] if len(anchor) else np.zeros(0, bool)
        anchor, following = anchor[fits], following[fits]
        value = _mixed(np.zeros(len(anchor), np.uint64), word[anchor])
        for k in range(self.chain):
            value = _mixed(value, word[content[following + k]])
        return text[anchor].astype(np.uint64) << np.uint64(32) | value >> np.uint64(32)

    def _all_chains(self, word: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Chains from every word on; the words that do not reach a full chain count only in a text that has none."""
        sizes = np.bincount(text)[text]
        start = np.r_[0, np.flatnonzero(np.diff(text)) + 1]
        place = np.arange(len(text)) - np.repeat(start, np.diff(np.r_[start, len(text)]))
        begins = np.flatnonzero((place + self.chain <= sizes) | (place == 0))
        value = np.zeros(len(begins), np.uint64)
        for k in range(self.chain):
            inside = place[begins] + k < sizes[begins]
            value = np.where(inside, _mixed(value, word[np.minimum(begins + k, len(word) - 1)]), value)
        return text[begins].astype(np.uint64) << np.uint64(32) | value >> np.uint64(32)


def fingerprint_text(keys: np.ndarray, texts: int) -> list[str]:
    """Each text's sorted signatures as 8 hex digits each."""
    digits = (keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    ends = np.searchsorted(keys >> np.uint64(32), np.arange(texts), "right") * 8
    return [digits[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def likeness(a: np.ndarray, b: np.ndarray, texts: int) -> np.ndarray:
    """Jaccard similarity of the sets of each text number in ``a`` and ``b``."""

    def counted(keys: np.ndarray) -> np.ndarray:
        return np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=texts)[:texts]

    both, any_ = counted(np.intersect1d(a, b, assume_unique=True)), counted(a) + counted(b)
    return np.where(any_ > 0, both / np.maximum(any_ - both, 1), 1.0)


def set_prints(keys: np.ndarray, texts: int) -> list[int]:
    """64-bit hash of each text's set; equal sets have equal ones."""
    digits = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    ends = np.searchsorted(keys >> np.uint64(32), np.arange(texts), "right").tolist()
    return [int.from_bytes(hashlib.blake2b(digits[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip([0, *ends], ends)]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id bigint, n_near bigint, nearest_class bigint, nearest double"
TOLD = "struct<print:bigint,class_id:bigint,n_near:bigint,nearest_class:bigint,nearest:double>"


def _compare_batches(signer: Signer):
    names = [c.split()[0] for c in OUT.split(", ")]

    told: dict[tuple[int | None, int], tuple] = {}

    def compared(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        """All but the last text, which is only the following one."""
        n = len(texts) - 1
        new = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, changed = signer.sets(texts), signer.sets(new)
        first, behind = own[own >> np.uint64(32) < n], own[own >> np.uint64(32) > 0] - np.uint64(1 << 32)
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
        columns = [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), digests, fingerprint_text(first, n), fingerprint_text(changed, n)]
        classes = [told.get((i, p), (i, 0, None, None)) for i, p in zip(ids, set_prints(first, n))]
        of_class = [pa.array([c[k] for c in classes], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
        for i, p in [k for k in told if k[0] != ids[-1]]:
            del told[i, p]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(likeness(first, changed, n)), pa.array(likeness(first, behind, n)), *of_class], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, texts, size, border = None, [], [], 0, False
        for batch in batches:
            for b, copy, doc, text, info in zip(*(c.to_pylist() for c in batch.columns)):
                if info is not None:
                    told[doc, info["print"]] = tuple(info.values())[1:]
                    continue
                if b != bucket:
                    if len(texts) > 1:
                        yield compared(ids, texts)
                    bucket, ids, texts, size, border = b, [], [], 0, False
                if border:
                    continue  # the following text of the bucket's last row is there already
                ids.append(doc)
                texts.append(text)
                size, border = size + len(text), copy
                if size > AT_ONCE and len(texts) > 1:
                    yield compared(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)
        if len(texts) > 1:
            yield compared(ids, texts)

    return run


def _in_order(docs: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Documents dealt into ranges of ids, each range also with the first row of the next one (``copy``).
    Rows of ``told`` (doc_id, told) come right before the documents with their id.

    The ranges come from quantiles of the ids alone; the text is shuffled once.
    The last range is followed by the first row of all.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [k / n for k in range(1, n)]
    bounds = rows.agg(F.percentile_approx("key", steps, 100 * n).alias("b")).first()["b"] if steps else []
    bounds = sorted(set(bounds or []))
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]

    def longs(values: list[int]):
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    def dealt_to(rows: DataFrame) -> DataFrame:
        if not groups:
            return rows.withColumn("bucket", F.lit(0))
        coarse = F.size(F.filter(longs([g[0] for g in groups]), lambda c: c <= F.col("key")))
        fine = F.size(F.filter(F.element_at(F.array(*map(longs, groups)), F.greatest(coarse, F.lit(1))), lambda c: c <= F.col("key")))
        return rows.withColumn("bucket", F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine).cast("int"))

    rows = dealt_to(rows)
    firsts = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min("key").alias("first")).collect()}  # one row per range
    there = sorted(firsts)
    before = {b: there[i - 1] for i, b in enumerate(there)}
    total = len(bounds) + 1
    first = F.element_at(longs([firsts.get(b, FIRST) for b in range(total)]), F.col("bucket") + 1)
    previous = F.element_at(F.array(*[F.lit(before.get(b, 0)) for b in range(total)]), F.col("bucket") + 1)
    here = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    ahead = F.struct(previous.alias("bucket"), F.lit(True).alias("copy"))
    dealt = rows.select("key", "doc_id", "text", F.explode(F.when(F.col("key") == first, F.array(here, ahead)).otherwise(F.array(here))).alias("to"))
    dealt = dealt.select(F.col("to.bucket").alias("bucket"), F.col("to.copy").alias("copy"), "key", "doc_id", "text", F.lit(None).cast(TOLD).alias("told"))
    if told is not None:
        ahead_of = dealt_to(told.select(F.coalesce("doc_id", F.lit(FIRST)).alias("key"), "doc_id", "told"))
        dealt = dealt.unionByName(ahead_of.select("bucket", F.lit(False).alias("copy"), "key", "doc_id", F.lit(None).cast("string").alias("text"), "told"))
    sorted_ = dealt.repartitionById(total, F.col("bucket")).sortWithinPartitions("bucket", "copy", "key", F.col("told").isNull(), "text")
    return sorted_.select("bucket", "copy", "doc_id", "text", "told")


def fingerprints(docs: DataFrame, signer: Signer | None = None, told: DataFrame | None = None) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike it is to that and to the next document.

    Columns as in ``OUT``. Documents follow each other by ascending doc_id, null ids
    first, rows with the same id by text; behind the last comes the first, so a single document
    follows itself. Null text counts as empty. Texts without a word have the empty
    fingerprint. Other columns are ignored. ``told`` (from ``near_classes``) has the classes of documents that
    share their fingerprint or have near ones; all others are classes of their own. All rows of one id lie in one
    task, which reads them one by one: texts of an id are only held together up to ``AT_ONCE`` characters.
    """
    return _in_order(docs, told).mapInArrow(_compare_batches(signer or Signer()), OUT)


def _each_set(signer: Signer, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """Every text's signatures, and the hash of the set."""
    keys = signer.sets(texts)
    ends = np.searchsorted(keys >> np.uint64(32), np.arange(len(texts)), "right").tolist()
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return [low[a:b] for a, b in zip([0, *ends], ends)], set_prints(keys, len(texts))


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (doc_id, text) in pieces of some ``AT_ONCE`` bytes."""
    parts = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(batch)]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _frequency_batches(signer: Signer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _in_parts(batch):
                counts += np.bincount((signer.sets(part.column(1).to_pylist()) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["bucket", "n"])

    return run


def _least_overlap(a, b, threshold: float):
    """Signatures that sets of these sizes must share."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _narrow(s: np.ndarray) -> np.ndarray:
    """Signatures as they are stored and shuffled: the same 32 bits, signed."""
    return s.astype(np.uint32).view(np.int32)


SPOTS = "doc_id bigint, print bigint, n int, bits bigint, heads array<int>"


def _head_batches(signer: Signer, frequency: np.ndarray, threshold: float):
    """Of every text the set's hash, size and digest, and its rarest signatures in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_parts(batch):
                sets, prints = _each_set(signer, part.column(1).to_pylist())
                sizes, bits, heads = [], [], []
                for s in sets:
                    n = len(s)
                    order = np.lexsort((s, frequency[s & (BUCKETS - 1)]))
                    heads.append(_narrow(s[order[: n - math.ceil(threshold * n - 1e-9) + 1]] if n else s))
                    odd = np.flatnonzero(np.bincount((s >> 16) & 63, minlength=64) & 1)
                    sizes.append(n)
                    bits.append(int(np.bitwise_or.reduce(np.int64(1) << odd, initial=np.int64(0))))
                columns = [part.column(0), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.int64()), pa.array(heads, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "print", "n", "bits", "heads"])

    return run


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) that span the components of the pairs; one less than members in each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


# A row's role under a signature: it may be the shorter set of a pair, the longer one, or either.
SHORT, LONG, EITHER = 0, 1, 2
MET = "hot boolean, a bigint, b bigint, key bigint, role int, place int, n int, bits bigint, print bigint"


def _meet_batches(keys: int, threshold: float, split: bool):
    """Links that span the candidate pairs of every group of rows that share the first ``keys`` columns; rows come sorted by them.

    Rows behind: role, place, n, bits, print. With ``split``, groups of over ``GROUP`` rows leave as they are, marked hot.
    """

    def pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.unique(rows, axis=0)
        short, long = rows[rows[:, 0] != LONG], rows[rows[:, 0] != SHORT]
        a = b = np.zeros(0, np.int64)
        for at in range(0, len(short), 256):
            x, y = short[at : at + 256, None, :], long[None, :, :]
            least = _least_overlap(x[..., 2], y[..., 2], threshold)
            good = (x[..., 2] < y[..., 2]) | ((x[..., 2] == y[..., 2]) & (x[..., 4] < y[..., 4]))
            good &= x[..., 2] >= threshold * y[..., 2] - 1e-9
            good &= np.minimum(x[..., 2] - x[..., 1], y[..., 2] - y[..., 1]) >= least
            good &= np.bitwise_count((x[..., 3] ^ y[..., 3]).view(np.uint64)) <= x[..., 2] + y[..., 2] - 2 * least
            i, j = np.nonzero(good)
            a, b = _spanning(np.concatenate([a, short[at + i, 4]]), np.concatenate([b, long[j, 4]]))
        return a, b

    def cold(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        no = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(a), pa.array(b), *no], names=names)

    def raw(rows: np.ndarray) -> pa.RecordBatch:
        no = pa.nulls(len(rows), pa.int64())
        key, role, place, n, bits, print_ = rows.T
        columns = [pa.array(np.ones(len(rows), bool)), no, no, pa.array(key), pa.array(role.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(bits), pa.array(print_)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, passing = np.zeros((0, keys + 5), np.int64), None
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            starts = np.flatnonzero(np.r_[True, (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)]) if len(rows) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(rows)])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            # Most signatures belong to one set only; just the others are looked at one by one.
            several = np.minimum.reduceat(rows[:, -1], starts) != np.maximum.reduceat(rows[:, -1], starts) if len(rows) else np.zeros(0, bool)
            several[:1] = several[-1:] = True
            for k in np.flatnonzero(several | (sizes > GROUP)).tolist():
                at, n = int(starts[k]), int(sizes[k])
                group, last = rows[at : at + n], k == len(starts) - 1
                if split and (n > GROUP or (passing is not None and tuple(group[0, :keys]) == passing)):
                    passing = tuple(group[0, :keys])
                    yield raw(group)
                    if last:
                        rest = rows[:0]
                elif last:
                    rest = group
                elif n > 1:
                    found = pairs(group[:, keys:])
                    a.append(found[0])
                    b.append(found[1])
            yield cold(*_spanning(np.concatenate(a), np.concatenate(b)))
        yield cold(*pairs(rest[:, keys:]))

    names = [c.split()[0] for c in MET.split(", ")]
    return run


def _wanted_batches(signer: Signer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_parts(batch):
                sets, prints = _each_set(signer, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array([_narrow(s) for s in sets], pa.list_(pa.int32()))], names=["print", "signatures"])

    return run


LINKS = "print bigint, n_near bigint, likeness double, other bigint"


def _alike(sizes: np.ndarray, flat: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of sets at least ``threshold`` alike, and their likeness: of side 0 with side 1, and any of side -1.

    The sets' distinct signatures stand one after the other in ``flat``. Shared ones are matched and counted for some sets at a time.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    ends = np.searchsorted(flat, flat, "right")
    met = side[owner] == 1
    right = np.flatnonzero(met | (side[owner] < 0))  # entries that sets on the left may meet
    many = np.r_[0, np.cumsum(met | (side[owner] < 0))]
    # On one side an entry meets those behind it, else all of the same signature; these lie behind one another in ``right``.
    begins = np.where(side[owner] < 0, np.arange(len(flat)) + 1, np.searchsorted(flat, flat, "left"))
    lo, n = many[begins], many[ends] - many[begins]
    left = np.flatnonzero((n > 0) & ~met)
    left = left[np.argsort(owner[left], kind="stable")]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    per = max(1, SHARED // max(1, len(sizes)))  # sets on the left at a time
    for first in range(0, len(sizes), per):
        mine = left[slice(*np.searchsorted(owner[left], (first, first + per)))]
        if not len(mine):
            continue
        both = np.zeros(min(per, len(sizes) - first) * len(sizes), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(n[mine]) // SHARED)) + 1
        for part in np.split(mine, cuts):
            total = np.cumsum(n[part])
            place = np.arange(total[-1]) - np.repeat(total - n[part], n[part]) + np.repeat(lo[part], n[part])
            met_by = np.repeat((owner[part] - first) * len(sizes), n[part])
            both += np.bincount(met_by + owner[right[place]], minlength=len(both))
        at = np.flatnonzero(both)
        i, j = at // len(sizes) + first, at % len(sizes)
        likeness_ = both[at] / (sizes[i] + sizes[j] - both[at])
        good = likeness_ >= threshold - 1e-9
        found.append((i[good], j[good], likeness_[good]))
    i, j, likeness_ = (np.concatenate(c) for c in zip(*found))
    return i, j, likeness_


def _likeness_batches(threshold: float, counted: bool):
    """Likeness of all alike pairs of each cell's sets (rows: x, y, a, b, signatures, class_id; sorted by the cell x, y).

    ``a`` is the set's name; ``b`` is 0 or 1 where only sets of different blocks meet, null where all do. Rows without signatures are passed over.
    With ``counted`` no pair leaves the task: each set is told how many near ones it has in the cell, and the nearest.
    """

    def told(names: np.ndarray, classes: pa.Array, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        i, j, value = pairs
        own, other, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
        # Of the nearest ones the smallest class, those without a name last.
        unnamed, class_ = classes.is_null().to_numpy(zero_copy_only=False), classes.fill_null(0).to_numpy()
        order = np.lexsort((class_[other], unnamed[other], -value, own))
        own, other, value = own[order], other[order], value[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        nearest = classes.take(pa.array(other[starts]))
        columns = [pa.array(names[own[starts]]), pa.array(np.diff(np.r_[starts, len(own)])), pa.array(value[starts]), nearest]
        return pa.RecordBatch.from_arrays(columns, names=["print", "n_near", "likeness", "other"])

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        names, classes = whole.column("a").to_numpy(), whole.column("class_id").combine_chunks()
        signatures, side = whole.column("signatures"), whole.column("b").fill_null(-1).to_numpy()
        sizes = pc.list_value_length(signatures).to_numpy().astype(np.int64)
        pairs = _alike(sizes, pc.list_flatten(signatures).to_numpy(), side, threshold)
        if not len(pairs[0]):
            return
        if counted:
            yield told(names, classes, pairs)
        else:
            i, j = names[pairs[0]], names[pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(pairs[2])], names=["a", "b", "likeness"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            batch = batch.filter(batch.column(4).is_valid())
            if not batch.num_rows:
                continue
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]).tolist()
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                if (x[at], y[at]) != cell:
                    if held:
                        yield from judged(held)
                    cell, held = (x[at], y[at]), []
                held.append(pa.RecordBatch.from_arrays(batch.slice(at, end - at).columns, names=["x", "y", "a", "b", "signatures", "class_id"]))
        if held:
            yield from judged(held)

    return run


def _part(size) -> object:
    return F.floor(F.log(size.cast("double")) / math.log(WIDTH) + 1e-9).cast("int")


def _candidates(spots: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that span all pairs of different sets that share one of their rarest signatures and are not pruned."""
    one_each = maybe_member(spots, classes.select(F.col("class_id").alias("doc_id"), "print"), ["doc_id", "print"]).where("_maybe and n > 0")
    n = F.col("n")
    # The shorter set of a pair needs fewer heads: the pair shares at least 2t / (1 + t) of it.
    as_short = n - F.ceil(F.lit(2 * threshold / (1 + threshold)) * n - 1e-9) + 1
    low = _part(F.ceil(F.lit(threshold) * n - 1e-9))
    rows = one_each.select("print", "n", "bits", _part(n).alias("part"), low.alias("low"), as_short.alias("as_short"), F.posexplode("heads").alias("place", "s"))
    roles = F.array(
        F.struct(F.when(F.col("place") < F.col("as_short"), EITHER).otherwise(LONG).alias("role"), F.col("part").alias("at")),
        F.when(F.col("low") < F.col("part"), F.struct(F.lit(LONG).alias("role"), F.col("low").alias("at"))),
    )
    each = rows.select("print", "n", "bits", "place", "s", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r"))
    heads = each.select(F.xxhash64("r.at", "s").alias("key"), "r.role", "place", "n", "bits", "print")
    met = scratch(heads.repartition("key").sortWithinPartitions("key").mapInArrow(_meet_batches(1, threshold, True), MET), "met")
    pairs = met.where("not hot").select("a", "b")
    single = F.explode(F.when(F.col("role") == EITHER, F.array(F.lit(SHORT), F.lit(LONG))).otherwise(F.array("role"))).alias("role")
    hot = met.where("hot").select("key", single, "place", "n", "bits", "print")
    blocks = hot.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count(F.lit(1)) / (GROUP // 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    grid = hot.join(blocks, F.col("key") == F.col("_key")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = F.col("role") == LONG
    cells = grid.select("key", F.when(long, F.col("other")).otherwise(F.col("own")).alias("x"), F.when(long, F.col("own")).otherwise(F.col("other")).alias("y"), "role", "place", "n", "bits", "print")
    split = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_meet_batches(3, threshold, False), MET)
    return pairs.unionByName(split.where("a is not null").select("a", "b")).toDF("u", "v")


def _in_cells(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Every set in the cells of its component, as ``_likeness_batches`` takes them; any two sets of a component meet in one cell.

    ``members`` (root, n: one row per set) tells how many blocks a component is cut into by a hash; there is a cell for each two blocks.
    """
    tasks = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    count = F.count(F.lit(1))
    spread = F.least(F.ceil(count / min(SPREAD, BLOCK)), F.lit(math.isqrt(2 * tasks) + 1))
    blocks = F.greatest(spread, F.ceil(count / BLOCK), F.ceil(F.sum("n") / HELD)).cast("int")
    cut = members.groupBy(F.col("root").alias("_root")).agg(blocks.alias("blocks")).where("blocks > 1")  # at most one row per SPREAD sets
    dealt = sets.join(F.broadcast(cut), F.col("root") == F.col("_root"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low < high, (F.col("own") == high).cast("bigint")).alias("b")
    cell = (low.cast("bigint") * F.col("blocks") + high).alias("y")
    return dealt.select(F.col("root").alias("x"), cell, F.col("print").alias("a"), side, "signatures", "class_id").repartition("x", "y")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, signer: Signer | None = None, listed: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Classes of equal fingerprints, all pairs of them at least ``threshold`` alike, and what documents are told.

    Returns (print, class_id, n_docs, n), (a, b, likeness) by prints, and (doc_id, told) for ``fingerprints``. A class is
    named by its smallest doc_id (null if it has none); ``n`` is the size of its set. Unless ``listed``, links are counted where they are found and the second
    result is None. Documents without a word are one class and in no
    pair. The order of signatures comes from frequencies of ``BUCKETS`` hash buckets over all documents.
    """
    signer = signer or Signer()
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    frequency = np.zeros(BUCKETS, np.int64)
    for row in narrow.mapInArrow(_frequency_batches(signer), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        frequency[row["bucket"]] = row["n"]
    spots = scratch(narrow.mapInArrow(_head_batches(signer, frequency, threshold), SPOTS), "spots")
    classes = scratch(spots.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"), F.max("n").alias("n")), "classes")
    member = components(_candidates(spots, classes, threshold))

    wanted = scratch(classes.join(member, F.col("print") == F.col("node")).select("print", F.col("class_id").alias("doc_id"), "n", "root"), "compared")
    texts = maybe_member(narrow, wanted, ["doc_id"]).where("_maybe").select("doc_id", "text")
    sets = texts.mapInArrow(_wanted_batches(signer), "print bigint, signatures array<int>")
    named = wanted.select("print", F.col("doc_id").alias("class_id"), "root")
    sets = scratch(sets.join(named, "print").dropDuplicates(["print"]), "compared-sets")
    ordered = _in_cells(sets, wanted).sortWithinPartitions("x", "y")
    nearest = F.min(F.struct((-F.col("likeness")).alias("l"), F.col("other").isNull(), F.col("other").alias("other"))).alias("best")
    if listed:
        alike = scratch(ordered.mapInArrow(_likeness_batches(threshold, False), "a bigint, b bigint, likeness double"), "alike")
        both = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
        links = both.join(classes.select(F.col("print").alias("_b"), F.col("class_id").alias("other")), F.col("b") == F.col("_b"))
        links = links.select(F.col("a").alias("print"), F.lit(1).cast("bigint").alias("n_near"), "likeness", "other")
    else:
        alike, links = None, ordered.mapInArrow(_likeness_batches(threshold, True), LINKS)
    near = links.groupBy(F.col("print").alias("_print")).agg(F.sum("n_near").alias("n_near"), nearest)
    of_class = classes.join(near, F.col("print") == F.col("_print"), "left").where("n_docs > 1 or n_near > 0")
    told = F.struct("print", "class_id", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.col("best.other").alias("nearest_class"), (-F.col("best.l")).alias("nearest"))
    shared = scratch(of_class.select(F.col("print").alias("_print"), told.alias("told")), "shared-classes")
    told = spots.select("doc_id", "print").distinct().join(shared, F.col("print") == F.col("_print")).select("doc_id", "told")
    return classes, alike, told


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, signer: Signer | None = None) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, likeness) of all alike classes, and (doc_id, class_id) of all documents with an id; see ``near_classes``."""
    classes, alike, told = near_classes(docs, threshold, signer)
    ids = {c: classes.select(F.col("print").alias(c), F.col("class_id").alias(f"class_{c}")) for c in "ab"}
    pairs = alike.join(ids["a"], "a").join(ids["b"], "b")
    pairs = pairs.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "likeness")
    members = fingerprints(docs.where("doc_id is not null"), signer, told).select("doc_id", "class_id")
    return pairs, members


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, and every document's class and near classes from the search over all documents."""
    docs = documents(spark, sf_dir)
    return fingerprints(docs, told=near_classes(docs, listed=False)[2])
