"""Arrow batch kernels for k-mer sampling.

A batch's sequence column is decoded in place from its Arrow buffers, all reads
are concatenated, and every window code is built by doubling, so the work is a
handful of vector operations per base. The functions are shipped by value, which
lets executors run them without the package installed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A worker's arrays are a small multiple of these, whatever the size of its batches; larger ones are no faster.
CHUNK = 1 << 16  # window starts handled at once
SLICE_BYTES = 1 << 20  # text bytes decoded at once (a single longer read stays whole)


def base_codes() -> np.ndarray:
    """Byte to base code: A0 C1 G2 T3, N read as A, anything else 255 (dropped)."""
    table = np.full(256, 255, np.uint8)
    for code, letters in enumerate((b"AaNn", b"Cc", b"Gg", b"Tt")):
        table[list(letters)] = code
    return table


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each piece holds about SLICE_BYTES of text."""
    size = np.cumsum(np.diff(_buffers(batch.column(column))[0]))
    cut = 0
    while cut < batch.num_rows:
        done = size[cut - 1] if cut else 0
        end = max(int(np.searchsorted(size, done + SLICE_BYTES, "right")), cut + 1)
        yield batch.slice(cut, end - cut)
        cut = end


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; nulls have length 0 by format."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated base codes and read boundaries, junk characters removed."""
    bounds, data = _buffers(column)
    table, parts, before = base_codes(), [np.zeros(0, np.uint8)], 0
    borders = np.zeros(len(bounds), np.int64)
    for start in range(0, len(data), CHUNK):
        codes = table[data[start : start + CHUNK]]
        kept = np.flatnonzero(codes < 4)
        here = slice(*np.searchsorted(bounds, (start, start + CHUNK)))
        borders[here] = before + np.searchsorted(kept, bounds[here] - start)
        parts.append(codes[kept])
        before += len(kept)
    borders[np.searchsorted(bounds, len(data)) :] = before
    return np.concatenate(parts), borders


def window_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """2-bit codes of every k-long window and of its reverse complement."""
    n = len(codes) - k + 1
    power_f, power_r, width = codes.astype(np.uint64), (3 - codes).astype(np.uint64), 1
    fwd = rev = None
    have = 0
    while True:
        if k & width:
            if have:
                part_f, part_r = power_f[have : have + n], power_r[have : have + n]
                fwd = (fwd << np.uint64(2 * width)) | part_f
                rev = rev | (part_r << np.uint64(2 * have))
            else:
                fwd, rev = power_f[:n], power_r[:n]
            have += width
        if have == k:
            return fwd, rev
        head, tail = slice(0, len(power_f) - width), slice(width, None)
        power_f = (power_f[head] << np.uint64(2 * width)) | power_f[tail]
        power_r = power_r[head] | (power_r[tail] << np.uint64(2 * width))
        width *= 2


def hashed(codes: np.ndarray, k: int, factor: int) -> np.ndarray:
    return (codes * np.uint64(factor)) >> np.uint64(64 - 2 * k)


def canonical(codes: np.ndarray, k: int, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical k-mer, its hash and whether the given strand won (ties: reverse)."""
    fwd, rev = window_codes(codes, k)
    hash_f, hash_r = hashed(fwd, k, factor), hashed(rev, k, factor)
    is_fwd = hash_f < hash_r
    return np.where(is_fwd, fwd, rev), np.where(is_fwd, hash_f, hash_r), is_fwd


def chunks(codes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, len(codes) - k + 1, CHUNK):
        yield start, codes[start : start + CHUNK + k - 1]


def sample_hits(codes: np.ndarray, bounds: np.ndarray, k: int, w: int, factor: int) -> dict[str, np.ndarray]:
    """All sampled windows lying inside one read, in read and position order."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))]
    for start, part in chunks(codes, k):
        kmer, value, is_fwd = canonical(part, k, factor)
        pick = np.flatnonzero(value % np.uint64(w) == 0)
        found.append((pick + start, kmer[pick], is_fwd[pick]))
    at, kmer, is_fwd = (np.concatenate(column) for column in zip(*found))
    read = np.searchsorted(bounds[1:], at, "right")
    inside = at + k <= bounds[1:][read]
    at, kmer, is_fwd, read = at[inside], kmer[inside], is_fwd[inside], read[inside]
    return {
        "_read": read,
        "ord": np.arange(len(read)) - np.searchsorted(read, read),
        "kmer": kmer.astype(np.int64),
        "is_fwd": is_fwd,
        "pos": at - bounds[read],
    }


def window_minima(value: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value among each ``w`` consecutive ones, cut at the end.

    Equal values are resolved by the smaller position modulo w. Minima of
    power-of-two spans are doubled, then two spans cover the window.
    """
    best, width = np.arange(len(value)), 1

    def lower(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        tie = (value[left] == value[right]) & (right % w < left % w)
        return np.where((value[right] < value[left]) | tie, right, left)

    def joined(offset: int) -> np.ndarray:
        paired = max(len(best) - offset, 0)
        return np.concatenate((lower(best[:paired], best[offset : offset + paired]), best[paired:]))

    while 2 * width <= w:
        best, width = joined(width), 2 * width
    return joined(w - width) if w > width else best


def jumping_minima(codes: np.ndarray, bounds: np.ndarray, k: int, w: int, factor: int) -> dict[str, np.ndarray]:
    """Per read, hop from one window minimum to the minimum of the next w windows.

    A window cut short by the read's end only counts when it beats the previous
    minimum.
    """
    found = [(np.zeros(0, np.int64),) * 5]
    for read, (left, right) in enumerate(zip(bounds[:-1], bounds[1:])):
        n = int(right - left) - k + 1
        if n < 1:
            continue
        _, value, is_fwd = canonical(codes[left:right], k, factor)
        following = window_minima(value, w).tolist()
        hops = [following[0]]
        while hops[-1] + w < n:
            hops.append(following[hops[-1] + 1])
        while hops[-1] + 1 < n and value[following[hops[-1] + 1]] < value[hops[-1]]:
            hops.append(following[hops[-1] + 1])
        at = np.array(hops)
        found.append((np.full(len(at), read), np.arange(len(at)), value[at].astype(np.int64), is_fwd[at], at))
    names = ("_read", "ord", "hash", "is_fwd", "pos")
    hits = dict(zip(names, (np.concatenate(column) for column in zip(*found))))
    hits["is_fwd"] = hits["is_fwd"].astype(bool)
    return hits


def byte_counter(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: one partial byte histogram per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _buffers(batch.column(text))[1]
            counts = np.zeros(256, np.int64)
            for start in range(0, len(data), CHUNK):
                counts += np.bincount(data[start : start + CHUNK], minlength=256)
            present = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(counts[present])], ["byte", "n"])

    return run


def _split_changes(batch: pa.RecordBatch) -> np.ndarray:
    """True where a row lies in another file split (_file, _block) than the one before; the first row is True."""
    changed = np.zeros(batch.num_rows, bool)
    changed[0] = True
    for name in ("_file", "_block"):
        column = batch.column(name)
        changed[1:] |= ~pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return changed


def _valid_rows(column: pa.Array) -> np.ndarray:
    """Each row's own number where the column has a value, else -1."""
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(len(column)), -1)


def split_totals(counted: list[str], carried: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: per run of one file split in a batch the sums of the ``counted``
    columns, the last value of the ``carried`` ones and the first ``_line``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            starts = np.flatnonzero(_split_changes(batch))
            arrays = {name: batch.column(name).take(pa.array(starts)) for name in ("_file", "_block", "_line")}
            for name in counted:
                arrays[name] = pa.array(np.add.reduceat(batch.column(name).to_numpy(), starts))
            for name in carried:
                last = np.maximum.reduceat(_valid_rows(batch.column(name)), starts)
                arrays[name] = batch.column(name).take(pa.array(last, mask=last < 0))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return run


def split_counter(counted: list[str], carried: list[str] = []) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: running totals of the ``counted`` columns within each
    file split (_file, _block), and the last value so far of the ``carried`` ones, kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, sums = None, [0] * len(counted)
        latest: dict[str, pa.Array] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            file, block = batch.column("_file"), batch.column("_block")
            changed = _split_changes(batch)
            changed[0] = split != (file[0].as_py(), block[0].as_py())
            segment = np.cumsum(changed)  # 0: still the previous batch's split
            starts = np.flatnonzero(changed)
            arrays = {name: batch.column(name) for name in batch.schema.names}
            for i, name in enumerate(counted):
                total = np.cumsum(batch.column(name).to_numpy())
                base = np.concatenate(([-sums[i]], np.concatenate(([0], total))[starts]))
                running = total - base[segment]
                sums[i] = int(running[-1])
                arrays[name] = pa.array(running)
            first = np.concatenate(([-1], starts))[segment]
            for name in carried:
                column = batch.column(name)
                before = latest.get(name, pa.nulls(1, column.type))
                last = np.maximum.accumulate(_valid_rows(column))
                # Place 0 is the value before the batch, which counts in its own split only.
                missing = (last < first) | (last < 0) & (segment > 0)
                arrays[name] = pa.concat_arrays([before, column]).take(pa.array(last + 1, mask=missing))
                latest[name] = arrays[name].slice(batch.num_rows - 1, 1)
            split = (file[-1].as_py(), block[-1].as_py())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return run


def arrow_mapper(
    extract: Callable[..., dict[str, np.ndarray]],
    text: str,
    keep: list[str],
    emit: list[str],
    params: tuple[int, int, int],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: kept columns repeated per hit, then the hit columns."""
    narrow = {"ord": np.int32, "pos": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                codes, bounds = decode(piece.column(text))
                hits = extract(codes, bounds, *params)
                hits["len"] = np.diff(bounds)[hits["_read"]]
                rows = pa.array(hits["_read"])
                arrays = [piece.column(name).take(rows) for name in keep]
                arrays += [pa.array(hits[name].astype(narrow.get(name, hits[name].dtype))) for name in emit]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *emit])

    return run


def orbit(successor: np.ndarray, start: int) -> np.ndarray:
    """``start``, its successor, and so on, below ``len(successor)``; found by pointer doubling.

    Every successor lies behind its row.
    """
    n = len(successor)
    jump = np.append(successor, n)
    seen = np.array([start] if start < n else [], np.int64)
    while len(seen) and seen[-1] < n:
        seen = np.concatenate((seen, jump[seen]))
        jump = jump[jump]
    return seen[seen < n]


def spaced_rows(gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow`` over rows sorted by (read_id, x): those that lie at least ``gap`` behind
    the last one kept of their read, the first from place 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free_from = None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            reads, x = batch.column("read_id"), batch.column("x").to_numpy().astype(np.int64)
            changed = np.ones(n, bool)
            changed[1:] = ~pc.equal(reads[1:], reads[:-1]).to_numpy(zero_copy_only=False)
            starts, read = np.flatnonzero(changed), np.cumsum(changed) - 1
            ends = np.append(starts[1:], n)
            # One key for the whole batch, with room for a gap behind each read.
            low = min(int(x.min()), 0)
            step = int(x.max()) - low + gap + 1
            key = x - low + read * step
            first_free = np.zeros(len(starts), np.int64)
            if reads[0].as_py() == current:
                first_free[0] = min(free_from, int(x.max()) + 1)
            entry = np.maximum(np.searchsorted(key, first_free - low + np.arange(len(starts)) * step), starts)
            # Reads without a row to keep lead on to the next one.
            entry = np.append(entry, n)
            for i in np.flatnonzero(entry[:-1] >= ends)[::-1]:
                entry[i] = entry[i + 1]
            after = np.maximum(np.searchsorted(key, key + gap), np.arange(n) + 1)
            kept = orbit(np.where(after < ends[read], after, entry[read + 1]), int(entry[0]))
            if reads[n - 1].as_py() != current:
                current, free_from = reads[n - 1].as_py(), 0
            if len(kept) and read[kept[-1]] == len(starts) - 1:
                free_from = int(x[kept[-1]]) + gap
            yield batch.take(pa.array(kept))

    return run
