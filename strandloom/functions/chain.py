"""Collinear blocks of seeds, from a stream of seeds sorted by query and place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACE = ("ref_id", "offset", "loc")
SCHEMA = (
    "q0 int, qN int, start_ref bigint, start_offset int, start_loc bigint, end_ref bigint, end_offset int, end_loc bigint, n1 int, n2 int, n_single bigint"
)
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
#: Seeds in a row that extend a block before whole runs are tried at once, and the first such run.
STEADY, RUN = 8, 32


@dataclass
class Block:
    """What has to be known of a block: where it starts and ends in seeds, query and reference, and its seeds by copies."""

    i0: int
    q0: int
    start: tuple[int, int, int]
    iN: int
    qN: int
    end: tuple[int, int, int]
    n1: int = 0
    n2: int = 0

    def breaks(self, place: tuple[int, int, int], drift: int) -> bool:
        """Whether a seed at ``place`` cannot extend the block; drift is that of the span the block already has."""
        start, end, at = self.start[2], self.end[2], place[2]
        if place[0] != self.start[0] or start < end and at < end or start > end and at > end:
            return True
        return start != end and abs(abs(end - start) - (self.iN - self.i0)) > drift

    def extend(self, i: int, q: int, place: tuple[int, int, int], single: bool) -> None:
        self.iN, self.qN, self.end = i, q, place
        self.n1 += single
        self.n2 += not single

    def steady(self, ord_: np.ndarray, ref: np.ndarray, loc: np.ndarray, drift: int) -> int:
        """How many of the seeds in order extend the block by their first places."""
        before = np.concatenate(([self.end[2]], loc[:-1]))
        at = np.concatenate(([self.iN], ord_[:-1]))
        start = self.start[2]
        backward = (start < before) & (loc < before) | (start > before) & (loc > before)
        drifted = (before != start) & (np.abs(np.abs(before - start) - (at - self.i0)) > drift)
        stops = np.flatnonzero((ref != self.start[0]) | backward | drifted)
        return int(stops[0]) if len(stops) else len(loc)

    def row(self) -> tuple:
        return (self.q0, self.qN, *self.start, *self.end, self.n1, self.n2, None)


def blocks(least: int, drift: int, strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: blocks with more than ``least`` seeds of each query, and for each query that has
    some a row with its single-copy seeds (``n_single``).

    State is one open block and a counter, whatever the number of seeds of a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, block, singles, reported = None, None, 0, False
        out: list[tuple] = []

        def finish() -> None:
            if block is not None and (block.n2 if strict else block.n1) > least:
                out.append((read, *block.row()))
            if reported or out and out[-1][0] == read:
                out.append((read, *[None] * 10, singles))

        def emit(read_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 12
            names = ["read_id", *(field.split()[0] for field in SCHEMA.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [read_type, *_TYPES])], names=names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column("read_id")
            same = pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            borders = np.append(np.flatnonzero(~same.astype(bool)) + 1, batch.num_rows)
            read_type, reads = column.type, column.to_pylist()
            ord_, pos = batch.column("ord").to_numpy(), batch.column("pos").to_numpy()
            single = batch.column("single").to_numpy(zero_copy_only=False)
            first = [batch.column(f"first_{c}").to_numpy() for c in PLACE]
            second = [batch.column(f"second_{c}").to_pylist() for c in PLACE]
            places, ords, positions, alone = list(zip(*(c.tolist() for c in first))), ord_.tolist(), pos.tolist(), single.tolist()
            i, n, run_of, size = 0, batch.num_rows, 0, RUN
            while i < n:
                if reads[i] != read or block is None:
                    if block is not None:
                        finish()
                    read, singles, reported, run_of, size = reads[i], 0, False, 0, RUN
                    block = Block(ords[i], positions[i], places[i], ords[i], positions[i], places[i], int(alone[i]), int(not alone[i]))
                    singles += alone[i]
                    i += 1
                    continue
                if run_of >= STEADY and block.start[2] != 0:
                    end = min(i + size, int(borders[np.searchsorted(borders, i, "right")]))
                    taken = block.steady(ord_[i:end], first[0][i:end], first[2][i:end], drift)
                    if taken:
                        ones, last = int(single[i : i + taken].sum()), i + taken - 1
                        block.iN, block.qN, block.end = ords[last], positions[last], places[last]
                        block.n1, block.n2, singles = block.n1 + ones, block.n2 + taken - ones, singles + ones
                        run_of = run_of if i + taken == end else 0
                        i, size = i + taken, size * 2
                        continue
                place, ends = places[i], block.start[2] == 0
                if not ends and block.breaks(place, drift):
                    ends = alone[i]
                    if not ends:
                        place = tuple(c[i] for c in second)
                        ends = block.breaks(place, drift)
                singles += alone[i]
                if ends:
                    if block.n1 > least:
                        out.append((read, *block.row()))
                        reported = True
                    block, run_of, size = Block(ords[i], positions[i], place, ords[i], positions[i], place), 0, RUN
                block.extend(ords[i], positions[i], place, alone[i])
                run_of += 1
                i += 1
            if out:
                yield emit(read_type)
                out = []
        if block is not None:
            finish()
            yield emit(read_type)

    return run
