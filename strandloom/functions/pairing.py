"""Pairs of anchors with the other k-mers of their reads, from a stream of reads sorted by cell.

A row has a ``cell``, a read and its length, all its eligible hits by position (arrays ``m_*``) and the places among them
of the cell's anchors (``a_at``). All reads of an anchor lie in its cell, so pairs are made, grouped and judged here, some at a time,
and never leave the task as rows to be grouped. Shipped by value to the tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS_AT_ONCE = 1 << 18  # a single anchor's pairs stay together
PAIRS = "anchor bigint, anchor_depth int, mod bigint, mod_depth int, read_id bigint, dx int, is_first boolean"
VERDICTS = (
    "anchor bigint, anchor_depth int, mod bigint, mod_depth int, is_down boolean, is_split boolean, n bigint, dist int, reaching bigint, "
    "is_poor boolean, is_good boolean, is_single boolean"
)
Columns = dict[str, np.ndarray]


ANCHORS = ("anchor", "anchor_depth", "pos", "is_fwd", "upstream", "downstream")
MODS = ("mod", "pos", "depth")


def _flat(batch: pa.RecordBatch, w: int) -> Columns:
    """Reads, and all hits and anchors on end with their number in each row; of an anchor its first occurrence in the read."""
    mods = {name: batch.column(f"m_{name}").flatten().to_numpy(zero_copy_only=False) for name in (*MODS, "is_fwd")}
    m_n, a_n = (np.diff(batch.column(name).offsets.to_numpy()) for name in ("m_mod", "a_at"))
    row = np.repeat(np.arange(batch.num_rows), a_n)
    hit = np.sort((np.cumsum(m_n) - m_n)[row] + batch.column("a_at").flatten().to_numpy())
    order = np.lexsort((hit, mods["mod"][hit], row))
    anchor = mods["mod"][hit[order]]
    first = np.ones(len(order), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[order][1:] != row[order][:-1])
    keep = np.sort(order[first])
    hit, row = hit[keep], row[keep]
    pos, is_fwd = mods["pos"][hit], mods["is_fwd"][hit]
    after = batch.column("len").to_numpy()[row] - pos - w
    return {
        "read_id": batch.column("read_id").to_numpy(), "m_n": m_n, "a_n": np.bincount(row, minlength=batch.num_rows),
        "a_anchor": mods["mod"][hit], "a_anchor_depth": mods["depth"][hit], "a_pos": pos, "a_is_fwd": is_fwd,
        "a_upstream": np.where(is_fwd, pos, after), "a_downstream": np.where(is_fwd, after, pos),
    } | {f"m_{name}": mods[name] for name in MODS}


def _cells(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[Columns]:
    """The columns of one cell after the other; a cell may go on in the next batch."""
    current, held = None, []

    def joined() -> Columns:
        out = {name: np.concatenate([part.pop(name) for part in held]) for name in list(held[0])}
        held.clear()
        # One number per mod, for a single sort of pairs.
        out["m_names"], out["m_code"] = np.unique(out["m_mod"], return_inverse=True)
        return out

    for batch in batches:
        if batch.num_rows == 0:
            continue
        cells = batch.column("cell").to_numpy()
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        for start, end in zip(starts, np.append(starts[1:], len(cells))):
            if held and cells[start] != current:
                yield joined()
            current = cells[start]
            held.append(_flat(batch.slice(start, end - start), w))
    if held:
        yield joined()


def _portions(cell: Columns) -> Iterator[Columns]:
    """The anchors' occurrences in a cell, sorted by anchor and cut so that each portion has about PAIRS_AT_ONCE pairs."""
    order = np.argsort(cell["a_anchor"], kind="stable")
    seen = {name: cell[f"a_{name}"][order] for name in ANCHORS}
    row = np.repeat(np.arange(len(cell["a_n"])), cell["a_n"])[order]
    seen["read_id"], seen["size"] = cell["read_id"][row], cell["m_n"][row]
    seen["from"] = (np.cumsum(cell["m_n"]) - cell["m_n"])[row]
    starts = np.flatnonzero(np.append(True, seen["anchor"][1:] != seen["anchor"][:-1]))
    ends, total = np.append(starts[1:], len(order)), np.cumsum(seen["size"])
    at = 0
    while at < len(starts):
        done = total[starts[at] - 1] if starts[at] else 0
        stop = max(int(np.searchsorted(total[ends - 1], done + PAIRS_AT_ONCE, "right")), at + 1)
        yield {name: values[starts[at] : ends[stop - 1]] for name, values in seen.items()}
        at = stop


def _paired(cell: Columns, seen: Columns) -> Columns:
    """All pairs of the occurrences with their reads' other hits, sorted by anchor and mod; ``is_first`` marks each new (anchor, mod)."""
    sizes = seen["size"]
    of = np.repeat(np.arange(len(sizes)), sizes)
    hit = np.arange(len(of)) + np.repeat(seen["from"] - (np.cumsum(sizes) - sizes), sizes)
    dx = (cell["m_pos"][hit] - seen["pos"][of]) * np.where(seen["is_fwd"], 1, -1).astype(np.int32)[of]
    apart = np.flatnonzero(dx)
    of, hit, dx = of[apart], hit[apart], dx[apart]
    number = np.cumsum(np.append(False, seen["anchor"][1:] != seen["anchor"][:-1]))
    key = number[of] * len(cell["m_names"]) + cell["m_code"][hit]
    order = np.argsort(key)
    of, hit, dx, key = of[order], hit[order], dx[order], key[order]
    first = np.ones(len(of), bool)
    first[1:] = key[1:] != key[:-1]
    return {
        "anchor": seen["anchor"][of], "anchor_depth": seen["anchor_depth"][of], "mod": cell["m_mod"][hit], "mod_depth": cell["m_depth"][hit],
        "read_id": seen["read_id"][of], "dx": dx, "is_first": first,
    }


def _judged(pairs: Columns, seen: Columns) -> Columns:
    """One verdict per (anchor, mod)."""
    starts = np.flatnonzero(pairs["is_first"])
    out = {name: pairs[name][starts] for name in ("anchor", "anchor_depth", "mod", "mod_depth")}
    n = np.diff(np.append(starts, len(pairs["dx"])))
    low, high = np.minimum.reduceat(pairs["dx"], starts), np.maximum.reduceat(pairs["dx"], starts)
    down = low > 0
    split = ~down & (high > 0)
    dist = np.where(down, low, np.where(split, -low, -high))
    # Occurrences are sorted by anchor; with its number in front, one search tells how many reaches fall short.
    names, number = np.unique(seen["anchor"], return_inverse=True)
    own, ends = np.searchsorted(names, out["anchor"]), np.cumsum(np.bincount(number))
    step = max(int(dist.max()), int(seen["upstream"].max()), int(seen["downstream"].max())) + 1
    reaching = np.zeros(len(starts), np.int64)
    for side, asked in (("upstream", ~down), ("downstream", down)):
        reach = np.sort(number * step + np.maximum(seen[side], 0))
        reaching[asked] = ends[own[asked]] - np.searchsorted(reach, own[asked] * step + dist[asked].astype(np.int64))
    return out | {
        "is_down": down, "is_split": split, "n": n, "dist": dist, "reaching": reaching,
        "is_poor": (n < out["mod_depth"]) & (2 * n < reaching),
        "is_good": (n == out["mod_depth"]) | (n >= 0.8 * reaching),
        "is_single": (n == 1) & (reaching >= 10),
    }


def pairing(verdicts: bool, w: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow`` over rows sorted by cell: PAIRS, or VERDICTS on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, w):
            for seen in _portions(cell):
                pairs = _paired(cell, seen)
                if len(pairs["dx"]):
                    out = _judged(pairs, seen) if verdicts else pairs
                    yield pa.RecordBatch.from_arrays([pa.array(values) for values in out.values()], names=list(out))

    return run
