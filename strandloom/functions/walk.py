"""One greedy walk along reads that share a k-mer; shipped by value to the tasks."""

from __future__ import annotations

import sys
from bisect import bisect_right
from statistics import median_low

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Track:
    """A read in the direction of the walk: its stops (position, oriented k-mer) in order, and where it lies in the layout."""

    def __init__(self, stops, length, start, offset):
        self.stops = sorted(stops)
        self.positions = [x for x, _ in self.stops]
        self.length, self.at, self.start = length, start, offset - start
        self.hits, self.end = 0, offset - start + length

    def ahead(self):
        """The next stop, None at the read's end."""
        i = bisect_right(self.positions, self.at)
        return self.stops[i] if i < len(self.stops) else None

    def meets(self, kmer):
        """Position of the first stop ahead with this k-mer, None without one."""
        return next((x for x, k in self.stops[bisect_right(self.positions, self.at) :] if k == kmer), None)


def greedy_walk(tracks, seed, offset, step):
    """Go from k-mer to k-mer while over half of the reads still under way step there; the nearest such k-mer wins.

    ``tracks`` maps reads to ``Track``s that all stand on the seed; ``step`` is 1 or
    -1. Reads that stand on the present k-mer vote for their next stop. Those that voted
    for the winner go there, others go to it if they meet it further on, or else as far as the voters' median;
    a read whose end is passed is done and does not come back. As every
    round moves at least one read on to a later of its stops, the walk ends.

    Returns layout rows (read, start, end, hits) and path rows (kmer, is_fwd, offset, support, active).
    """
    under_way, on_kmer, here, path = dict(tracks), set(tracks), seed, []
    while True:
        votes = {}
        for read in sorted(on_kmer):
            stop = under_way[read].ahead()
            if stop:
                votes.setdefault(stop[1], {})[read] = stop[0] - under_way[read].at
        carried = {kmer: moves for kmer, moves in votes.items() if 2 * len(moves) > len(under_way)}
        winner = min(carried, key=lambda kmer: (min(carried[kmer].values()), kmer), default=None)
        moves = carried.get(winner, {})
        path.append((here[1], here[0], offset, len(moves), len(under_way)))
        if winner is None:
            break
        move = median_low(moves.values())
        offset += step * move
        on_kmer = set()
        for read, track in list(under_way.items()):
            met = track.at + moves[read] if read in moves else track.meets(winner)
            track.at = met if met is not None else track.at + move
            if met is not None:
                on_kmer.add(read)
                track.hits += 1
                track.end = offset - track.at + track.length
            elif track.at > track.length:
                del under_way[read]
        here = winner
    rows = [(read, track.start, track.end, track.hits) for read, track in tracks.items()]
    return sorted(rows, key=lambda row: (row[1], row[0])), path
