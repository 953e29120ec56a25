"""Plain Python restatements used to check the Spark operators on small inputs."""

from __future__ import annotations

CODE = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 0}


def windows(seq, p):
    codes = [CODE[c] for c in seq.upper() if c in CODE]
    for pos in range(len(codes) - p.k + 1):
        forward = reverse = 0
        for c in codes[pos : pos + p.k]:
            forward = forward * 4 + c
        for c in reversed(codes[pos : pos + p.k]):
            reverse = reverse * 4 + 3 - c
        hf, hr = ((v * p.factor % 2**64) >> p.shift for v in (forward, reverse))
        yield pos, (forward if hf < hr else reverse), min(hf, hr), hf < hr


def sampled(seq, p):
    return [(pos, kmer, fwd) for pos, kmer, h, fwd in windows(seq, p) if h % p.w == 0]


def jumping(seq, p):
    found = list(windows(seq, p))
    out, start, last = [], 0, None
    while start < len(found):
        window = found[start : start + p.w]
        low = min(h for _, _, h, _ in window)
        if last is not None and len(window) < p.w and low >= last:
            break
        pos = min((q for q, _, h, _ in window if h == low), key=lambda q: q % p.w)
        out.append((pos, low))
        start, last = pos + 1, low
    return out


def chain(seeds, ref_of, strict=False):
    """``seeds``: (ord, pos, [loc] or [loc, loc]) with one or two places."""
    blocks, block = [], None

    def fits(b, loc):
        if ref_of[loc] != ref_of[b["start"]]:
            return False
        if b["start"] == b["end"]:
            return True
        if abs(abs(b["end"] - b["start"]) - (b["iN"] - b["i0"])) > 50:
            return False
        return loc >= b["end"] if b["end"] > b["start"] else loc <= b["end"]

    for order, pos, places in seeds:
        single = len(places) == 1
        at, new = places[0], True
        if block and block["start"]:
            new = not fits(block, at)
            if new and not single:
                at = places[1]
                new = not fits(block, at)
        if new:
            if block and block["n1"] > 2:
                blocks.append(block)
            block = {"start": at, "i0": order, "q0": pos, "n1": 0, "n2": 0}
        block["n1" if single else "n2"] += 1
        block.update(end=at, iN=order, qN=pos)
    if block and block["n2" if strict else "n1"] > 2:
        blocks.append(block)
    return [(b["q0"], b["qN"], b["start"], b["end"], b["n1"], b["n2"]) for b in blocks]


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def thin(hits, gap):
    kept, free = [], {}
    for read, x in sorted(hits):
        if x >= free.get(read, 0):
            kept.append((read, x))
            free[read] = x + gap
    return kept


def overlap_counts(hits):
    """``hits``: (read, pos, kmer) of single-copy k-mers; shared hits per ordered pair."""
    first, every = set(), {}
    for read, _, kmer in hits:
        first.add((read, kmer))
        every.setdefault(kmer, []).append(read)
    pairs = {}
    for read, kmer in first:
        for other in every[kmer]:
            pairs[read, other] = pairs.get((read, other), 0) + 1
    return pairs
