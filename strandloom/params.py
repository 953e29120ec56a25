"""Sampling parameters and the seeded multiplier behind the k-mer hash."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import lru_cache

MAX_K = 31


def additive_feedback_random(seed: int, n: int) -> list[int]:
    """First ``n`` outputs of the C library's default additive-feedback generator.

    Published recurrence: 31 words from a Lehmer generator, then
    ``r[i] = r[i-3] + r[i-31] (mod 2^32)``; 310 warm-up values are discarded and
    the low bit is dropped. Seed 0 counts as 1.
    """
    state = [seed or 1]
    while len(state) < 31:
        state.append(16807 * state[-1] % 2147483647)
    state += state[:3]
    while len(state) < 344 + n:
        state.append((state[-3] + state[-31]) % 2**32)
    return [value >> 1 for value in state[344:]]


@lru_cache(maxsize=64)
def multiplier(seed: int) -> int:
    high, low = additive_feedback_random(seed, 2)
    return (high << 32) | low | 1


@dataclass(frozen=True)
class SketchParams:
    """k-mer length, sampling modulus (or window) and hash seed."""

    k: int = 19
    w: int = 31
    seed: int = 17

    def __post_init__(self) -> None:
        if not 1 <= self.k <= MAX_K:
            raise ValueError(f"k must be in 1..{MAX_K}, got {self.k}")
        if self.w < 1:
            raise ValueError(f"w must be positive, got {self.w}")

    @property
    def factor(self) -> int:
        return multiplier(self.seed)

    @property
    def shift(self) -> int:
        """Right shift that leaves a hash of 2k bits."""
        return 64 - 2 * self.k

    def compatible(self, other: "SketchParams") -> bool:
        return (self.k, self.w, self.factor) == (other.k, other.w, other.factor)

    def as_dict(self) -> dict[str, int]:
        return asdict(self)
