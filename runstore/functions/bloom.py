"""Sizing of Bloom filters."""

from __future__ import annotations

import math


def bits(n: int, p: float) -> int:
    """Bits for n keys at a false-positive rate p."""
    return math.ceil(-(n * math.log(p)) / math.log(2) ** 2)


def hashes(n: int, m: int) -> int:
    """The better of the two whole numbers beside ln 2 * m / n, at least 1."""
    ideal = math.log(2) * m / n
    low, high = max(1, math.floor(ideal)), max(1, math.ceil(ideal))
    return low if rate(n, m, low) <= rate(n, m, high) else high


def capacity(m: int, p: float) -> int:
    """Keys that m bits hold at a rate p."""
    return math.ceil(-m * math.log(2) ** 2 / math.log(p))


def rate(n: int, m: int, k: int) -> float:
    return (1 - math.exp(-k * n / m)) ** k


def rate_of_bits_per_key(bits_per_key: float) -> float:
    return 0.6185**bits_per_key
