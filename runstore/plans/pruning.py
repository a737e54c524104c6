"""What to read: files that a key range touches, and which of them need merging at all."""

from __future__ import annotations

import bisect

from ..sources.manifest import Run


def pruned(runs: list[Run], low: bytes | None = None, high: bytes | None = None, as_of: int | None = None) -> list[Run]:
    """Files that may hold a key within [low, high] with a sequence not above ``as_of``."""
    a, b = low.hex().upper() if low is not None else None, high.hex().upper() if high is not None else None
    return [r for r in runs if r.overlaps(a, b) and (as_of is None or r.min_seq <= as_of)]


def holding(runs: list[Run], keys: list[bytes] | None) -> list[Run]:
    """Files whose range holds one of ``keys`` at least; all if there is no such list."""
    if keys is None:
        return runs
    wanted = sorted(k.hex().upper() for k in keys)
    return [r for r in runs if (i := bisect.bisect_left(wanted, r.first_key)) < len(wanted) and wanted[i] <= r.last_key]


def components(runs: list[Run]) -> list[list[Run]]:
    """Files grouped so that key ranges of different groups don't meet; a group of one needs no merge."""
    out: list[list[Run]] = []
    last = None
    for r in sorted(runs, key=lambda r: (r.first_key, r.last_key)):
        if last is not None and r.first_key <= last:
            out[-1].append(r)
            last = max(last, r.last_key)
        else:
            out.append([r])
            last = r.last_key
    return out


def disjoint(runs: list[Run]) -> bool:
    return all(len(c) == 1 for c in components(runs))
