"""The manifest: which runs make a store. A new version's file is the one commit point of every change."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

FORMAT = 1


@dataclass(frozen=True)
class Run:
    """A sorted file: unique keys unless versioned; keys as upper-case hexadecimal, which sorts as the bytes do."""

    file: str
    first_key: str
    last_key: str
    entries: int
    tombstones: int
    bytes: int
    min_seq: int
    max_seq: int

    def overlaps(self, low: str | None, high: str | None) -> bool:
        return (high is None or self.first_key <= high) and (low is None or low <= self.last_key)


@dataclass(frozen=True)
class Manifest:
    """``l0``: batches oldest first, each the files of one write; ``levels``: files of disjoint key ranges, in order."""

    version: int = 0
    mode: str = "plain"
    next_seq: int = 1
    published: int = 0
    l0: tuple[tuple[Run, ...], ...] = ()
    levels: tuple[tuple[Run, ...], ...] = ()
    sources: dict[str, int] = field(default_factory=dict)  # the last batch of each stream

    def runs(self) -> list[Run]:
        return [r for group in (*self.l0, *self.levels) for r in group]

    def next(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)

    def to_json(self) -> str:
        return json.dumps({"format": FORMAT} | asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        x = json.loads(text)
        if x.pop("format", None) != FORMAT:
            raise ValueError("unknown manifest format")
        groups = lambda g: tuple(tuple(Run(**r) for r in group) for group in g)
        return cls(**x | {"l0": groups(x["l0"]), "levels": groups(x["levels"])})


def name(version: int) -> str:
    return f"manifest-{version:012d}.json"
