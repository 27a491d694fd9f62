"""Leveled compaction: when a level is too large, which files move down, and what they become."""

from __future__ import annotations

from dataclasses import dataclass

from keystrand.functions.keys import level_limit
from keystrand.schema import LEVELS
from keystrand.sources.manifest import FileMeta, Version

#: Files of level 0 that start a compaction, and bytes of an output file.
LEVEL_ZERO_FILES = 4
OUTPUT_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Plan:
    """Files to merge, the level they go to, and whether tombstones may be dropped there."""

    level: int
    victims: tuple[FileMeta, ...]
    overlapped: tuple[FileMeta, ...]
    drop_tombstones: bool

    @property
    def inputs(self) -> tuple[FileMeta, ...]:
        return self.victims + self.overlapped


def level_to_compact(version: Version, level_zero_files: int = LEVEL_ZERO_FILES) -> int | None:
    """The first level over its limit: level 0 by number of files (at least so many), deeper ones
    by bytes (more than so many); the last level never."""
    if len({f.file_id.split("/")[0] for f in version.at_level(0)}) >= level_zero_files:
        return 0
    for level in range(1, LEVELS - 1):
        if sum(f.n_bytes for f in version.at_level(level)) > level_limit(level):
            return level
    return None


def plan(version: Version, level: int) -> Plan | None:
    """Level 0 moves as a whole, a deeper level its first file by key; with the files of the next
    level whose keys they overlap.  Tombstones go only where everything deeper is empty."""
    own = version.at_level(level)
    victims = own if level == 0 else own[:1]
    if not victims or level >= LEVELS - 1:
        return None
    low, high = min(f.smallest_key.encode() for f in victims), max(f.largest_key.encode() for f in victims)
    below = [f for f in version.at_level(level + 1) if f.smallest_key.encode() <= high and f.largest_key.encode() >= low]
    bottom = all(f.level <= level + 1 for f in version.files)
    return Plan(level + 1, tuple(victims), tuple(below), bottom)
