"""Codes, options and settings of the catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import IntEnum


class Kind(IntEnum):
    FILE = 0
    DIRECTORY = 1
    SYMLINK = 2


class VolumeType(IntEnum):
    LOCAL = 0
    NETWORK = 1
    REMOVABLE = 2
    UNKNOWN = 3


class Category:
    """Bits of the category mask."""

    OTHER, ARCHIVE, DOCUMENT, IMAGE, VIDEO, AUDIO, TEXT = 0, 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class Entry:
    """A file's metadata; times in microseconds since 1970."""

    path: str
    volume: str
    kind: int = Kind.FILE
    last_modified: int = 0
    last_accessed: int = 0
    category: int = Category.OTHER
    volume_type: int = VolumeType.LOCAL


@dataclass(frozen=True)
class ScoringWeights:
    base_exact_filename: float = 1.0
    base_exact_stem: float = 0.9
    base_filename_prefix: float = 0.7
    base_in_filename: float = 0.5
    base_in_path: float = 0.4
    penalty_extension: float = 0.5
    penalty_midword: float = 0.8
    mult_recency_max: float = 1.2
    recency_decay_rate: float = 0.1
    mult_dir: float = 1.1
    mult_file: float = 1.0
    mult_proximity_max: float = 1.15
    mult_ordered: float = 1.05
    coverage_immunity: float = 0.5


@dataclass(frozen=True)
class ScoringConfig:
    """``function``: takes ``(weights, tokens, raw_words, now_micros)`` and gives a Column over the candidates; None is the
    built-in score."""

    weights: ScoringWeights = field(default_factory=ScoringWeights)
    function: Callable | None = None


@dataclass(frozen=True)
class SearchOptions:
    scoring: ScoringConfig = field(default_factory=ScoringConfig)
    volume_name: str | None = None
    category: int | None = None
    kind: int | None = None
    volume_type: tuple[int, ...] | None = None
    max_expansions: int = 50
    max_scoring_cap: int | None = None
    short_prefix_threshold: int = 1


@dataclass(frozen=True)
class CompactorConfig:
    """``lateness``: how far, in sequence numbers, an op that brings its own sequence may be behind the newest; None is
    without bound, so that merges keep all delete markers. ``background``: merge beside the writer instead of letting it
    wait."""

    min_merge_count: int = 8
    flush_threshold: int = 100_000
    tombstone_threshold: int = 2_500
    lateness: int | None = None
    background: bool = False

    def with_(self, **changes: int) -> CompactorConfig:
        new = replace(self, **changes)
        if min(new.min_merge_count, new.flush_threshold, new.tombstone_threshold) < 1:
            raise ValueError("compactor settings are at least 1")
        return new
