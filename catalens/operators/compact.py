"""Which generations to merge."""

from __future__ import annotations

from catalens.model import CompactorConfig


def merge_candidates(sizes: list[int], config: CompactorConfig = CompactorConfig(), tombstones: int = 0) -> list[int]:
    """Indices of the generations to merge next, from their row counts in order of age; empty if none.

    Too many prefix deletes force all to be merged, since only that can drop them. Else generations are classed by powers
    of four of their bytes of metadata (16 a row), and the smallest class with ``min_merge_count`` members gives its oldest
    ones. Failing that, with more than three times as many generations, the smallest are merged."""
    if tombstones > config.tombstone_threshold:
        return list(range(len(sizes)))
    classes: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        classes.setdefault((max(16 * n, 1).bit_length() - 1) // 2, []).append(i)
    for _, members in sorted(classes.items()):
        if len(members) >= config.min_merge_count:
            return members[: config.min_merge_count]
    if len(sizes) > 3 * config.min_merge_count:
        return sorted(range(len(sizes)), key=lambda i: sizes[i])[: config.min_merge_count]
    return []
