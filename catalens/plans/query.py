"""Parsing a query into term predicates, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from catalens.functions.tokens import EXTENSION_TAG, is_alnum, tokenize_text
from catalens.model import SearchOptions


@dataclass(frozen=True)
class Query:
    """``tokens``: longest first in bytes, ties in byte order; those with the extension tag match whole terms, others are
    prefixes. ``raw``: the words as typed, in lower case."""

    tokens: tuple[str, ...]
    raw: tuple[str, ...]


def is_exact(token: str) -> bool:
    return token.startswith(EXTENSION_TAG)


def is_short(token: str, options: SearchOptions) -> bool:
    """Prefixes of so few characters that their expansion is limited."""
    return not is_exact(token) and len(token) <= options.short_prefix_threshold


def parse(text: str) -> Query:
    raw = text.lower().split()
    tokens = tokenize_text(text)
    for word in raw:
        if len(word) > 1 and word[0] == "." and all(is_alnum(c) for c in word[1:]):
            tokens.append(EXTENSION_TAG + word[1:])
    return Query(tuple(sorted(tokens, key=lambda t: -len(t.encode()))), tuple(raw))


def scoring_cap(limit: int, offset: int, options: SearchOptions) -> int:
    """How many candidates are scored at most."""
    usual = min(max(500, 3 * (limit + offset)), 1000)
    return max(limit + offset + 50, usual if options.max_scoring_cap is None else options.max_scoring_cap)
