"""The relevance score of a path for a query.

Every query token is looked up in the path; the best of its places counts (whole name, stem, start of the name, in the
name, in a folder), and the mean over the tokens makes the text score. It is then weighed by how much of the path was hit,
by age, kind, closeness and order of the hits, and by query words that stand in the path with their punctuation. Lengths
and places are in bytes of UTF-8. The score is only computed for rows that are left after pre-ranking, so it is an Arrow
function; its rules are too positional for an expression that stays readable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.functions.tokens import fold_text, is_alnum
from catalens.model import ScoringWeights

DAY_MICROS = 86_400 * 1_000_000


def places(text: bytes, token: bytes) -> list[int]:
    """Where a token stands in a text, overlaps too."""
    out, at = [], text.find(token)
    while at >= 0:
        out.append(at)
        at = text.find(token, at + 1)
    return out


def split_words(text: str) -> list[str]:
    """Runs of letters and digits."""
    return "".join(c if is_alnum(c) else " " for c in text).split(" ")


class _Target:
    """A path as the score looks at it."""

    def __init__(self, path: str):
        self.ascii = path.isascii()
        self.text = path if self.ascii else fold_text(path)
        self.full = self._bytes(self.text)
        self.trimmed_text = self.text.rstrip("/")
        self.trimmed = self._bytes(self.trimmed_text)
        self.name_at = self.trimmed.rfind(b"/") + 1

    def _bytes(self, text: str) -> bytes:
        return (text.lower() if self.ascii else text).encode()

    def needle(self, word: str) -> bytes:
        if self.ascii:
            return bytes(c + 32 if 65 <= c <= 90 else c for c in word.encode())
        return fold_text(word).encode()

    def token(self, token: str) -> bytes:
        return bytes(c + 32 if 65 <= c <= 90 else c for c in token.encode()) if self.ascii else token.encode()

    def starts_word(self, at: int) -> bool:
        if at == 0:
            return True
        return not is_alnum(self.trimmed[:at].decode()[-1])

    def words(self) -> int:
        return sum(w != "" for w in split_words(self.trimmed_text))


def _token_quality(w: ScoringWeights, p: _Target, token: bytes, raw: list[str], only: bool) -> tuple[float, bool, list[int]]:
    """Best place of a token, whether it names the file, and where it stands."""
    best, names = 0.0, False
    found = places(p.trimmed, token)
    for at in found:
        inside = at >= p.name_at
        if not p.starts_word(at):
            value = (w.base_in_filename if inside else w.base_in_path) * w.penalty_midword
        elif at != p.name_at:
            value = w.base_in_filename if inside else w.base_in_path
        else:
            rest = p.trimmed[at + len(token) :]
            names = names or not rest
            value = w.base_exact_filename if not rest else w.base_exact_stem if rest[:1] == b"." else w.base_filename_prefix
        best = max(best, value)
    suffixed = p.trimmed if p.ascii else p.full
    if suffixed.endswith(b"." + token):
        if any(len(r.encode()) > len(token) and r.encode().endswith(b"." + token) for r in raw):
            return max(best, w.base_exact_stem), True, found
        if only:
            best *= w.penalty_extension
    return best, names, found


def score(w: ScoringWeights, tokens: list[str], raw: list[str], path: str, kind: int, last_modified: int, last_accessed: int, now_micros: float) -> float:
    p = _Target(path)
    needles = [p.token(t) for t in tokens]
    total, names, hit = 0.0, False, set()
    for t in needles:
        value, named, found = _token_quality(w, p, t, raw, len(needles) == 1)
        total, names = total + value, names or named
        hit.update(found)
    base = total / len(needles) if needles else 0.0
    name = [c.lower() if c.isascii() else c for c in p.trimmed.decode()[len(p.trimmed[: p.name_at].decode()) :] if is_alnum(c)]
    asked = list("".join(tokens))
    if len(asked) - len(name) in (0, 1) and asked[: len(name)] == name:  # one character too many is let pass
        base, names = w.base_exact_filename, True
    out = base * 100.0
    words = p.words()
    if not names and words:
        out *= w.coverage_immunity + (1 - w.coverage_immunity) * min(len(hit) / min(words, 8.0), 1.0)
    age = (now_micros - max(last_modified or 0, last_accessed or 0)) / DAY_MICROS
    out *= 1 + (w.mult_recency_max - 1) * math.exp(-w.recency_decay_rate * max(age, 0.0))
    out *= w.mult_dir if kind == 1 else w.mult_file if kind == 0 else w.mult_file * 0.9
    if len(needles) > 1:
        first = [(at, len(t)) for t in needles if (at := p.full.find(t)) >= 0]
        span = max((a + n for a, n in first), default=0) - min((a for a, _ in first), default=0)
        if len(first) > 1 and span > 0:
            out *= 1 + (w.mult_proximity_max - 1) * min(sum(n for _, n in first) / span, 1.0)
    if len(raw) > 1 and _in_order(p, raw):
        out *= w.mult_ordered
    marked = [r for r in raw if any(not is_alnum(c) for c in r)]
    return out * (1 + sum(p.needle(r) in p.full for r in marked))


def _in_order(p: _Target, raw: list[str]) -> bool:
    """True if the words of the query, more than one, follow each other in the path."""
    at, n = 0, 0
    for word in (x for r in raw for x in split_words(r) if x):
        needle = p.needle(word)
        found = p.full.find(needle, at)
        if found < 0:
            return False
        at, n = found + len(needle), n + 1
    return n > 1


def score_column(weights: ScoringWeights, tokens: list[str], raw: list[str], now_micros: int) -> Column:
    """The score over ``path, kind, last_modified, last_accessed``."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for path, kind, modified, accessed in batches:
            m, a = modified.fillna(0), accessed.fillna(0)
            yield pd.Series([score(weights, tokens, raw, p, k, int(x), int(y), now_micros) for p, k, x, y in zip(path, kind, m, a, strict=True)], dtype="float64")

    return run("path", "kind", "last_modified", "last_accessed")
