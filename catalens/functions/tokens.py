"""Tokens and parts of paths.

Text in ASCII is handled by built-in functions, in generated code; other text by one Arrow function, to which ASCII rows
are handed as nulls, so their text never leaves the JVM. Null text gives null.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of terms made from volume and extension.
VOLUME_TAG, EXTENSION_TAG, PATH_TAG = "\x01", "\x02", "\x00"
# The blocks whose characters are split one by one.
CJK_RANGES = ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F))

_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_RUNS = regex.compile(rf"[{_CJK}&&[\p{{Alphabetic}}\p{{N}}]]+|[\p{{Alphabetic}}\p{{N}}--[{_CJK}]]+", regex.V1)
_PIECES = regex.compile(r"(?<=\p{Lowercase})(?=\p{Uppercase})|(?<=\p{Alphabetic})(?=\p{N})|(?<=\p{N})(?=\p{Alphabetic})", regex.V1)
_CJK_ONE = regex.compile(rf"[{_CJK}]")


@lru_cache(50_000)
def is_alnum(c: str) -> bool:
    """Alphabetic by Unicode, or a number of any kind."""
    return _ALNUM.match(c) is not None


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK_RANGES)


def fold_text(text: str) -> str:
    """Decomposed, without accents, in lower case."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M").lower()


def _run_tokens(run: str) -> frozenset[str]:
    if _CJK_ONE.match(run):
        out = {fold_text(run[i:]) for i in range(len(run))} | {fold_text(c) for c in run}
    else:
        out = {fold_text(p) for p in (run, *_PIECES.split(run)) if p}
    return frozenset(out - {""})


_short_run_tokens = lru_cache(100_000)(_run_tokens)


def tokenize_text(text: str) -> list[str]:
    """The tokens of a text: its runs of letters and digits, and their pieces at changes of case and between letters and
    digits; of a run in a script without blanks every character and every ending of the run. Runs repeat, so those of
    usual length are remembered."""
    runs = set(_RUNS.findall(unicodedata.normalize("NFKC", text)))
    out = set().union(*[_short_run_tokens(r) if len(r) < 64 else _run_tokens(r) for r in runs])
    return sorted(out, key=lambda t: t.encode())


def is_ascii(c: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(c) == F.char_length(c)


def _arrow(make, kind: str):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else make(t))

    return run


def ascii_tokens(c: Column) -> Column:
    """The tokens of text in ASCII, null for other text."""
    runs = F.split(c, "[^A-Za-z0-9]+")
    pieces = F.split(c, "[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
    words = F.filter(F.concat(runs, pieces), lambda t: t != "")
    return F.when(is_ascii(c), F.array_sort(F.array_distinct(F.transform(words, F.lower))))


def tokens(c: Column) -> Column:
    """The tokens of any text, sorted by bytes."""
    other = _arrow(tokenize_text, "array<string>")(F.when(~is_ascii(c), c))
    return F.coalesce(ascii_tokens(c), other)


def folded(c: Column) -> Column:
    """:func:`fold_text` of a column."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(_arrow(fold_text, "string")(F.when(~is_ascii(c), c)))


def trimmed(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def basename(path: Column) -> Column:
    """What stands after the last separator, trailing separators aside."""
    return F.substring_index(trimmed(path), "/", -1)


def extension(path: Column) -> Column:
    """What stands after the last dot of the name; null without one, for a name that only begins with it, and for ``..``."""
    name = basename(path)
    return F.when(name.rlike("(?s)^.+\\.[^.]*$") & (name != ".."), F.regexp_extract(name, "(?s)^.+\\.([^.]*)$", 1))


def hidden_extension(path: Column) -> Column:
    """Of a name that begins with a dot the first word after it, unless it is the extension too; else null."""
    name = basename(path)
    word = F.regexp_extract(name, "(?s)^\\.([^.]+)", 1)
    return F.when((word != "") & ~word.eqNullSafe(extension(path)), word)


def ancestor_terms(path: Column) -> Column:
    """The leading parts of a path that end with a separator, but for one at its start, in lower case."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(path), F.lit(1))), lambda i: (i > 1) & F.substring(path, i, F.lit(1)).isin("/", "\\"))
    return F.transform(ends, lambda i: F.lower(F.substring(path, F.lit(1), i)))


def depth(path: Column) -> Column:
    """The number of separators, at most 255."""
    return F.least(F.length(path) - F.length(F.replace(path, F.lit("/"))), F.lit(255))


def normalised_prefix(prefix: Column) -> Column:
    """A prefix as prefix deletes store it: one kind of separator, lower case."""
    return F.lower(F.translate(prefix, "\\", "/"))


def all_terms(path: Column, volume: Column) -> Column:
    """The terms an entry is indexed under: its tokens, its volume and extensions with their tags, and its folded name if
    that has a dot and begins with a letter or digit."""
    tag = lambda t, c: F.when(c.isNotNull(), F.concat(F.lit(t), F.lower(c)))
    name = basename(path)
    whole = F.when(name.contains(".") & name.rlike("^[\\p{IsAlphabetic}\\p{N}]"), folded(name))
    extra = F.array(F.when(volume != "", tag(VOLUME_TAG, volume)), tag(EXTENSION_TAG, extension(path)), tag(EXTENSION_TAG, hidden_extension(path)), whole)
    return F.array_distinct(F.concat(tokens(path), F.filter(extra, lambda t: t.isNotNull())))
