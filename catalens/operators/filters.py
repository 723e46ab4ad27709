"""Predicates on entries. A null code never passes a filter."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.model import Kind, SearchOptions


def kind_is(kind: int) -> Column:
    """Directories, or all that are none: links count as files."""
    is_dir = F.col("kind") == int(Kind.DIRECTORY)
    return is_dir if kind == Kind.DIRECTORY else ~is_dir


def category_has(mask: int) -> Column:
    """Some bit in common; a mask of 0 passes nothing."""
    return F.col("category").bitwiseAND(F.lit(mask)) != 0


def volume_type_in(types: tuple[int, ...]) -> Column:
    return F.col("volume_type").isin(*[int(t) for t in types]) if types else F.lit(False)


def volume_is(name: str) -> Column:
    return F.col("volume") == name


def latest(micros: bool = True) -> Column:
    """The later of both times; seconds are cut, not rounded."""
    a, b = F.coalesce("last_modified", F.lit(0)), F.coalesce("last_accessed", F.lit(0))
    return F.greatest(a, b) if micros else F.greatest(F.expr("coalesce(last_modified, 0) div 1000000"), F.expr("coalesce(last_accessed, 0) div 1000000"))


def recent_since(seconds: int) -> Column:
    return latest(micros=False) >= seconds


def of_options(o: SearchOptions) -> Column:
    """All metadata filters of a search."""
    tests = [F.lit(True)]
    if o.kind is not None:
        tests.append(kind_is(o.kind))
    if o.category is not None:
        tests.append(category_has(o.category))
    if o.volume_type is not None:
        tests.append(volume_type_in(o.volume_type))
    if o.volume_name is not None:
        tests.append(volume_is(o.volume_name))
    return reduce(and_, tests)
