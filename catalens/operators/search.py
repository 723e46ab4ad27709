"""Search and recent files over live entries and their postings.

Deleted and older versions are gone before any filter is applied (the entries are a live view), so a filter can't bring
back what a newer version hides. The order of results is total: score, time of change, kind, path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.score import score_column
from catalens.functions.tokens import depth
from catalens.model import SearchOptions
from catalens.operators.filters import latest, of_options, recent_since
from catalens.operators.postings import match_all
from catalens.plans.query import parse, scoring_cap
from catalens.schemas import RESULT_COLUMNS, RESULT_SCHEMA
from catalens.session import small

#: Live entries, or a function that gives those of some paths.
Entries = DataFrame | Callable[[DataFrame], DataFrame]


def prerank(rows: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` rows that are scored: directories first, then shallow ones, then recent ones; ties by path. Planned as a
    bounded heap in each task."""
    return rows.orderBy((F.col("kind") == 1).desc(), depth(F.col("path")).asc(), latest(micros=False).desc(), F.col("path").asc()).limit(cap)


def ranked(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("last_modified").desc(), F.col("kind").asc(), F.col("path").asc()]
    return rows.orderBy(*order).offset(offset).limit(limit)


def bounded(paths: DataFrame) -> DataFrame:
    """Distinct paths, sent to all tasks if a count shows at most ``BROADCAST_ROWS`` of them, so that the log they are looked up
    in isn't shuffled. The count reads the few row groups once more that the terms are in; nothing is left behind on disk."""
    return F.broadcast(paths) if small(paths) else paths


def candidates(entries: Entries, postings: DataFrame, text: str, limit: int, offset: int, options: SearchOptions) -> DataFrame:
    """The rows that match and pass the filters, at most the scoring cap."""
    query, cap = parse(text), scoring_cap(limit, offset, options)
    paths = match_all(postings, query, options, cap)
    rows = entries(bounded(paths)) if callable(entries) else entries.join(paths, "path", "left_semi")
    return prerank(rows.where(of_options(options)), cap)


def search(entries: Entries, postings: DataFrame, text: str, limit: int, offset: int = 0, options: SearchOptions = SearchOptions(), now_micros: int = 0) -> DataFrame:
    """One page of results. A query without tokens has none."""
    query = parse(text)
    if not query.tokens:
        return postings.sparkSession.createDataFrame([], RESULT_SCHEMA)
    rows = candidates(entries, postings, text, limit, offset, options)
    make = options.scoring.function or score_column
    score = make(options.scoring.weights, list(query.tokens), list(query.raw), now_micros)
    if _in_python(rows, score):
        # A Python score would be moved below the limit of the pre-ranking and make it a full sort; this keeps it above.
        rows = rows.mapInArrow(lambda batches: batches, rows.schema)
    return ranked(rows.withColumn("score", score).select(*RESULT_COLUMNS), limit, offset)


def _in_python(rows: DataFrame, score: Column) -> bool:
    plan = rows.limit(0).select(score)._jdf.queryExecution().analyzed().toString()
    return "UDF" in plan or "run(" in plan


def recent_paths(ops: DataFrame, since_seconds: int, options: SearchOptions) -> DataFrame:
    """The paths with an op that passes the filters of :func:`recent_files`."""
    return bounded(ops.where(recent_since(since_seconds) & of_options(options)).select("path").distinct())


def recent_files(entries: DataFrame, since_seconds: int, limit: int, offset: int = 0, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Entries changed or read since then, latest first; their score is 0."""
    rows = entries.where(recent_since(since_seconds) & of_options(options)).withColumn("score", F.lit(0.0))
    return rows.orderBy(latest().desc(), F.col("path").asc()).offset(offset).limit(limit).select(*RESULT_COLUMNS)


def page(number: int, size: int = 100) -> tuple[int, int]:
    """``(limit, offset)`` of a page; pages are counted from 0, and there is a next one only after a full page."""
    return size, number * size


def cutoff_seconds(now_micros: int, days: int = 5) -> int:
    """The time, in seconds, from which files count as recent."""
    return max(now_micros // 1_000_000 - days * 86_400, 0)
