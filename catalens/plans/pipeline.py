"""Queries of the core problems 1 and 6, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.operators.changefeed import ChangeFeed
from catalens.operators.incremental import IncrementalTarget, taken_in
from catalens.plans.sql import LIVE
from catalens.session import run_dir
from catalens.sources.tables import table


def in_order(df: DataFrame, key: str, parts: int) -> list[DataFrame]:
    """A table in so many parts of its numbers, one after the other; rows without number are in the first."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return [df]
    edges = [low + (high + 1 - low) * i // parts for i in range(1, parts)]
    place = sum((F.when(F.col(key) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return [df.where(place == i) for i in range(parts)]


def _applied(spark: SparkSession, d: str, batches: int = 3) -> ChangeFeed:
    """The change feed applied as it arrives, in batches, each on the state that the one before left."""
    feed = ChangeFeed(spark, run_dir(spark, "p1"))
    changes, deletes = in_order(table(spark, d, "fs_oplog"), "rec_id", batches), in_order(table(spark, d, "fs_tombstones"), "tomb_id", batches)
    for i in range(max(len(changes), len(deletes))):
        feed.apply(changes[min(i, len(changes) - 1)], deletes[i] if i < len(deletes) else None)
    return feed


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).current(payload=[]).select("path", "seq")


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).current()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ops = table(spark, d, "fs_oplog")
    target = IncrementalTarget(spark, run_dir(spark, "p6"))
    done = taken_in(ops, table(spark, d, "index_runs"))
    target.take_in(done.groupBy(F.col("seq").alias("source_key")).agg(F.max("last_modified").alias("source_version")))
    return target.run(ops, "seq", "last_modified").selectExpr("source_key AS seq")


def p6_changed(spark: SparkSession, d: str) -> DataFrame:
    """Rulings that are new or have a newer version, after a run over the first versions, and one that failed."""
    docs = table(spark, d, "documents")
    target = IncrementalTarget(spark, run_dir(spark, "p6"))
    target.run(docs.where("version_no = 1"), "ruling_id", "version_no")
    target.new(docs, "ruling_id", "version_no").write.parquet(f"{target.table.root}/{target.table.new_folder()}")  # never published
    return target.run(docs, "ruling_id", "version_no").selectExpr("source_key AS ruling_id", "source_version AS version_no")


_TAKEN = """
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY logged_at DESC, run_state DESC) AS rn FROM index_runs),
good AS (SELECT DISTINCT basis, lo, hi, started_at FROM latest WHERE rn = 1 AND run_state = 'committed'),
taken AS (SELECT DISTINCT o.seq FROM fs_oplog o JOIN good g ON g.started_at >= o.arrived_at
          AND g.lo < CASE g.basis WHEN 'seq' THEN o.seq ELSE o.last_modified END AND CASE g.basis WHEN 'seq' THEN o.seq ELSE o.last_modified END <= g.hi)
"""

QUERIES = {"p1_found": p1_found, "p1_current": p1_current, "p6_found": p6_found, "p6_changed": p6_changed}
SQL = {
    "p1_found": LIVE + "SELECT path, seq FROM live",
    "p1_current": LIVE + "SELECT path, volume, kind, last_modified, last_accessed, category, volume_type, seq FROM live",
    "p6_changed": "SELECT ruling_id, CAST(max(version_no) AS BIGINT) AS version_no FROM documents WHERE ruling_id IS NOT NULL GROUP BY ruling_id HAVING max(version_no) > 1 OR min(version_no) > 1",
    "p6_found": _TAKEN + "SELECT DISTINCT seq FROM fs_oplog WHERE seq NOT IN (SELECT seq FROM taken)",
}
