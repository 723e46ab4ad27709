"""Processing only new or changed records (problem 6): the target is the state.

No cursor is kept beside the data. Every row written to the target carries the key and the version of the source row it
was made from; a run takes in the source rows that an anti-join does not find there, writes them to a new folder and
publishes the next version of the target with one manifest. A run that fails before that leaves the target as it was, and
the next run finds the same rows again; a run that is repeated after publishing finds none.

For an op log whose past runs are only known from a run log, :func:`taken_in` gives the rows that successful runs took in;
they are the target's first version. There the key is the op's seq and the version its last_modified, so that a record
that changed since it was taken in would come out again.

Hot keys: keys are made distinct by a partial aggregate before the join, so a key with a third of all rows is one row.
Nulls: rows without key can't be recognised again and are left out. Empty source or target: no rows / all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.session import BROADCAST_ROWS
from catalens.sources.versioned import VersionedTable

TARGET_SCHEMA = T.StructType([T.StructField("source_key", T.LongType()), T.StructField("source_version", T.LongType())])
#: Folders of a target after which they are merged; so a run reads at most that many rows of a key.
MOST_FOLDERS = 16
_NEVER = np.iinfo(np.int64).min


def successful_runs(runs: DataFrame) -> DataFrame:
    """One row per run whose latest log row says ``committed``; of rows logged at one time the state last in the alphabet
    counts, so a run that is also said to have failed or gone on isn't successful."""
    last = F.max(F.struct("logged_at", "run_state", "started_at", "basis", "lo", "hi")).alias("r")
    return runs.where("run_id is not null and logged_at is not null").groupBy("run_id").agg(last).select("run_id", "r.*").where("run_state = 'committed' and started_at is not null and lo < hi").drop("run_state", "logged_at")


def cover(lo: np.ndarray, hi: np.ndarray, started: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The latest start among the runs that cover x (``lo < x <= hi``), as a step function: ends of the steps, ascending,
    and the value up to each end; beyond the last end nothing covers."""
    ends = np.unique(np.concatenate([lo, hi]))
    order, value, heap, k = np.argsort(lo, kind="stable"), np.full(len(ends), _NEVER, np.int64), [], 0
    for i in range(1, len(ends)):
        while k < len(order) and lo[order[k]] < ends[i]:
            heapq.heappush(heap, (-int(started[order[k]]), int(hi[order[k]])))
            k += 1
        while heap and heap[0][1] < ends[i]:
            heapq.heappop(heap)
        if heap:
            value[i] = -heap[0][0]
    return ends, value


def taken_in(ops: DataFrame, runs: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``seq`` and ``last_modified`` of every op row that some successful run took in: the run started at or after the row's arrival, and its
    window (lo, hi] holds the row's seq (basis ``seq``) or last_modified (basis ``mtime``).

    Of the runs that cover a point only the latest start matters, so each basis becomes a step function of at most two
    steps a run, which tasks search by bisection: no row meets a list of runs. Beyond ``bound`` successful runs the step
    functions aren't built; rows and runs are then joined on the buckets of the x-axis that the windows touch."""
    good = successful_runs(runs).select("basis", "lo", "hi", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started"))
    rows = ops.where("seq is not null and arrived_at is not null").select("seq", "last_modified", F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("arrived"))
    if good.limit(bound + 1).count() > bound:
        return _taken_in_joined(rows, good)
    steps: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    held = good.toPandas()  # at most ``bound`` rows
    for basis, part in held.groupby("basis"):
        steps[basis] = cover(*(part[c].to_numpy(np.int64) for c in ("lo", "hi", "started")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrived, hit = b.column("arrived").to_numpy(zero_copy_only=False), np.zeros(b.num_rows, bool)
            for basis, column in (("seq", "seq"), ("mtime", "last_modified")):
                if basis in steps:
                    ends, value = steps[basis]
                    known = b.column(column).is_valid().to_numpy(zero_copy_only=False)
                    at = np.searchsorted(ends, b.column(column).fill_null(0).to_numpy(zero_copy_only=False), side="left")
                    hit |= known & (at < len(ends)) & (np.append(value, _NEVER)[at] >= arrived)
            yield b.filter(pa.array(hit)).select(["seq", "last_modified"])

    return rows.mapInArrow(look, "seq long, last_modified long")


def _taken_in_joined(rows: DataFrame, good: DataFrame) -> DataFrame:
    """The same for any number of runs: windows are laid out on at most 512 buckets whose edges are quantiles of the
    windows' ends. A window that covers a whole bucket counts there by its start alone, as one maximum per bucket; only
    the two buckets it ends in keep it as a window."""
    out = []
    for basis, column in (("seq", "seq"), ("mtime", "last_modified")):
        own = good.where(F.col("basis") == basis)
        ends = own.select(F.explode(F.array("lo", "hi")).alias("x"))
        edges = F.lit(np.unique(np.array(ends.approxQuantile("x", [i / 512 for i in range(513)], 0.0005), dtype=np.int64)).tolist()).cast("array<bigint>")
        place = lambda x: F.size(F.filter(edges, lambda e: e < x))  # noqa: E731, B023
        spans = own.select("lo", "hi", "started", place(F.col("lo")).alias("a"), place(F.col("hi")).alias("z"))
        whole = spans.where("z - a > 1").groupBy("a", "z").agg(F.max("started").alias("started"))
        whole = whole.select(F.explode(F.sequence(F.col("a") + 1, F.col("z") - 1)).alias("b"), "started").groupBy("b").agg(F.max("started").alias("w_started"))
        part = spans.select(F.explode(F.array_distinct(F.array("a", "z"))).alias("p"), "lo", "hi", "started")
        mine = rows.where(F.col(column).isNotNull()).select("seq", "last_modified", F.col(column).alias("x"), "arrived", place(F.col(column)).alias("b"))
        full = mine.join(F.broadcast(whole), "b").where("w_started >= arrived")  # at most 513 rows
        some = mine.join(part, (F.col("b") == F.col("p")) & (F.col("lo") < F.col("x")) & (F.col("x") <= F.col("hi")) & (F.col("started") >= F.col("arrived")), "left_semi")
        out += [full.select("seq", "last_modified"), some.select("seq", "last_modified")]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


class IncrementalTarget:
    """A target below ``root`` whose rows carry ``source_key`` and ``source_version``."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = VersionedTable(spark, root)

    def rows(self) -> DataFrame:
        return self.table.read(self.table.manifest()["folders"], TARGET_SCHEMA)

    def new(self, source: DataFrame, key: str, version: str) -> DataFrame:
        """Keys and versions of the source that the target doesn't hold in that version or a newer one. Of repeated
        source rows with one key the newest version counts."""
        mine = source.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("source_key")).agg(F.max(F.col(version).cast("long")).alias("source_version"))
        held = self.rows().select(F.col("source_key").alias("t_key"), F.col("source_version").alias("t_version"))
        seen = (F.col("source_key") == F.col("t_key")) & (F.coalesce("t_version", F.lit(_NEVER)) >= F.coalesce("source_version", F.lit(_NEVER)))
        return mine.join(held, seen, "left_anti")

    def take_in(self, rows: DataFrame) -> DataFrame:
        """Write the rows (``source_key``, ``source_version``) and publish them with all earlier ones as the next version;
        gives the rows as published. When the earlier ones are in ``MOST_FOLDERS`` folders, these become one with the newest
        version of each key, in the same publication."""
        old, folder = self.table.manifest(), self.table.new_folder()
        self.table.write(rows.select("source_key", "source_version"), folder)
        before = old["folders"]
        if len(before) >= MOST_FOLDERS:
            merged = self.table.new_folder()
            newest = self.table.read(before, TARGET_SCHEMA).groupBy("source_key").agg(F.max("source_version").alias("source_version"))
            self.table.write(newest, merged)
            before = [merged]
        self.table.publish([*before, folder], {"rows_of": folder}, expect=old["version"])
        self.table.vacuum()
        return self.table.read([folder], TARGET_SCHEMA)

    def run(self, source: DataFrame, key: str, version: str) -> DataFrame:
        """One run: what is new, taken in. Gives what was new."""
        return self.take_in(self.new(source, key, version))
