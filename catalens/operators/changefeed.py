"""Applying a stream of inserts, updates and deletes to a bucketed table (problem 1).

The state keeps the newest op of each (path, volume), delete markers included, in hash buckets of the path. A batch of
changes is applied in four steps:

1. *combine*: before the shuffle every task reduces its rows with an aggregate in an embedded DuckDB, so a path that
   holds a third of the feed leaves each task as a few rows; the reduced batch is written once;
2. *upsert*: rows go to their bucket; there a DuckDB table whose primary key is the 128-bit hash of (path, volume), so that
   the index has the same small size for paths of any length, takes them in Arrow batches by
   ``INSERT ... ON CONFLICT DO UPDATE ... WHERE excluded.op > stored.op``. The condition compares sequences, so order of
   arrival and repeats don't matter, and a delete marker that is kept keeps a late older insert dead;
3. *export*: the task hands its rows back and Spark's committer writes them as new folders, one per bucket;
4. *publish*: one manifest names the folders of all buckets and of the prefix deletes; until it exists readers see the
   old version. Buckets without changes keep their folder.

A lost executor costs a rerun of its tasks: nothing is kept in a worker between tasks. Memory: the manifest counts the rows
of the state, and the number of buckets, a power of two, is doubled when rows of state and batch together are more than
``bucket_rows`` for each bucket; a bucket b of B then splits into b and b + B by one more bit of its hash, in the apply that
asks for it. What a bucket still holds beyond DuckDB's memory goes to Spark's scratch folder of the task, like Spark's own
spills, and is gone with the task.

Prefix deletes don't change stored rows: they are resolved when a version is read, row by row (:mod:`catalens.operators.live`).

Nulls, ties and clashing columns: see :mod:`catalens.operators.live`; here a null volume is stored as ''. An empty batch
publishes a version without changes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.operators.live import PAYLOAD, cleaned_ops, reduced_tombstones, resolve
from catalens.schemas import OPLOG_SCHEMA, TOMB_SCHEMA
from catalens.session import shuffle_partitions, written
from catalens.sources.versioned import VersionedTable

#: Rows of a bucket; DuckDB's memory suffices for four times as many, then it spills until its index alone fills it.
BUCKET_ROWS = 1_000_000
#: Rows that a task combines at once before the shuffle.
COMBINE_ROWS = 120_000
MEMORY = "400MB"
#: ``h`` is the hash of the path; its lowest bits are the number of the bucket.
STATE_SCHEMA = T.StructType([T.StructField("h", T.IntegerType()), *OPLOG_SCHEMA.fields])
_WRITTEN = T.StructType([*STATE_SCHEMA.fields, T.StructField("b", T.IntegerType())])
_FIELDS = ["seq", "is_delete", *PAYLOAD]
_OP = "{" + ", ".join(f"'{c}': {c}" for c in _FIELDS) + "}"
_REDUCE = f"SELECT any_value(h) AS h, path, volume, max({_OP}) AS op FROM batch GROUP BY path, volume"
_OUT = "SELECT h, path, volume, " + ", ".join(f"op.{c} AS {c}" for c in _FIELDS) + " FROM "
_TYPES = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}
_ARROW = pa.schema([(f.name, _TYPES[f.dataType]) for f in STATE_SCHEMA.fields])
_COLUMNS = [f.name for f in _ARROW]


def _connect(memory: str = MEMORY):
    import duckdb

    scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    db = duckdb.connect(":memory:")
    for s in ("threads=1", f"memory_limit='{memory}'", f"temp_directory='{scratch and f'{scratch}/duckdb-{uuid.uuid4().hex[:12]}'}'", "preserve_insertion_order=false"):
        db.execute("SET " + s)
    return db


def _batches(db, table: str) -> Iterator[pa.RecordBatch]:
    """The rows of a query on ``table`` in bounded Arrow batches."""
    reader = db.sql(_OUT + table).to_arrow_reader(20_000)
    for batch in reader:
        yield from pa.Table.from_batches([batch]).select(_COLUMNS).cast(_ARROW).to_batches()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches put together to tables of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def power_of_two(n: int) -> int:
    """The least one that isn't less."""
    return 1 << max(n - 1, 0).bit_length()


def _bucket(buckets: int):
    return F.col("h").bitwiseAND(buckets - 1).alias("b")


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, in a task before the shuffle."""
    db = _connect()
    for table in _gathered(batches, COMBINE_ROWS):
        db.register("batch", table)
        yield from _batches(db, f"({_REDUCE})")
        db.unregister("batch")
    db.close()


def upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over the rows of a bucket: those of the last version and the changes, in any order."""
    db, table = _connect(), None
    keyed = _REDUCE.replace("SELECT ", "SELECT md5_number(path || chr(0) || volume) AS k, ", 1)
    for part in _gathered(batches, 20_000):
        db.register("batch", part)
        if table is None:
            db.execute(f"CREATE TABLE state AS {keyed} LIMIT 0")
            db.execute("ALTER TABLE state ADD PRIMARY KEY (k)")
            table = "state"
        db.execute(f"INSERT INTO state {keyed} ON CONFLICT (k) DO UPDATE SET op = excluded.op WHERE excluded.op > state.op")
        db.unregister("batch")
    if table:
        yield from _batches(db, table)
    db.close()


class ChangeFeed:
    """The state below ``root``."""

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.bucket_rows = spark, bucket_rows
        self.table = VersionedTable(spark, root)

    def apply(self, ops: DataFrame, tombs: DataFrame | None = None) -> dict:
        """Apply a batch of ops and prefix deletes; gives the manifest that was published."""
        old = self.table.manifest()
        meta = dict(old["meta"])
        held, rows, buckets = meta.get("state", {}), meta.get("rows", 0), meta.get("buckets", 0)

        changes = written(self._hashed(ops).mapInArrow(combine, STATE_SCHEMA), "changes")
        fits = power_of_two(max(shuffle_partitions(self.spark), -(-(rows + changes.count()) // self.bucket_rows)))
        if fits > buckets:  # buckets split: all are written again
            before, kept, buckets = list(held.values()), {}, fits
        else:
            touched = {str(r[0]) for r in changes.select(_bucket(buckets)).distinct().collect()}  # at most as many as there are buckets
            before, kept = [held[b] for b in touched if b in held], {b: f for b, f in held.items() if b not in touched}
        folder = self.table.new_folder()
        both = changes.unionByName(self._read([f for f, _ in before])) if before else changes
        states = both.repartitionById(buckets, _bucket(buckets)).mapInArrow(upsert, STATE_SCHEMA)
        self.table.write(states.withColumn("b", _bucket(buckets)), folder, by="b")
        counts = {str(b): n for b, n in self.table.read([folder], _WRITTEN).groupBy("b").count().collect()}  # one row per bucket
        state = kept | {b: [f, counts.get(b, 0)] for b, f in self.table.folders_by(folder).items()}

        deletes: list[str] = []
        if tombs is not None or meta.get("tombs"):
            known = self._tombs(meta)
            both = known if tombs is None else known.unionByName(tombs.select(*[F.col(f.name).cast(f.dataType) for f in TOMB_SCHEMA.fields]))
            deletes = [self.table.new_folder()]
            self.table.write(reduced_tombstones(both).select(F.col("t_volume").alias("volume"), F.col("t_prefix").alias("prefix"), F.col("t_seq").alias("seq")), deletes[0])
        meta |= {"buckets": buckets, "state": state, "rows": sum(n for _, n in state.values()), "tombs": deletes}
        return self.table.publish(sorted({f.split("/")[0] for f, _ in state.values()} | set(deletes)), meta, expect=old["version"])

    def _hashed(self, ops: DataFrame) -> DataFrame:
        rows = cleaned_ops(ops).withColumn("volume", F.coalesce("volume", F.lit("")))
        return rows.select(F.xxhash64("path").bitwiseAND(0x7FFFFFFF).cast("int").alias("h"), *_COLUMNS[1:])

    def _read(self, folders: list[str]) -> DataFrame:
        return self.table.read(folders, STATE_SCHEMA).select(_COLUMNS)

    def _tombs(self, meta: dict) -> DataFrame:
        return self.table.read(meta.get("tombs", []), TOMB_SCHEMA)

    def newest(self, version: int | None = None) -> DataFrame:
        """The stored ops, delete markers too."""
        return self._read([f for f, _ in self.table.manifest(version)["meta"].get("state", {}).values()]).drop("h")

    def current(self, payload: list[str] = PAYLOAD, version: int | None = None) -> DataFrame:
        """One row per live path of a version."""
        return resolve(self.newest(version), self._tombs(self.table.manifest(version)["meta"]), payload)
