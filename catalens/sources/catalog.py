"""A catalogue of entries in a folder: inserts, deletes, search, recent files, compaction.

The folder holds generations, each a Parquet folder of ops and one of the terms of their paths sorted by term, and folders
of prefix deletes; a manifest names those that count (:mod:`catalens.sources.versioned`). A write adds a generation, a
compaction replaces some by one, readers keep to the version they have read. Single inserts and deletes are logged
(:mod:`catalens.sources.oplog`) and held back by the handle, visible to its own searches at once; they become a generation
by :meth:`Catalog.sync`, by closing, and when there are ``flush_threshold`` of them, for which the caller waits.

Sequences. All writers share one sequence. A generation stores its ops with numbers from 0, and its *base* is assigned by
the manifest that publishes it: the next free number of the version it goes on top of. So what is published later is newer,
whichever handle wrote it and whenever that was opened, and a writer that is overtaken needs no second write. Ops that
bring their own sequences (:meth:`Catalog.append_ops`) have the base 0 and lift the next free number above their highest.

What compaction may forget. Ops with sequences of their own can arrive late, after newer ones have been merged; then the
delete markers and prefix deletes that they must meet have to be there still. A merge therefore keeps them, unless no older
op can arrive: in a catalogue that has only ever numbered its ops itself, or below the *floor* that :meth:`Catalog.purge`
or the setting ``lateness`` sets. Ops and prefix deletes below the floor that arrive nevertheless are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions.tokens import normalised_prefix
from catalens.model import CompactorConfig, Entry, SearchOptions
from catalens.operators import search as S
from catalens.operators.compact import merge_candidates
from catalens.operators.live import PAYLOAD, cleaned_ops, live_view, newest_per_volume, reduced_tombstones, with_kill_seq
from catalens.operators.postings import postings, write_postings
from catalens.schemas import OPLOG_SCHEMA, POSTING_SCHEMA, TOMB_SCHEMA
from catalens.session import written
from catalens.sources.oplog import HeldLog, lines, logs
from catalens.sources.versioned import VersionConflict, VersionedTable

_COLUMNS = [f.name for f in OPLOG_SCHEMA.fields]
_ROW_BITS = 33
TRIES = 20
#: Entries whose terms one task makes.
TASK_ROWS = 500_000


class Catalog:
    """Open with the folder; use as a context manager, or :meth:`close` it."""

    def __init__(self, spark: SparkSession, root: str, config: CompactorConfig = CompactorConfig()):
        self.spark, self.config = spark, config
        self.table = VersionedTable(spark, root)
        self._log = HeldLog(self.table)
        self._held: list[list] = []
        self._pool: ThreadPoolExecutor | None = None
        self._job: Future | None = None
        self.recover()

    def __enter__(self) -> Catalog:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.sync()
        self._log.close()
        if self._pool:
            self._pool.shutdown(wait=True)
            self._pool = None

    # writing

    def insert(self, entry: Entry) -> None:
        """Add an entry or replace that of its path."""
        self._hold(["op", entry.path, entry.volume, int(entry.kind), entry.last_modified, entry.last_accessed, entry.category, int(entry.volume_type), False])

    def insert_batch(self, entries: DataFrame | Iterable[Entry], chunk_size: int = 10_000) -> None:
        """Add many entries. Of rows with one path the last counts: in a DataFrame that of the later partition, then the
        later row. A DataFrame is written as one generation without passing through the driver."""
        if not isinstance(entries, DataFrame):
            for e in entries:
                self.insert(e)
            return
        self.sync()
        rows = cleaned_ops(entries.withColumn("seq", F.monotonically_increasing_id()).withColumn("is_delete", F.lit(False)))
        rows = written(rows, "batch")  # numbered as written: the numbers of a task stay what they are if it runs again
        counts = rows.groupBy(F.shiftright("seq", _ROW_BITS).alias("task")).agg((F.max(F.col("seq").bitwiseAND((1 << _ROW_BITS) - 1)) + 1).alias("n")).orderBy("task").collect()  # one row per task
        starts, n = [], 0
        for task, count in counts:
            starts.append((task, n))
            n += count
        start = F.broadcast(self.spark.createDataFrame(starts, "task long, start long"))
        dense = rows.join(start, F.shiftright("seq", _ROW_BITS) == F.col("task")).withColumn("seq", F.col("start") + F.col("seq").bitwiseAND((1 << _ROW_BITS) - 1))
        self._publish([self._write(dense)], [], used=n)

    def append_ops(self, ops: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Add op rows that bring their own sequences. With the name of a stream and the number of its batch, a batch that
        is already in is not added again; gives whether it was added."""
        meta = self._meta()
        if stream is not None and meta.get("streams", {}).get(stream, -1) >= batch:
            return False
        self.sync()
        rows = cleaned_ops(ops)
        if meta.get("floor"):
            rows = rows.where(F.col("seq") >= meta["floor"])
        self._publish([self._write(rows, own=True)], [], {stream: batch} if stream is not None else None, own=True)
        return True

    def delete(self, path: str) -> None:
        """Delete a path; unknown ones too, which hides late inserts."""
        self._hold(["op", path, "", 0, 0, 0, 0, 0, True])

    def delete_prefix(self, prefix: str) -> None:
        self.delete_by_volume_name(None, prefix)

    def delete_by_volume_name(self, volume: str | None, prefix: str) -> None:
        """Delete all that is there now at or below a path, on one volume or on all."""
        self._hold(["tomb", volume, prefix.replace("\\", "/").lower()])

    def add_tombstones(self, tombs: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Add prefix deletes ``(volume, prefix, seq)`` that bring their own sequences; streams as in
        :meth:`append_ops`."""
        meta = self._meta()
        if stream is not None and meta.get("streams", {}).get(stream, -1) >= batch:
            return False
        self.sync()
        rows = tombs.select("volume", normalised_prefix(F.col("prefix")).alias("prefix"), F.col("seq").cast("long")).where("prefix is not null and seq is not null").distinct()
        if meta.get("floor"):
            rows = rows.where(F.col("seq") >= meta["floor"])
        self._publish([], [self._write_tombs(rows, own=True)], {stream: batch} if stream is not None else None, own=True)
        return True

    def _hold(self, row: list) -> None:
        self._log.append(row)
        self._held.append(row)
        if len(self._held) >= self.config.flush_threshold:
            self.flush()

    def _rows_held(self, base: int, kind: str, since: int = 0) -> DataFrame | None:
        """What is held back, from the place ``since`` on, as rows of a kind, numbered from ``base``."""
        picked = [(k, r) for k, r in enumerate(self._held) if k >= since and r[0] == kind]
        if not picked:
            return None
        if kind == "op":
            return self.spark.createDataFrame([(*r[1:-1], base + k, r[-1]) for k, r in picked], OPLOG_SCHEMA)
        return self.spark.createDataFrame([(*r[1:], base + k) for k, r in picked], TOMB_SCHEMA)

    def sync(self) -> None:
        """Make what is held back a generation."""
        if self._held:
            self._take_in(self._log.name)
            self._held = []
            self._log.remove()

    def _take_in(self, name: str, rows: list[list] | None = None) -> None:
        """Publish the lines of a log that no generation holds. ``rows``: those of another handle's log."""
        own, self._held = self._held, self._held if rows is None else rows
        try:
            made: dict[int, tuple] = {}
            for _ in range(TRIES):
                old = self.table.manifest()
                since = old["meta"].get("logged", {}).get(name, 0)
                if since >= len(self._held) or rows is not None and name not in logs(self.table):
                    return
                if since not in made:  # a writer that took in some of the lines meanwhile makes a second write
                    ops, tombs = self._rows_held(0, "op", since), self._rows_held(0, "tomb", since)
                    made[since] = ([self._write(ops)] if ops is not None else [], [self._write_tombs(tombs)] if tombs is not None else [])
                if self._publish_once(old, *made[since], None, len(self._held), False, {name: len(self._held)}):
                    return
            raise VersionConflict("other writers published all the time")
        finally:
            if rows is not None:
                self._held = own

    def recover(self) -> None:
        """Take in what handles that are gone have logged."""
        for name in logs(self.table):
            if name != self._log.name and (rows := lines(self.table, name)):
                self._take_in(name, rows)

    def flush(self) -> None:
        """Write what is held back and merge generations as the policy says, with the setting ``background`` in a thread of
        its own."""
        self.sync()
        if not self.config.background:
            self.compact()
        elif self._job is None or self._job.done():
            self._pool = self._pool or ThreadPoolExecutor(1)
            self._job = self._pool.submit(self._compact_beside)

    def _compact_beside(self) -> bool:
        try:
            return self.compact()
        except VersionConflict:
            return False  # another writer was faster; the next flush tries again

    def _write(self, ops: DataFrame, state: str = "log", own: bool = False) -> dict:
        """Write a generation. ``state``: ``log``, or after a full merge ``live`` (one row per live path) and ``hidden``."""
        rows, terms = self.table.new_folder(), self.table.new_folder()
        self.table.write(ops.select(_COLUMNS), rows)
        held = self.table.read([rows], OPLOG_SCHEMA)
        n, top = held.agg(F.count("*"), F.max("seq")).first()
        # making terms is the dearest step, so it is spread over all cores; the number is given, else small shuffles are merged
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)) if n >= 1000 else 1
        made = postings(held.where("not is_delete").select("path", "volume").repartition(tasks, "path", "volume").distinct())
        # range partitioning reads its input twice, so terms are written before; a generation of the log is sorted in its
        # tasks only
        write_postings(written(made, "terms") if state == "live" else made, f"{self.table.root}/{terms}", ranged=state == "live")
        return {"ops": rows, "terms": terms, "rows": n, "state": state, "base": 0, "top": (top or 0) if own else -1}

    def _write_tombs(self, rows: DataFrame, own: bool = False) -> dict:
        folder = self.table.new_folder()
        self.table.write(rows.select([f.name for f in TOMB_SCHEMA.fields]).coalesce(1) if not own else rows.select([f.name for f in TOMB_SCHEMA.fields]), folder)
        n, top = self.table.read([folder], TOMB_SCHEMA).agg(F.count("*"), F.max("seq")).first()
        return {"folder": folder, "rows": n, "base": 0, "top": (top or 0) if own else -1, "applied": False}

    def _publish(self, add: list[dict], deletes: list[dict], streams: dict | None = None, used: int = 0, own: bool = False) -> None:
        for _ in range(TRIES):
            if self._publish_once(self.table.manifest(), add, deletes, streams, used, own, {}):
                return
        raise VersionConflict(f"other writers published {TRIES} versions meanwhile")

    def _publish_once(self, old: dict, add: list[dict], deletes: list[dict], streams: dict | None, used: int, own: bool, logged: dict[str, int]) -> bool:
        """The next version with some more generations and prefix deletes. ``used``: how many numbers they use; ``own``: they
        bring their own."""
        meta = dict(old["meta"])
        base = meta.get("next_seq", 1)
        new = lambda x: x | {"base": 0 if own else base}
        meta |= {
            "generations": [*meta.get("generations", []), *map(new, add)], "tombs": [*meta.get("tombs", []), *map(new, deletes)],
            "streams": meta.get("streams", {}) | (streams or {}), "logged": meta.get("logged", {}) | logged, "own": meta.get("own", False) or own,
            "next_seq": max([base + used, *(x["top"] + 1 for x in [*add, *deletes])]),
        }
        try:
            self.table.publish(self._folders(meta), meta, expect=old["version"])
            return True
        except VersionConflict:
            return False

    @staticmethod
    def _folders(meta: dict) -> list[str]:
        return [f for g in meta["generations"] for f in (g["ops"], g["terms"])] + [t["folder"] for t in meta["tombs"]]

    # reading

    def _meta(self) -> dict:
        return self.table.manifest()["meta"]

    def _generations(self) -> list[dict]:
        return self._meta().get("generations", [])

    def _numbered(self, parts: list[dict], key: str, schema) -> DataFrame:
        """The rows of generations, or of prefix deletes, with their final sequences: one scan for each base."""
        by_base: dict[int, list[str]] = {}
        for p in parts:
            by_base.setdefault(p["base"], []).append(p[key])
        out = None
        for base, folders in by_base.items():
            rows = self.table.read(folders, schema)
            rows = rows.withColumn("seq", F.col("seq") + base) if base else rows
            out = rows if out is None else out.unionByName(rows)
        return self.table.read([], schema) if out is None else out

    def _ops_of(self, generations: list[dict]) -> DataFrame:
        return self._numbered(generations, "ops", OPLOG_SCHEMA)

    def _with_held(self, meta: dict, stored: DataFrame, kind: str) -> DataFrame:
        held = self._rows_held(meta.get("next_seq", 1), kind, meta.get("logged", {}).get(self._log.name, 0))
        return stored if held is None else stored.unionByName(held)

    def ops(self, meta: dict | None = None) -> DataFrame:
        """All ops, held-back ones too. ``meta``: of the version to read, here and below; by default the newest."""
        meta = meta or self._meta()
        return self._with_held(meta, self._ops_of(meta.get("generations", [])), "op")

    def tombstones(self, meta: dict | None = None) -> DataFrame:
        meta = meta or self._meta()
        return self._with_held(meta, self._numbered(meta.get("tombs", []), "folder", TOMB_SCHEMA), "tomb")

    def live(self, of: DataFrame | None = None, meta: dict | None = None) -> DataFrame:
        """The live entries, or those of the paths ``of`` only: then versions are resolved for these paths alone, the rest
        of the log is left out by a semi-join before anything is aggregated. After a full compaction without later changes
        it is a plain scan."""
        meta = meta or self._meta()
        generations, tombs = meta.get("generations", []), meta.get("tombs", [])
        only = lambda rows: rows if of is None else rows.join(of, "path", "left_semi")
        if not self._held and all(g["state"] != "log" for g in generations) and all(t["applied"] for t in tombs):
            return only(self._ops_of([g for g in generations if g["state"] == "live"])).drop("is_delete")
        return live_view(only(self.ops(meta)), self.tombstones(meta) if tombs or any(r[0] == "tomb" for r in self._held) else None)

    def postings(self, meta: dict | None = None) -> DataFrame:
        """The terms of all paths ever inserted since the last compaction; searches join them with the live entries."""
        meta = meta or self._meta()
        stored = self.table.read([g["terms"] for g in meta.get("generations", [])], POSTING_SCHEMA)
        held = self._rows_held(0, "op")
        return stored if held is None else stored.unionByName(postings(held.where("not is_delete")))

    def search(self, text: str, limit: int, offset: int = 0, options: SearchOptions = SearchOptions(), now_micros: int | None = None) -> DataFrame:
        now, meta = int(time.time() * 1e6) if now_micros is None else now_micros, self._meta()
        return S.search(lambda paths: self.live(paths, meta), self.postings(meta), text, limit, offset, options, now)

    def recent_files(self, since_seconds: int, limit: int, offset: int = 0, options: SearchOptions = SearchOptions()) -> DataFrame:
        """A live entry that passes is the op that passes, so versions are resolved only for paths with such an op."""
        meta = self._meta()
        may = S.recent_paths(self.ops(meta).where("not is_delete"), since_seconds, options)
        return S.recent_files(self.live(may, meta), since_seconds, limit, offset, options)

    def search_or_recent(self, text: str, limit: int, offset: int = 0, options: SearchOptions = SearchOptions(), now_micros: int | None = None) -> DataFrame:
        """What an interactive client shows: results for the words typed, or without any the files of the last five days."""
        now = int(time.time() * 1e6) if now_micros is None else now_micros
        if text.strip():
            return self.search(text, limit, offset, options, now)
        return self.recent_files(S.cutoff_seconds(now), limit, offset, options)

    # maintenance

    def wait_for_completed_recovery(self) -> None:
        """Nothing to wait for: opening takes in what was logged."""

    def compact(self) -> bool:
        """Merge the generations that the policy names; gives whether there were any."""
        meta = self._meta()
        generations = meta.get("generations", [])
        new_deletes = sum(t["rows"] for t in meta.get("tombs", []) if not t["applied"])
        which = merge_candidates([g["rows"] for g in generations], self.config, new_deletes)
        if not which:
            return False
        if len(which) == len(generations):
            self._merge_all()
            return True
        merged = [generations[i] for i in which]
        # delete markers stay: generations that aren't merged may hold older versions
        self._replace(merged, [self._write(newest_per_volume(self._ops_of(merged)), own=True)])
        return True

    def purge(self, floor: int | None = None) -> None:
        """Merge all and forget the delete markers and prefix deletes below a sequence (by default all of them). What is
        older and arrives afterwards is ignored."""
        self.sync()
        self._merge_all(self._meta().get("next_seq", 1) if floor is None else floor)

    def force_compact_all(self) -> None:
        """One generation of the live entries, and, while older ops may still arrive, one of what they would have to meet:
        delete markers and the newest ops of other volumes. Prefix deletes are applied and reduced."""
        self.sync()
        self._merge_all()

    def _merge_all(self, floor: int | None = None) -> None:
        meta = self._meta()
        if floor is None:
            upto, late = meta.get("next_seq", 1), self.config.lateness
            floor = max(upto if not meta.get("own") else upto - late if late is not None else 0, meta.get("floor", 0))
        generations, tombs = meta.get("generations", []), meta.get("tombs", [])
        if not generations:
            return
        newest = newest_per_volume(self._ops_of(generations))
        deletes = self._numbered(tombs, "folder", TOMB_SCHEMA)
        keep = ["seq", "is_delete", *PAYLOAD]
        left = with_kill_seq(newest, deletes, keep).where("t_seq is null or seq >= t_seq") if tombs else newest
        best = left.groupBy("path").agg(F.max(F.struct("seq", "is_delete", "volume")).alias("best"), F.max(F.when(F.col("is_delete") & (F.col("seq") < floor), F.col("seq"))).alias("dead_upto"))
        # an op that isn't the newest of its path matters again if a prefix delete for one volume hides the newest
        marked = written(left.join(best, "path").select("path", "volume", *keep, (F.struct("seq", "is_delete", "volume").eqNullSafe(F.col("best")) & ~F.col("is_delete")).alias("is_live"), F.coalesce(F.col("seq") <= F.col("dead_upto"), F.lit(False)).alias("is_gone")), "merged")
        new = [self._write(marked.where("is_live"), "live", own=True)]
        if not (rest := marked.where("not is_live and not is_gone")).isEmpty():
            new.append(self._write(rest, "hidden", own=True))
        old_deletes = []
        if tombs:
            t = reduced_tombstones(deletes).select(F.col("t_volume").alias("volume"), F.col("t_prefix").alias("prefix"), F.col("t_seq").alias("seq")).where(F.col("seq") > floor)
            if not t.isEmpty():
                old_deletes = [self._write_tombs(t, own=True) | {"applied": True}]
        self._replace(generations, new, tombs, old_deletes, floor, own=meta.get("own", False))

    def _replace(self, merged: list[dict], new: list[dict], tombs: list[dict] | None = None, deletes: list[dict] | None = None, floor: int = 0, own: bool | None = None) -> None:
        old = self.table.manifest()
        meta = dict(old["meta"])
        gone, gone_tombs = {g["ops"] for g in merged}, {t["folder"] for t in tombs or []}
        left = [g for g in meta["generations"] if g["ops"] not in gone]
        if len(left) + len(merged) != len(meta["generations"]):
            raise VersionConflict("another compaction was faster")
        if own is False and meta.get("own"):
            raise VersionConflict("ops with sequences of their own came in meanwhile")
        there = set(logs(self.table))
        meta |= {
            "generations": [*new, *left], "tombs": [*(deletes or []), *(t for t in meta["tombs"] if t["folder"] not in gone_tombs)],
            "logged": {k: v for k, v in meta.get("logged", {}).items() if k in there}, "floor": max(floor if meta.get("own") else 0, meta.get("floor", 0)),
        }
        self.table.publish(self._folders(meta), meta, expect=old["version"])
        self.table.vacuum()
