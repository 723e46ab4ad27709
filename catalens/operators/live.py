"""The live view: prefix deletes, newest op of each path, deleted paths dropped.

Rules. A prefix delete kills an op iff ``op.seq < its seq``, its volume is null or the op's, and its prefix is the path
or a leading part of the path that ends before a ``/``; the case of ASCII letters is ignored, of others not. Of the ops
left, the one with the highest ``seq`` stands for its path; if that is a delete, the path is gone.

What kills an op depends on nothing but its path, volume and seq, so the newest op of each (path, volume) decides for
that pair: if it is killed, all older ones are. That lets the log be reduced by a partial aggregate before anything is
shuffled, however many ops one path has.

Nulls: ops without path or seq can't be placed and are left out; a null volume is matched by volume-less prefix deletes
only; null ``is_delete`` counts as false; prefix deletes without prefix or seq are left out. Ties: of ops with one seq a
delete wins, then the greatest row. Columns other than those of the op log are left out, so none can clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.schemas import OPLOG_SCHEMA
from catalens.session import BROADCAST_ROWS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER, _NEVER = str.maketrans(UPPER, LOWER), -(1 << 63)
PAYLOAD = ["kind", "last_modified", "last_accessed", "category", "volume_type"]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def cleaned_ops(ops: DataFrame) -> DataFrame:
    """The op-log columns only, rows without path or seq dropped."""
    types = {f.name: f.dataType for f in OPLOG_SCHEMA.fields}
    have = set(ops.columns)
    cols = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return ops.select(cols).withColumn("is_delete", F.coalesce("is_delete", F.lit(False))).where("path is not null and seq is not null")


def newest_per_volume(ops: DataFrame, payload: list[str] = PAYLOAD) -> DataFrame:
    """One row per (path, volume): its newest op."""
    best = F.max(F.struct("seq", "is_delete", *payload)).alias("op")
    return cleaned_ops(ops).groupBy("path", "volume").agg(best).select("path", "volume", "op.*")


def reduced_tombstones(tombs: DataFrame) -> DataFrame:
    """One row per (volume, folded prefix) with its highest seq."""
    return tombs.where("prefix is not null and seq is not null").groupBy(F.col("volume").alias("t_volume"), ascii_lower(F.col("prefix")).alias("t_prefix")).agg(F.max("seq").alias("t_seq"))


def ancestors(path: Column, most: int | None = None) -> Column:
    """The leading parts of a path that end before a ``/``, and the path itself; ``most``: no part longer than that is
    wanted, which bounds the work on very long paths."""
    cut = F.substring(path, 1, most + 1) if most is not None else path
    parts = F.split(cut, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _killer(tombs: list[tuple[str | None, str, int]]):
    """A function of (path, volume) for Arrow batches: the highest seq of a prefix delete that covers them. What covers a
    folder is looked up once and remembered for the paths in it."""
    deletes: dict[str, dict[str | None, int]] = {}
    for volume, prefix, seq in tombs:
        deletes.setdefault(prefix, {})[volume] = seq

    def folder(path: str, known: dict) -> dict[str | None, int]:
        """Of each volume (None: of all) the highest seq at or above a folder."""
        got = known.get(path)
        if got is None:
            own = deletes.get(path, {})
            if "/" in path:
                above = folder_of(path, known)
                got = own and {v: max(own.get(v, _NEVER), above.get(v, _NEVER)) for v in {*own, *above}} or above
            else:
                got = own
            if len(known) > 50_000:
                known.clear()
            known[path] = got
        return got

    def folder_of(path: str, known: dict) -> dict[str | None, int]:
        up = path.rsplit("/", 1)[0]
        if up.count("/") < 200:
            return folder(up, known)
        got: dict[str | None, int] = {}  # very deep: from the top, without recursion
        at = -1
        while (at := path.find("/", at + 1)) >= 0:
            for v, s in deletes.get(path[:at], {}).items():
                got[v] = max(got.get(v, _NEVER), s)
        return got

    @F.pandas_udf("long")
    def kill(paths: pd.Series, volumes: pd.Series) -> pd.Series:
        known, out = {}, []
        for p, v in zip(paths, volumes, strict=True):
            p = p.lower() if p.isascii() else p.translate(_LOWER)
            covers = folder_of(p, known) if "/" in p else {}
            own = deletes.get(p)
            if not covers and not own:
                out.append(None)
                continue
            best = max(covers.get(None, _NEVER), covers.get(v, _NEVER) if v is not None else _NEVER)
            if own:
                best = max(best, own.get(None, _NEVER), own.get(v, _NEVER) if v is not None else _NEVER)
            out.append(best if best > _NEVER else None)
        return pd.Series(out, dtype="Int64")

    return kill


def with_kill_seq(rows: DataFrame, tombs: DataFrame, keep: list[str], sent: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (unique in path and volume) with ``t_seq``, the highest seq of a prefix delete that covers them, or null.

    While a count shows at most ``sent`` reduced deletes, they are sent to all tasks and looked up row by row: nothing is
    shuffled. (Built-in functions can do it too, by exploding each path's leading parts, but take several times as long.)
    Beyond that the prefix test is an equi-join of the paths' leading parts with the prefixes by a shuffle; a (volume, prefix)
    is there once, so a hot one such as the root is a hot key of the left side only, which adaptive execution splits."""
    t = reduced_tombstones(tombs)
    n, most = t.agg(F.count("*"), F.max(F.length("t_prefix"))).first()
    rows = rows.select("path", "volume", *keep)
    if not n:
        return rows.withColumn("t_seq", F.lit(None).cast("long"))
    if n <= sent:
        return rows.withColumn("t_seq", _killer([tuple(r) for r in t.collect()])("path", "volume"))
    spread = rows.select("path", "volume", *keep, F.explode(ancestors(ascii_lower(F.col("path")), most)).alias("a"))
    hit = (F.col("a") == F.col("t_prefix")) & (F.col("t_volume").isNull() | (F.col("t_volume") == F.col("volume")))
    return spread.join(t, hit, "left").groupBy("path", "volume", *keep).agg(F.max("t_seq").alias("t_seq"))


def without_killed(ops: DataFrame, tombs: DataFrame, sent: int = BROADCAST_ROWS) -> DataFrame:
    """The ops that no prefix delete kills, each row as often as it was there."""
    ops = cleaned_ops(ops)
    pairs = ops.groupBy("path", "volume").agg(F.min("seq").alias("low"))
    kill = with_kill_seq(pairs, tombs, ["low"], sent).where("low < t_seq").select(F.col("path").alias("k_path"), F.col("volume").alias("k_volume"), "t_seq")
    return ops.join(kill, (F.col("path") == F.col("k_path")) & F.col("volume").eqNullSafe(F.col("k_volume")), "left").where("t_seq is null or seq >= t_seq").select(ops.columns)


def resolve(newest: DataFrame, tombs: DataFrame | None, payload: list[str] = PAYLOAD, with_deleted: bool = False, sent: int = BROADCAST_ROWS) -> DataFrame:
    """Live rows from the newest ops of each (path, volume)."""
    keep = ["seq", "is_delete", *payload]
    rows = newest.select("path", "volume", *keep)
    if tombs is not None:
        rows = with_kill_seq(rows, tombs, keep, sent).where("t_seq is null or seq >= t_seq")
    top = rows.groupBy("path").agg(F.max(F.struct("seq", "is_delete", "volume", *payload)).alias("op")).select("path", "op.*")
    return top if with_deleted else top.where("not is_delete").drop("is_delete")


def live_view(ops: DataFrame, tombs: DataFrame | None = None, sent: int = BROADCAST_ROWS) -> DataFrame:
    """One row per live path: its entry columns and ``seq``."""
    return resolve(newest_per_volume(ops), tombs, sent=sent).select("path", "volume", *PAYLOAD, "seq")
