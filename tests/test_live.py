import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalens.operators import live as V
from catalens.operators.changefeed import ChangeFeed
from catalens.operators.incremental import IncrementalTarget, cover, taken_in
from catalens.schemas import OPLOG_SCHEMA, TOMB_SCHEMA
from catalens.session import run_dir
from catalens.sources.versioned import VersionConflict, VersionedTable


def op(path, seq, volume="v", delete=False, kind=0):
    return (path, volume, kind, seq, seq, 1, 0, seq, delete)


def ops(spark, data):
    return spark.createDataFrame(data, OPLOG_SCHEMA)


def tombs(spark, data):
    return spark.createDataFrame(data, TOMB_SCHEMA)


def fold(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute(data, deletes):
    """The rules of the live view, one op at a time."""
    best = {}
    for o in data:
        path, volume, seq, dead = o[0], o[1], o[7], bool(o[8])
        if path is None or seq is None:
            continue
        p = fold(path)
        killed = any(x is not None and s is not None and seq < s and (v is None or v == volume) and (p == fold(x) or p.startswith(fold(x) + "/")) for v, x, s in deletes)
        if not killed and (path not in best or (seq, dead) > best[path]):
            best[path] = (seq, dead)
    return sorted((p, s) for p, (s, d) in best.items() if not d)


GOLDEN_TOMBS = [(None, "/foo", 100), ("vol1", "/bar", 200)]


@pytest.mark.parametrize("volume,path,seq,dead", [("volX", "/foo/abc", 50, True), ("volX", "/foo", 50, True), ("vol1", "/bar/abc", 50, True), ("vol2", "/bar/abc", 50, False), ("vol1", "/bar/abc", 200, False), ("vol1", "/foobar/abc", 50, False), ("volX", "/FOO/abc", 50, True)])
def test_prefix_deletes(spark, volume, path, seq, dead):
    df = ops(spark, [op(path, seq, volume)])
    assert V.without_killed(df, tombs(spark, GOLDEN_TOMBS)).count() == (0 if dead else 1)


def test_newest_counts(spark):
    got = rows(V.live_view(ops(spark, [op("a", 20), op("a", 10), op("b", 10), op("b", 20, delete=True), op("c", 5), op("c", 5)])).select("path", "seq"))
    assert got == [("a", 20), ("c", 5)]


def test_same_path_on_two_volumes(spark):
    t = tombs(spark, [("v1", "/a", 50)])
    got = rows(V.live_view(ops(spark, [op("/a/x", 40, "v1"), op("/a/x", 30, "v2")]), t).select("path", "volume", "seq"))
    assert got == [("/a/x", "v2", 30)]


def test_odd_prefixes(spark):
    data = [op("/a/b", 1), op("//x", 1), op("/", 1), op("a", 1), op("É/x", 1)]
    for prefix in ("", "/", "/a/", "//", "a", "é", "É"):
        t = [(None, prefix, 9)]
        assert rows(V.live_view(ops(spark, data), tombs(spark, t)).select("path", "seq")) == brute(data, t), prefix


EDGE = [op("a", 1), op("a", 1), op(None, 5), ("n", None, None, None, None, None, None, 4, None), op("big/" + "x/" * 5000, 3), ("s", "v", 0, 1, 1, 1, 0, None, False), op("d", 7, delete=True), op("t", 3), op("t", 3, delete=True)]


def test_edges(spark):
    t = [(None, "zzz", 9), (None, None, 3), ("v", "big", None), ("w", "a", 9)]
    assert rows(V.live_view(ops(spark, EDGE), tombs(spark, t)).select("path", "seq")) == brute(EDGE, t)
    assert V.live_view(ops(spark, []), tombs(spark, [])).count() == 0
    extra = ops(spark, EDGE).selectExpr("*", "1 as bucket", "2 as op", "3 as t_seq", "4 as a")
    assert rows(V.live_view(extra, tombs(spark, t).selectExpr("*", "1 as path", "2 as t_seq")).select("path", "seq")) == brute(EDGE, t)


NAMES = st.sampled_from(["/a", "/a/b", "/A/b", "/ab", "/a/b/c", "x"])
OPS = st.lists(st.tuples(NAMES, st.integers(1, 30), st.sampled_from(["v", "w"]), st.booleans()), max_size=25)
TOMBS = st.lists(st.tuples(st.sampled_from([None, "v", "w"]), st.sampled_from(["/a", "/A", "/a/b", "x", ""]), st.integers(1, 30)), max_size=4)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(OPS, TOMBS, st.randoms())
def test_any_order_of_batches(spark, changes, deletes, rnd):
    """The change feed gives the same state for ops in any order, split into batches anywhere, with repeats."""
    data = [op(p, s, v, d) for p, s, v, d in {(p, s): (p, s, v, d) for p, s, v, d in changes}.values()]
    want = brute(data, deletes)
    shuffled = data + data[:3]
    rnd.shuffle(shuffled)
    cut = rnd.randint(0, len(shuffled))
    feed = ChangeFeed(spark, run_dir(spark, "feed"))
    feed.apply(ops(spark, shuffled[:cut]), tombs(spark, deletes[:2]))
    feed.apply(ops(spark, shuffled[cut:]), tombs(spark, deletes[2:]))
    assert rows(feed.current(payload=[]).select("path", "seq")) == want
    assert rows(V.live_view(ops(spark, shuffled), tombs(spark, deletes)).select("path", "seq")) == want


def test_feed_versions_and_hot_path(spark):
    rnd = random.Random(1)
    data = [op("hot", s) for s in range(1, 4000)] + [op(f"/p/{k}", 5000 + k) for k in range(2000)]
    rnd.shuffle(data)
    feed = ChangeFeed(spark, run_dir(spark, "feed"), bucket_rows=500)
    one = feed.apply(ops(spark, data))
    assert one["meta"]["buckets"] == 8 and rows(feed.current(payload=[]).select("path", "seq")) == brute(data, [])
    two = feed.apply(ops(spark, [op("hot", 9000, delete=True)]))
    assert sum(one["meta"]["state"][b] != f for b, f in two["meta"]["state"].items()) == 1  # one bucket was written again
    assert feed.current(version=1).count() == 2001 and feed.current().count() == 2000
    feed.apply(ops(spark, [op("hot", 8000)]))  # late: the kept marker holds
    assert feed.current().count() == 2000


def test_buckets_follow_the_state(spark):
    """One row first, then many: buckets split, and none is left above its size."""
    feed = ChangeFeed(spark, run_dir(spark, "feed"), bucket_rows=2000)
    assert feed.apply(ops(spark, [op("/p/3", 1)]))["meta"]["buckets"] == 4
    many = spark.range(60_000).selectExpr("concat('/p/', id) as path", "'v' as volume", "0 as kind", "id as last_modified", "id as last_accessed", "1 as category", "0 as volume_type", "id + 10 as seq", "false as is_delete")
    two = feed.apply(many)["meta"]
    assert two["buckets"] == 32 and two["rows"] == 60_000 and max(n for _, n in two["state"].values()) < 2400
    three = feed.apply(many.where("id % 2 = 0").withColumn("seq", F.col("seq") + 100_000))["meta"]
    assert three["rows"] == 60_000 and three["buckets"] == 64 and feed.current().where("seq > 100000").count() == 30_000
    four = feed.apply(ops(spark, [op("/p/3", 5, delete=True), op("/p/3", 7)]))["meta"]  # older than what is there
    assert sum(three["state"][b] != f for b, f in four["state"].items()) == 1 and feed.current().count() == 60_000


def test_upsert_beyond_its_memory(tmp_path, monkeypatch):
    import pyarrow as pa

    from catalens.operators import changefeed as C

    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    monkeypatch.setattr(C, "_connect", lambda f=C._connect: f("100MB"))

    def batches(n):
        for k in range(0, n, 50_000):
            i = range(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([i, [f"/some/long/path/to/fill/memory/{x:09d}" for x in i], ["v"] * len(i), [0] * len(i), i, i, [1] * len(i), [0] * len(i), i, [False] * len(i)], [f.type for f in C._ARROW], strict=True)], schema=C._ARROW)

    assert sum(b.num_rows for b in C.upsert(batches(800_000))) == 800_000
    assert list(tmp_path.iterdir()) == []


def test_both_ways_to_find_prefix_deletes(spark):
    rnd = random.Random(4)
    names = ["a", "B", "é", "", "c c", "Ab"]
    data = [op("/".join(rnd.choice(names) for _ in range(rnd.randint(1, 6))), s, rnd.choice(["v", "w", None])) for s in range(1, 300)] + [op("d/" * 1500 + "x", 3), op("d/" * 1500 + "y", 900)]
    deletes = [(rnd.choice([None, "v", "w"]), "/".join(rnd.choice(names) for _ in range(rnd.randint(1, 3))), rnd.randint(1, 300)) for _ in range(40)] + [(None, "D/" * 700 + "d", 50)]
    want = brute(data, deletes)
    for sent in (0, 1000):
        assert rows(V.live_view(ops(spark, data), tombs(spark, deletes), sent).select("path", "seq")) == want
        assert len(want) == V.without_killed(ops(spark, data), tombs(spark, deletes), sent).select("path").distinct().count()


def test_feed_edges(spark):
    feed = ChangeFeed(spark, run_dir(spark, "feed"))
    feed.apply(ops(spark, []), tombs(spark, []))
    assert feed.current().count() == 0
    feed.apply(ops(spark, EDGE).selectExpr("*", "1 as bucket", "2 as b"), tombs(spark, [(None, None, 3)]))
    assert rows(feed.current(payload=[]).select("path", "seq")) == brute(EDGE, [])


def test_versions_are_published_once(spark):
    t = VersionedTable(spark, run_dir(spark, "versions"))
    assert t.manifest()["version"] == 0
    t.publish([], {"a": 1})
    with pytest.raises(VersionConflict):
        t.publish([], {}, expect=0)
    t.publish([], {"a": 2})
    assert t.manifest()["meta"] == {"a": 2} and t.manifest(1)["meta"] == {"a": 1} and t.versions() == [1, 2]
    spark.range(3).write.parquet(f"{t.root}/{t.new_folder()}")
    assert t.vacuum() == 0 and t.versions() == [1, 2]  # it may belong to a write that goes on
    assert t.vacuum(older_than=0) == 1 and t.versions() == [2]


def test_one_of_many_publishers_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    from catalens.sources import versioned

    root = run_dir(spark, "race")

    def publish(k):
        try:
            return VersionedTable(spark, root).publish([], {"by": k}, expect=0)["meta"]["by"]
        except VersionConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(publish, range(8)) if k is not None]
    assert won == [VersionedTable(spark, root).manifest()["meta"]["by"]]
    for commit in (versioned.renamed, versioned.created):
        t = VersionedTable(spark, run_dir(spark, "commit"), commit)
        t.publish([], {"by": 1}, expect=0)
        with pytest.raises(VersionConflict):
            t.publish([], {"by": 2}, expect=0)
        assert t.manifest()["meta"]["by"] == 1


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from catalens.session import shared_dir

    with pytest.raises(RuntimeError):
        shared_dir(N(conf=N(get=lambda k, d: None), sparkContext=N(master="yarn", getCheckpointDir=lambda: None)))


def test_cover():
    rnd = random.Random(3)
    import numpy as np

    for _ in range(30):
        runs = [(a := rnd.randint(0, 40), a + rnd.randint(1, 15), rnd.randint(0, 9)) for _ in range(rnd.randint(1, 12))]
        lo, hi, s = (np.array(x, np.int64) for x in zip(*runs, strict=True))
        ends, value = cover(lo, hi, s)
        for x in range(-2, 60):
            want = max((c for a, b, c in runs if a < x <= b), default=np.iinfo(np.int64).min)
            at = np.searchsorted(ends, x, side="left")
            assert (value[at] if at < len(ends) else np.iinfo(np.int64).min) == want


RUNS = "run_id long, run_state string, logged_at timestamp, started_at timestamp, basis string, lo long, hi long"


def test_taken_in_both_ways(spark):
    import datetime as dt

    rnd, t0 = random.Random(5), dt.datetime(2020, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    runs = []
    for r in range(60):
        a = rnd.randint(0, 900)
        start, basis = rnd.randint(0, 500), rnd.choice(["seq", "mtime", "other"])
        for n, state in enumerate(["started", rnd.choice(["committed", "committed", "failed", "started"]), rnd.choice(["committed", "rolled_back"])][: rnd.randint(1, 3)]):
            runs.append((r, state, at(start + 5 * n), at(start), basis, a, a + rnd.randint(0, 200)))
    runs += [(None, "committed", at(1), at(1), "seq", 0, 999), (99, "committed", None, at(1), "seq", 0, 999), (98, "committed", at(1), None, "seq", 0, 999), (97, "committed", at(1), at(900), "seq", None, 999)]
    source = [(rnd.randint(0, 1000), rnd.choice([None, rnd.randint(0, 1000)]), at(rnd.randint(0, 500))) for _ in range(800)] + [(None, 5, at(0)), (7, 7, None)]
    latest = {}
    for r in runs:
        if r[0] is not None and r[2] is not None:
            latest[r[0]] = max(latest.get(r[0], r), r, key=lambda x: (x[2], x[1]))
    good = [r for r in latest.values() if r[1] == "committed" and r[3] is not None and r[5] is not None]
    want = set()
    for seq, mtime, arrived in source:
        if seq is None or arrived is None:
            continue
        if any(r[3] >= arrived and (x := {"seq": seq, "mtime": mtime}.get(r[4])) is not None and r[5] < x <= r[6] for r in good):
            want.add(seq)
    o = spark.createDataFrame(source, "seq long, last_modified long, arrived_at timestamp").selectExpr("*", "1 as started", "2 as x", "3 as b")
    g = spark.createDataFrame(runs, RUNS)
    assert {r[0] for r in taken_in(o, g).collect()} == want
    assert {r[0] for r in taken_in(o, g, bound=3).collect()} == want
    assert taken_in(o, g.where("false")).count() == 0 and taken_in(o.where("false"), g).count() == 0


def test_large_times_stay_exact(spark):
    """Beside nulls, too."""
    import datetime as dt

    t, big = dt.datetime(2020, 1, 1), (1 << 60) + 1
    o = spark.createDataFrame([(1, big, t), (2, None, t), (3, big + 2, t)], "seq long, last_modified long, arrived_at timestamp").coalesce(1)
    g = spark.createDataFrame([(1, "committed", t, t, "seq", 0, 9)], RUNS)
    for bound in (9, 0):
        assert rows(taken_in(o, g, bound)) == [(1, big), (2, None), (3, big + 2)]


def test_incremental_runs(spark):
    target = IncrementalTarget(spark, run_dir(spark, "target"))
    source = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 3), (4, None)], "k long, v long").selectExpr("*", "9 as source_key", "8 as t_key")
    assert rows(target.run(source, "k", "v")) == [(1, 1), (2, 1), (4, None)]
    assert target.run(source, "k", "v").count() == 0
    more = source.unionByName(spark.createDataFrame([(2, 2, 0, 0), (5, 1, 0, 0)], "k long, v long, source_key int, t_key int"))
    before = target.table.manifest()
    target.new(more, "k", "v").write.parquet(f"{target.table.root}/{target.table.new_folder()}")  # a run that fails before publishing
    assert target.table.manifest() == before
    assert rows(target.run(more, "k", "v")) == [(2, 2), (5, 1)]
    assert target.run(source.where("false"), "k", "v").count() == 0
    for k in range(16):  # folders are merged meanwhile
        assert rows(target.run(more.withColumn("v", F.lit(10 + k)), "k", "v")) == [(i, 10 + k) for i in (1, 2, 4, 5)]
    assert len(target.table.manifest()["folders"]) < 10 and target.run(more, "k", "v").count() == 0
