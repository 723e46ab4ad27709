import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from catalens.model import Category, CompactorConfig, Entry, Kind, ScoringConfig, SearchOptions, VolumeType
from catalens.operators import postings as P
from catalens.operators import search as S
from catalens.operators import stats
from catalens.operators.compact import merge_candidates
from catalens.schemas import ENTRY_SCHEMA, OPLOG_SCHEMA
from catalens.session import run_dir
from catalens.sources.catalog import Catalog

NOW = 2_000_000_000


def entry(path, volume="vol1", kind=Kind.FILE, t=100, category=Category.TEXT, volume_type=VolumeType.LOCAL):
    return Entry(path, volume, kind, t, t, category, volume_type)


def paths(df):
    return [r.path for r in df.select("path").collect()]


@pytest.fixture
def catalog(spark):
    return Catalog(spark, run_dir(spark, "catalog"))


def test_lifecycle_and_reopen(spark, catalog):
    catalog.insert(entry("/foo/bar.txt"))
    assert paths(catalog.search("bar", 10, now_micros=NOW)) == ["/foo/bar.txt"]
    catalog.close()
    with Catalog(spark, catalog.table.root) as again:
        again.wait_for_completed_recovery()
        assert paths(again.search("bar", 10, now_micros=NOW)) == ["/foo/bar.txt"]
        again.delete("/foo/bar.txt")
        assert paths(again.search("bar", 10, now_micros=NOW)) == []
    assert Catalog(spark, catalog.table.root).live().count() == 0


def test_batch_and_pages(catalog):
    catalog.insert_batch([entry(f"/foo/file_{i}.txt") for i in range(100)], 10)
    assert len(paths(catalog.search("file", 150, now_micros=NOW))) == 100
    assert paths(catalog.search("file_42", 10, now_micros=NOW)) == ["/foo/file_42.txt"]
    whole = paths(catalog.search("file", 100, now_micros=NOW))
    assert [p for k in range(4) for p in paths(catalog.search("file", 30, 30 * k, now_micros=NOW))] == whole
    assert paths(catalog.search("", 5, now_micros=NOW)) == [] == paths(catalog.search("-", 5, now_micros=NOW))


def test_batch_from_a_table(spark, catalog):
    data = [("/a/one.txt", "v", 0, 1, 1, 0, 0), ("/a/one.txt", "v", 0, 2, 2, 0, 0), ("/a/two.txt", "v", 0, None, None, None, None), (None, "v", 0, 1, 1, 0, 0)]
    catalog.insert_batch(spark.createDataFrame(data, ENTRY_SCHEMA).coalesce(1).selectExpr("*", "1 as seq", "true as is_delete", "7 as terms"))
    assert rows(catalog.live().select("path", "last_modified")) == [("/a/one.txt", 2), ("/a/two.txt", None)]
    assert sorted(paths(catalog.search("a", 10, now_micros=NOW))) == ["/a/one.txt", "/a/two.txt"]


def test_cjk(catalog):
    catalog.insert(entry("/home/user/日本語の文書.txt"))
    for word in ("日本語", "本語", "文書", "の"):
        assert len(paths(catalog.search(word, 5, now_micros=NOW))) == 1
    assert paths(catalog.search("語日", 5, now_micros=NOW)) == []


def test_prefix_deletes(catalog):
    catalog.insert_batch([entry("/foo/bar/a.txt"), entry("/other/b.txt")])
    catalog.delete_prefix("\\FOO")
    assert paths(catalog.search("txt", 10, now_micros=NOW)) == ["/other/b.txt"]
    catalog.insert(entry("/foo/bar/a.txt"))
    assert len(paths(catalog.search("txt", 10, now_micros=NOW))) == 2
    catalog.delete_by_volume_name("vol2", "/other")
    catalog.sync()
    assert len(paths(catalog.search("txt", 10, now_micros=NOW))) == 2
    catalog.delete_by_volume_name("vol1", "/other")
    assert paths(catalog.search("txt", 10, now_micros=NOW)) == ["/foo/bar/a.txt"]


def test_compaction_changes_no_result(spark):
    c = Catalog(spark, run_dir(spark, "catalog"), CompactorConfig(min_merge_count=2))
    rnd = random.Random(2)
    for k in range(4):
        for i in range(6):
            c.insert(entry(f"/foo/{rnd.choice('abcdef')}{k % 2}.txt", t=10 * i + k))
        c.delete(f"/foo/a{k % 2}.txt")
        if k == 2:
            c.delete_prefix("/foo/b0.txt")
        c.sync()
    before = rows(c.live()), paths(c.search("foo", 20, now_micros=NOW))
    assert len(c._generations()) == 4
    c.flush()
    assert len(c._generations()) == 3 and (rows(c.live()), paths(c.search("foo", 20, now_micros=NOW))) == before
    c.force_compact_all()
    assert len(c._generations()) == 1 and c.table.manifest()["meta"]["tombs"] == []
    assert (rows(c.live()), paths(c.search("foo", 20, now_micros=NOW))) == before


def test_two_writers(spark):
    root = run_dir(spark, "catalog")
    a, b = Catalog(spark, root), Catalog(spark, root)
    a.insert(entry("/x/a.txt"))
    b.insert(entry("/x/b.txt"))
    a.sync()
    b.sync()
    assert sorted(paths(Catalog(spark, root).search("txt", 5, now_micros=NOW))) == ["/x/a.txt", "/x/b.txt"]


def test_newer_means_published_later(spark):
    """Handles that were opened before others wrote, and sequences of the ops' own."""
    root = run_dir(spark, "catalog")
    a, b = Catalog(spark, root), Catalog(spark, root)
    a.insert_batch(spark.createDataFrame([("/x/a.txt", "v", 0, 1, 1, 0, 0), ("/y/b.txt", "v", 0, 1, 1, 0, 0)], ENTRY_SCHEMA))
    b.delete("/x/a.txt")
    b.sync()
    assert paths(a.live()) == ["/y/b.txt"]
    high = 9_000_000_000_000_000
    b.append_ops(spark.createDataFrame([("/z/c.txt", "v", 0, 1, 1, 0, 0, high, False)], OPLOG_SCHEMA))
    a.delete("/z/c.txt")
    a.delete_prefix("/y")
    assert paths(a.live()) == []
    a.insert(entry("/z/c.txt"))
    assert paths(a.live()) == ["/z/c.txt"] and paths(a.recent_files(0, 9)) == ["/z/c.txt"]
    a.close()
    assert paths(b.live()) == ["/z/c.txt"] and b.live().first().seq == high + 3


def test_late_ops_meet_what_was_merged(spark):
    def c_ops(*data):
        return spark.createDataFrame([(p, v, 0, 1, 1, 0, 0, s, d) for p, v, s, d in data], OPLOG_SCHEMA)

    def t(*data):
        return spark.createDataFrame(data, "volume string, prefix string, seq long")

    c = Catalog(spark, run_dir(spark, "catalog"))
    c.append_ops(c_ops(("/a", "v", 10, False), ("/a", "", 20, True), ("/b", "v", 10, False), ("/b", "w", 12, False), ("/d/x", "v", 5, False)))
    c.add_tombstones(t((None, "/d", 30)))
    c.force_compact_all()
    assert paths(c.live()) == ["/b"]
    c.append_ops(c_ops(("/a", "v", 15, False), ("/d/y", "v", 29, False), ("/e", "v", 1, False)))  # older than the merged deletes
    assert sorted(paths(c.live())) == ["/b", "/e"]
    c.add_tombstones(t(("w", "/b", 50)))  # the older op on another volume comes to light
    assert rows(c.live().select("path", "volume", "seq")) == [("/b", "v", 10), ("/e", "v", 1)]
    c.force_compact_all()
    c.force_compact_all()
    assert rows(c.live().select("path", "volume", "seq")) == [("/b", "v", 10), ("/e", "v", 1)]
    c.append_ops(c_ops(("/a", "v", 60, False)))
    assert "/a" in paths(c.live())
    c.purge()
    assert c._meta()["tombs"] == [] and c.ops().where("is_delete").count() == 0
    c.append_ops(c_ops(("/a", "", 30, True), ("/q", "v", 3, False)))  # below the floor: ignored
    assert sorted(paths(c.live())) == ["/a", "/b", "/e"]


def test_log_survives_the_driver(spark):
    root = run_dir(spark, "catalog")
    lost = Catalog(spark, root)
    lost.insert(entry("/x/a.txt"))
    lost.insert(entry("/x/b.txt"))
    lost.delete_prefix("/x/a.txt")
    other = Catalog(spark, root)  # the first handle never synced
    assert paths(other.live()) == ["/x/b.txt"]
    lost.insert(entry("/x/c.txt"))  # it was alive after all
    assert sorted(paths(lost.live())) == ["/x/b.txt", "/x/c.txt"]
    other.delete("/x/b.txt")
    other.sync()
    lost.sync()
    assert paths(Catalog(spark, root).live()) == ["/x/c.txt"] and lost.live().count() == 1
    lost.sync()
    assert lost._meta()["generations"] == Catalog(spark, root)._meta()["generations"]


def test_search_resolves_the_paths_it_found_only(spark, catalog):
    catalog.insert_batch([entry(f"/foo/f{i}.txt") for i in range(9)])
    catalog.sync()
    catalog.insert_batch([entry("/foo/f1.txt", "vol2")])
    catalog.delete_prefix("/bar")
    catalog.sync()
    plan = catalog.search("f1", 5, now_micros=NOW)._jdf.queryExecution().optimizedPlan().toString()
    join, last = plan.index("LeftSemi"), plan.rindex("Aggregate", 0, plan.index("LeftSemi"))
    assert 0 < last < join  # trees are printed from the root: the aggregate is above the semi-join
    assert [r.volume for r in catalog.search("f1", 5, 0, SearchOptions(volume_name="vol2"), NOW).collect()] == ["vol2"]
    assert paths(catalog.search("f1", 5, 0, SearchOptions(volume_name="vol1"), NOW)) == []


def test_merges_beside_the_writer(spark):
    with Catalog(spark, run_dir(spark, "catalog"), CompactorConfig(min_merge_count=2, background=True)) as c:
        for k in range(3):
            c.insert(entry(f"/a/{k}.txt"))
            c.delete("/a/0.txt")
            c.flush()
        c._job.result()
        assert sorted(paths(c.live())) == ["/a/1.txt", "/a/2.txt"]
    assert sorted(paths(Catalog(spark, c.table.root).live())) == ["/a/1.txt", "/a/2.txt"]


def test_held_back_rows_are_bounded(spark):
    c = Catalog(spark, run_dir(spark, "catalog"), CompactorConfig(flush_threshold=5))
    for i in range(7):
        c.delete_prefix(f"/p{i}")
    assert len(c._held) == 2 and sum(t["rows"] for t in c._meta()["tombs"]) == 5


def test_filters(catalog):
    catalog.insert_batch([entry("/d/a.txt"), entry("/d/b.txt", "vol2", category=Category.IMAGE, volume_type=VolumeType.NETWORK), entry("/d/c.txt", kind=Kind.SYMLINK, category=0), entry("/d/txt", kind=Kind.DIRECTORY, category=0)])

    def found(**o):
        return sorted(p[3:] for p in paths(catalog.search("txt", 10, 0, SearchOptions(**o), NOW)))

    assert found(volume_name="vol1") == ["a.txt", "c.txt", "txt"] and found(volume_name="VOL1") == []
    assert found(category=Category.IMAGE) == ["b.txt"] and found(category=Category.IMAGE | Category.TEXT) == ["a.txt", "b.txt"] and found(category=0) == []
    assert found(kind=Kind.DIRECTORY) == ["txt"] and found(kind=Kind.FILE) == found(kind=Kind.SYMLINK) == ["a.txt", "b.txt", "c.txt"]
    assert found(volume_type=(VolumeType.NETWORK,)) == ["b.txt"] and found(volume_type=()) == []


def test_filters_see_the_newest_version_only(catalog):
    catalog.insert(entry("/d/a.txt", "vol1"))
    catalog.sync()
    catalog.insert(entry("/d/a.txt", "vol2", category=Category.IMAGE))
    assert paths(catalog.search("txt", 9, 0, SearchOptions(volume_name="vol1"), NOW)) == []
    catalog.delete("/d/a.txt")
    assert paths(catalog.search("txt", 9, 0, SearchOptions(category=Category.IMAGE), NOW)) == [] == paths(catalog.recent_files(0, 9))


def test_recent(catalog):
    catalog.insert_batch([entry("/a", t=100_000_000), entry("/b", t=1_000_000_000), entry("/c", t=1_000_000_000)])
    assert paths(catalog.recent_files(500, 10)) == ["/b", "/c"] and paths(catalog.recent_files(100, 1, 2)) == ["/a"]
    assert [r.score for r in catalog.recent_files(0, 1).collect()] == [0.0]


def test_custom_score(catalog):
    catalog.insert_batch([entry("/x/a.txt"), entry("/x/aaa.txt")])
    o = SearchOptions(scoring=ScoringConfig(function=lambda w, tokens, raw, now: F.lit(-1.0) * F.length("path")))
    assert paths(catalog.search("txt", 5, 0, o, NOW)) == ["/x/a.txt", "/x/aaa.txt"]


def test_expansions(spark):
    data = [(f"a{k:02d}", f"p{i}") for k in range(60) for i in range(3)]
    df = spark.createDataFrame(data, "term string, path string")
    o = SearchOptions()
    assert P.expansions(df, "a", o, 1000, True) == [f"a{k:02d}" for k in range(50)]
    assert P.expansions(df, "a", o, 4, False) == [f"a{k:02d}" for k in range(7)]
    assert P.expansions(df, "z", o, 4, False) == []


def test_postings_edges(spark):
    data = [("/a/b.txt", None), (None, "v"), ("", "v"), ("/a/" + "w " * 20_000, "v")]
    df = spark.createDataFrame(data, "path string, volume string").selectExpr("*", "1 as term", "2 as terms")
    got = P.postings(df)
    assert {r.term for r in got.where("path = '/a/b.txt'").collect()} == {"a", "b", "txt", "b.txt", "\x02txt"}
    assert got.where("path = ''").count() == 1
    grouped = {r.term: r.paths for r in P.grouped(got.where("path <> ''")).collect()}
    assert grouped["a"] == sorted(p for p, _ in data if p)
    cut = P.grouped(spark.range(500).selectExpr("if(id < 400, 'hot', 'cold') as term", "concat('/p/', id % 450) as path"), 50).collect()
    assert max(len(r.paths) for r in cut if r.term == "hot") < 90 and sorted(p for r in cut if r.term == "hot" for p in r.paths) == sorted(f"/p/{i}" for i in range(400))
    assert len({r.block for r in cut if r.term == "hot"}) == 8
    assert P.postings(df.where("false")).count() == 0


def test_sorted_postings_prune(spark):
    to = run_dir(spark, "sorted")
    df = spark.range(20_000).selectExpr("concat('t', id % 500) as term", "concat('/p/', id) as path")
    P.write_postings(df, to, 4)
    back = spark.read.parquet(to)
    plan = back.where("term like 't49%'")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,t49)" in plan
    assert back.where(F.col("term").startswith("t49")).count() == 440


def test_merge_policy():
    c = CompactorConfig(min_merge_count=3)
    assert merge_candidates([10, 10], c) == []
    assert merge_candidates([1000, 10, 10, 10, 10], c) == [1, 2, 3]
    assert merge_candidates([1, 5, 17, 70, 300, 1100, 4500, 18000, 70000, 280000], c) == [0, 1, 2]
    assert merge_candidates([9, 9], CompactorConfig(tombstone_threshold=1), tombstones=2) == [0, 1]
    with pytest.raises(ValueError):
        c.with_(min_merge_count=0)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 50_001])
def test_percentiles(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([rnd.random(), 0.5, 1e6 * rnd.random()]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    got = stats.percentiles(df, "v").first()
    s = sorted(values)
    assert [got.p50, got.p75, got.p90, got.p95, got.p99] == [s[n // 2], *(s[max(int(n * p), 1) - 1] for p in (0.75, 0.9, 0.95, 0.99))]
    assert got.max == s[-1]


def test_percentiles_of_nothing_and_ties(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert list(stats.percentiles(df, "v").first()) == [None] * 7
    many = spark.range(60_000).selectExpr("if(id % 3 = 0, 1e300, 7.0) as v")
    assert stats.percentiles(many, "v", (0.5, 0.99)).first()[:2] == (7.0, 1e300)


def test_stream(spark, tmp_path):
    from catalens.streaming.ingest import ingest, oplog_stream

    data = [(f"/p/{i % 7}", "v", 0, i, i, 1, 0, i, i % 5 == 0) for i in range(60)]
    random.Random(1).shuffle(data)
    source = str(tmp_path / "in")
    c = Catalog(spark, run_dir(spark, "catalog"), CompactorConfig(min_merge_count=2))
    spark.createDataFrame(data[:40], OPLOG_SCHEMA).repartition(4).write.parquet(source)
    ingest(c, oplog_stream(spark, source, 1), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame(data[40:], OPLOG_SCHEMA).write.mode("append").parquet(source)
    ingest(c, oplog_stream(spark, source, 1), str(tmp_path / "cp")).awaitTermination()
    want = {}
    for o in sorted(data, key=lambda o: o[7]):
        want[o[0]] = o
    assert {r.path: r.seq for r in c.live().collect()} == {p: o[7] for p, o in want.items() if not o[8]}
    n = len(c._generations())
    assert not c.append_ops(spark.createDataFrame(data[:1], OPLOG_SCHEMA), "ops", 0) and len(c._generations()) == n


def test_walker(spark, tmp_path):
    from catalens.sources.walker import register

    (tmp_path / "d/e/f").mkdir(parents=True)
    (tmp_path / "d/e/f/pic.JPG").write_text("x")
    (tmp_path / "a.txt").write_text("x")
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    register(spark)
    got = {r.path.removeprefix(str(tmp_path)): r for r in spark.read.format("entries").option("path", str(tmp_path)).option("volume", "V").load().collect()}
    assert {p: r.kind for p, r in got.items()} == {"": 1, "/d": 1, "/d/e": 1, "/d/e/f": 1, "/d/e/f/pic.JPG": 0, "/a.txt": 0, "/link": 2}
    assert got["/d/e/f/pic.JPG"].category == Category.IMAGE and got["/a.txt"].category == Category.TEXT and got["/a.txt"].volume == "V"
    assert got["/a.txt"].last_modified == os.stat(tmp_path / "a.txt").st_mtime_ns // 1000


def test_search_plans(spark):
    """One scan of the postings for all tokens, and a bounded heap for the page."""
    entries = spark.createDataFrame([("/a/b.txt", "v", 0, 1, 1, 0, 0)], ENTRY_SCHEMA)
    to = run_dir(spark, "p")
    P.write_postings(P.postings(entries), to)
    plan = S.search(entries, spark.read.parquet(to), "ab cd ef", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("TakeOrderedAndProject") == 2


def test_command_line(spark, tmp_path, capsys):
    from catalens.__main__ import main

    (tmp_path / "files/sub").mkdir(parents=True)
    (tmp_path / "files/sub/budget.pdf").write_text("x")
    (tmp_path / "files/notes.txt").write_text("x")
    where = f"file://{tmp_path}/catalog"
    main([where, "index", str(tmp_path / "files")])
    assert "4 entries" in capsys.readouterr().out
    main([where, "search", "budget", "--category", "2"])
    out = capsys.readouterr().out
    assert "budget.pdf" in out and "DOC " in out and "notes" not in out
    main([where, "search"])
    assert "notes.txt" in capsys.readouterr().out
    main([where, "delete", str(tmp_path / "files/sub"), "--prefix"])
    main([where, "compact"])
    main([where, "search", "budget"])
    assert "budget.pdf" not in capsys.readouterr().out


def test_search_or_recent(catalog):
    catalog.insert_batch([entry("/a/old.txt", t=10), entry("/a/new.txt", t=10**15)])
    assert paths(catalog.search_or_recent(" ", 5, now_micros=10**15)) == ["/a/new.txt"]
    assert paths(catalog.search_or_recent("old", 5, now_micros=10**15)) == ["/a/old.txt"]
    assert S.cutoff_seconds(10) == 0
