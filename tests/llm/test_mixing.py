import random

import pytest
from conftest import rows

from catalens.llm import mixing as M

TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.0, 4)]


def frames(spark, n=600):
    rnd = random.Random(1)
    docs = []
    for k in range(n):
        s = rnd.choices(["big", "mid", "small", "other", None], [60, 25, 3, 8, 4])[0]
        docs.append((k, "word " * rnd.randint(1, 200), s))
    docs += [(None, "a b", "big"), (9001, None, "big"), (9002, "", "mid"), (9003, "long " * 20_000, "big")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "2 as block", "3 as h", "4 as part")
    return d, spark.createDataFrame(TARGETS, "source string, target_share double, max_copies int").selectExpr("*", "1 as share", "2 as copies")


def test_token_counts():
    lengths = M._Lengths(M.tokenizer_path())
    for text in ["", " ", "a  b", "\n\n x", "it's  'tis\t a", "  lead", "end  ", " \n b", "a \n\n  b", "x  y", "日本 語", "1 234,56 ███ "]:
        assert M.count_tokens(text, lengths) == len(lengths.encode(text)), repr(text)


def test_shares_and_copies(spark):
    d, t = frames(spark)
    chosen = M.mixture(d, t, total=30_000, block=500).cache()
    used = chosen.select("doc_id", "source", "copy").distinct().groupBy("doc_id", "source").count()
    limit = {s: c for s, _, c in TARGETS}
    assert all(r["count"] <= limit[r.source] for r in used.collect())
    assert chosen.groupBy("doc_id", "copy", "first").count().where("count > 1").count() == 0
    assert chosen.groupBy("slot").sum("tokens").where("`sum(tokens)` > 500").count() == 0
    by = {r.source: r for r in M.shares(d, t, total=30_000, block=500).collect()}
    assert set(by) == {"big", "mid", "small", "none"} and by["none"].selected_tokens == 0
    assert by["big"].selected_tokens == pytest.approx(15_000, abs=501) and by["mid"].selected_tokens == pytest.approx(9_000, abs=1_001)
    assert by["small"].most_copies == 3 or by["small"].selected_tokens == pytest.approx(6_000, abs=1_001)
    assert sum(r.reached_share for r in by.values()) == pytest.approx(1)
    sums = {r.source: r[1] for r in chosen.groupBy("source").sum("tokens").collect()}
    assert sums == {s: r.selected_tokens for s, r in by.items() if r.selected_tokens}
    assert rows(chosen) == rows(M.mixture(d.repartition(5), t, total=30_000, block=500))  # the same anywhere


def test_fit_keeps_the_shares(spark):
    d, t = frames(spark)
    whole = {r.source: r for r in M.shares(d, t, block=200).collect()}
    assert abs(whole["small"].reached_share - 0.2) > 0.02  # it can't fill its part of all tokens
    fitted = {r.source: r for r in M.shares(d, t, block=200, fit=True).collect()}
    assert all(abs(fitted[s].reached_share - share) < 0.02 for s, share, _ in TARGETS)


def test_the_same_in_any_order(spark):
    """Neither shares nor the fitted total depend on the order in which the targets' rows come."""
    shares = {"registry_feed": 0.3, "law_reports": 0.22, "scan_archive": 0.1, "tribunal_site": 0.15, "gazette": 0.12, "bar_digest": 0.08, "clerk_memos": 0.03}
    docs = spark.createDataFrame([(k, s, 19422 if s == "bar_digest" else 900_000) for k, s in enumerate(shares)], "doc_id long, source string, n_chars long")
    whole, parts = [(s, x, 5) for s, x in shares.items()], [(s, x * k, 5) for k in (0.1, 0.2, 0.3, 0.4) for s, x in shares.items()]
    turned = lambda targets, k: spark.createDataFrame(targets[k:] + targets[:k], "source string, target_share double, max_copies int").coalesce(1)
    assert M.planned(docs, turned(whole, 3), size="n_chars", fit=True).total == 1_213_875  # 19422 * 5 / 0.08
    for targets in (whole, parts):
        assert len({tuple(rows(M.clean_targets(turned(targets, k)))) for k in (0, 3, 6, 9)}) == 1


def test_many_sources(spark):
    t = spark.range(9000).selectExpr("concat('s', id) as source", "1 / 9000D as target_share", "1 as max_copies")
    slots = M.schedule(M.clean_targets(t), 40_000)
    assert slots.count() == slots.select("slot").distinct().count() == 40_000
    assert slots.groupBy("source").count().agg({"count": "max"}).first()[0] <= 8


def test_schedule(spark):
    _, t = frames(spark)
    slots = M.schedule(M.clean_targets(t), 1000).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(1000))
    for source, share, _ in TARGETS[:3]:
        own = [r for r in slots if r.source == source]
        assert [r.rank for r in own] == list(range(len(own)))
        for n in (10, 100, 1000):
            assert abs(sum(r.source == source for r in slots[:n]) - share * n) <= 3


def test_blocks(spark):
    """Every token of every document is in one block, blocks are full but for the last of a source."""
    d, t = frames(spark)
    laid = M.laid_out(M.with_tokens(d), M.clean_targets(t)).cache()
    cut = M.blocks(laid, 500).cache()
    assert cut.groupBy("source", "doc_id").sum("tokens").exceptAll(laid.select("source", "doc_id", "tokens")).count() == 0
    for s in ("big", "mid"):
        sizes = [r[1] for r in cut.where(f"source = '{s}'").groupBy("block").sum("tokens").orderBy("block").collect()]
        assert set(sizes[:-1]) == {500} and sizes[-1] <= 500
    assert laid.where("source not in ('big', 'mid', 'small')").count() == 0
    assert cut.where("doc_id = 9003").count() >= 40


def test_edges(spark):
    d, t = frames(spark, 50)
    assert M.mixture(d.where("false"), t).count() == 0 and M.mixture(d, t.where("false")).count() == 0
    odd = spark.createDataFrame([("big", None, None), ("big", 2.0, 1), (None, 1.0, 1), ("mid", -1.0, 2)], "source string, target_share double, max_copies int")
    assert rows(M.clean_targets(odd)) == [("big", 1.0, 1), ("mid", 0.0, 2)]
    assert M.shares(d.where("false"), t).where("selected_tokens <> 0 or reached_share <> 0").count() == 0
