import random

import numpy as np
import pytest
from conftest import rows

from catalens.llm import leaks as L

WORDS = [f"w{i}" for i in range(300)]


def corpus():
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(5, 60)))) for i in range(30)]
    docs = []
    for d in range(200):
        parts = [" ".join(rnd.choices(WORDS + ["other"], k=rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 2)):
            w = rnd.choice(items)[1].split()
            a = rnd.randint(0, max(0, len(w) - 12))
            piece = w[a : a + rnd.randint(8, 20)]
            if rnd.random() < 0.3:
                piece[len(piece) // 2] = "changed"
            parts += [rnd.choice(["; ", " -- \n", " "]).join(x.upper() if rnd.random() < 0.2 else x for x in piece), "tail"]
        docs.append((d, " ".join(parts)))
    return docs, items


def exact(docs, items, span=12):
    out = set()
    for d, t in docs:
        w = L.words(t or "")
        mine = {tuple(w[k : k + span]) for k in range(len(w) - span + 1)}
        for i, x in items:
            v = L.words(x or "")
            if any(tuple(v[k : k + span]) in mine for k in range(len(v) - span + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as h", "3 as key")
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as suite")


def test_exact_runs_are_all_found(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    got = L.leaks(d.repartition(3), i)
    assert {(r.doc_id, r.item_id) for r in got.where("exact_words >= 12").collect()} == exact(docs, items)
    assert rows(got) == rows(L.leaks(d, i, bound=1))  # the joined way gives the same


def test_joined_way_drops_windows_of_no_item(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    windows = i.selectExpr("item_id as key", "text").mapInPandas(L._windows(None), "key long, h long, m int, at long")
    held = L._filter(windows)
    kept = d.selectExpr("doc_id as key", "text").mapInPandas(L._windows(held), "key long, h long, m int, at long").count()
    every = d.selectExpr("doc_id as key", "text").mapInPandas(L._windows(None), "key long, h long, m int, at long").count()
    own = set(windows.select("h", "m").distinct().collect())
    real = sum((r.h, r.m) in own for r in d.selectExpr("doc_id as key", "text").mapInPandas(L._windows(None), "key long, h long, m int, at long").collect())
    assert real <= kept <= real + 5 and kept < every / 5


@pytest.mark.parametrize("part,least", [(0.05, 0.99), (0.1, 0.97), (0.15, 0.9)])
def test_recall_of_substituted_passages(spark, part, least):
    rnd = random.Random(int(part * 100))
    items = [(i, " ".join(rnd.choices([f"v{k}" for k in range(5000)], k=40))) for i in range(400)]
    docs = [(i, "a b c " + " ".join(f"new{rnd.randrange(10**9)}" if rnd.random() < part else w for w in t.split()) + " d") for i, t in items]
    d, i = frames(spark, docs, items)
    found = L.leaks(d, i).where("doc_id = item_id").count()
    assert found / len(items) >= least, found


def test_substitutions_are_tolerated(spark):
    w = WORDS[:40]
    changed = [x if k % 9 else "new" for k, x in enumerate(w)]
    d, i = frames(spark, [(1, "x y " + " ".join(changed)), (2, " ".join(reversed(w)))], [(7, " ".join(w))])
    got = L.leaks(d, i).collect()
    assert [(r.doc_id, r.item_id, r.exact_words, r.doc_start, r.item_start) for r in got] == [(1, 7, 8, 3, 1)]
    assert got[0].words == 35  # up to the last word that still pays for the substitution before it


def test_edges(spark):
    long = " ".join(WORDS[:50])
    docs = [(None, long), (1, None), (2, ""), (3, long), (3, long), (4, "z " * 100_000 + long), (5, " ".join(WORDS[:11]))]
    items = [(1, long), (1, long), (2, None), (None, long), (3, ""), (4, "short one")]
    d, i = frames(spark, docs, items)
    assert [(r.doc_id, r.item_id, r.words, r.doc_start) for r in L.leaks(d, i).orderBy("doc_id").collect()] == [(3, 1, 50, 0), (4, 1, 50, 100_000)]
    assert L.leaks(d.where("false"), i).count() == 0 and L.leaks(d, i.where("false")).count() == 0


def test_overlap():
    assert L.overlap(np.array([1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 1], bool)) == (3, 4, 4, 3)
    assert L.overlap(np.zeros(3, bool))[1:3] == (0, 0)
    assert L.overlap(np.zeros(0, bool)) == (0, 0, 0, 0)


def test_masks_ignore_positions():
    a = np.arange(1, 13)
    for mask in L.MASKS:
        for k, on in enumerate(mask):
            b = a.copy()
            b[k] = 99
            assert (L.seed_hashes(a, mask) == L.seed_hashes(b, mask)).all() == (on == "0")
