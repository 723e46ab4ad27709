import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows

from catalens.llm import line_ledger, term_counts, term_weight
from catalens.session import run_dir

SCHEMA = "term string, entry_id long, pos int, segment_no int"


def sample(n=1500):
    rnd = random.Random(7)
    data = [(rnd.choice(["all", f"t{int(rnd.expovariate(0.05))}"]), rnd.choice([rnd.randint(0, 40), 70_000 + rnd.randint(0, 90), 3]), rnd.randint(0, 5), 0) for _ in range(n)]
    return data + data[:50] + [(None, 1, 1, 0), ("", 1, 1, 0), ("x", None, 1, 0), ("x", 5, None, 0), ("x", 5, None, 1), ("y" * 50_000, 2, 1, 0), (None, None, None, None)]


def brute(data):
    tf = Counter((t, e) for t, e, _ in {(t, e, p) for t, e, p, _ in data if t and e is not None})
    by = defaultdict(dict)
    for (t, e), n in tf.items():
        by[t][e] = n
    return by


def test_weights(spark):
    data = sample()
    by = brute(data)
    n = len({e for d in by.values() for e in d})
    want = {}
    for t, d in by.items():
        gf = sum(d.values())
        h = -sum(x / gf * math.log(x / gf) for x in d.values())
        for e, x in d.items():
            want[e, t] = (x, len(d), gf, math.log2(1 + x) * (1 - h / math.log(n)))
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as tf", "2 as df", "3 as gf", "4 as weight", "5 as entropy")
    got = {(r.entry_id, r.term): (r.tf, r.df, r.gf, r.weight) for r in term_weight.term_weights(df).collect()}
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-9)
    found = {(r.entry_id, r.term) for r in term_weight.distinctive(df).collect()}
    assert found == {k for k, v in want.items() if v[0] >= 3 and 2 <= v[1] <= 20}


def test_weights_of_little(spark):
    df = spark.createDataFrame([("a", 1, 0, 0), ("a", 1, 1, 0)], SCHEMA)
    assert rows(term_weight.term_weights(df)) == [(1, "a", 2, 1, 2, math.log2(3))]
    assert term_weight.term_weights(df.where("false")).count() == 0


def test_counts(spark):
    data = sample()
    by = brute(data)
    n = len({e for d in by.values() for e in d})
    want = {t: (sum(d.values()), len(d), "rare" if len(d) <= 2 else "common" if len(d) > 0.1 * n else None) for t, d in by.items()}
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as bitmap", "2 as occurrences", "3 as b").repartition(5)
    assert {r.term: (r.occurrences, r.entries, r.mark) for r in term_counts.term_counts(df).collect()} == want
    assert term_counts.records_with_terms(df) == n
    assert term_counts.term_counts(df.where("false")).count() == 0


def test_bitmaps():
    rnd = np.random.default_rng(1)
    for n in (1, 4094, 4095, 4096, 20_000, 65_536):
        ids = np.sort(rnd.choice(65_536, n, replace=False)).astype(np.uint16)
        packed = term_counts.pack(ids)
        assert len(packed) == (2 * n if n <= 4095 else 8192)
        assert (term_counts.unpack(packed) == ids).all()
    a, b = np.arange(0, 6000, dtype=np.uint16), np.arange(3000, 9000, dtype=np.uint16)
    assert len(term_counts.union([term_counts.pack(a), term_counts.pack(b)])) == 9000


def test_dense_term(spark):
    df = spark.range(140_000).selectExpr("'hot' as term", "id as entry_id", "0 as pos", "0 as segment_no")
    layout = term_counts.term_bitmaps(df.repartition(7)).collect()
    assert sorted((r.range, len(r.bitmap), r.entries) for r in layout) == [(0, 8192, 65_536), (1, 8192, 65_536), (2, 8192, 8_928)]


LINES = [
    (1, "volume = vol3, kind = file, path = /Srv/Survey/Invoice_0024.Docx"),
    (2, '<entry PATH="\\srv\\survey\\invoice 0024.docx" KIND="FILE" VOLUME="Vol3"/>'),
    (3, "kind='file'\tvolume='vol3'\tpath='/srv/survey/invoice/0024.docx/'"),
    (4, '{"path": "/srv/survey/INVOICE-0024.docx ", "volume": "vol3", "kind": "file"}'),
    (5, "PATH=/srv/survey/invoice_0024.docx |KIND=dir|VOLUME=vol3"),
    (6, "path: /srv/survey/invoice0024.docx; volume: vol3; kind: file"),
    (7, "path: /srv/Ökö/año.txt; volume: büro; kind: file"),
    (8, "KIND: FILE; VOLUME: BÜRO; PATH: /SRV/ÖKÖ/AÑO.TXT"),
    (9, None), (None, "path: x; volume: y; kind: z"), (10, ""), (11, ""), (12, "path: " + "a/" * 30_000 + "; volume: v; kind: file"), (13, "no labels here"),
]


def test_ledger(spark):
    df = spark.createDataFrame(LINES, "line_id long, line string").selectExpr("*", "1 as key", "2 as bucket", "3 as n")
    ledger = line_ledger.LineLedger(spark, run_dir(spark, "ledger"))
    ledger.add(df.where("line_id > 3 or line_id is null"))
    ledger.add(df.where("line_id <= 3"))
    assert set(rows(ledger.copies(df))) == {(1, 2), (1, 3), (1, 4), (7, 8), (10, 11), (10, 13)}
    assert sorted((r.keep_id, r.lines) for r in ledger.rows().collect()) == [(1, 4), (5, 1), (6, 1), (7, 2), (10, 3), (12, 1)]
    before = rows(ledger.rows())
    ledger.add(df.where("false"))
    assert rows(ledger.rows()) == before and ledger.table.manifest()["version"] == 3


def test_ledger_hot_group(spark):
    df = spark.range(3000).selectExpr("id as line_id", "if(id % 3 = 0, concat('path: A', repeat(' ', id % 5), '; volume: v; kind: f'), concat('path: ', id, '; volume: v; kind: f')) as line")
    ledger = line_ledger.LineLedger(spark, run_dir(spark, "ledger"))
    ledger.add(df)
    got = ledger.copies(df)
    assert got.count() == 999 and got.where("keep_id <> 0").count() == 0
    empty = line_ledger.LineLedger(spark, run_dir(spark, "ledger"))
    empty.add(df.where("false"))
    assert empty.copies(df).count() == 0 and empty.rows().count() == 0


def test_ledger_buckets_follow_the_records(spark):
    """One line first, then many: buckets split, counts are kept."""
    df = spark.range(12_000).selectExpr("id as line_id", "concat('path: /p/', id % 6000, '; volume: v; kind: f') as line")
    ledger = line_ledger.LineLedger(spark, run_dir(spark, "ledger"), bucket_rows=500)
    assert ledger.add(df.where("line_id = 7"))["meta"]["buckets"] == 4
    two = ledger.add(df.where("line_id <> 7"))["meta"]
    assert two["buckets"] == 16 and two["records"] == 6000 and max(n for _, n in two["held"].values()) < 600
    assert ledger.rows().where("lines = 2 and keep_id < 6000").count() == 6000
    three = ledger.add(spark.createDataFrame([(99_999, "path: /P/7; volume: v; kind: f")], "line_id long, line string"))["meta"]
    assert sum(three["held"][b] != f for b, f in two["held"].items()) == 1 and ledger.rows().where("lines = 3").first().keep_id == 7


def test_weights_choose_the_terms(spark):
    """The plan of the selection holds the weight, and its bound loses no term that keeps the counts."""
    data = [("a", i, p, 0) for i in range(20) for p in range(3)] + [("b", i, p, 0) for i in range(21) for p in range(9)] + [("c", 1, p, 0) for p in range(2)] + [("c", 2, 0, 0), ("d", 3, 0, 0), *[(f"u{k}", k, 0, 0) for k in range(60)]]
    df = spark.createDataFrame(data, "term string, entry_id long, pos int, segment_no int")
    got = term_weight.distinctive(df)
    assert sorted({r.term for r in got.collect()}) == ["a"] and got.count() == 20
    assert "LOG2" in got._jdf.queryExecution().optimizedPlan().toString().upper()
