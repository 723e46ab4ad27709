"""Every registered query of the core against its SQL, on the smallest tables on which it has rows."""

from pathlib import Path

import duckdb
import pytest

from catalens.plans import catalogue, pipeline
from compare import canon

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries for which the smallest tables hold no rows.
RARE = {"search_unicode", "search_ext", "search_page2", "recent_page2", "recent_filtered", "catalog_search", "term_exact_ext", "volume_filter", "catalog_search_generations"}
QUERIES = catalogue.QUERIES | pipeline.QUERIES
SQL = catalogue.SQL | pipeline.SQL


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    data = MORE if name in RARE else DATA
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = canon([tuple(r) for r in df.select(*cols).collect()])
    assert got
    if name in SQL:
        db = duckdb.connect()
        db.execute("SET TimeZone='UTC'")
        for p in Path(data).iterdir():
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = db.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert got == canon([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_core_does_not_need_the_llm_package():
    root = Path(__file__).resolve().parent.parent / "catalens"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "catalens.llm" not in p.read_text(), p
