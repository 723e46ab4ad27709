import pytest
from pyspark.sql import functions as F

from catalens.functions import tokens as K
from catalens.plans.query import parse, scoring_cap
from catalens.model import SearchOptions

# Texts and the tokens that must come out.
GOLDEN = {
    "hello world": "hello world",
    "MySuperFile": "file my mysuperfile super",
    "report2023.txt": "2023 report report2023 txt",
    "café": "cafe",
    "café": "cafe",
    "日本語": "日 日本語 本 本語 語",
    "한국어": " ".join(K.fold_text(t) for t in ("국", "국어", "어", "한", "한국어")),
    "Документ.txt": "txt документ",
    "hElLo": "el h hello lo",
    "Hello HELLO": "hello",
    "project測試.txt": "project txt 測 測試 試",
    "这是测试.txt": "txt 是 是测试 测 测试 试 这 这是测试",
    "HTTPServer": "httpserver",
    "": "",
    "/__--": "",
}


@pytest.mark.parametrize("text", GOLDEN)
def test_tokens_of_text(text):
    assert set(K.tokenize_text(text)) == set(GOLDEN[text].split())
    assert K.tokenize_text(text) == sorted(K.tokenize_text(text), key=str.encode)


def test_columns_agree_with_text(spark):
    texts = [*GOLDEN, None, "a" * 100_000 + " B1", "x/Y9z_aB", "ﬁle ＡＢ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", K.tokens(F.col("t")).alias("k"), K.ascii_tokens(F.col("t")).alias("a"), K.folded(F.col("t")).alias("f")).collect()
    for r in got:
        assert r.k == (None if r.t is None else K.tokenize_text(r.t))
        assert r.a == (r.k if r.t is not None and r.t.isascii() else None)
        assert r.f == (None if r.t is None else K.fold_text(r.t))


def test_fold():
    assert K.fold_text("Café/Report_2023") == "cafe/report_2023"


def test_path_parts(spark):
    paths = ["/a/b.tar.gz", "/a/.bashrc", "/a/.config.json", "/a/foo.", "/a/b/", "noext", "/", "", "/x/..", "/a/b.c/d", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    got = {r.p: (r.n, r.e, r.h, r.d) for r in df.select("p", K.basename(p).alias("n"), K.extension(p).alias("e"), K.hidden_extension(p).alias("h"), K.depth(p).alias("d")).collect()}
    assert got["/a/b.tar.gz"] == ("b.tar.gz", "gz", None, 2)
    assert got["/a/.bashrc"] == (".bashrc", None, "bashrc", 2)
    assert got["/a/.config.json"] == (".config.json", "json", "config", 2)
    assert got["/a/foo."][1] == ""
    assert got["/a/b/"][:2] == ("b", None) and got["noext"][1] is None and got["/a/b.c/d"][1] is None
    assert got["/x/.."][1] is None and got[None][0] is None


def test_all_terms(spark):
    df = spark.createDataFrame([("/Docs/Café.PDF", "Vol1"), ("/a/.env", "")], "p string, v string")
    got = {r.p: set(r.t) for r in df.select("p", K.all_terms(F.col("p"), F.col("v")).alias("t")).collect()}
    assert got["/Docs/Café.PDF"] == {"docs", "cafe", "pdf", "\x01vol1", "\x02pdf", "cafe.pdf"}
    assert got["/a/.env"] == {"a", "env", "\x02env"}


def test_ancestors(spark):
    df = spark.createDataFrame([("/A/b\\c/d",), ("x",)], "p string")
    assert [r[0] for r in df.select(K.ancestor_terms(F.col("p"))).collect()] == [["/a/", "/a/b\\", "/a/b\\c/"], []]


def test_parse():
    q = parse("Report .pdf ab")
    assert q.raw == ("report", ".pdf", "ab")
    assert q.tokens == ("report", "\x02pdf", "pdf", "ab")
    assert parse("  ").tokens == () and parse(".").tokens == ()


def test_cap():
    o = SearchOptions()
    assert [scoring_cap(10, 0, o), scoring_cap(200, 50, o), scoring_cap(2000, 0, o)] == [500, 750, 2050]
    assert scoring_cap(10, 5, SearchOptions(max_scoring_cap=20)) == 65
