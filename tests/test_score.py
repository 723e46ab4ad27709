import pytest
from pyspark.sql import functions as F

from catalens.functions.score import score, score_column
from catalens.model import ScoringWeights

W = ScoringWeights()
NOW = 10**15
GOLDEN = [
    ("abc.txt", ["abc"], ["abc"], 81.0), ("other.txt", ["abc"], ["abc"], 0.0), ("/foo/bar/abc.txt", ["abc"], ["abc"], 67.5), ("/foo/abc/file.txt", ["abc"], ["abc"], 30.0),
    ("/foo/bar/baz/abc.txt", ["abc"], ["abc"], 64.8), ("/lib.rs", ["lib", "rs"], ["lib", "rs"], 141.75), ("/my_app/src/lib.rs", ["lib", "rs"], ["lib", "rs"], 141.75), ("foo_bar.txt", ["foo", "bar"], ["foo", "bar"], 71.1),
    ("bar_foo.txt", ["foo", "bar"], ["foo", "bar"], 67.714286), ("Мой Документ.txt", ["документ"], ["документ"], 40.0), ("日本語のテスト.txt", ["日", "本"], ["日本"], 75.9), ("/документ/file.txt", ["документ"], ["документ"], 32.0),
    ("/folder/документ.txt", ["документ"], ["документ"], 72.0),
]


def of(path, tokens, raw, kind=0, modified=NOW, accessed=NOW, now=NOW):
    return score(W, tokens, raw, path, kind, modified, accessed, now)


@pytest.mark.parametrize("path,tokens,raw,want", GOLDEN)
def test_absolute(path, tokens, raw, want):
    assert round(of(path, tokens, raw), 6) == pytest.approx(want, abs=1e-6)


def test_relations():
    assert of("/a/abc.txt", ["abc"], ["abc"]) > of("/a/abc.txt", ["abc"], ["abc"], modified=0, accessed=0)
    assert of("/a/abc.txt", ["abc"], ["abc"], kind=1) > of("/a/abc.txt", ["abc"], ["abc"]) > of("/a/abc.txt", ["abc"], ["abc"], kind=2)
    assert of("/foo/документ.txt", ["документ"], ["документ"]) > of("/документ/foo.txt", ["документ"], ["документ"])
    assert of("/x/report.pdf", ["report", "pdf"], ["report", ".pdf"]) > of("/x/report.pdf", ["report", "pdf"], ["report", "pdf"])


def test_one_character_too_many_is_exact():
    assert of("/a/lib", ["libx"], ["libx"]) == pytest.approx(120.0)
    assert of("/a/lib", ["libxy"], ["libxy"]) == 0.0


def test_future_and_no_tokens():
    assert of("/a/abc", ["abc"], ["abc"], modified=NOW * 2) == pytest.approx(120.0)
    assert of("/a/abc", [], []) == 0.0


def test_column(spark):
    df = spark.createDataFrame([(p, 0, NOW, None) for p, *_ in GOLDEN[:5]], "path string, kind int, last_modified long, last_accessed long")
    got = {r.path: r.s for r in df.withColumn("s", score_column(W, ["abc"], ["abc"], NOW)).collect()}
    assert {p: round(s, 6) for p, s in got.items()} == {p: w for p, _, _, w in GOLDEN[:5]}
    assert df.where("path is null").withColumn("s", F.lit(1)).count() == 0
