import pytest
from conftest import rows

from catalens.llm import lookalike as K

SCHEMA = "entry_id long, path string, volume string"


def test_fold():
    assert K.fold("ＡＢ．ｔｘｔ") == "AB.txt" and K.fold("oﬃce­ﬁ​") == "officefi"
    assert K.fold("a b　c d\te") == "a b c d e" and K.fold("café") == "café"
    assert K.fold("ガｶﾞ ガ") == "ガガ ガ" and K.fold("") == ""
    assert K.fold("É l0") == "É l0" != K.fold("É lO")


def test_results():
    assert K.results("audit") == () and K.results("отчёт") == () and K.results("ガイドNorth") == ()
    assert K.results("аudit") == ("audit",)  # Cyrillic а
    assert "отчёт" in K.results("oтчёт")  # Latin o
    assert K.results("ԁеrо") == ("dero",) and K.results("jɑv") == ("jav",)
    assert K.results("сор") == ("cop",) and K.results("Файлы") == ()
    assert K.results("cafе́") == ("café",)


@pytest.fixture
def entries(spark):
    data = [
        (1, "/srv/audit draft/scan.pdf", "vol1"), (2, "/srv/аudit draft/sсan.pdf", "vol1"), (3, "/srv/audit draft/scan​.pdf", "ｖol1"), (4, "/srv/Audit draft/scan.pdf", "vol1"), (5, "/srv/áudit draft/scan.pdf", "vol1"),
        (6, "/srv/audit draft/scan.pdf", "vol1"), (7, "/srv/audit draft/scan.pdf", "vol2"), (8, "/отчёт/ФайлыScan.txt", "D:"), (9, "/oтчёт/ФайлыSсan.txt", "D:"), (10, "/forged/tοtal", "x"), (11, "/forged/tоtal", "x"), (12, "/lone/zzеzz", "x"),
        (13, None, "v"), (14, None, None), (15, "", ""), (16, "​", ""), (None, "/srv/a", "v"), (17, "/l0/O1", "v"), (18, "/lO/01", "v"), (19, "/b" * 20_000 + "о", "v"), (20, "/b" * 20_000 + "ο", "v"),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_pairs(spark, entries):
    df = entries.selectExpr("*", "1 as look", "2 as text", "3 as token", "4 as c_path")
    want = [(1, 2), (1, 3), (2, 3), (2, 6), (3, 6), (8, 9), (10, 11), (15, 16), (19, 20)]
    assert rows(K.same_looking(df)) == sorted(want, key=repr)
    assert K.same_looking(df.where("false")).count() == 0


def test_canonical(spark, entries):
    got = {r.entry_id: (r.c_volume, r.c_path) for r in K.canonical(entries).collect()}
    assert got[1] == got[2] == got[3] == ("vol1", "/srv/audit draft/scan.pdf")
    assert got[9] == ("D:", "/отчёт/ФайлыScan.txt") and got[12] == ("x", "/lone/zzеzz")  # not in the vocabulary: stays
    assert got[13] == ("v", None) and got[14] == (None, None) and got[16] == ("", "")
    assert len(got) == 20


def test_many_copies_of_one_spelling(spark):
    df = spark.range(3000).selectExpr("id as entry_id", "'/a/b' as path", "'v' as volume").unionByName(spark.createDataFrame([(9999, "/а/b", "v")], SCHEMA))
    assert K.same_looking(df).count() == 3000


def test_one_form_for_all_spellings_of_a_look(spark):
    ops = ["ops", "орs", "оps", "oрs", "орѕ"]
    css = ["сss", "сѕs", "ѕѕс", "сѕѕ"]  # never in Latin; the third is another look
    df = spark.createDataFrame([(i, f"/{w}/x", "v") for i, w in enumerate(ops + css)], SCHEMA)
    got = {r.entry_id: r.c_path for r in K.canonical(df).collect()}
    assert {got[i] for i in range(5)} == {"/ops/x"} and {got[i] for i in (5, 6, 8)} == {"/css/x"} and got[7] == "/ѕѕс/x"
    assert rows(K.members(df)) == sorted([*[(i, 0, 5) for i in range(5)], *[(i, 5, 3) for i in (5, 6, 8)]], key=repr)
    want = [(a, b) for g in ([0, 1, 2, 3, 4], [5, 6, 8]) for a in g for b in g if a < b]
    assert rows(K.same_looking(df)) == sorted(want, key=repr)


def test_words_of_two_scripts_joined(spark):
    words = ["отчётscan", "отчётsсan", "ОТЧЁТSCAN", "ОТЧЁТSСAN", "базаscan", "базaѕcan", "базаѕсan", "отчётsсanлон", "ガイドnоrth", "ガイドnorth"]
    df = spark.createDataFrame([(i, f"/{w}/x", "v") for i, w in enumerate(words)], SCHEMA)
    got = {r.entry_id: r.c_path for r in K.canonical(df).collect()}
    assert [got[i] for i in (0, 1, 2, 3)] == [f"/{words[i]}/x" for i in (0, 0, 2, 2)] and got[7] == f"/{words[7]}/x"
    assert got[4] == got[5] == got[6] == "/базаscan/x" and got[8] == got[9] == "/ガイドnorth/x"
    assert rows(K.same_looking(df)) == sorted([(0, 1), (2, 3), (4, 5), (4, 6), (5, 6), (8, 9)], key=repr)


def test_words_of_one_script_stay_where_nothing_else_is_written(spark):
    data = [(1, "/договор с клиентом", "v"), (2, "/a/c", "v"), (3, "/c/е", "v"), (4, "/отчёт/c/дом", "w"), (5, "/отчёт/с/дом", "w"), (6, "/сор", "v"), (7, "/cop", "v"), (8, "/cop", "v")]
    got = {r.entry_id: r.c_path for r in K.canonical(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1] == "/договор с клиентом" and got[3] == "/c/е" and got[6] == got[7] == got[8] == "/cop"
    assert got[4] == got[5] == "/отчёт/с/дом"


def test_repairs_of_any_number(spark, entries):
    """Sent to all tasks or joined."""
    a, b = K.classes(entries), K.classes(entries, sent=0)
    assert rows(a.rows) == rows(b.rows) and rows(a.several) == rows(b.several) and rows(a.rest) == rows(b.rest)
