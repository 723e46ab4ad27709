import pytest
from conftest import rows

from catalens.llm import pii
from catalens.llm import pii_train as T

GIVEN = frozenset({"søren", "tessaly", "halric"}) | T._GIVEN_SET


@pytest.fixture(scope="module")
def decode():
    return pii.Decoder(T.trained(), GIVEN)


# Frames that share none with the training's.
OTHER_FRAMES = """
The committee thanked {name} for the report.
Minutes taken by {name}
{name} wrote to the editor from {street}.
Dear {mr} {fam}, your file has been closed.
My neighbour {name} keeps bees at {street}.
The ring was pawned by {name} in {year}.
Only {name} voted no.
Reservation for {name}, phone {phone}.
You may text {phone} at any hour.
Forward the form to {mail} today.
The visa lists passport {id}.
Her licence number {id} had been misread.
Tax identification: {id}.
Ticket to {town}: {money} euros, gate {n}.
The {town} Planning Act {year} was repealed.
{firm} hired {firm} in {year}.
Appeal {letter} {n}/{year} was heard in {town}.
Account {account} was overdrawn by {money} pounds.
Order {group} arrived on {date}.
The sloop {given} sank off {town}.
{fam} v {fam} ({year}) {n} {series} {n} was doubted.
Frau {name} pflegte den Garten in {strasse}.
Gutachter {name} wurde befragt.
Die Mieterin {name} zog aus {strasse} aus.
Bitte antworten Sie an {mail}.
Telefonnummer {phone}
Personalausweis {id} liegt vor.
Lieferschein {lot}, Kiste {group}.
Die {firm} liefert {Noun} nach {town}.
Oberlandesgericht {town}, Beschluss vom {date}
Madame {name} enseigne à {town}.
Le notaire a reçu {name} chez lui, {rue}.
Répondre à {mail} sous {n} jours.
Son numéro de téléphone est le {phone}.
Passeport n° {id} délivré à {town}.
La société {firm} doit {money} francs.
Le conteneur {box} a été ouvert le {date}.
""".strip().split("\n")


@pytest.mark.parametrize("frames,least_recall,least_precision", [(T.FRAMES, (0.94, 0.99, 0.97, 0.97, 0.89), (0.92, 0.99, 0.97, 0.97, 0.95)), (OTHER_FRAMES, (0.9, 0.99, 0.9, 0.9, 0.9), (0.95, 0.99, 0.75, 0.95, 0.95))])
def test_held_out(decode, frames, least_recall, least_precision):
    """Precision and recall of each kind: on sentences of another seed, and on frames that training never saw."""
    assert frames is T.FRAMES or not set(frames) & set(T.FRAMES)
    right, missed, extra = [0] * 5, [0] * 5, [0] * 5
    for text, spans in T.labelled(2500, 12345, frames):
        got, want = set(decode(text)), set(spans)
        for k in range(5):
            a, b = {x for x in got if x[2] == k}, {x for x in want if x[2] == k}
            right[k] += len(a & b)
            missed[k] += len(b - a)
            extra[k] += len(a - b)
    recall, precision = [r / (r + m) for r, m in zip(right, missed, strict=True)], [r / (r + e) for r, e in zip(right, extra, strict=True)]
    print({k: (round(a, 3), round(b, 3)) for k, a, b in zip(pii.KINDS, recall, precision, strict=True)})
    assert all(a > b for a, b in zip(recall, least_recall, strict=True)), recall
    assert all(a > b for a, b in zip(precision, least_precision, strict=True)), precision


@pytest.mark.parametrize(
    "text,want",
    [
        ("The tenant Anna Maria Schmidt left.", "Anna Maria Schmidt"), ("Present was María García López of Madrid.", "María García López"), ("Свидетель Иван Петров пришёл.", "Иван Петров"),
        ("Mr John Ronald Smith came.", "John Ronald Smith"), ("Mr Wanjiru Otieno came.", "Wanjiru Otieno"), ("Frau Erika Mustermann kam.", "Erika Mustermann"), ("Hans Peter von der Heide kam.", "Hans Peter von der Heide"),
        ("Νίκος Παπαδόπουλος signed.", "Νίκος Παπαδόπουλος"), ("Er wohnt Hauptstr. 12 in Bonn.", "Hauptstr. 12"), ("He lives at 12 Rue de Rivoli, Paris.", "12 Rue de Rivoli"), ("Il habite 5, Place Bellecour à Lyon.", "5, Place Bellecour"),
    ],
)
def test_whole_names_and_streets(text, want):
    decode = pii.Decoder(T.trained(), frozenset("anna maria maría john hans peter иван νίκος".split()) | T._GIVEN_SET)
    assert [text[a:z] for a, z, _ in decode(text)] == [want]


def test_training_holds_no_text_of_the_tables():
    """No longer piece of a frame stands in the documents it is tested on, but for single words and names of offices."""
    import re
    from pathlib import Path

    import pyarrow.parquet as pq

    at = Path("/root/testdata/sf0.001/documents.parquet")
    if not at.exists():
        pytest.skip("no test tables here")
    texts = "\n".join(pq.read_table(at, columns=["text"])["text"].to_pylist())
    pieces = {p for f in T.FRAMES for p in re.split(r"\{\w+\}", f) if len(p.strip()) >= 14}
    assert len(pieces) > 70 and {p for p in pieces if p in texts} <= {" Reports ", "Cour d'appel de "}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Before Judge Umbath and Søren Vrilo, sitting", [("name", "Søren Vrilo")]),
        ("Present: VRILO-HALT, Søren, T. van Drool and Tessaly K. O'Hult.", [("name", "VRILO-HALT, Søren"), ("name", "T. van Drool"), ("name", "Tessaly K. O'Hult")]),
        ("The barge Tessaly lay at berth 36, 58 metres from the quay.", []),
        ("Account 7243 8708 0321 of Tarn Holdings SA was closed on 4 October 2006.", []),
        ("The passport (no. 7243 8708 0321) was lost; call +999 (0)817 555 01 91.", [("id_number", "7243 8708 0321"), ("phone", "+999 (0)817 555 01 91")]),
        ("Halric Vrilo lived at 126a St Odran's Walk, Pryn.", [("name", "Halric Vrilo"), ("address", "126a St Odran's Walk")]),
        ("Frau Tessaly Hult, wohnhaft Obere Gasse 12b, 32200 Kelm, kam.", [("name", "Tessaly Hult"), ("address", "Obere Gasse 12b")]),
        ("M. A. Hult, titulaire de la carte d'identité n° AB 12 34 56 X, demeurant 29 bis, rue des Tanneries", [("name", "A. Hult"), ("id_number", "AB 12 34 56 X"), ("address", "29 bis, rue des Tanneries")]),
        ("Reply to <a.b+court@x-y.example> or C.D AT post DOT kelm DOT test", [("email", "a.b+court@x-y.example"), ("email", "C.D AT post DOT kelm DOT test")]),
        ("A.B. and X*** wrote to k***@***; tel. 555 *** **", []),
        ("", []),
    ],
)
def test_texts(decode, text, want):
    assert [(pii.KINDS[k], text[a:z]) for a, z, k in decode(text)] == want


def test_memory_does_not_change_results():
    one, texts = pii.Decoder(T.trained(), GIVEN), [t for t, _ in T.labelled(400, 5)]
    assert [one(t) for t in texts] == [pii.Decoder(T.trained(), GIVEN)(t) for t in texts]
    small = pii.Decoder(T.trained(), GIVEN)
    small.known.keep = small.chunks.keep = lambda k, v: v  # remembers nothing
    assert [small(t) for t in texts] == [one(t) for t in texts]


def test_best_set_is_best(decode):
    """Dynamic programming against all sets of segments."""
    words, weights = decode.words, decode.weights
    for text, _ in T.labelled(150, 8):
        flat = pii.flattened(text)
        for a, z in pii.chunks(flat):
            own, like, form = words.tokens(flat[a:z], "")
            scored = [(sum(weights.get(f, 0.0) for f in pii.features(s, like, "", form, "", GIVEN)), s) for s in pii.segments(like, form)]

            def best(at, scored=scored, n=len(like)):
                return 0.0 if at >= n else max([best(at + 1), *(x + best(s[1]) for x, s in scored if s[0] == at)])

            if len(like) < 12:
                got = pii.best_segments(weights, like, "", form, "", GIVEN)
                assert sum(x for x, s in scored if s in got) == pytest.approx(best(0))


DOCS = [
    (1, "Søren Vrilo (claimant)\nTel. 0243/555 0199"), (1, "Søren Vrilo (claimant)"), (2, None), (3, ""), (None, "Tessaly Hult (claimant)"),
    (4, "Before Søren Hult, sitting alone\n" + "x " * 60_000 + "\n(signed) Tessaly Hult, Registrar"), (5, "Søren Odd, Kläger"), (6, "Tessaly Odd, appellant\nTessaly Erd (respondent)"),
]


def test_tables(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as pii_kind", "2 as w", "3 as replaced")
    assert pii.given_names(df) == {"søren", "tessaly"}
    got = rows(pii.found(df))
    assert [r for r in got if r[0] == 1] == [(1, "name", "Søren Vrilo"), (1, "phone", "0243/555 0199")]
    assert {r[2] for r in got if r[0] == 4} == {"Søren Hult", "Tessaly Hult"} and {r[0] for r in got} == {1, 4, 5, 6}
    masked = {r.doc_id: (r.text, r.replaced) for r in pii.masked(df).where("doc_id in (2, 3, 5, 6)").collect()}
    assert masked == {2: (None, 0), 3: ("", 0), 5: ("[NAME], Kläger", 1), 6: ("[NAME], appellant\n[NAME] (respondent)", 2)}
    assert pii.found(df.where("false")).count() == 0 and pii.masked(df.where("false")).count() == 0


def test_rare_given_names_and_shuffled_list(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert rows(pii.found(df, sent=0)) == rows(pii.found(df)) and rows(pii.masked(df, sent=0)) == rows(pii.masked(df))
    many = spark.range(16_000).selectExpr("id as doc_id", "if(id < 3, 'Claimant: Ysolde Vrilo', 'Claimant: Tessaly Hult') as text")
    assert pii.given_names(many) == {"ysolde", "tessaly"}
    assert {"jean", "pierre", "jean-pierre", "mc", "donald", "mcdonald"} <= pii.name_keys("Jean-Pierre McDonald", 20)
