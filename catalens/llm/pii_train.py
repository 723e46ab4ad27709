"""Training of the span model: labelled sentences from a generator, conditional likelihood, AdaGrad.

The labelled sample is bounded: ``SENTENCES`` sentences by a fixed seed. Each is a frame from the list below with invented
names, numbers and places in it. The frames are general English, German and French sentences as letters, files and
decisions have them, in their own wording; kinds of numbers and headings that were taken for entities in the test documents
have frames, too. The tests measure the model on frames that aren't in the list. Training takes some seconds on the driver and is done once per process. In a frame
``{name}``, ``{mail}``, ``{phone}``, ``{id}``, ``{street}``, ``{strasse}`` and ``{rue}`` stand for entities, other braces for
things that look like them but aren't.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from functools import lru_cache

from catalens.llm import pii

SENTENCES, EPOCHS, RATE, L2, SEED = 7000, 5, 0.25, 1e-4, 17

FRAMES = """
{name} (plaintiff)
{name}, petitioner
Plaintiff: {name}
Applicant: {name}
Heard by {name}
Heard by Judge {fam} and {name}, assessors
Delivered by Lord Justice {fam}; {name} and {name} concurring
(signed) {name}, clerk
{name}, clerk of the court
{fam}, clerk
In attendance were {name}, {name} as well as {name}.
{name} testified on the second day.
On the second day {mr} {name} testified that {mr} {fam} had left.
Yesterday {name} and {mr} {fam} agreed on a price.
{mr} {fam} replied at once.
The letter was read by {mr} {name} and returned.
The driver, {name}, had no licence with {given}.
{fam} told {name} to wait.
When {name} arrived, the door was locked.
Nobody but {name} and the caretaker of {street} knew it.
Nobody in {town} knew of {street} then.
Her sister {name} moved from {street} to {street} in {year}.
{name}, {street}, {zip} {town}
A parcel for {name} was left at {street}, {town}.
He lives at {street} in {town}; she lives at {street}.
{street} was sold to {name} for {money} euros.
The flat ({street}) belongs to {name}.
Send it to {name}, {street}, {town}, before {date}.
Statement of {name}, dated {date}, page {n}.
Statement by {name}: "{thing} and {thing} were missing".
{name} ({mail}, {phone}) will assist.
My client {name} (passport {id}) agrees.
{name}, born on {date}, holds ID {id}.
Passport number {id}, issued in {town} on {date}.
National insurance number: {id}; tax reference {id}.
Her social security number is {id}, that of {name} is {id}.
Driver's licence no. {id} expired on {date}.
The identity document ({id}) of {name} was copied.
A tax number, {id}, was entered for {name}.
Please write to {mail} or telephone {phone}.
Call {phone} or {phone} (mobile).
Fax {phone}, e-mail {mail}
She rang {phone} and left a message.
Nobody answered on {phone}.
An e-mail of {date} from {mail} to {mail} was filed.
The address <{mail}> no longer works.
Invoice {invoice} of {date} remains open.
Invoice no. {invoice} and receipt {folio} were attached.
IBAN account {account} at {firm} was frozen.
Account {account} is held by {firm}.
Order no. {group} was cancelled by {firm}.
Batch {lot} went to {town}; lot {lot} did not.
Contract {folio} and policy number {account} were renewed.
Parcel {group} was lost between {town} and {town}.
Shipment {group} reached {firm} after {n} days.
Container {box} and container {box} were sealed.
Meter reading {meter}, before that {meter}.
The folio is {folio}; the register has {lot}.
{firm} and {firm} merged in {year}.
{firm}, respondent
Applicant: {firm}
{firm} bought the {thing} from {firm}.
{fam} v. {fam}, {year} {series} {n}
As held in {fam} v {fam} ({year}) {n} {series} {n}, para {n}, notice is needed.
See {firm} v {fam} [{year}] {series} {n} at {n}, or [{n}].
Compare {fam} v {fam} [{year}] {town} Reports {n} with section {n}({n}) of the {fam} Lending Act.
Under the {fam} Act {year}, s {n}({n}), notice is needed.
Rule {n}.{n} of the {town} Regulations {year} says so.
Case C {n}/{year} concerned the {town} Rules {year}, rule {n}.
{letter} {n}/{year}
{letter} {n}/{year}, {town}
File {letter} {n}/{year} of the {town} County Court
Docket {n}/{year} - {letter} {n}/{year} - page {n}
{n} {letter} {n}/{year}
[{n}] {letter} {n}/{year} | {town} {Noun}
{letter} {n}/{year} (continued)
{town} County Court
{firm} and {firm} sued {firm}.
Neither {firm} nor {fam} replied; {firm} paid.
Subject: {Loud}
Question: {Noun} {Noun}, {thing}
Betreff: {Noun} {Noun} in {town}
Frage: Wer {Noun} nimmt, gibt der {Noun} zurück?
Objet : {Noun} {Noun}
The number ({phone}) was wrong; ({phone}) was right.
La déclaration de {name} manque.
Le témoignage de {name} et celui de {fam} diffèrent.
Die Aussage von {name} und die von {fam} fehlen.
High Court at {town}
The {town} District Court sits in {town}.
The vessel {given} of {town} sailed on {date}.
The ferries {given} {given2} and {given} {fam} were laid up in {town}.
The yacht {given} {fam} is {n}.{n} metres long.
Price: {money} dollars, payable within {n} days.
A total of {money} pounds for {n} boxes was agreed.
{n} km from {town}, {n}.{n} kg of {thing}
At {time} on {date} the {thing} stopped.
From {date} until {date}, that is {n} days.
Title {n}  {Loud}
{LOUD}
{town} {Noun} {Noun} {year}
Old {Noun} and New {Noun}, {town}
Page {n}  {LOUD}  {n}
{n}/{n}  {town} {Noun}
{name} (Klägerin)
{name}, Antragsteller
{name}, Beklagter
Vertreten durch {name}, {strasse}, {zip} {town}.
Zeuge {name}, {strasse}, {zip} {town}, ist verhindert.
{mrd} {name} wohnt jetzt {strasse} in {town}.
{mrd} {fam} und {mrd} {name} haben unterschrieben.
Gestern hat {name} Klage erhoben.
Mit {name} Vergleich zu schließen, lehnte die {firm} ab.
Für {name} meldete sich niemand.
Das Haus {strasse} gehört {name}.
Die Wohnung in {strasse}, {town}, steht leer.
Nach Aussage von {name} war niemand da.
Ausweisnummer {id}, ausgestellt auf {name}.
Sein Führerschein ({id}) wurde eingezogen.
Steuernummer {id}; Versichertennummer {id}.
Der Pass mit der Nummer {id} ist abgelaufen.
Rückfragen an {mail}, Telefon {phone}.
Unter {phone} meldet sich {name}.
Handy {phone}, Fax {phone}
Schreiben Sie an {mail} oder rufen Sie {phone} an.
Die {firm} hat Konto {account} aufgelöst.
Rechnung {invoice} vom {date} über {money} Euro.
Bestellung {group}, Sendung {lot}, Vertrag {folio}.
Container {box} kam {n} Tage zu spät.
Urteil des Landgerichts {town} vom {date}
Amtsgericht {town}, Az. {n} C {n}/{n}
Nach § {n} Abs. {n} Satz {n} der {Noun}ordnung gilt das nicht.
In der Sache {fam} gegen {fam}, Rn. {n}, lag es anders.
Am {date} wurden {n} {Noun} geliefert, {n},{n} Meter lang.
Anlage {n}: {Noun} und {Noun} aus {town}
Wer {Noun} kauft, muss {Noun} prüfen.
{Noun} {Noun} nach {Noun} in {town}
{Noun} gegen {Noun} vor dem {Noun}
{name}, demanderesse
{name}, requérant
Entre {name} et la société {firm}
{mrf} {name}, née le {date}, habite {rue} à {town}.
{mrf} {name} et {mrf} {fam} ont signé.
M. {name} est propriétaire du {rue}.
M. {name} et son épouse, {name}, ont quitté {town}.
Le logement du {rue}, {zip} {town}, est vide.
Convoqué par {name}, il a refusé.
L'avocat de {name} n'a pas répondu.
D'après {name}, la porte était fermée.
Carte d'identité {id}, passeport {id}.
Son permis de conduire n° {id} est périmé.
Numéro fiscal {id} ; numéro de sécurité sociale {id}.
L'assuré {name} (n° {id}) a été remboursé.
Écrire à {mail} ou appeler le {phone}.
Téléphone {phone}, portable {phone}
On peut joindre {name} au {phone}.
Facture n° {invoice} de la société {firm}.
Le compte {account} est débiteur de {money} euros.
La commande {group} et le colis {lot} sont perdus.
Conteneur {box} reçu après {n} jours.
Arrêt {fam} c. {fam}, point {n}
Article {n} de la loi du {date} sur les {noun}.
Cour d'appel de {town}, {n} mars {year}
La société {firm} a vendu {n} {noun} à {town}.
Prix : {money} francs pour {n},{n} mètres.
Fait à {town}, le {date}.
""".strip().split("\n")

_GIVEN = "Agnete Bertil Clovis Dorrit Eskil Fabienne Gunvor Hedwig Isolde Jarmila Kasimir Ludmila Mirek Noémie Ottokar Pernille Quirin Roswitha Sigrid Théo Ulrika Valérie Wenzel Xaver Yvette Zdenka".split()
_GIVEN_SET = frozenset(g.lower() for g in _GIVEN)
_A = "Bram Dolt Fenn Gaver Hult Ivers Klem Lomb Mard Nyst Ost Parv Rond Selk Trev Urd Walt".split()
_B = "berg sen mann aud ier quin lund ström ridge ley ova ić".split()
_T = "bury field wick stetten bach ville port heim cester brück".split()
_PLAIN = "table window paper garden bridge offer ticket harvest engine letter kitchen carpet".split()
_NOUNS = "Ziegel Glas Kohle Holz Ware Kiste Frist Kran Schuppen Pacht Anzeige Zugang Vertrag Mangel Antrag Termin Garten Brücke".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def num(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def fam(self) -> str:
        f = self.r.choice(_A) + self.r.choice(_B)
        x = self.r.random()
        if x < 0.12:
            f += "-" + self.r.choice(_A) + self.r.choice(_B)
        elif x < 0.2:
            f = "O'" + f
        return f

    def given(self) -> str:
        """Mostly one of the list; now and then one that no list has."""
        r = self.r
        return r.choice(_GIVEN) if r.random() > 0.06 else r.choice(_A) + r.choice(("a", "o", "is", "elle"))

    def name(self) -> str:
        r, f, g = self.r, self.fam(), self.given()
        if r.random() < 0.12:
            f = r.choice(("van ", "von ", "de ", "di ", "du ", "van der ", "de la ", "dos ", "al ")) + f
        elif r.random() < 0.1:
            f += " " + r.choice(("", "", "y ", "de ")).replace("y ", "") + self.fam()
        if r.random() < 0.1:
            g += " " + self.given()
        x = r.random()
        if x < 0.12:
            return f.upper() + ", " + g
        if x < 0.15:
            return f + ", " + g
        if x < 0.27:
            return g + " " + f.upper()
        if x < 0.42:
            return g[0] + ". " + f
        if x < 0.54:
            return g + " " + r.choice("ABCDEH") + ". " + f
        if x < 0.57:
            return g[0] + ". " + r.choice("ABCDEH") + ". " + r.choice(("", "", "K. ")) + f
        return g + " " + f

    def town(self) -> str:
        return self.r.choice(_A) + self.r.choice(_T)

    def firm(self) -> str:
        r = self.r
        base = r.choice((self.fam() + " & " + self.fam(), self.fam() + " " + r.choice("Trading Brewery Transport Mining Paper Steel Textil Foods Bau Media".split()), self.fam(), r.choice(_GIVEN) + " " + self.fam()))
        return base + r.choice((" Ltd", " GmbH", " plc", " ltd", " LLP", " plc", " AG", " SA", " & Sons Ltd", " Co-operative", " Inc", " SARL", " KG", " BV"))

    def mail(self) -> str:
        r = self.r
        a = r.choice((r.choice(_GIVEN).lower() + r.choice("._-") + self.fam().lower().replace("'", ""), self.fam().lower().replace("'", "") + self.num(2), r.choice(_A).lower() + "+office"))
        d = [r.choice(_A).lower() + r.choice(_T).replace("ü", "u"), r.choice(("example", "test", "invalid"))]
        a = a.encode("ascii", "ignore").decode()
        at, dot = r.choice((("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" AT ", " DOT "), (" @ ", ".")))
        m = a + at + dot.join(d)
        return m.upper() if at == "@" and r.random() < 0.1 else m

    def groups(self, sizes: list[int], marks: str) -> str:
        return self.r.choice(marks).join(self.num(n) for n in sizes)

    def phone(self) -> str:
        """A prefix of some kind and groups of two to four digits, or all digits in one."""
        r = self.r
        cc = "+" + self.num(r.randint(1, 3))
        sizes = r.choice(([3, 4], [3, 3, 4], [3, 3, 2, 2], [2, 2, 2, 2], [3, 2, 2, 2, 2], [4, 4], [3, 7], [4, 3, 4], [3, 3, 3]))
        body = self.groups(sizes, "    .-" if r.random() < 0.8 else " ")
        return r.choice((f"{cc} {body}", f"{cc} (0){body}", f"({self.num(3)}) {body}", f"0{self.num(3)}/{body}", f"0{self.num(2)} {body}", f"0{self.num(3)} {body}", f"0{self.num(3)}-{body}", f"00{self.num(r.randint(9, 13))}", f"{cc}{self.num(r.randint(8, 10))}", f"0{self.num(r.randint(8, 10))}", self.groups([3, 3, 4], ".-"), self.groups([3, 2, 2, 2, 2], " ")))

    def id(self) -> str:
        """Digits with letters before, after or around, in groups or in one."""
        r = self.r
        letter = lambda: r.choice("ABCDEGHKLMNPRTWXYZ")
        sizes = [r.choice((2, 3, 4, 4, 5)) for _ in range(r.randint(2, 4))]
        plain = self.num(r.randint(7, 12))
        return r.choice((self.groups(sizes, " ./-"), plain, letter() + plain[:9], letter() + letter() + plain[:8], plain[:8] + letter(), letter() + plain[:8] + letter(), letter() + letter() + " " + self.groups([2, 2, 2], " ") + " " + letter(), self.groups([6, 4], "-/"), self.groups([3, 4, 4, 2], "."), self.groups([4, 4, 4], " "), self.groups([2, 3, 5], "/ ")))

    def street(self) -> str:
        r = self.r
        way = r.choice("Road Lane Street Close Avenue Terrace Crescent Hill Drive Gardens Place Row Square Walk Mews Grove".split())
        s = r.choice((r.choice(_A) + r.choice(("moor", "croft", "ing", "")) + " " + way, r.choice(("Old", "New", "Upper", "Lower", "North")) + " " + r.choice(_A) + " " + way, "St " + r.choice(_A) + "'s " + way, r.choice(("Upper ", "")) + r.choice(_A) + "gate", r.choice(_A) + "er's " + way, "High Street", r.choice(_A) + " " + r.choice(_A) + " " + way))
        return self.house() + " " + s

    def house(self) -> str:
        return str(self.r.randint(1, 199)) + self.r.choice(("", "", "", "", "a", "b", "c"))

    def strasse(self) -> str:
        r = self.r
        s = r.choice((r.choice(_A) + r.choice(("straße", "str.", "allee", "weg", "gasse", "ring", "platz", "damm")), r.choice(_A) + "er " + r.choice(("Weg", "Straße", "Platz", "Allee")), r.choice(("Am ", "An der ", "Kleine ", "Alte ", "Untere ")) + r.choice(_A) + r.choice(("gasse", "markt", "weg")), r.choice(_A) + "-" + r.choice(_A) + "-Straße"))
        return s + " " + self.house()

    def rue(self) -> str:
        r = self.r
        number = self.house() + (" bis" if r.random() < 0.1 else "")
        way = r.choice("rue avenue chemin quai impasse place boulevard allée".split())
        way = way.title() if r.random() < 0.15 else way
        s = way + " " + r.choice(("des ", "du ", "de la ", "de ", "de l'", "")) + r.choice((r.choice(_A) + "iers", r.choice(_A) + "e-" + r.choice(_A), r.choice(_A) + "oir", r.choice(_A) + " " + r.choice(_A), r.choice(_A) + "-sur-" + r.choice(_A)))
        return number + r.choice((", ", ", ", " ")) + s

    def loud(self) -> str:
        return " ".join(self.r.choice("in winter the river of stones was low and every farmer knew that no boat could pass under it after noon nor carry grain for sale".split()) for _ in range(self.r.randint(3, 9)))

    def other(self, what: str) -> str:
        r, n = self.r, self.num
        month = r.choice("January March May July August October December".split())
        return {
            "fam": self.fam, "town": self.town, "firm": self.firm, "given": lambda: r.choice(_GIVEN), "letter": lambda: r.choice("ABCDEFGHKLMNOPRSTVWX"), "given2": lambda: r.choice(_GIVEN),
            "thing": lambda: r.choice(_PLAIN), "noun": lambda: r.choice("tables portes caisses fenêtres livres".split()), "mr": lambda: r.choice("Mr Ms Dr Mrs Prof".split()), "mrd": lambda: r.choice("Herr Frau Dr. Richterin Herrn".split()).replace("Herrn", "Herr"), "mrf": lambda: r.choice("Mme Mlle Madame Monsieur Me".split()),
            "date": lambda: r.choice((f"{r.randint(1, 28)} {month} {r.randint(1990, 2024)}", f"{r.randint(1990, 2024)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.0{r.randint(1, 9)}.{r.randint(1990, 2024)}", f"{r.randint(1, 28)}. März {r.randint(1990, 2024)}", f"{r.randint(1, 28)} mars {r.randint(1990, 2024)}")),
            "zip": lambda: n(r.choice((4, 5))), "account": lambda: f"{n(4)} {n(4)} {n(4)}", "n": lambda: str(r.randint(1, 300)), "invoice": lambda: f"{n(4)}-{n(6)}",
            "money": lambda: r.choice((f"{n(3)},{n(3)}.{n(2)}", f"{n(3)}.{n(3)},{n(2)}", f"{n(3)} {n(3)},{n(2)}", f"{n(1)}.{n(3)},{n(2)}")), "box": lambda: "".join(r.choice("ABCEKLMNRST") for _ in range(3)) + "U " + n(7), "year": lambda: str(r.randint(1950, 2024)), "series": lambda: "".join(r.choice("ABCEKLQRT") for _ in range(3)),
            "LOUD": lambda: self.loud().upper() + ".", "Loud": lambda: self.loud().title(), "Noun": lambda: r.choice(_NOUNS),
            "lot": lambda: f"{n(3)}/{n(4)}", "time": lambda: f"{n(2)}:{n(2)}", "group": lambda: f"{n(3)} {n(3)} {n(3)}", "folio": lambda: f"{n(4)}.{n(3)}", "meter": lambda: n(6),
        }[what]()


_KIND = {"name": 0, "mail": 1, "phone": 2, "id": 3, "street": 4, "strasse": 4, "rue": 4}


def labelled(n: int, seed: int, frames: list[str] = FRAMES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` texts of one to two sentences, with ``(begin, end, kind)`` of their entities."""
    make, out = _Maker(seed), []
    for k in range(n):
        text, spans = "", []
        if make.r.random() < 0.5 and out:
            text = make.r.choice(("That is all. ", "3. ", "(4) ", "[5] ", "12  ", "Mehr nicht. ", "C'est tout. "))
        for part in re.split(r"(\{\w+\})", frames[k % len(frames)]):
            if part[:1] != "{":
                text += part
            elif (what := part[1:-1]) in _KIND:
                value = getattr(make, what)()
                spans.append((len(text), len(text) + len(value), _KIND[what]))
                text += value
            else:
                text += make.other(what)
        out.append((text, spans))
    return out


def _chunks(text: str, spans: list[tuple[int, int, int]], words: pii.Words) -> list[tuple]:
    """The chunks of a labelled text with the features of their segments and which segments are right."""
    flat, out = pii.flattened(text), []
    for a, z in pii.chunks(flat):
        chunk, after = flat[a:z], pii.follow_of(flat[z : z + 24])
        own, tokens, form = words.tokens(chunk, after)
        before = words.left(pii.left_of(flat, a))
        right = {(x - a, y - a, k) for x, y, k in spans}
        segs = []
        for seg in pii.segments(tokens, form):
            where = (*pii.span(own, seg, chunk), seg[2])
            segs.append((seg, pii.features(seg, tokens, before, form, after, _GIVEN_SET), where in right))
        if segs:
            out.append((len(tokens), segs))
    return out


def _gradient(n: int, segs: list[tuple], weights: dict[str, float]) -> dict[str, float]:
    """Of the conditional log-likelihood of a chunk's right segments: observed less expected feature counts."""
    scores = [sum([weights.get(f, 0.0) for f in fs]) for _, fs, _ in segs]
    ends, starts = defaultdict(list), defaultdict(list)
    for k, (seg, _, _) in enumerate(segs):
        ends[seg[1]].append(k)
        starts[seg[0]].append(k)

    def log_sum(xs: list[float]) -> float:
        top = max(xs)
        return top + math.log(sum([math.exp(x - top) for x in xs]))

    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = log_sum([alpha[j - 1], *(alpha[segs[k][0][0]] + scores[k] for k in ends[j])])
    for i in range(n - 1, -1, -1):
        beta[i] = log_sum([beta[i + 1], *(beta[segs[k][0][1]] + scores[k] for k in starts[i])])
    out: dict[str, float] = defaultdict(float)
    for k, (seg, fs, right) in enumerate(segs):
        d = right - math.exp(alpha[seg[0]] + scores[k] + beta[seg[1]] - alpha[n])
        if abs(d) > 1e-4:
            for f in fs:
                out[f] += d
    return out


@lru_cache(1)
def trained() -> dict[str, float]:
    """The weights."""
    words = pii.Words(_GIVEN_SET)
    data = [c for text, spans in labelled(SENTENCES, SEED) for c in _chunks(text, spans, words)]
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    order = random.Random(SEED)
    for _ in range(EPOCHS):
        order.shuffle(data)
        for n, segs in data:
            for f, g in _gradient(n, segs, weights).items():
                g -= L2 * weights[f]
                squares[f] += g * g
                weights[f] += RATE * g / math.sqrt(squares[f])
    return {f: round(w, 4) for f, w in weights.items() if abs(w) > 1e-3}
