"""Personal information in free text, replaced by typed placeholders (problem 9).

A semi-Markov conditional random field labels spans, not words. The text is cut into *chunks*: maximal runs of capitalised
words, initials, name particles, street words, numbers and addresses of e-mail, with at most one separator between two of
them; everything else can't begin or end an entity and only serves as context. Over the tokens of a chunk every segment of
bounded length that an entity of some type could have is scored by features of the whole span (its pattern of word
classes, its digits' shape, its length, the words before and after it), and dynamic programming finds the set of
segments with the highest joint score, so boundaries and types are chosen together. A segment's score competes with that
of leaving its tokens out, which is 0. The weights maximise the conditional likelihood of labelled sentences
(:mod:`catalens.llm.pii_train`), with the same recursion in sums.

Scale: one pass over the texts, no shuffle of texts. Digits are made alike before decoding, and a chunk with its context is
decoded once per task and remembered, so the work follows the number of different contexts. The given names that the
corpus itself shows (:func:`given_names`) are counted over all documents, once; a name must be seen three times, however
large the corpus. A span of a name holds any number of given names, initials, particles and family names that nine tokens
have room for, in any script with capitals. The list is sent to every task if it has at most ``BROADCAST_ROWS``
names; beyond that each text gets the names among its words by a shuffle of words, not of texts' chunks.

Null or empty texts give no entities; null ids are left out of :func:`found`. Very long texts are taken whole; chunks of any
length are decoded in time linear in their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import BROADCAST_ROWS, small, spread, written

KINDS = ("name", "email", "phone", "id_number", "address")
PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}
MOST_TOKENS = 9

# Word lists of the features, in lower case: general vocabulary of English, German and French.
TITLES = "mr mrs ms miss mx dr prof professor judge justice sir lady lord dame advocate notary herr frau richter richterin rechtsanwalt rechtsanwältin notar notarin m mme mlle me monsieur madame maître juge"
FIRMS = "ltd limited llp lp plc inc incorporated corp corporation co company companies gmbh ag kg kgaa ohg ug se sa sas sarl sàrl snc cie bv nv oy ab as aps spa srl co-operative cooperative genossenschaft coopérative holding holdings group gruppe groupe partners sons söhne fils bank banque trust foundation stiftung & et"
LEGAL = "act acts rules rule regulation regulations order ordinance statute code directive charter treaty court courts tribunal chamber chambers section article case law reports rep gericht landgericht amtsgericht oberlandesgericht arbeitsgericht verwaltungsgericht kammer senat gesetz verordnung cour chambre conseil loi règlement arrêté v vs"
PARTICLES = "van von de der den di du da dos la le del della ten ter zu af av bin ibn al el"
STREET_AFTER = "road lane street close row walk terrace avenue hill crescent place square way drive gardens mews quay green gate parade rise grove yard court view park wharf boulevard alley circus"
STREET_BEFORE = "rue avenue quai chemin impasse place boulevard allée cours route passage ruelle sentier square faubourg esplanade"
STREET_TAIL = ("straße", "strasse", "str.", "gasse", "allee", "weg", "ring", "platz", "ufer", "damm", "steig", "markt", "gate", "chaussee", "pfad", "graben", "stieg", "zeile")
MONTHS = "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre"
ID_WORDS = r"passport|identity|\bid\b|licen[cs]e|\btax|insurance (?:no|number|record)|social|\bssn\b|national (?:no|number|insurance)|ausweis|reisepass|\bpass\b|pass-?n[ru]|führerschein|steuer|sozialversicherung|rentenversicherung|versicherten|identité|passeport|permis|fiscal|sécurité|assuré|\bahv\b|\bnir\b"
OTHER_WORDS = r"account|konto|compte|\biban\b|\blots?\b|batch|charge|shipment|consignment|sendung|colis|parcel|order|bestell|commande|contract|vertrag|contrat|policy|police|folio|grundbuch|invoice|rechnung|facture|receipt|quittung|container|conteneur|meter|mètre|kilo|\bkm\b|\bsum|amount|price|betrag|preis|somme|montant|euro|dollar|pound|franc|kron|crown|couronne|case|docket|register|aktenzeichen|\baz\b|\brg\b|exhibit|anlage|annexe|pièce|section|rule|article|artikel|page|seite|\brn\b|randn|ziffer|considérant|paragraph|§|\babs|degree|grad|percent|prozent|pour cent|days|tage|jours|months|monat|mois"
PHONE_WORDS = r"\btel|tél|\bcall|dial|mobile|landline|phone|\brang|\bring|reached|reachable|erreich|joignable|handy|rückruf|anruf|appel[eé]|\bfax|mobil|portable|durchwahl"
NEAR_NAMES = "by for to with between against from von für mit gegen durch an par pour avec contre entre à and und et or oder ou that dass que"
PEOPLE = r"witness|zeug|témoin|signed|gez|signé|claimant|plaintiff|applicant|petitioner|appellant|respondent|defendant|kläger|beklagte|antragsteller|demande|défende|requérant|appelant|intimé|owner|tenant|buyer|seller|eigentümer|mieter|käufer|verkäufer|propriétaire|locataire|counsel|solicitor|anwalt|anwältin|avocat|son|daughter|wife|husband|sohn|tochter|fils|fille|épou|before|present|contact|according|angaben|selon"
PLACE_WORDS = r"ship|vessel|boat|yacht|ferry|schiff|fähre|bateau|navire|town|city|village|port|harbour|stadt|gemeinde|hafen|ville|commune|in|at|near|the|of|im|der|die|das|dans|le|la|les"
CURRENCIES = r"euros?|dollars?|pounds?|francs?|franken|crowns|kronen|couronnes|eur|usd|gbp|chf"
ROLES = r"claimant|plaintiff|applicant|petitioner|appellant|respondent|defendant|kläger(?:in)?|beklagter?|antragsteller(?:in)?|antragsgegner(?:in)?|demandeur|demanderesse|défendeur|défenderesse|requérante?|appelante?|intimée?"
OFFICES = r"registrar|clerk|judge|president|secretary|greffière?|juge|présidente?|richter(?:in)?|vorsitzende[r]?|urkundsbeamt\w+|sitting"

_SETS = {
    "T": set(TITLES.split()), "C": set(FIRMS.split()), "L": set(LEGAL.split()), "P": set(PARTICLES.split()),
    "near": set(NEAR_NAMES.split()), "S": set(STREET_AFTER.split()), "R": set(STREET_BEFORE.split()), "M": set(MONTHS.split()),
}


def _ranges(chars: list[str]) -> str:
    """Characters as the inside of a character class."""
    out, at = [], 0
    while at < len(chars):
        z = at
        while z + 1 < len(chars) and ord(chars[z + 1]) == ord(chars[z]) + 1:
            z += 1
        out.append(chars[at] if z == at else f"{chars[at]}-{chars[z]}")
        at = z + 1
    return "".join(out)


#: The capitals of all scripts that have them.
_UP, _LO = _ranges([c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Lu"]), r"\w"
_NUMBER = r"\+?(?:\(0{1,6}\)|0+)(?:[./-]?(?:\(0{1,6}\)|0+))*(?:[A-Za-z](?![\w]))?"
_MAIL = r"[A-Za-z0-9](?:[\w.+'-]*\w)? ?(?:@|\(at\)|\[at\]|\{at\}|(?<= )AT(?= )) ?\w[\w-]*(?:(?:\.| ?\(dot\) ?|\[dot\]| DOT )\w[\w-]*)+"
_WORD = rf"[{_UP}](?:\.(?:-?[{_UP}]\.)*|[{_LO}]*(?:['’-][{_LO}]+)*(?:(?<=[Ss]tr)\.)?)"
_SMALL = r"(?:van|von|de|der|den|di|du|da|dos|des|la|le|les|l['’]|d['’]|della|del|ten|ter|zu|af|av|bin|ibn|al|el|rue|avenue|quai|chemin|impasse|place|boulevard|allée|cours|route|passage|ruelle|sentier|square|faubourg|esplanade|bis|quater)(?![\w])"
_SEPARATOR = r"(?:, ?|[ \u00a0\u202f](?:\((?!0+\)))?|(?<=['’]))"
_MORE = rf"(?:{_SEPARATOR}(?:{_NUMBER}|{_WORD}|{_SMALL}|&))"
_GROUPS = r"(?:[./-]?(?:\(0{1,6}\)|0+))*(?:[A-Za-z](?!\w))?"
# The first character is a class of its own, so that the search skips all others; then two words at least, or a
# number.
_CHUNK = re.compile(
    rf"[{_UP}0+(vd](?<![\w*].)(?:"
    rf"(?<=[{_UP}])[A-Z]{{0,2}}0\w*+{_MORE}*|(?<=[{_UP}])(?:\.(?:-?[{_UP}]\.)*+|\w*+(?:['’-]\w++)*+(?:(?<=[Ss]tr)\.)?+){_MORE}+"
    rf"|(?<=0)0*+{_GROUPS}{_MORE}*|(?<=\+)(?:\(0{{1,6}}\)|0+){_GROUPS}{_MORE}*|(?<=\()0{{1,6}}\){_GROUPS}{_MORE}*"
    rf"|(?<=[vd])(?:an|on|er|en|os|e|i|u|a)(?!\w){_MORE}+)"
)
_MAIL_SIGN = re.compile(r"@|\(at\)|\[at\]|\{at\}| AT ")
_MAIL_ONLY = re.compile(rf"(?<![\w*]){_MAIL}")
_TOKEN = re.compile(rf"({_MAIL})|({_NUMBER})|({_WORD})|({_SMALL})|(&)")
_CONTEXT = {"id": re.compile(ID_WORDS), "other": re.compile(OTHER_WORDS), "phone": re.compile(PHONE_WORDS)}
_LAST_WORD = re.compile(r"([^\W\d_]+)[^\w]*$")
#: What goes on in French after a name.
_PEOPLE = re.compile(PEOPLE)
_FRENCH = re.compile(r"\b(?:est|était|né|née|et|qui|que|le|la|les|du|des|demeur\w*|domicil\w*|titul\w*|soutien\w*|a \w+)")


def word_class(word: str, given: frozenset[str]) -> str:
    """One letter: T title, C firm, L law, P particle, S/R street, M month, I initial, J several initials, G given name,
    A capitals, N number, E e-mail, B number's addition, K letters with digits or a
    letter by itself, W other word."""
    low = word.lower()
    if "@" in word or re.search(r"\(at\)|\[at\]|\{at\}| AT ", word):
        return "E"
    if word[0] in "+(0" and "0" in word:
        return "N"
    if low in ("bis", "quater"):
        return "B"
    if len(word) == 1:
        return "K"
    bare = low.rstrip(".")
    if bare in _SETS["T"] and (len(bare) > 1 or word == "M."):
        return "T"
    if re.fullmatch(rf"[{_UP}]\.", word):
        return "I"
    if re.fullmatch(rf"(?:[{_UP}]\.-?)+", word):
        return "J"
    for k in "CLM":
        if low in _SETS[k]:
            return k
    if low in given:
        return "G"
    if low in _SETS["R"] and (not word[0].isupper() or low not in _SETS["S"] and word.upper() != word):
        return "R"
    if low in _SETS["P"] or low in ("des", "les", "l'", "l’", "d'", "d’"):
        return "P" if not word[0].isupper() or word.isupper() and len(word) > 1 else "W"
    if low in _SETS["S"] or low.endswith(STREET_TAIL):
        return "S"
    if any(c == "0" for c in word):
        return "K"
    if len(word) > 1 and word.upper() == word and any(c.isalpha() for c in word):
        return "A"
    return "W"


def shape(text: str) -> str:
    """Of a number the digits as 0, capitals as A, other letters as a, kinds of blanks as one."""
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text.replace("\u00a0", " ").replace("\u202f", " ")))


#: Given names, initials, particles and family names, any number of each that a name may have; or the family name first.
_NAME = re.compile(r"[GWAIJ][GWAIJ]{0,3}(?:P{0,3}[WAG]){1,2}|P{1,3}[WAG]{1,2},[GI][GIJW]{0,2}|[WAG]{1,2},[GI][GIJW]{0,2}")
_DIGITS = re.compile(r"[NKABI]+")
_ADDRESS = re.compile(r"NB?,?[RS][PSWAGKLC]*|NB?[SWGALC]{1,4}|[SWGA]{1,3}NB?")


_HOUSE = re.compile(r"0{1,4}[A-Za-z]?(?:[-/]0{1,4}[a-z]?)?")


def segments(tokens: list[tuple[int, int, str]], chunk: str) -> list[tuple[int, int, int]]:
    """``(first, last + 1, kind)`` of all spans that could be an entity of some kind, by their classes alone."""
    out, n = [], len(tokens)
    commas = ["," in chunk[tokens[k][1] : tokens[k + 1][0]] for k in range(n - 1)]
    opens = ["(" in chunk[tokens[k][1] : tokens[k + 1][0]] for k in range(n - 1)]
    for i in range(n):
        text, digits = "", 0
        for j in range(i, min(n, i + MOST_TOKENS)):
            c = tokens[j][2]
            if j > i:
                if opens[j - 1]:
                    break
                text += "," * commas[j - 1]
            text += c
            if c == "E":
                if j == i:
                    out.append((i, j + 1, 1))
                break
            digits += chunk.count("0", tokens[j][0], tokens[j][1])
            if _NAME.fullmatch(text):
                out.append((i, j + 1, 0))
            if digits >= 6 and "," not in text and _DIGITS.fullmatch(text) and j - i < 6:
                out.append((i, j + 1, 3))
                if text.strip("N") == "":
                    out.append((i, j + 1, 2))
            if "N" in text and _ADDRESS.fullmatch(text) and all(_HOUSE.fullmatch(chunk, *tokens[x][:2]) for x in range(i, j + 1) if tokens[x][2] == "N"):
                out.append((i, j + 1, 4))
    return out


def _before(left: str) -> tuple[str, str]:
    m = _LAST_WORD.search(left)
    word = m[1].lower() if m else ""
    return word, left.rstrip(" ")[-1:]


def _nearest(left: str) -> str:
    best, at = "none", -1
    for name, pattern in _CONTEXT.items():
        for m in pattern.finditer(left):
            if m.end() > at:
                best, at = name, m.end()
    return best


def _word_kind(word: str, given: frozenset[str]) -> str:
    if not word:
        return "-"
    for k in "TCLPSRM":
        if word in _SETS[k]:
            return k
    if word in _SETS["near"] or _PEOPLE.match(word):
        return "n"
    return "p" if re.fullmatch(PLACE_WORDS, word) else "w"


def features(seg: tuple[int, int, int], tokens: list[tuple[int, int, str]], before: str, chunk: str, after: str, given: frozenset[str]) -> list[str]:
    """Features of a whole span of a kind."""
    i, j, kind = seg
    a, z = span(tokens, seg, chunk)
    k = KINDS[kind][0]
    text = chunk[a:z]
    classes = "".join(("," if x > i and "," in chunk[tokens[x - 1][1] : tokens[x][0]] else "") + tokens[x][2] for x in range(i, j))
    left = (before + chunk[:a])[-48:]
    word, mark = _before(left)
    follow = (chunk[z:] + after)[:24]
    next_class = tokens[j][2] if j < len(tokens) else "-"
    prev_class = tokens[i - 1][2] if i else "-"
    gap = chunk[z : tokens[j][0]] if j < len(tokens) else ""
    prev_gap = chunk[tokens[i - 1][1] : a] if i else ""
    out = [k, k + ":len" + str(min(j - i, 6))]
    if kind == 0:
        out += [f"{k}:c{classes}", f"{k}:p{prev_class if prev_gap == ' ' else '-'}", f"{k}:n{next_class if gap == ' ' else '-'}", f"{k}:w{_word_kind(word, given) if not i or prev_gap != ' ' else '='}"]
        known = any(tokens[x][2] in "GI" for x in range(i, j))
        out.append(f"{k}:known{known}:{prev_class if prev_gap == ' ' else '-'}{next_class if gap == ' ' else '-'}")
        out.append(f"{k}:f{known}:{'role' if _ROLE.match(follow.lower()) else '-'}")
        first = next((x for x in range(i, j) if tokens[x][2] in "GI"), None)
        out.append(f"{k}:lead{'-' if first is None else first - i}")
        if first is not None and "," not in classes:
            last = max(x for x in range(i, j) if tokens[x][2] in "GIJ")
            out.append(f"{k}:family{j - 1 - last - sum(tokens[x][2] == 'P' for x in range(last, j))}:{next_class if gap == ' ' else '-'}")
        out.append(f"{k}:firm{_FIRM.match(follow.lower()) is not None or next_class == 'C' and gap == ' '}:{known}")
        if tokens[i][2] == "P":
            out.append(f"{k}:particle{text[0].isupper()}{tokens[i + 1][2]}")
        if i and prev_gap != " " and "," in prev_gap and not known:
            out.append(f"{k}:commaprev")
        if "," in classes:
            first = text.split(",")[0]
            out.append(f"{k}:rev{first.upper() == first}{known}")
        if not known and len(classes) == 2:
            out.append(f"{k}:unknown{mark in ':(' and mark != ''}{_word_kind(word, given)}")
    elif kind == 1:
        out.append(f"{k}:mail")
    elif kind in (2, 3):
        s = shape(text)
        near = _nearest(left.lower())
        digits = text.count("0")
        out += [f"{k}:near:{near}", f"{k}:s{s}", f"{k}:{near}:d{min(digits, 16)}", f"{k}:prev{prev_class if prev_gap in (' ', chr(160)) else '-'}", f"{k}:next{next_class if gap in (' ', chr(160)) else '-'}", f"{k}:plus{text[0] in '+(' or text.startswith('00')}:{near}"]
        out.append(f"{k}:{near}:more{(next_class in 'NKA' and gap in (' ', chr(160))) or (prev_class in 'NKA' and prev_gap in (' ', chr(160)))}")
        out.append(f"{k}:money{bool(_MONEY.match(follow.lower()))}")
    else:
        number = next(chunk[tokens[x][0] : tokens[x][1]] for x in range(i, j) if tokens[x][2] == "N")
        plain = re.fullmatch(r"0{1,3}[a-z]?", number) is not None
        order = "before" if tokens[i][2] == "N" else "after"
        street = any(tokens[x][2] in "SR" for x in range(i, j))
        ends = tokens[j - 1][2] if order == "before" else tokens[j - 2][2]
        out += [f"{k}:{order}:plain{plain}", f"{k}:{order}:street{street}:{plain}", f"{k}:{order}:ends{ends}:{street}", f"{k}:{order}:next{next_class if gap == ' ' else '-'}", f"{k}:{order}:prev{prev_class if prev_gap == ' ' else '-'}", f"{k}:{order}:R{'R' in classes}"]
        out += [f"{k}:{order}:w{word if word in _AT else '-'}:{street}", f"{k}:month{'M' in classes or next_class == 'M' and gap == ' '}", f"{k}:{order}:legal{any(c in classes for c in 'LC')}:{street}", f"{k}:{order}:more{next_class in 'SW' and gap == ' '}:{street}"]
    return out


_MEANT = re.compile("|".join((ID_WORDS, OTHER_WORDS, PHONE_WORDS)))
_AT = frozenset("at of from to nach in der wohnhaft bei demeurant au sis address adresse anschrift house".split())
_KEPT = re.compile(rf"(?:{PEOPLE}).*|{PLACE_WORDS}|{'|'.join(sorted(_AT))}")
_ROLE = re.compile(rf" \((?:{ROLES})|, (?:{ROLES}|{OFFICES})")
_FIRM = re.compile(rf" (?:{'|'.join(w for w in FIRMS.split() if w[0] not in '&as' or len(w) > 2)})\b")
_MONEY = re.compile(rf"[.,]0| (?:{CURRENCIES})\b")
_FOLLOW = re.compile(rf" \((?:{ROLES})|, (?:{ROLES}|{OFFICES})|{_FIRM.pattern}|[.,]0| (?:{CURRENCIES})\b|.{{0,4}}?{_FRENCH.pattern}", re.I)


class Words:
    """The classes of words and the form that stands for each: words of one class that no feature looks at are alike, so
    that chunks that differ in names and digits only are decoded once."""

    def __init__(self, given: frozenset[str]):
        self.given = given
        self.known: dict[str, tuple[str, str]] = {}

    def __call__(self, word: str) -> tuple[str, str]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[word] = self._make(word)
        return got

    def _make(self, word: str) -> tuple[str, str]:
        c = word_class(word, self.given)
        return c, self._form(word, c)

    def _form(self, word: str, c: str) -> str:
        low = word.lower()
        if c == "E":
            return "x@x"
        if c in "NK":
            return shape(word)
        if c in "IJ":
            return "I." * (1 + (c == "J"))
        if _MEANT.search(low) or any(low in s for s in _SETS.values()) or _KEPT.fullmatch(low) or c in "TP":
            return word
        if c == "A":
            return "A" * min(len(word), 5)
        return {"G": "Gg", "W": "Ww", "S": "Ssgasse"}.get(c, word) + "'s" * low.endswith(("'s", "’s"))

    def tokens(self, chunk: str, after: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], str]:
        """``(begin, end, class)`` of the words of a chunk, the same in the form that stands for it, and that form. ``M.``
        is a title before a given name, and before an initial where the text goes on in French."""
        own, like, parts, at = [], [], [], 0
        for m in _TOKEN.finditer(chunk):
            a, z = m.span()
            c, form = self(m[0])
            parts += [chunk[at:a], form]
            own.append((a, z, c))
            at = z
        for k, (a, z, c) in enumerate(own):
            then = own[k + 1][2] if k + 1 < len(own) else ""
            number = then == "N" and own[k + 1][0] == z + 1
            if c in "CTLP" and z - a == 2 and chunk[a:z].isupper() and number:
                new = "A"  # letters before a number
            elif c in "IT" and chunk[a:z] == "M.":
                new = "T" if then == "G" or then == "I" and _FRENCH.search(chunk[z:] + after) else "I"
            elif c == "S" and not number and all(x[2] != "N" for x in own[max(0, k - 4) : k]):
                new = "A" if chunk[a:z].isupper() else "W"  # no house number near: a name like that of a street
            else:
                continue
            own[k] = (a, z, new)
            parts[2 * k + 1] = self._form(chunk[a:z], new)
        at = 0
        for k, (_, _, c) in enumerate(own):  # forms may have changed in length
            at += len(parts[2 * k])
            like.append((at, at + len(parts[2 * k + 1]), c))
            at += len(parts[2 * k + 1])
        return own, like, "".join(parts)

    def left(self, before: str) -> str:
        """What the features see of the text before a chunk: the nearest word of a list, the last word, the last mark."""
        near = None
        for near in _MEANT.finditer(before.lower()):
            pass
        m = _LAST_WORD.search(before)
        if m is None:
            return (near[0] + " " if near else "") + before.rstrip(" ")[-1:]
        word = m[1].lower()
        if near and near.end() > m.start():
            return near[0] + before[m.end(1) :]
        return (near[0] + " - " if near else "") + (self(word)[1] if word not in self.given else "w") * 1 + before[m.end(1) :]


def span(tokens: list[tuple[int, int, str]], seg: tuple[int, int, int], chunk: str) -> tuple[int, int]:
    """The characters of a segment: without a possessive, and without the full stop after a number's last letter."""
    i, j, kind = seg
    a, z = tokens[i][0], tokens[j - 1][1]
    if kind == 0 and chunk[a:z].endswith(("'s", "’s")):
        z -= 2
    elif kind == 3 and chunk[z - 1] == ".":
        z -= 1
    return a, z


def best_segments(weights: dict[str, float], tokens: list[tuple[int, int, str]], before: str, chunk: str, after: str, given: frozenset[str]) -> list[tuple[int, int, int]]:
    """The highest-scoring set of segments of a chunk: ``(first, last + 1, kind)`` in its tokens."""
    ending: dict[int, list] = {}
    for seg in segments(tokens, chunk):
        score = sum([weights.get(f, 0.0) for f in features(seg, tokens, before, chunk, after, given)])
        if score > 0:
            ending.setdefault(seg[1], []).append((score, seg))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for score, seg in ending.get(j, ()):
            if best[seg[0]] + score > best[j]:
                best[j], back[j] = best[seg[0]] + score, seg
    out, j = [], len(tokens)
    while j > 0:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def left_of(flat: str, at: int) -> str:
    """What stands before a chunk in its sentence, at most 40 characters."""
    before = flat[max(0, at - 40) : at]
    cut = max(before.rfind(". "), before.rfind("\n"), before.rfind("; "))
    if cut >= 0 and not before[max(0, cut - 4) : cut].lower().endswith(("no", "nr", "tel", "tél", "rn", "abs")):
        return before[cut + 1 :]
    return before


def follow_of(text: str) -> str:
    """What the features see of the text after a chunk."""
    m = _FOLLOW.match(text)
    return m[0].lower() if m else ""


def flattened(text: str) -> str:
    """The text with all digits made 0; every character keeps its place."""
    for d in "123456789":
        text = text.replace(d, "0")
    return text


def chunks(flat: str) -> list[tuple[int, int]]:
    """Begin and end of all chunks of a flattened text: addresses of e-mail, found around their sign, and the runs outside
    them."""
    out = []
    signs = _MAIL_SIGN.finditer(flat) if any(x in flat for x in ("@", "(at)", "[at]", "{at}", " AT ")) else ()
    for m in signs:
        a = m.start() - (flat[m.start() - 1 : m.start()] == " ")
        while a and (flat[a - 1].isalnum() or flat[a - 1] in "_.+'-"):
            a -= 1
        for k in range(max(a, out[-1][1] if out else 0), m.start()):
            if (x := _MAIL_ONLY.match(flat, k)) and x.end() > m.start():
                out.append(x.span())
                break
    for a, z in out:
        flat = flat[:a] + "\0" * (z - a) + flat[z:]
    out += [m.span() for m in _CHUNK.finditer(flat)]
    return out


class _Memory(dict):
    """Results by key, emptied when there are many."""

    def keep(self, key, value):
        if len(self) > 100_000:
            self.clear()
        self[key] = value
        return value


class Decoder:
    """Decodes texts, remembering chunks in their contexts, in the form that stands for them."""

    def __init__(self, weights: dict[str, float], given: frozenset[str]):
        self.weights, self.given, self.words = weights, given, Words(given)
        self.known, self.lefts, self.chunks = _Memory(), _Memory(), _Memory()

    def _parsed(self, chunk: str, after: str) -> tuple | None:
        """Words and form of a chunk, or None if no span of it could be an entity."""
        own, like, form = self.words.tokens(chunk, after)
        return (own, like, form) if segments(like, form) else None

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """``(begin, end, kind)`` of all entities, in order."""
        flat, out, known, lefts, parses = flattened(text), [], self.known, self.lefts, self.chunks
        for a, z in chunks(flat):
            chunk, after = flat[a:z], None
            if "M." in chunk:
                after = follow_of(flat[z : z + 24])
                parsed = self._parsed(chunk, after)
            else:
                parsed = parses.get(chunk, 0)
                if parsed == 0:
                    parsed = parses.keep(chunk, self._parsed(chunk, ""))
            if parsed is None:
                continue
            own, like, form = parsed
            before = left_of(flat, a)
            left = lefts.get(before)
            if left is None:
                left = lefts.keep(before, self.words.left(before))
            key = (left, form, follow_of(flat[z : z + 24]) if after is None else after)
            got = known.get(key)
            if got is None:
                got = known.keep(key, best_segments(self.weights, like, *key, self.given))
            for seg in got:
                x, y = span(own, seg, chunk)
                out.append((a + x, a + y, seg[2]))
        return sorted(out)


_FORM = r"(?!(?i:%s)(?![\p{L}-]))" % "|".join(w for w in FIRMS.split() if w[0] not in "&")
_PERSON = rf"(\p{{Lu}}[\p{{L}}'’-]*)(?: \p{{Lu}}\.| {_FORM}\p{{Lu}}[\p{{L}}'’-]+){{0,2}}(?: (?:{'|'.join(PARTICLES.split())})){{0,2}} {_FORM}\p{{Lu}}[\p{{L}}'’-]+"
_PARTY_FIRST = rf"(?m)^(?i:{ROLES}) ?: {_PERSON}$"
_PARTY_LAST = rf"(?m)(?:^Before |\(signed\) |^){_PERSON}(?: \((?i:{ROLES})\)|, (?i:{ROLES}|{OFFICES})(?: \p{{L}}+)?)$"


def shown_names(docs: DataFrame) -> DataFrame:
    """``(w)``: the given names, in lower case, that the corpus shows in its parties, judges and signatures: first words of
    names that stand alone in such a place, three times at least. Counted over all documents."""
    words = docs.where("text is not null").select(F.explode(F.concat(*[F.regexp_extract_all("text", F.lit(p), 1) for p in (_PARTY_FIRST, _PARTY_LAST)])).alias("w"))
    drop = sorted(set().union(*_SETS.values(), PEOPLE.split("|")))
    return words.groupBy(F.lower("w").alias("w")).count().where("count >= 3").where(~F.col("w").isin(drop)).select("w")


def given_names(docs: DataFrame) -> frozenset[str]:
    """The names of :func:`shown_names` as a set."""
    return frozenset(r.w for r in shown_names(docs).collect())


_RUN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-])*")
_SMALL_LETTER = re.compile(rf"[^\W{_UP}]")


def name_keys(text: str, longest: int) -> set[str]:
    """All parts of a text's words that could be looked up as a name of up to ``longest`` characters, in lower case."""
    keys = set()
    for run in {m[0] for m in _RUN.finditer(flattened(text))}:
        low = [bool(_SMALL_LETTER.match(c)) for c in run]
        cuts = [0, *(i for i in range(1, len(run)) if not (low[i] and low[i - 1])), len(run)]
        for k, i in enumerate(cuts):
            for j in cuts[k + 1 :]:
                if j - i > longest:
                    break
                keys.add(run[i:j].lower())
    return keys


def _with_names(rows: DataFrame, docs: DataFrame, sent: int) -> tuple[DataFrame, frozenset[str] | None]:
    """The rows and the names for all of them, or, if there are more than ``sent``, the rows with ``given``, the names
    among their own words, and None."""
    names = written(shown_names(docs), "names")
    if small(names, sent):
        return rows, frozenset(r.w for r in names.collect())
    longest = names.agg(F.max(F.length("w"))).first()[0]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(h, w) for h, text in zip(b["h"], b["text"], strict=True) for w in name_keys(text, longest)]
            yield pd.DataFrame(out, columns=["h", "w"], dtype=object)

    key = F.sha2("text", 256)
    words = rows.where("text is not null").select(key.alias("h"), "text").mapInPandas(keys, "h string, w string").distinct()
    own = words.join(names, "w").groupBy("h").agg(F.collect_set("w").alias("given"))
    return rows.withColumn("h", key).join(own, "h", "left").drop("h"), None


def _decoders(weights: dict[str, float], given: frozenset[str] | None) -> Callable[[pd.DataFrame], Decoder]:
    """The decoder for a batch: one for all, or one that knows the names of the batch's texts."""
    if given is not None:
        decode = Decoder(weights, given)
        return lambda b: decode
    return lambda b: Decoder(weights, frozenset().union(*(x for x in b["given"] if x is not None)))


def _finder(weights: dict[str, float], given: frozenset[str] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoders(weights, given)
        for b in batches:
            decode = decoder(b)
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                out += [(doc_id, k, v) for k, v in sorted({(KINDS[k], text[a:z]) for a, z, k in decode(text)})]
            yield pd.DataFrame(out, columns=["doc_id", "pii_kind", "found_text"])

    return run


def _masker(weights: dict[str, float], given: frozenset[str] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoders(weights, given)
        for b in batches:
            decode = decoder(b)
            texts, counts = [], []
            for text in b["text"]:
                parts, at, spans = [], 0, decode(text) if text else []
                for a, z, k in spans:
                    parts += [text[at:a], PLACEHOLDER[KINDS[k]]]
                    at = z
                texts.append("".join([*parts, text[at:]]) if text else text)
                counts.append(len(spans))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "replaced": counts})

    return run


def found(docs: DataFrame, sent: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, pii_kind, found_text)``: each distinct value of each document, as it stands in the text."""
    from catalens.llm.pii_train import trained

    rows = spread(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text"))
    rows, given = _with_names(rows, docs, sent)
    return rows.mapInPandas(_finder(trained(), given), "doc_id long, pii_kind string, found_text string").distinct()


def masked(docs: DataFrame, sent: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, text, replaced)``: every document with placeholders for its entities, and how many there are."""
    from catalens.llm.pii_train import trained

    rows = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    rows, given = _with_names(rows, docs, sent)
    return rows.mapInPandas(_masker(trained(), given), "doc_id long, text string, replaced long")
