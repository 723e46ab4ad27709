"""Text that looks the same but is written differently, brought to one form (problem 4).

Three steps.

*Folding* needs no corpus: compatibility forms, ligatures, widths and kinds of blanks by NFKC, characters without
appearance removed, letters and accents composed.

*Script-aware repair* replaces look-alike letters, token by token (a token is a run of letters, accents and digits, cut
between a small letter and a capital after it). A token is suspect if its letters are of several scripts or of a Latin block
of look-alikes, or if it isn't Latin and every letter has a Latin shape, so that nothing in it shows its script. For each
suspect token the possible results are made: all look-alikes in the dominant script, that of most letters, then in the
others. One result replaces all suspect tokens of a look, the token with every look-alike in Latin: a result in the corpus
vocabulary, the tokens of all rows that aren't suspect, wins. Without any, if there are several spellings of the look (an
entry may be there in forged spellings only), it is the result that most of them lead to, then the Latin one. A single
spelling without a known result stays. A token that joins words of two scripts without a capital between them has no result
in one script; of its spellings, that with the fewest changes of script replaces the others.

*Classes.* Rows whose repaired volume and path are equal are a class. In a class every suspect token is repaired. The form
that is given out repairs tokens of one script only where the corpus holds another spelling of the whole (volume, path): a
Cyrillic word of letters with Latin shapes stays what it is in a path that nobody wrote otherwise. In a class of several
spellings all rows get the form, of those its members have, with the fewest changes of script, then that of most rows.
Letter case, accents and the difference between letters and digits are never changed.

Only rows with other than ASCII characters reach Python. Suspect tokens alone are joined with the vocabulary, on distinct
tokens, and repairs are sent to all tasks if a count shows few of them, else joined. Rows in ASCII are compared with the
classes of other rows only. Null volumes and paths stay null and differ from ''; rows without entry_id are left out. Empty
tables give no rows; very long texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from catalens.functions.tokens import is_ascii
from catalens.session import BROADCAST_ROWS, small, written

# Letters with the shape of a Latin letter, by script, each followed by that letter (after the table of
# confusable characters published with Unicode).
SHAPES = {
    "CYRILLIC": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX УY ҮY ԚQ ԜW ԌG ӀI аa еe ѕs іi јj оo рp сc уy үy хx һh ԁd ԛq ԝw ӏl ѵv",
    "GREEK": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC αa ιi κk νv οo ρp υu γy χx ϲc ϳj",
    "ARMENIAN": "ՍU ՏS ՕO ԼL ոn սu օo հh ցg զq յj",
    "CHEROKEE": "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏎS ᏙV ᏟC ᏢP ᏦK ᏞL ᏴB",
    "LISU": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
    "LATIN": "ɑa ɡg ɩi",
}
_TO_LATIN = {pair[0]: pair[1] for text in SHAPES.values() for pair in text.split()}
_FROM_LATIN = {s: {pair[1]: pair[0] for pair in reversed(text.split())} for s, text in SHAPES.items() if s != "LATIN"}
_TOKEN = re.compile(r"([^\W_](?:[^\W_]|[\u0300-\u036f\u3099\u309a])*)")
# Characters without appearance that are no format characters.
_FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
_BLANKS = {c: " " for c in (*range(9, 14), 0x85, 0x2028, 0x2029, 0x1680)}


_PLANES = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000), *range(0x11000, 0x14000), *range(0x1B000, 0x1E000), *range(0xE0000, 0xE01F0))]
#: Format characters, variation selectors and fillers have no appearance; blanks of all kinds are one.
_CLEAR = {ord(c): None for c in _PLANES if unicodedata.category(c) == "Cf" or c in _FILLERS or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef"}
_CLEAR |= {ord(c): " " for c in _PLANES if unicodedata.category(c) == "Zs"} | _BLANKS


def fold(text: str) -> str:
    """The form of a text that needs no corpus."""
    if text.isascii():
        return text.translate(_BLANKS)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).translate(_CLEAR))


@lru_cache(100_000)
def _script(c: str) -> str | None:
    """The script of a letter, if it is one of those with look-alikes."""
    if c.isascii():
        return "LATIN" if c.isalpha() else None
    name = unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""
    return name if name in SHAPES else None


def look(token: str) -> str:
    """A token with every look-alike in Latin: equal for all that look the same."""
    if token.isascii():
        return token
    return unicodedata.normalize("NFC", "".join(_TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", token)))


@lru_cache(200_000)
def results(token: str) -> tuple[str, ...]:
    """What a suspect token may stand for, the dominant script first; nothing for one that isn't suspect."""
    if token.isascii():
        return ()
    letters = unicodedata.normalize("NFD", token)
    count = Counter(s for s in map(_script, letters) if s)
    odd = any(_script(c) == "LATIN" and c in _TO_LATIN for c in letters)
    hidden = "LATIN" not in count and bool(count) and all(c in _TO_LATIN for c in letters if _script(c))
    if not (len(count) > 1 or odd or hidden):
        return ()
    out = []
    for script in [s for s, _ in sorted(count.items(), key=lambda x: (-x[1], x[0] != "LATIN", x[0]))] + ["LATIN"] * hidden:
        own = _FROM_LATIN.get(script)
        made = []
        for c in letters:
            latin = _TO_LATIN.get(c, c)
            if _script(c) in (None, script) and not (script == "LATIN" and c in _TO_LATIN):
                made.append(c)
            elif own is None:
                made.append(latin)
            else:
                made.append(own.get(latin, c))
        new = unicodedata.normalize("NFC", "".join(made))
        if {_script(c) for c in unicodedata.normalize("NFD", new)} - {None} <= {script} and new not in out:
            out.append(new)
    if hidden:  # where the Latin reading is known, it is preferred: the token's own script can't be told
        out = [x for x in out if x != token]
    return tuple(x for x in out if x != token)


def changes(token: str) -> int:
    """How often the script changes from one letter to the next."""
    scripts = [s for s in map(_script, unicodedata.normalize("NFD", token)) if s]
    return sum(a != b for a, b in zip(scripts, scripts[1:], strict=False))


def _words(run: str) -> list[str]:
    """A run of letters and digits cut where a capital follows a small letter."""
    if run[1:].islower() or run.isupper():
        return [run]
    cuts = [0, *(i for i in range(1, len(run)) if run[i].isupper() and run[i - 1].islower()), len(run)]
    return [run[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def pieces(text: str | None) -> list[str] | None:
    """The tokens of a folded text and what is between them, in order."""
    return None if text is None else [w for p in _TOKEN.split(fold(text)) if p for w in _words(p)]


_FOLDED = "entry_id long, volume string, path string, v_pieces array<string>, p_pieces array<string>, plain array<string>, suspects array<struct<token:string,look:string,changes:int,results:array<string>>>"


@lru_cache(200_000)
def _suspicion(token: str) -> dict | None:
    """What is to be known of a token, or None if it isn't suspect."""
    found, n = results(token), changes(token)
    return {"token": token, "look": look(token), "changes": n, "results": list(found) or [token]} if found or n else None


def _fold_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, v, p in zip(b["entry_id"], b["volume"], b["path"], strict=True):
            vp, pp = pieces(v), pieces(p)
            plain, suspects = [], []
            for t in {*(vp or ()), *(pp or ())}:
                if t[0].isalnum():
                    if not t.isascii() and (s := _suspicion(t)):
                        suspects.append(s)
                    else:
                        plain.append(t)
            out.append((i, v, p, vp, pp, plain, suspects))
        yield pd.DataFrame(out, columns=["entry_id", "volume", "path", "v_pieces", "p_pieces", "plain", "suspects"])


def repairs(folded: DataFrame, ascii_tokens: DataFrame) -> DataFrame:
    """``(token, result, mixed)``: the replacements that the corpus confirms, one result per look; ``mixed``: the token is of
    several scripts. ``ascii_tokens``: ``token`` of the rows in ASCII."""
    suspects = written(folded.select(F.explode("suspects").alias("s")).select("s.token", "s.look", "s.changes", "s.results").distinct(), "suspects")
    options = suspects.select("token", "look", "changes", F.posexplode("results").alias("rank", "result"))
    wanted = options.select(F.col("result").alias("token")).distinct()
    wanted = F.broadcast(wanted) if small(wanted) else wanted
    vocabulary = ascii_tokens.unionByName(folded.select(F.explode("plain").alias("token"))).join(wanted, "token", "left_semi").distinct()
    vocabulary = vocabulary.select(F.col("token").alias("result"), F.lit(True).alias("known"))
    offers = options.groupBy("look", "result").agg(F.count("*").alias("n"), F.min(F.when(F.col("token") == F.col("result"), F.col("changes")).otherwise(F.col("rank"))).alias("rank"), F.min("token").alias("a"), F.max("token").alias("z"))
    order = F.struct(F.col("known").isNull().alias("new"), (-F.col("n")).alias("n"), (F.col("result") != F.col("look")).alias("other"), "rank", "result")
    best = offers.join(vocabulary, "result", "left").groupBy("look").agg(F.min(order).alias("best"), (F.min("a") < F.max("z")).alias("several")).where("several or not best.new")
    return suspects.select("token", "look", (F.col("changes") > 0).alias("mixed")).join(best, "look").select("token", "best.result", "mixed").where("token <> result")


_REPAIRED = "entry_id long, volume string, path string, r_volume string, r_path string, m_volume string, m_path string"


def _by_rows(folded: DataFrame, mapping: DataFrame) -> DataFrame:
    """``folded`` with all tokens repaired (``r_``), and with those of several scripts only (``m_``); the mapping is small."""
    every = {r.token: r.result for r in mapping.collect()}  # at most BROADCAST_ROWS tokens
    mixed = {r.token: r.result for r in mapping.where("mixed").collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"entry_id": b["entry_id"], "volume": b["volume"], "path": b["path"]}
            for name, how in (("r", every), ("m", mixed)):
                for column, parts in (("volume", "v_pieces"), ("path", "p_pieces")):
                    out[f"{name}_{column}"] = [None if ps is None else "".join([how.get(t, t) for t in ps]) for ps in b[parts]]
            yield pd.DataFrame(out)

    return folded.select("entry_id", "volume", "path", "v_pieces", "p_pieces").mapInPandas(run, _REPAIRED)


def _by_join(folded: DataFrame, mapping: DataFrame) -> DataFrame:
    """The same for mappings of any size."""
    own = folded.where("size(suspects) > 0").select("entry_id", F.explode("suspects.token").alias("token")).join(mapping, "token")
    pair = F.struct("token", "result")
    maps = own.groupBy("entry_id").agg(F.map_from_entries(F.collect_set(pair)).alias("every"), F.map_from_entries(F.collect_set(F.when(F.col("mixed"), pair))).alias("mixed"))

    def joined(parts: str, how: str) -> Column:
        new = F.transform(parts, lambda t: F.coalesce(F.try_element_at(F.col(how), t), t))
        return F.when(F.col(parts).isNull(), None).otherwise(F.array_join(F.when(F.col(how).isNull(), F.col(parts)).otherwise(new), ""))

    rows = folded.select("entry_id", "volume", "path", "v_pieces", "p_pieces").join(maps, "entry_id", "left")
    return rows.select("entry_id", "volume", "path", *[joined(parts, how).alias(f"{how[0] if how == 'mixed' else 'r'}_{c}") for how in ("every", "mixed") for c, parts in (("volume", "v_pieces"), ("path", "p_pieces"))])


def _text(volume: str, path: str) -> Column:
    """One text for a volume and a path; nulls differ from ''."""
    return F.concat(F.coalesce(volume, F.lit("\x02")), F.lit("\x01"), F.coalesce(path, F.lit("\x02")))


class Classes(NamedTuple):
    """``rows``: ``entry_id, volume, path, m_volume, m_path, text, look`` of the rows that may be written in several ways;
    ``several``: ``look, class_id, spellings`` of the classes that are; ``rest``: the other rows, with the form that needs no
    corpus as ``m_volume, m_path``."""

    rows: DataFrame
    several: DataFrame
    rest: DataFrame


def classes(entries: DataFrame, sent: int | None = None) -> Classes:
    """The classes of rows that look the same. ``sent``: how many repairs may be sent to all tasks."""
    rows = entries.where("entry_id is not null").select(F.col("entry_id").cast("long"), "volume", "path")
    ascii_only = lambda c: F.coalesce(is_ascii(F.col(c)), F.lit(True))
    rows = rows.withColumn("ascii", ascii_only("volume") & ascii_only("path"))
    plain = rows.where("ascii").drop("ascii")
    folded = written(rows.where("not ascii").drop("ascii").mapInPandas(_fold_rows, _FOLDED), "folded")
    split = F.filter(F.split(F.concat_ws("/", "volume", "path"), "[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])"), lambda t: t != "")
    mapping = written(repairs(folded, plain.select(F.explode(F.array_distinct(split)).alias("token"))), "repairs")
    repaired = (_by_rows if small(mapping, BROADCAST_ROWS if sent is None else sent) else _by_join)(folded, mapping)
    other = repaired.select("entry_id", "volume", "path", "m_volume", "m_path", _text("volume", "path").alias("text"), _text("r_volume", "r_path").alias("look"))
    blank = lambda c: F.translate(c, "\t\n\x0b\x0c\r", "     ")
    own = plain.select("entry_id", "volume", "path", blank(F.col("volume")).alias("m_volume"), blank(F.col("path")).alias("m_path")).withColumn("text", _text("volume", "path")).withColumn("look", _text("m_volume", "m_path"))
    other = written(other.unionByName(own.where("text <> look")), "looks")
    touched = other.select("look").distinct()
    touched = F.broadcast(touched) if small(touched) else touched
    own = own.where("text = look")
    met = written(other.unionByName(own.join(touched, "look", "left_semi").select(other.columns)), "classes")
    several = met.groupBy("look").agg(F.min("entry_id").alias("class_id"), F.count_distinct("text").alias("spellings")).where("spellings > 1")
    return Classes(met, written(several, "several"), own.join(touched, "look", "left_anti").select(other.columns))


@F.pandas_udf(IntegerType())
def _script_changes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: changes(t or ""))


def canonical(entries: DataFrame) -> DataFrame:
    """``(entry_id, volume, path, c_volume, c_path)``: every row with its volume and path in one consistent form."""
    c = classes(entries)
    form = F.struct("m_volume", "m_path")
    forms = c.rows.join(c.several, "look").groupBy("look", form.alias("form")).agg(F.count("*").alias("n"))
    forms = forms.withColumn("changes", _script_changes(F.concat_ws("/", "form.m_volume", "form.m_path")))
    best = forms.groupBy("look").agg(F.min(F.struct("changes", (-F.col("n")).alias("n"), "form")).alias("b")).select("look", F.col("b.form").alias("best"))
    mine = c.rows.join(best, "look", "left").withColumn("c", F.when(F.col("best").isNull(), form).otherwise(F.col("best")))
    out = mine.select("entry_id", "volume", "path", F.col("c.m_volume").alias("c_volume"), F.col("c.m_path").alias("c_path"))
    return out.unionByName(c.rest.select("entry_id", "volume", "path", F.col("m_volume").alias("c_volume"), F.col("m_path").alias("c_path")))


def members(entries: DataFrame) -> DataFrame:
    """``(entry_id, class_id, spellings)``: each row of a class with several spellings; ``class_id`` is the least entry_id of
    the class. That is the result without pairs, in size linear in the rows."""
    c = classes(entries)
    return c.rows.join(c.several, "look").select("entry_id", "class_id", "spellings")


def same_looking(entries: DataFrame) -> DataFrame:
    """``(entry_id_a, entry_id_b)``: the pairs of rows of :func:`members` whose texts differ, written out.

    Spellings are paired first, each once, and rows are joined to these pairs by their spelling: no row meets one of its own
    spelling, so the work follows the output."""
    c = classes(entries)
    rows = c.rows.join(c.several, "look", "left_semi").select("look", "text", "entry_id")
    forms = rows.select("look", "text").distinct()
    pairs = forms.withColumnRenamed("text", "text_a").join(forms.withColumnRenamed("text", "text_b"), "look").where("text_a < text_b").select("text_a", "text_b")
    met = pairs.join(rows.select(F.col("text").alias("text_a"), F.col("entry_id").alias("a")), "text_a").join(rows.select(F.col("text").alias("text_b"), F.col("entry_id").alias("b")), "text_b").where("a <> b")
    return met.select(F.least("a", "b").alias("entry_id_a"), F.greatest("a", "b").alias("entry_id_b"))


def shown_as() -> dict[str, str]:
    """Each character that is written differently from what it looks like, and its look, made from the rules above for the
    blocks in which they are: for comparisons outside this module."""
    blocks = [(0, 0x250), (0x250, 0x2B0), (0x370, 0x590), (0x1100, 0x1200), (0x13A0, 0x1400), (0x1E00, 0x2100), (0x2150, 0x2190), (0x3000, 0x3200), (0xA4D0, 0xA500), (0xF900, 0xFB10), (0xFE00, 0x10000)]
    found = {c: look(fold(c)) for a, z in blocks for c in map(chr, range(a, z)) if unicodedata.category(c) not in ("Cn", "Cs", "Co", "Cc")}
    return {c: v for c, v in found.items() if v != c and unicodedata.normalize("NFC", c) == c}
