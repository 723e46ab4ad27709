"""Categories by extension and texts for display. Nulls stay null, but for labels, where null is the rest class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.functions.tokens import extension
from catalens.model import Category

# Extensions by category, in lower case.
EXTENSIONS = {
    Category.IMAGE: "jpg jpeg png gif webp svg",
    Category.VIDEO: "mp4 mkv mov avi webm",
    Category.AUDIO: "mp3 wav ogg flac aac",
    Category.DOCUMENT: "pdf doc docx ppt pptx xls xlsx odt",
    Category.ARCHIVE: "zip tar gz bz2 xz 7z rar",
    Category.TEXT: "txt md rs js ts c cpp h hpp py go rb json yaml toml html css",
}
KIND_LABELS = {0: "FILE", 1: "DIR ", 2: "SYM "}
CATEGORY_LABELS = {4: "IMG ", 8: "VID ", 16: "AUD ", 2: "DOC ", 1: "ARC ", 32: "TXT "}


def classify(path: Column) -> Column:
    """The category of a path by its extension."""
    ext = F.lower(extension(path))
    out = F.when(F.lit(False), 0)
    for category, names in EXTENSIONS.items():
        out = out.when(ext.isin(*names.split()), category)
    return out.otherwise(Category.OTHER)


def _label(c: Column, labels: dict[int, str], rest: str) -> Column:
    out = F.when(F.lit(False), rest)
    for code, text in labels.items():
        out = out.when(c == code, text)
    return out.otherwise(rest)


def kind_label(c: Column) -> Column:
    return _label(c, KIND_LABELS, "?   ")


def category_label(c: Column) -> Column:
    """Of single categories; combined masks are the rest."""
    return _label(c, CATEGORY_LABELS, "OTH ")


def score_band(c: Column) -> Column:
    return F.when(c > 20.0, "green").when(c > 10.0, "yellow").otherwise("gray")


def time_label(micros: Column) -> Column:
    """``yy-MM-dd HH:mm:ss`` in UTC (the session's time zone), ``N/A`` for times outside the years 1 to 9999."""
    secs = F.floor(micros / F.lit(1_000_000)).cast("long")
    shown = F.date_format(F.timestamp_seconds(F.when(secs.between(-62135596800, 253402300799), secs)), "yy-MM-dd HH:mm:ss")
    return F.coalesce(shown, F.lit("N/A"))


def _two_places(n: Column, unit: int) -> Column:
    """``n / unit`` with two decimal places, rounded as the double it is: halves go up or down by what that double is above or
    below them, and to the even neighbour if it is neither. In whole numbers, as the JVM's formatter rounds the shortest
    decimal form of a double instead."""
    n = n.cast("long")
    part = F.pmod(n * 100, F.lit(unit))
    cents, rest = F.round((n * 100 - part) / unit).cast("long"), 2 * part
    x = n.cast("double") / unit
    high = x.cast("float").cast("double")  # both parts times the unit are exact, so the sign of their sum is
    error = (high * unit - n.cast("double")) + (x - high) * unit
    up = F.when(rest != unit, rest > unit).when(error != 0, error > 0).otherwise(cents % 2 == 1)
    cents = cents + up.cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def micros_label(us: Column) -> Column:
    return F.when(us < 1000, F.concat(us.cast("string"), F.lit("µs"))).when(us < 1_000_000, F.concat(_two_places(us, 1000), F.lit("ms"))).otherwise(F.concat(_two_places(us, 1_000_000), F.lit("s")))


def millis_label(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(_two_places(ms, 1000), F.lit("s"))).otherwise(F.concat(_two_places(ms, 60_000), F.lit("m")))
