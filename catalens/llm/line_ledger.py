"""Records that differ only in notation, collapsed with a ledger of counts (problem 5).

The canonical key of a line is the word sequence of its fields path, volume and kind, in that order, whatever order,
quoting or separators the line uses; a word is a maximal run of letters and digits in lower case. The ledger keeps, in
hash buckets of the key, how many lines stood for a record and its earliest line. A batch of lines is first aggregated on
its own (before the shuffle too, so a record with a third of all lines leaves each task as one row), then joined in full
to the ledger's buckets that it touches; counts are added, the smaller line id stays, and one manifest publishes the new
buckets with the untouched old ones.

The manifest counts the records. The number of buckets, a power of two, doubles when there are more than ``bucket_rows``
records for each: a bucket then splits by one more bit of the key's hash, in the batch that asks for it.

A line without one of the labels has no words for that field. Null lines and null line ids stand for no record. A line
applied twice counts twice: the caller hands over new lines only. An empty batch publishes no change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.operators.changefeed import power_of_two
from catalens.operators.skew import join_unique
from catalens.session import shuffle_partitions, written
from catalens.sources.versioned import VersionedTable

FIELDS = ["path", "volume", "kind"]
BUCKET_ROWS = 2_000_000
LEDGER_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("lines", T.LongType()), T.StructField("keep_id", T.LongType())])
_WRITTEN = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("b", T.IntegerType())])
_LABEL = r"(?:^|[^\p{L}\p{N}])%s[\"']?\s*[:=]"


def words(text: Column) -> Column:
    """The words of a text in lower case, each between blanks."""
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def field(line: Column, name: str, names: list[str] = FIELDS) -> Column:
    """What stands after the label ``name`` and before the next label, whatever the notation."""
    others = "|".join(n for n in names if n != name)
    return F.regexp_extract(line, "(?is)" + _LABEL % name + "(.*?)(?:" + _LABEL % f"(?:{others})" + r"|\z)", 1)


def line_key(line: Column, names: list[str] = FIELDS) -> Column:
    return F.concat_ws("\u0001", *[words(field(line, n, names)) for n in names])


def keyed(lines: DataFrame) -> DataFrame:
    """``(line_id, key)`` of the lines ``(line_id, line)``."""
    return lines.where("line is not null and line_id is not null").select(F.col("line_id").cast("long"), line_key(F.col("line")).alias("key"))


def _bucket(buckets: int) -> Column:
    return F.xxhash64("key").bitwiseAND(buckets - 1).cast("int")


class LineLedger:
    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.table, self.bucket_rows = spark, VersionedTable(spark, root), bucket_rows

    def rows(self) -> DataFrame:
        """``(key, lines, keep_id)`` of the newest version."""
        return self._read([f for f, _ in self.table.manifest()["meta"].get("held", {}).values()])

    def _read(self, folders: list[str]) -> DataFrame:
        return self.table.read(folders, LEDGER_SCHEMA)

    def add(self, lines: DataFrame) -> dict:
        """Take in a batch of ``(line_id, line)``; gives the manifest that was published."""
        return self.add_keyed(keyed(lines))

    def add_keyed(self, known: DataFrame) -> dict:
        """Take in a batch of ``(line_id, key)``."""
        old = self.table.manifest()
        meta = dict(old["meta"])
        held, records, buckets = meta.get("held", {}), meta.get("records", 0), meta.get("buckets", 0)
        batch = written(known.groupBy("key").agg(F.count("*").alias("n"), F.min("line_id").alias("first_id")), "ledger-batch")
        fits = power_of_two(max(shuffle_partitions(self.spark), -(-(records + batch.count()) // self.bucket_rows)))
        if fits > buckets:  # buckets split: all are written again
            before, kept, buckets = [f for f, _ in held.values()], {}, fits
        else:
            touched = {str(r[0]) for r in batch.select(_bucket(buckets)).distinct().collect()}  # at most as many as there are buckets
            before, kept = [held[b][0] for b in touched if b in held], {b: f for b, f in held.items() if b not in touched}
        both = self._read(before).join(batch, "key", "full_outer")
        merged = both.select("key", (F.coalesce("lines", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("lines"), F.least("keep_id", "first_id").alias("keep_id"))
        folder = self.table.new_folder()
        self.table.write(merged.withColumn("b", _bucket(buckets)).repartitionById(buckets, F.col("b")), folder, by="b")
        counts = {str(b): n for b, n in self.table.read([folder], _WRITTEN).groupBy("b").count().collect()}  # one row per bucket
        held = kept | {b: [f, counts.get(b, 0)] for b, f in self.table.folders_by(folder).items()}
        meta |= {"buckets": buckets, "held": held, "records": sum(n for _, n in held.values())}
        return self.table.publish(sorted({f.split("/")[0] for f, _ in held.values()}), meta, expect=old["version"])

    def copies(self, lines: DataFrame) -> DataFrame:
        """``(keep_id, line_id)`` for every line that isn't the earliest of its record."""
        return self.copies_keyed(keyed(lines))

    def copies_keyed(self, known: DataFrame) -> DataFrame:
        several = self.rows().where("lines > 1")
        total = several.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
        return join_unique(known, several, "key", "lines", total).where("line_id <> keep_id").select("keep_id", "line_id")
