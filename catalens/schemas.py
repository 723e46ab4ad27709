"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY_FIELDS = [
    ("path", T.StringType()),
    ("volume", T.StringType()),
    ("kind", T.IntegerType()),
    ("last_modified", T.LongType()),
    ("last_accessed", T.LongType()),
    ("category", T.IntegerType()),
    ("volume_type", T.IntegerType()),
]
ENTRY_SCHEMA = T.StructType([T.StructField(n, t) for n, t in ENTRY_FIELDS])
OPLOG_SCHEMA = T.StructType([*ENTRY_SCHEMA.fields, T.StructField("seq", T.LongType()), T.StructField("is_delete", T.BooleanType())])
TOMB_SCHEMA = T.StructType([T.StructField("volume", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("seq", T.LongType())])
POSTING_SCHEMA = T.StructType([T.StructField("term", T.StringType()), T.StructField("path", T.StringType())])
RESULT_COLUMNS = ["path", "volume", "volume_type", "kind", "last_modified", "last_accessed", "category", "score"]
RESULT_SCHEMA = T.StructType([*[T.StructField(n, dict(ENTRY_FIELDS)[n]) for n in RESULT_COLUMNS[:-1]], T.StructField("score", T.DoubleType())])
