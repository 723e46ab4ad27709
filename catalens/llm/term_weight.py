"""How distinctive a term is per record: log-entropy weighting (problem 2).

``weight = log2(1 + tf) * (1 - H / ln N)``: tf is how often the term stands in the record, H the entropy of the term's
spread over the records that hold it, N the number of records that hold any term. A term in one record only has H = 0 and
keeps its local weight, one spread evenly over all records gets 0. For one record in all (ln N = 0) the second factor is 1.

Two SQL aggregations compute it: occurrences to (term, record) and (term, record) to term. Both results are written
to the shared folder, so that neither is computed twice. Terms in most records are hot keys: both aggregations combine before they
shuffle, and the join of the term figures to their rows goes by :func:`join_unique`.

Null and empty terms and rows without record are ignored; a null position counts as one position; repeated rows count
once. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.operators.skew import join_unique
from catalens.session import written

_LOCAL = """
SELECT term, entry_id, count(DISTINCT coalesce(pos, -1)) AS tf FROM {postings}
WHERE term <> '' AND entry_id IS NOT NULL GROUP BY term, entry_id
"""
_GLOBAL = """
SELECT term, count(*) AS df, sum(tf) AS gf, greatest(ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf), 0) AS entropy
FROM {local} GROUP BY term
"""


def _local(postings: DataFrame) -> DataFrame:
    return written(postings.sparkSession.sql(_LOCAL, postings=postings.select("term", "entry_id", "pos")), "term-local")


def _size(local: DataFrame) -> tuple[int, int]:
    """Records and rows."""
    return tuple(local.agg(F.count_distinct("entry_id"), F.count("*")).first())


def _weighted(local: DataFrame, records: int, total: int) -> DataFrame:
    terms = written(local.sparkSession.sql(_GLOBAL, local=local), "term-global")
    spread = F.lit(1.0) if records < 2 else F.lit(1.0) - F.col("entropy") / F.log(F.lit(float(records)))
    return join_unique(local, terms, "term", "df", total).select("entry_id", "term", "tf", "df", "gf", (F.log2(F.lit(1.0) + F.col("tf")) * spread).alias("weight"))


def term_weights(postings: DataFrame) -> DataFrame:
    """``(entry_id, term, tf, df, gf, weight)``, one row for each term of each record."""
    local = _local(postings)
    return _weighted(local, *_size(local))


def distinctive(postings: DataFrame, least_tf: int = 3, least_df: int = 2, most_df: int = 20) -> DataFrame:
    """The terms that are characteristic of their record, by their weight: at least that of a term which occurs ``least_tf``
    times there and is spread evenly over ``most_df`` records. Weights rise with tf and fall with the spread, so no term that
    keeps both bounds is below; a term that makes up for one by the other is told apart by an exact check of the counts."""
    local = _local(postings)
    records, total = _size(local)
    spread = math.log(most_df) / math.log(records) if records > 1 else 0.0
    least = math.log2(1 + least_tf) * (1 - spread) - 1e-9
    chosen = _weighted(local, records, total).where(F.col("weight") >= least)
    return chosen.where((F.col("tf") >= least_tf) & F.col("df").between(least_df, most_df))
