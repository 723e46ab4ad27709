"""The inverted index: terms to paths, and matching all tokens of a query."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions.tokens import VOLUME_TAG, all_terms
from catalens.model import SearchOptions
from catalens.plans.query import Query, is_exact, is_short
from catalens.session import small
from catalens.sources.versioned import CODEC


def postings(entries: DataFrame) -> DataFrame:
    """``(term, path)``, one row for each term of each entry. Rows without path have none."""
    rows = entries.where("path is not null").select("path", all_terms(F.col("path"), F.coalesce("volume", F.lit(""))).alias("terms"))
    return rows.select(F.explode("terms").alias("term"), "path")


def write_postings(rows: DataFrame, to: str, partitions: int | None = None, ranged: bool = True) -> None:
    """Postings sorted by term, so a prefix touches few row groups. ``ranged``: over range partitions, whose bounds go by
    term and path, so that a term in most entries is cut into several; else each task sorts its own rows and nothing is
    shuffled, which suits the small generations of a log."""
    if ranged:
        rows = rows.repartitionByRange(partitions, "term", "path") if partitions else rows.repartitionByRange("term", "path")
    rows.sortWithinPartitions("term", "path").write.option("compression", CODEC).parquet(to)


def posting_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("entries"))


def grouped(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``(term, block, paths)`` with sorted distinct paths: the form for export. A term of more than ``most`` entries is cut into
    blocks of about that many by the hash of the path, so that no task holds more of one term; others have block 0."""
    heavy = posting_counts(rows).where(F.col("entries") > most).select("term", F.ceil(F.col("entries") / most).alias("blocks"))
    heavy = F.broadcast(heavy) if small(heavy) else heavy
    cut = rows.join(heavy, "term", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("path"), F.col("blocks")), F.lit(0)))
    return cut.groupBy("term", "block").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def term_test(token: str, limit: Column | None = None) -> Column:
    test = F.col("term") == token if is_exact(token) else F.col("term").startswith(token)
    return test if limit is None else test & limit


def expansions(rows: DataFrame, token: str, options: SearchOptions, cap: int, first: bool) -> list[str]:
    """The terms a short prefix stands for: in byte order, the first ``max_expansions`` of them for the first token of a
    query, and no further than the term with which ``5 * cap`` postings are reached. At most that many terms are read."""
    counts = posting_counts(rows.where(F.col("term").startswith(token)))
    most = 5 * cap
    head = counts.orderBy("term").limit(min(options.max_expansions, most) if first else most)
    before = F.coalesce(F.sum("entries").over(Window.partitionBy(F.lit(1)).orderBy("term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return [r.term for r in head.withColumn("before", before).where(F.col("before") < most).select("term").collect()]


def match_all(rows: DataFrame, query: Query, options: SearchOptions, cap: int) -> DataFrame:
    """``path`` of the entries that hold a term for every token: one scan with all predicates, one partial aggregate. A
    volume that is asked for is one more term, so entries that were never on it are left out before they are read."""
    tests: list[Column] = []
    for i, token in enumerate(query.tokens):
        if is_short(token, options):
            first = i == 0 and options.volume_name is None
            terms = expansions(rows, token, options, cap, first)
            tests.append(F.col("term").isin(terms) if terms else F.lit(False))
        else:
            tests.append(term_test(token))
    if options.volume_name:
        tests.append(F.col("term") == F.lower(F.lit(VOLUME_TAG + options.volume_name)))
    bits = [F.max(F.when(t, 1).otherwise(0)).alias(f"hit{i}") for i, t in enumerate(tests)]
    held = rows.where(reduce(or_, tests)).groupBy("path").agg(*bits)
    return held.where(" and ".join(f"hit{i} = 1" for i in range(len(tests)))).select("path")
