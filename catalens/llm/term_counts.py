"""Frequency of every distinct term, from bitmaps of record ids (problem 3).

Vertical layout: each term has compressed bitmaps of the records that hold it, one per range of 65,536 record ids, and a
counter of occurrences beside each. A bitmap of at most 4,095 ids is an array of 16-bit offsets, a fuller one 65,536 bits.
Tasks build bitmaps from their rows; those of one term and range are merged by union and their counters added; the
document frequency is read from the cardinalities. A term in most records is spread over many ranges, so no task gets all
of it, and its bitmaps are far smaller than its rows before they are shuffled.

Occurrences are distinct (term, record, position): they are made distinct first, by an aggregate that combines before the
shuffle. Null and empty terms and rows without record are ignored; a null position is one position. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_BITS, ARRAY_MOST = 16, 4095
BITMAP_SCHEMA = "term string, range long, bitmap binary, occurrences long"
MERGED = ["term", "range", "bitmap", "occurrences", "entries"]


def pack(offsets: np.ndarray) -> bytes:
    """A bitmap of sorted distinct 16-bit offsets."""
    if len(offsets) <= ARRAY_MOST:
        return offsets.astype("<u2").tobytes()
    bits = np.zeros(1 << RANGE_BITS, np.uint8)
    bits[offsets] = 1
    return np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The offsets of a bitmap; an array is always shorter than the 8,192 bytes of the other form."""
    if len(data) < (1 << RANGE_BITS) // 8:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype("<u2")


def union(bitmaps: list[bytes]) -> np.ndarray:
    return unpack(bitmaps[0]) if len(bitmaps) == 1 else np.unique(np.concatenate([unpack(b) for b in bitmaps]))


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for held in _gathered(batches, 200_000):
        codes, terms = pd.factorize(held["term"])
        ids = held["entry_id"].to_numpy(np.int64)
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        ranges, offsets = ids >> RANGE_BITS, ids & ((1 << RANGE_BITS) - 1)
        new_group = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (ranges[1:] != ranges[:-1])])
        first = np.r_[True, (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])]
        occurrences = np.diff(np.r_[new_group, len(ids)])
        kept, at = offsets[first], np.r_[np.cumsum(first)[new_group] - 1, first.sum()]
        maps = [pack(kept[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pd.DataFrame({"term": np.asarray(terms, dtype=object)[codes[new_group]], "range": ranges[new_group], "bitmap": maps, "occurrences": occurrences})


def _gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by term and range; one group's bitmaps may stand in two batches."""

    def closed() -> tuple:
        offsets = union(maps)
        return (*key, pack(offsets), n, len(offsets))

    key, maps, n = None, [], 0
    for b in batches:
        out = []
        for term, rng, bitmap, occ in zip(b["term"], b["range"], b["bitmap"], b["occurrences"], strict=True):
            if (term, rng) != key:
                if maps:
                    out.append(closed())
                key, maps, n = (term, rng), [], 0
            maps.append(bitmap)
            n += occ
            if len(maps) > 64:
                maps = [pack(union(maps))]
        yield pd.DataFrame(out, columns=MERGED)
    if maps:
        yield pd.DataFrame([closed()], columns=MERGED)


def occurrences(postings: DataFrame) -> DataFrame:
    return postings.where("term <> '' and entry_id is not null").select("term", "entry_id", F.coalesce("pos", F.lit(-1)).alias("pos")).distinct()


def term_bitmaps(postings: DataFrame) -> DataFrame:
    """``(term, range, bitmap, occurrences, entries)``: the vertical layout, ``entries`` being the bitmap's cardinality."""
    built = occurrences(postings).select("term", "entry_id").mapInPandas(_build, BITMAP_SCHEMA)
    return built.repartition("term", "range").sortWithinPartitions("term", "range").mapInPandas(_merge, BITMAP_SCHEMA + ", entries long")


def records_with_terms(postings: DataFrame) -> int:
    """The number of distinct records that hold a term, from one bitmap over all terms."""
    bits = postings.where("term <> '' and entry_id is not null").groupBy(F.expr("bitmap_bucket_number(entry_id)")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(entry_id))").alias("b"))
    return bits.agg(F.sum(F.expr("bitmap_count(b)"))).first()[0] or 0


def term_counts(postings: DataFrame, rare_most: int = 2, common_part: float = 0.1) -> DataFrame:
    """``(term, occurrences, entries, mark)``; mark is ``rare`` for a term in at most ``rare_most`` records, ``common`` for
    one in more than ``common_part`` of the records that hold a term (rare goes first), else null."""
    records = records_with_terms(postings)
    totals = term_bitmaps(postings).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("entries").alias("entries"))
    mark = F.when(F.col("entries") <= rare_most, "rare").when(F.col("entries") > common_part * records, "common")
    return totals.withColumn("mark", mark)
