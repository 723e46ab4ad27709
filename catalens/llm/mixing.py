"""Mixing sources to target weights with a low-discrepancy schedule (problem 8).

The mixture is a sequence of slots of ``block`` tokens each. Slot n belongs to the source whose stretch of the cumulative
target shares holds the golden-ratio point ``frac((n + 0.5) * 0.618...)``; such points fill the line evenly, so after any
number of slots every source has had its share to within a few slots, and no random draw is needed. Slots are ranked per
source. Each source's documents are put in a hashed order and laid out one after the other, and the line of their tokens is
cut into blocks of equal size; a document that crosses an edge is in both blocks with its parts, as when sequences for
training are packed, and a long text fills as many blocks as it has tokens for. Slot rank r of a source with B blocks takes
block ``r mod B`` as copy ``r div B``; from ``max_copies`` on it stays empty, which is how a source that is too small falls
short.

The sum of all slots is ``total``, by default the tokens of all documents whose source has a target; or, with ``fit``, the
largest total at which no source that has documents falls short, so that the target shares hold among these. Reached shares
are reported against the total and against what was selected.

At scale: sizes are counted once and written; sums run over hash buckets of each source and only bucket totals meet in one
place, so a source with a third of all rows is cut into buckets like any other; slots are ranked the same way. Points find
their source by an equi-join on cells of the line, whatever the number of sources.

Documents without source, target or size, and null ids, can't be selected. Null or non-positive shares count as 0, null
copies as 1; repeated targets of a source are added up, their copies maximised. Repeated ids are separate documents.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.session import small, spread, written

GOLDEN = 0.6180339887498949
BLOCK_TOKENS, BUCKET_TOKENS, SLOT_CHUNK, CELLS = 8192, 1 << 24, 1 << 16, 4096
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token never spans a blank before a character that isn't blank; the blank belongs to what follows.
_CUT = re.compile(r" (?=\S)")


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Where the vocabulary file is: in the folder that the environment's ``CATALENS_TOKENIZERS`` names, else in
    /opt/tokenizers. Any byte-pair vocabulary in the format of tiktoken will do: a token in base 64 and its rank in each line;
    the default is a public byte-level one of 50,256 tokens."""
    return str(Path(os.environ.get("CATALENS_TOKENIZERS", "/opt/tokenizers")) / name)


class _Lengths(dict):
    """Tokens of a piece of text, remembered; emptied when it gets large."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}
        self.encode = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) > 300_000:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


def count_tokens(text: str, lengths: _Lengths) -> int:
    first, *rest = _CUT.split(text)
    return lengths[first] + sum([lengths[" " + p] for p in rest])


def _counter(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = _Lengths(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [count_tokens(t, lengths) for t in b["text"]]})

    return run


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, tokens)`` of the documents that can be selected; every text is counted whole."""
    rows = docs.where("doc_id is not null and source is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long"), "source", "text")
    return spread(rows).mapInPandas(_counter(path or tokenizer_path()), "doc_id long, source string, tokens long").where("tokens > 0")


def _summed(by: Column | str, order: str) -> Column:
    """Sum of the shares of ``by``, added up in one order: a sum of fractions in the order of arrival can differ in its last
    digit from run to run, which the floor of a fitted total turns into another total."""
    return F.sum("share").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def clean_targets(targets: DataFrame) -> DataFrame:
    """One row per source: ``source, share, copies``, shares scaled to sum 1, the same however the rows come."""
    rows = targets.where("source is not null").select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_copies", F.lit(1)).alias("copies"))
    rows = rows.withColumn("share", _summed("source", "share")).groupBy("source").agg(F.max("share").alias("share"), F.greatest(F.max("copies"), F.lit(0)).alias("copies"))
    return rows.withColumn("share", F.col("share") / _summed(F.lit(1), "share"))


def with_sizes(docs: DataFrame, size: str) -> DataFrame:
    """``(doc_id, source, tokens)`` with a size that the table has instead of counted tokens."""
    rows = docs.where("doc_id is not null and source is not null").select(F.col("doc_id").cast("long"), "source", F.col(size).cast("long").alias("tokens"))
    return rows.where("tokens > 0")


def laid_out(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """``counted`` with ``begin``, the tokens of its source before it."""
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = max(8, -(-total // BUCKET_TOKENS))
    rows = counted.join(F.broadcast(targets.select("source")), "source", "left_semi") if small(targets) else counted.join(targets.select("source"), "source", "left_semi")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "source")).withColumn("part", F.pmod(F.shiftright("h", 20), F.lit(parts)))
    sums = rows.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("base", F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).drop("n")
    inside = F.sum("tokens").over(W.partitionBy("source", "part").orderBy("h", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens")
    placed = rows.withColumn("inside", inside).join(before, ["source", "part"]).withColumn("begin", F.col("base") + F.col("inside"))
    return placed.select("doc_id", "source", "tokens", "begin")


def blocks(laid: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """``(source, block, doc_id, first, tokens)``: the parts of documents that each block holds; ``first`` is the place in the
    document."""
    end = F.col("begin") + F.col("tokens")
    cut = laid.select("source", "doc_id", "begin", end.alias("end"), F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + tokens - 1) div {block}"))).alias("block"))
    a, z = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    return cut.select("source", "block", "doc_id", (a - F.col("begin")).alias("first"), (z - a).alias("tokens"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """``(slot, source, rank)``: which source each slot belongs to and its how-manieth slot that is."""
    spark = targets.sparkSession
    upto = F.sum("share").over(W.partitionBy(F.lit(1)).orderBy("source"))
    top = _summed(F.lit(1), "source")
    # the last stretch ends at 1, whatever the sum of the rounded shares is
    ranges = targets.select("source", "share", upto.alias("z"), top.alias("t")).select("source", (F.col("z") - F.col("share")).alias("a"), F.when(F.col("z") >= F.col("t"), 1.0).otherwise(F.col("z")).alias("z"), "share").where("share > 0")
    ranges = ranges.withColumn("a", F.coalesce(F.lag("z").over(W.partitionBy(F.lit(1)).orderBy("z", "source")), F.lit(0.0)))
    cells = ranges.select("source", "a", "z", F.explode(F.sequence(F.floor(F.col("a") * CELLS), F.floor(F.col("z") * CELLS))).alias("cell"))
    cells = F.broadcast(cells) if small(cells) else cells
    point = F.pmod((F.col("id") + 0.5) * GOLDEN, F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"), F.floor(point * CELLS).alias("cell"))
    drawn = points.join(cells, "cell").where("a <= point and point < z").select("slot", "chunk", "source")
    sums = drawn.groupBy("source", "chunk").count()
    before = sums.select("source", "chunk", (F.sum("count").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")).alias("base"))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    return drawn.withColumn("inside", inside).join(before, ["source", "chunk"]).select("slot", "source", (F.col("base") + F.col("inside")).alias("rank"))


class Plan(NamedTuple):
    """What a mixture is made from."""

    goals: DataFrame
    laid: DataFrame
    available: DataFrame
    total: int
    block: int


def planned(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, path: str | None = None, fit: bool = False, size: str | None = None) -> Plan:
    """``total``: size of the mixture; ``fit``: no larger than all sources with documents can fill; ``size``: a column that
    has the documents' sizes, for tokens to be counted in otherwise."""
    goals = written(clean_targets(targets), "targets")
    counted = with_sizes(docs, size) if size else written(with_tokens(docs, path), "tokens")
    laid = written(laid_out(counted, goals), "laid-out")
    available = laid.groupBy("source").agg(F.sum("tokens").alias("available"))
    want = total if total is not None else laid.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if fit:
        most = available.join(goals, "source").where("share > 0 and copies > 0").agg(F.min(F.floor(F.col("available") * F.col("copies") / F.col("share")))).first()[0]
        want = min(want, most or 0)
    return Plan(goals, laid, available, want, block)


def _used(plan: Plan) -> DataFrame:
    """The slots that are filled: ``slot, source, block, copy``."""
    slots = schedule(plan.goals, -(-plan.total // plan.block))
    held = slots.join(plan.available.join(plan.goals, "source"), "source").withColumn("blocks", F.expr(f"(available + {plan.block - 1}) div {plan.block}"))
    return held.select("slot", "source", F.pmod("rank", "blocks").alias("block"), F.expr("rank div blocks").alias("copy"), "copies").where("copy < copies")


def mixed(plan: Plan) -> DataFrame:
    return _used(plan).join(blocks(plan.laid, plan.block), ["source", "block"]).select("slot", "source", F.col("copy").cast("int").alias("copy"), "doc_id", "first", "tokens")


def mixture(docs: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """``(slot, source, copy, doc_id, first, tokens)``: the selection in the order of its slots, one row per part of a
    document, which begins at its token ``first``. Settings as in :func:`planned`."""
    return mixed(planned(docs, targets, **how))


def shares(docs: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """One row per source of the targets: what it should hold (``target_tokens`` of the total) and what it holds, as part
    of the total that was aimed at (``share_of_total``) and of what was selected (``reached_share``). Sums are made from the
    blocks that the slots take; no document is looked at again."""
    plan = planned(docs, targets, **how)
    sizes = F.least(F.lit(plan.block), F.col("available") - F.col("block") * plan.block)
    got = _used(plan).join(plan.available, "source").groupBy("source").agg(F.sum(sizes).alias("selected_tokens"), F.count("*").alias("selected_blocks"), F.max(F.col("copy") + 1).alias("most_copies"))
    all_tokens = F.sum("selected_tokens").over(W.partitionBy(F.lit(1)))
    rows = plan.goals.join(got, "source", "left").na.fill(0, ["selected_tokens", "selected_blocks", "most_copies"])
    part = lambda n: F.when(n > 0, F.col("selected_tokens") / n).otherwise(0.0)
    return rows.select(
        "source", F.col("share").alias("target_share"), F.col("copies").alias("max_copies"), F.round(F.col("share") * plan.total).cast("long").alias("target_tokens"), "selected_tokens", "selected_blocks", "most_copies",
        part(F.lit(plan.total)).alias("share_of_total"), part(all_tokens).alias("reached_share"),
    )
