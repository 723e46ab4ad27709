"""Figures over latencies and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of which an exact rank is taken at once; larger ranges are narrowed by histograms first.
DIRECT_ROWS, BINS = 20_000, 1024


def _at_ranks(values: DataFrame, ranks: list[int], low: float, high: float, n: int) -> dict[int, float]:
    """The values of 0-based ranks of the ``n`` values of the column ``x``, which lie from ``low`` to ``high``.

    Each pass counts, for all ranks that are open, the values of their range in 1,024 equal bins, with the bins' own least
    and greatest values, and each rank goes on in its bin. So a pass is one scan however many ranks there are, and its result
    has at most 1,024 rows a rank. Ranges of at most ``DIRECT_ROWS`` values are sorted in one last scan."""
    found: dict[int, float] = {}
    parts = {r: (low, high, n, r) for r in ranks}  # range, its count, the rank within it
    while parts:
        for r in [r for r, (a, z, _, _) in parts.items() if a == z]:
            found[r] = parts.pop(r)[0]
        wide = sorted({p[:2] for p in parts.values() if p[2] > DIRECT_ROWS})
        if not wide:
            break
        places = F.array(*[F.when(F.col("x").between(a, z), F.struct(F.lit(k).alias("k"), F.least(F.floor((F.col("x") - a) / (z - a) * BINS), F.lit(BINS - 1)).alias("bin"))) for k, (a, z) in enumerate(wide)])
        seen = values.select("x", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).groupBy("p.k", "p.bin")
        counts = seen.agg(F.count("*"), F.min("x"), F.max("x")).collect()
        for r, (a, z, size, rank) in parts.items():
            if size <= DIRECT_ROWS:
                continue
            for _, _, c, least, most in sorted(x for x in counts if wide[x[0]] == (a, z)):
                if rank < c:
                    parts[r] = (least, most, c, rank)
                    break
                rank -= c
    if parts:
        ranges = sorted({p[:2] for p in parts.values()})
        inside = F.array(*[F.when(F.col("x").between(a, z), F.lit(k)) for k, (a, z) in enumerate(ranges)])
        held = values.select("x", F.explode(F.filter(inside, lambda k: k.isNotNull())).alias("k")).groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        at = {k: F.element_at("xs", F.lit(rank + 1)) for k, rank in ((r, p[3]) for r, p in parts.items())}
        for k, *row in held.select("k", *[F.when(F.col("k") == ranges.index(parts[r][:2]), v) for r, v in at.items()]).collect():
            found |= {r: x for r, x in zip(at, row, strict=True) if ranges.index(parts[r][:2]) == k}
    return found


def percentile_ranks(n: int, parts: tuple[float, ...]) -> list[int]:
    """The 0-based ranks: of 0.5 the upper middle, of others ``trunc(n * p) - 1``, at least 0."""
    return [n // 2 if p == 0.5 else max(int(n * p), 1) - 1 for p in parts]


def percentiles(df: DataFrame, column: str, parts: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row ``p50, p75, ...`` with ``avg`` and ``max``; exact. Nulls and NaN are ignored; no values give nulls."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, mean, top, low = values.agg(F.count("*"), F.avg("x"), F.max("x"), F.min("x")).first()
    ranks = percentile_ranks(n, parts)
    found = _at_ranks(values, ranks, low, top, n) if n else {}
    row = {f"p{round(p * 100)}": found.get(r) for p, r in zip(parts, ranks, strict=True)}
    names = list(row)
    return df.sparkSession.createDataFrame([(*row.values(), mean, top)], ", ".join(f"{c} double" for c in [*names, "avg", "max"]))


def whole_mean(column: str) -> Column:
    """The mean of whole numbers, cut."""
    return F.expr(f"sum({column}) div count({column})")


def files_per_second(files: Column, millis: Column) -> Column:
    """Cut to a whole number; 0 where no time passed."""
    return F.when(millis == 0, F.lit(0)).otherwise(F.floor(files / (millis / 1000.0))).cast("long")
