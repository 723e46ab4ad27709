"""A join that a hot key can't hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it stands for more than this part of all rows; so at most 1 / HEAVY keys are heavy, whatever the data.
HEAVY = 1 / 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` on ``key``, which is unique in ``right``. ``weight`` of a right row bounds its
    number of left rows, and ``total`` is the sum of all weights.

    Rows of heavy keys meet their right row by a broadcast of at most ``1 / HEAVY`` rows and aren't shuffled; the others
    are shuffled by key, where no key has more than the part ``HEAVY`` of the rows."""
    edge = max(total * HEAVY, 1)
    heavy = F.broadcast(right.where(F.col(weight) > edge))
    hot = left.join(heavy, key)
    rest = left.join(heavy.select(key), key, "left_anti").join(right.where(F.col(weight) <= edge), key)
    return hot.unionByName(rest)
