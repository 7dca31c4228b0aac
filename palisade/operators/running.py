"""Running aggregates of long sequences in two levels."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that share a block.
BLOCK = 4096


def running_sums(rows: DataFrame, keys: list[str], order: str, sums: Mapping[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the same keys up to and including this one.

    ``order`` is a whole number that is unique within the keys.  Blocks of it are
    summed first and only one row a block is ordered by key as a whole, so the
    rows of one long sequence are spread over tasks.
    """
    part = F.floor(F.col(order) / block)
    blocks = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), part.alias("_b")).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*(f"_k{i}" for i in range(len(keys))), "_b", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), part == F.col("_b"))
    here = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, same).select(*rows.columns, *((F.col(f"_t_{n}") + F.sum(c).over(here)).alias(n) for n, c in sums.items()))
