"""Running totals over tables of any size: range partitions, a window in each, and one small window over their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.shared import written

PLACE = "_place"


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, written, with `_place`: the number of a row's range in the order. Spark cuts the ranges by a sample, as many as shuffles have
    partitions; with the order's last column unique no range holds much more than another."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    return written(df.repartitionByRange(*keys).withColumn(PLACE, F.spark_partition_id()))


def prefix_sums(df: DataFrame, order: str | list[str | Column], value: str, name: str, by: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """df with the sum of `value` over all rows before this one in the order, up to this one if inclusive; of each group `by`, if given.

    The order should end with a unique key. A row costs the same however many there are: two shuffles, and windows of a range
    each. The window over the ranges' totals has a row for each range, and for each group that meets it.
    """
    by, keys = by or [], [order] if isinstance(order, str) else list(order)
    at = ranged(df, *by, *keys)
    last = W.currentRow if inclusive else -1
    sums = at.groupBy(*by, PLACE).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy(PLACE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*by, PLACE, before.alias("_start"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*by, PLACE).orderBy(*keys).rowsBetween(W.unboundedPreceding, last)), F.lit(0))
    rows = at.withColumn("_in", inside).join(starts if by else F.broadcast(starts), [*by, PLACE])
    return rows.withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop(PLACE, "_in", "_start")


def ranks(df: DataFrame, order: str | list[str | Column], name: str, by: list[str] | None = None) -> DataFrame:
    """df with each row's place in the order, from 0; of each group `by`, if given."""
    one = F.lit(1).cast("long")
    return prefix_sums(df.withColumn("_one", one), order, "_one", name, by).drop("_one")
