"""Positions and successors inside a group, computed block by block.

A window partitioned by log would put a whole log into one task. Here every group is first
divided into consecutive blocks; rows are ordered inside their block only, and a second,
much smaller window over one or two rows per block joins the blocks up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrends.session import store_table

ROWS_PER_BLOCK = 50_000
_BEFORE_ALL = -(2**62)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; keeps the key columns of the left side only."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def number_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], block: Column, name: str) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    ``block`` must be a number that never falls along ``order_by``; it decides how far a
    large group is spread over tasks.
    """
    blocked = df.withColumn("_block", F.coalesce(block.cast("bigint"), F.lit(_BEFORE_ALL)))
    by_block = [*keys, "_block"]
    inside = F.row_number().over(Window.partitionBy(*by_block).orderBy(*order_by))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*by_block)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by_block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        join_null_safe(blocked.withColumn("_inside", inside), offsets, by_block)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_block", "_inside", "_offset")
    )


def with_next(df: DataFrame, keys: Sequence[str], order_col: str, values: dict[str, str],
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``values[new] = old`` of the following row of the same group (null on the last row).

    ``order_col`` is a dense or nearly dense position, so that ``position / rows_per_block``
    bounds the size of a block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order_col) / rows_per_block))
    block = Window.partitionBy(*keys, "_block").orderBy(order_col)
    inside = blocked.select(
        "*",
        F.lag(order_col).over(block).isNull().alias("_first"),
        F.lead(order_col).over(block).isNull().alias("_last"),
        *[F.lead(old).over(block).alias(new) for new, old in values.items()],
    )
    ends = inside.filter("_first or _last")
    across = Window.partitionBy(*keys).orderBy(order_col)
    for new, old in values.items():
        ends = ends.withColumn(new, F.lead(old).over(across))
    return (
        inside.filter("not _last")
        .unionByName(ends.filter("_last"))
        .drop("_block", "_first", "_last")
    )


def number_all(df: DataFrame, order_by: Sequence[Column], name: str, weight: str | None = None) -> DataFrame:
    """Global 0-based position in sorted order, or the sum of ``weight`` over all earlier rows.

    The rows are spread by range, so no task sees more than its share; only one number per
    range meets in a single window. The ranges are stored, because their borders are
    sampled and must not be drawn twice. ``df`` is read twice and should be cheap to read.
    """
    amount = F.col(weight) if weight else F.lit(1)
    ranged = store_table(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range").agg(F.sum(amount).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy("_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(offsets, "_range")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )
