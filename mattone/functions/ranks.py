"""Positions in a total order without sorting in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` plus the place (from 1) of each row in ``order``.

    Rows are dealt over tasks by ranges of the order and written with the number of their range. The rows of each range
    are counted, the counts of the ranges before it (one line per task) are its offset, and a row's place is the offset
    plus its rank in the range. Rows that tie in all of ``order`` get different places in no particular order, so the
    order should end in an id. An empty table gives an empty result.
    """
    part, before, rank = (f"{name}_{x}" for x in ("range", "before", "rank"))
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select(part, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(before))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return ranked.join(offsets, part).withColumn(name, F.col(before) + F.col(rank)).drop(part, before, rank)


def with_position_in(df: DataFrame, key: str, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` plus the place of each row among the rows of its ``key``: the place in the order of all rows less that of
    the key's first row. A key of any size is spread over the ranges that it spans; a null key is one of its own."""
    first, known = f"{name}_first", f"{name}_key"
    placed = with_position(df, [F.asc(key), *order], name)
    starts = placed.groupBy(F.col(key).alias(known)).agg(F.min(name).alias(first))
    both = placed.join(starts, F.col(key).eqNullSafe(F.col(known)))
    return both.withColumn(name, F.col(name) - F.col(first) + 1).drop(first, known)
