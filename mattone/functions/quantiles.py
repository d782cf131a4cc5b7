"""Exact quantiles per group without holding a group in one task.

``percentile`` keeps every distinct value of a group in one buffer, which fails when one
group holds a large part of the table. Here values are pre-aggregated, counted in narrow
value buckets, and only the buckets that contain a wanted rank are opened.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import half_up

BUCKETS_PER_E_FOLD = 1000


def value_bucket(value: Column) -> Column:
    """Monotone bucket of a positive number, about 0.1 % wide."""
    return F.floor(F.log(value) * BUCKETS_PER_E_FOLD).cast("bigint")


def group_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    places: int | None = None) -> DataFrame:
    """``keys`` plus one column per quantile (linear interpolation between neighbours).

    Rows with a null or non-positive value are ignored. The bucket histogram of one key has
    a bounded number of rows, so its running total is a small window; the values themselves
    are ranked inside (key, bucket).
    """
    values = (df.where(F.col(value) > 0).withColumn("_bucket", value_bucket(F.col(value)))
              .groupBy(*keys, "_bucket", value).agg(F.count(F.lit(1)).alias("_c")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_end", F.sum("_c").over(inside))
    histogram = values.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (histogram.withColumn("_base", F.sum("_n").over(running) - F.col("_n"))
                 .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_total") - 1) * F.lit(q)).alias("position"))
                       for name, q in quantiles.items()])
    targets = (histogram.withColumn("_q", F.explode(wanted))
               .where((F.floor("_q.position") < F.col("_base") + F.col("_n"))
                      & (F.least(F.floor("_q.position") + 1, F.col("_total") - 1) >= F.col("_base")))
               .select(*keys, "_bucket", "_base", "_total", F.col("_q.name").alias("_name"),
                       F.col("_q.position").alias("_position")))
    picked = (ranked.join(targets, [*keys, "_bucket"])
              .withColumn("_last", F.col("_base") + F.col("_end") - 1)
              .withColumn("_first", F.col("_last") - F.col("_c") + 1)
              .withColumn("_low", F.floor("_position"))
              .withColumn("_high", F.least(F.col("_low") + 1, F.col("_total") - 1)))
    low = F.max(F.when(F.col("_low").between(F.col("_first"), F.col("_last")), F.col(value)))
    high = F.max(F.when(F.col("_high").between(F.col("_first"), F.col("_last")), F.col(value)))
    solved = (picked.groupBy(*keys, "_name", "_position", "_low")
              .agg(low.alias("_a"), high.alias("_b"))
              .withColumn("_v", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_position") - F.col("_low"))))
    out = [F.max(F.when(F.col("_name") == name, half_up("_v", places) if places is not None else F.col("_v"))).alias(name)
           for name in quantiles]
    return solved.groupBy(*keys).agg(*out)
