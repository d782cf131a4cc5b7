"""Unlevered scenario arithmetic over listings and team assumptions, in decimals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import labels

INPUTS = {"purchase": (0, 1e9), "sale": (0, 1e10), "works": (0, 1e9), "acquisition_costs": (0, 1e9), "contingency_pct": (0, 100),
          "selling_pct": (0, 99.99), "holding_monthly": (0, 1e7), "months": (1, 120), "target_roi_pct": (0, 300),
          "stress_sale_pct": (0, 90), "stress_works_pct": (0, 300), "stress_delay_months": (0, 120)}


def _d(c: str) -> Column:
    """An input of a row within bounds; null on the others."""
    return F.when(F.col("_ok"), F.col(c).cast("decimal(20,4)"))


def _money(c: Column) -> Column:
    return F.round(c.cast("decimal(38,10)"), 2).cast("double")


def _floor(c: Column) -> Column:
    return (F.floor(c.cast("decimal(38,10)") * 100) / 100).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    """Quotient of two decimals with eighteen exact places."""
    return a.cast("decimal(20,6)") / b.cast("decimal(20,6)")


def _checked(inputs: DataFrame) -> DataFrame:
    """Adds ``error``, the inputs that are missing or outside their bounds, and ``_ok``."""
    def within(name, low, high):
        above = (F.col(name) > low) if name in ("purchase", "sale") else (F.col(name) >= low)
        return F.coalesce(above & (F.col(name) <= high) & ~F.isnan(F.col(name).cast("double")), F.lit(False))

    outside = labels([(name, ~within(name, low, high)) for name, (low, high) in INPUTS.items()])
    error = F.when(F.size(outside) > 0, F.concat(F.lit("out of bounds: "), F.array_join(outside, ", ")))
    return inputs.withColumn("error", error).withColumn("_ok", F.col("error").isNull())


def _pct(c) -> Column:
    return (c if isinstance(c, Column) else _d(c)) / F.lit(100).cast("decimal(3,0)")


def _outcome(sale_shift=None, works_shift=None, delay=None) -> tuple[Column, Column]:
    """(invested, profit) under shifts given as decimal columns."""
    zero = F.lit(0).cast("decimal(10,4)")
    one = F.lit(1).cast("decimal(1,0)")
    sale_shift, works_shift, delay = (zero if x is None else x for x in (sale_shift, works_shift, delay))
    wide = lambda c: c.cast("decimal(30,8)")
    works = wide(_d("works") * wide(one + _pct(works_shift)))
    sale = wide(_d("sale") * wide(one + _pct(sale_shift)))
    invested = wide(_d("purchase") + _d("acquisition_costs") + wide(works * wide(one + _pct("contingency_pct")))
                    + wide(_d("holding_monthly") * (_d("months") + delay)))
    return invested, wide(wide(sale * wide(one - _pct("selling_pct"))) - invested)


def scenario_profit(inputs: DataFrame) -> DataFrame:
    """Capital, result, ROI, break-even, purchase ceiling and a combined stress per input row.

    Rows with values outside the accepted bounds keep no results and name the inputs in ``error``.
    """
    rows = _checked(inputs)
    invested, profit = _outcome()
    s_invested, s_profit = _outcome(-_d("stress_sale_pct"), _d("stress_works_pct"), _d("stress_delay_months"))
    rows = (rows.withColumn("_i", invested).withColumn("_p", profit).withColumn("_si", s_invested).withColumn("_sp", s_profit))
    one = F.lit(1).cast("decimal(1,0)")
    wide = lambda c: c.cast("decimal(30,8)")
    target = wide(one + _pct("target_roi_pct"))
    net = wide(one - _pct("selling_pct"))

    def ceiling(i, p):
        return _ratio(F.col(i) + F.col(p), target).cast("decimal(30,12)") - (F.col(i) - _d("purchase"))

    keep = [c for c in inputs.columns]
    return rows.select(
        *keep, _money(F.col("_i")).alias("invested"), _money(F.col("_p")).alias("profit"),
        _money(_ratio(F.col("_p") * 100, F.col("_i"))).alias("roi_pct"), _money(_ratio(F.col("_i"), net)).alias("breakeven_sale"),
        _money(_d("sale") * _pct("selling_pct")).alias("selling_costs"), _money(_d("works") * _pct("contingency_pct")).alias("contingency"),
        _floor(ceiling("_i", "_p")).alias("max_purchase"),
        _money(F.greatest(F.lit(0).cast("decimal(30,8)"), _d("purchase") - ceiling("_i", "_p"))).alias("price_reduction_needed"),
        (F.col("_p") * 100 >= _d("target_roi_pct") * F.col("_i")).alias("target_met"),
        _money(F.col("_si")).alias("stress_invested"), _money(F.col("_sp")).alias("stress_profit"),
        _money(_ratio(F.col("_sp") * 100, F.col("_si"))).alias("stress_roi_pct"), _money(_ratio(F.col("_si"), net)).alias("stress_breakeven_sale"),
        _floor(ceiling("_si", "_sp")).alias("stress_max_purchase"),
        (F.col("_sp") * 100 >= _d("target_roi_pct") * F.col("_si")).alias("stress_target_met"), "error")


def sensitivity_grid(inputs: DataFrame) -> DataFrame:
    """Result of each input row under six shifts of sale price and works; ``error`` as in ``scenario_profit``."""
    shifts = F.array(*[F.struct(F.lit(s).alias("sale_change_pct"), F.lit(w).alias("works_change_pct"))
                       for s in (-10, 0, 10) for w in (0, 20)])
    rows = _checked(inputs).withColumn("_s", F.explode(shifts)).select("*", "_s.*").drop("_s")
    dec = lambda c: F.col(c).cast("decimal(10,4)")
    _, profit = _outcome(dec("sale_change_pct"), dec("works_change_pct"))
    return rows.withColumn("profit", _money(profit)).drop("_ok")
