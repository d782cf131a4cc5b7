"""Column expressions shared by the operators. All stay inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it.

    Without it, filters pushed through a projection copy long expressions many times over.
    """
    return F.get(F.transform(F.array(value), body), 0)


def known(c) -> Column:
    """Present: not null and none of the words that mean "not known"."""
    c = col(c)
    return c.isNotNull() & ~c.isin(*rules.UNKNOWN_WORDS)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def stamp(value) -> Column:
    """An explicit "now": a literal timestamp without zone, or a column."""
    return F.lit(str(value)).cast("timestamp_ntz") if not isinstance(value, Column) else value


def days(n) -> Column:
    return F.expr(f"make_dt_interval({int(n)})")


def half_up(c, places: int) -> Column:
    """Round half away from zero on eight exact decimals, so that engines agree."""
    return F.round(col(c).cast("decimal(28,8)"), places).cast("double")


def present(c) -> Column:
    """A number that counts as given: not null and not zero."""
    c = col(c)
    return c.isNotNull() & (c != 0)


def price_sqm(price="price", surface="surface") -> Column:
    p, s = col(price), col(surface)
    return F.when(present(p) & present(s), half_up(p / s, 2))


def size_band(surface="surface") -> Column:
    s = col(surface)
    return (F.when(s < 150, "<150").when(s < 500, "150–499")
            .when(s < 1500, "500–1499").when(s >= 1500, "≥1500"))


def inactive(c="availability") -> Column:
    return F.coalesce(col(c).isin(*rules.INACTIVE), F.lit(False))


def closed(c="availability") -> Column:
    return F.coalesce(col(c).isin(*rules.CLOSED), F.lit(False))


def missing(field: str) -> Column:
    """One definition of a missing quality field, used by counts, filters and exports."""
    if field not in rules.QUALITY_FIELDS:
        raise ValueError(f"not a quality field: {field}")
    c = F.col(field)
    if field in ("price", "surface"):
        return c.isNull()
    return c.isNull() | c.isin("", "unknown")


def labels(pairs) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    items = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(label) if isinstance(label, str) else label)
                      for label, cond in pairs])
    return F.filter(items, lambda x: x.isNotNull())


def missing_fields() -> Column:
    return labels([(f, missing(f)) for f in rules.QUALITY_FIELDS])


def completeness() -> Column:
    """Percent of the ten quality fields that are filled."""
    absent = reduce(lambda a, b: a + b, [missing(f).cast("int") for f in rules.QUALITY_FIELDS])
    return ((F.lit(len(rules.QUALITY_FIELDS)) - absent) * (100 // len(rules.QUALITY_FIELDS))).cast("bigint")


def period_year(c) -> Column:
    return F.substring(col(c), 1, 4).cast("int")


def period_half(c) -> Column:
    return F.substring(col(c), -1, 1).cast("int")


def months_since(period, as_of) -> Column:
    """Months from the end of a half-year period (June or December) to ``as_of``."""
    end = F.when(period_half(period) == 1, 6).otherwise(12)
    now = stamp(as_of)
    return (F.year(now) - period_year(period)) * 12 + F.month(now) - end


def future_period(period, as_of) -> Column:
    now = stamp(as_of)
    current = F.year(now) * 2 + F.when(F.month(now) <= 6, 1).otherwise(2)
    return period_year(period) * 2 + period_half(period) > current


def text_stamp(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(col(c), fmt)


def csv_safe(c) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading quote."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c.rlike(r"^\s*[=+\-@]") | c.rlike(r"^[\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def newest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key. Catalyst turns this into a per-partition limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def text_key(*cols) -> Column:
    """Case-insensitive composite key as one string."""
    return F.concat_ws("\u0001", *[F.lower(col(c)) for c in cols])
