"""Price history: what each listing asked, when, and in which context."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.expr import days, half_up, inactive, known, newest_per, present, stamp

CONTEXT = ["currency", "transaction_type", "area_basis", "surface"]


def with_previous(observations: DataFrame, columns: list[str], key: str = "property_id", at: str = "observed_at",
                  ident: str = "observation_id", grain: str = "day") -> DataFrame:
    """Add ``prev``: the chosen columns of the row before, in (at, ident) order of each key.

    A key may hold a large part of the table, so rows are ordered inside (key, day) and only
    the last row of each day is carried over to the next one. ``prev`` is null for the first row.
    """
    payload = F.struct(*columns)
    bucket = F.date_trunc(grain, F.col(at))
    rows = observations.withColumn("_bucket", bucket).withColumn("_row", payload)
    tails = rows.groupBy(key, "_bucket").agg(F.max_by("_row", F.struct(at, ident)).alias("_tail"))
    tails = tails.withColumn("_carried", F.lag("_tail").over(Window.partitionBy(key).orderBy("_bucket"))).drop("_tail")
    inside = Window.partitionBy(key, "_bucket").orderBy(at, ident)
    out = rows.withColumn("_inside", F.lag("_row").over(inside)).join(tails, [key, "_bucket"])
    return out.withColumn("prev", F.coalesce("_inside", "_carried")).drop("_bucket", "_row", "_inside", "_carried")


def _same_known(columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        value = F.col(c)
        usable = value.isNotNull() if c == "surface" else known(c)
        test = test & usable & F.coalesce(value == F.col("prev")[c], F.lit(False))
    return test


def price_changes(observations: DataFrame, as_of, since_days: int = 30, window_days: int = 90) -> DataFrame:
    """Latest price drop of each listing between consecutive rows of unchanged, known context."""
    now = stamp(as_of)
    recent = observations.where(F.col("observed_at") >= now - days(window_days))
    rows = with_previous(recent, ["price", *CONTEXT])
    drops = rows.where(_same_known(CONTEXT) & (F.col("observed_at") >= now - days(since_days))
                       & present("price") & present("prev.price") & (F.col("price") < F.col("prev.price")))
    last = newest_per(drops, ["property_id"], [F.desc("observed_at"), F.desc("observation_id")])
    return last.select("property_id", F.col("prev.price").alias("previous_price"), "price", "currency",
                       half_up((F.col("prev.price") - F.col("price")) / F.col("prev.price") * 100, 1).alias("reduction_pct"),
                       "observed_at")


def top_reductions(changes: DataFrame, n: int = 20) -> DataFrame:
    return changes.orderBy(F.desc("reduction_pct"), F.asc("property_id")).limit(n)


def price_reductions(observations: DataFrame, listings: DataFrame) -> DataFrame:
    """Per listing: step-downs in equal context, highest comparable ask, total change, last drop."""
    rows = with_previous(observations, ["price", "currency", "transaction_type"])
    comparable = F.col("currency").isNotNull() & (F.col("currency") != "XXX") & F.col("transaction_type").isin("sale", "rent")
    same = (F.col("currency") == F.col("prev.currency")) & (F.col("transaction_type") == F.col("prev.transaction_type"))
    drop = F.coalesce(comparable & same & (F.col("price") < F.col("prev.price")), F.lit(False))
    steps = rows.withColumn("_drop", drop).groupBy("property_id").agg(
        F.sum(F.col("_drop").cast("bigint")).alias("reductions"), F.max(F.when(F.col("_drop"), F.col("observed_at"))).alias("last_drop_at"))
    # The highest ask counts only in the context of the listing today.
    highs = (observations.where(comparable & F.col("price").isNotNull())
             .groupBy("property_id", "currency", "transaction_type").agg(F.max("price").alias("highest")))
    own = listings.select(F.col("id").alias("property_id"), "currency", "transaction_type", F.col("price").alias("current_price"))
    total = F.when(F.col("current_price").isNotNull() & present("highest") & (F.col("current_price") < F.col("highest")),
                   half_up((F.col("current_price") / F.col("highest") - 1) * 100, 1))
    return (own.join(highs, ["property_id", "currency", "transaction_type"], "left").join(steps, "property_id", "left")
            .select("property_id", F.coalesce("reductions", F.lit(0).cast("bigint")).alias("reductions"), total.alias("total_pct"),
                    F.when(total.isNotNull(), F.col("highest")).alias("from_price"), "last_drop_at"))


def observed_price_change() -> Column:
    """Percent between stored asks, only in an unchanged and known measurement context."""
    now, prior = F.col("fields"), F.col("prev.fields")
    ok = (prior["currency"].isNotNull() & ~prior["currency"].isin("", "XXX") & prior["transaction_type"].isin("sale", "rent")
          & prior["area_basis"].isin("commercial", "gross", "net"))
    for c in ("price", "surface"):
        ok = ok & (now[c] > 0) & (prior[c] > 0)
    for c in CONTEXT:
        ok = ok & (now[c] == prior[c])
    change = half_up((now["price"] / prior["price"] - 1) * 100, 1)
    return F.when(ok & (change != 0), change)


def observation_history(observations: DataFrame) -> DataFrame:
    """Every observation with its field-by-field changes against the row before."""
    rows = with_previous(observations.withColumn("has_evidence", F.col("fields").isNotNull()), ["observation_id", "fields"])
    now, prior = F.col("fields"), F.col("prev.fields")
    both = now.isNotNull() & prior.isNotNull()
    changes = F.filter(F.array(*[
        F.when(both & ~now[f].eqNullSafe(prior[f]), F.struct(F.lit(f).alias("field"), prior[f].cast("string").alias("before"),
                                                              now[f].cast("string").alias("after")))
        for f in rules.OBSERVED_FIELDS]), lambda x: x.isNotNull())
    return rows.select("property_id", "observation_id", "observed_at", "parser_version",
                       F.col("prev").isNull().alias("baseline"), "has_evidence", both.alias("comparable"),
                       changes.alias("changes"), observed_price_change().alias("price_change_pct"))


def history_page(observations: DataFrame, property_id: str, before: tuple | None = None, limit: int = 30) -> DataFrame:
    """One page of a listing's history, newest first, with one row more to show there is a next page."""
    rows = observation_history(observations.where(F.col("property_id") == property_id))
    if before is not None:
        at, ident = stamp(before[0]), F.lit(before[1])
        rows = rows.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("observation_id") < ident)))
    return rows.orderBy(F.desc("observed_at"), F.desc("observation_id")).limit(limit + 1)


def history_coverage(observations: DataFrame) -> DataFrame:
    return observations.groupBy("property_id").agg(F.count(F.lit(1)).alias("total"), F.count("fields").alias("with_fields"))


def history_price_delta(observations: DataFrame) -> DataFrame:
    """Absolute change for the report, only against a row of the same known context."""
    rows = with_previous(observations, ["price", "currency", "transaction_type", "fields"])
    comparable = F.coalesce(F.col("currency") != "XXX", F.lit(False)) & F.col("transaction_type").isin("sale", "rent")
    same = (F.col("currency") == F.col("prev.currency")) & (F.col("transaction_type") == F.col("prev.transaction_type"))
    return rows.select("property_id", "observation_id", "observed_at", "price", "currency",
                       F.when(comparable & same, half_up(F.col("price") - F.col("prev.price"), 2)).alias("price_delta"),
                       "content_hash", "transaction_type", observed_price_change().alias("price_change_pct"))


def observation_context_join(observations: DataFrame, context: DataFrame) -> DataFrame:
    """Observations with their context where it was recorded; old rows keep nulls."""
    return observations.join(context, "observation_id", "left")


def reduced_semi(listings: DataFrame, observations: DataFrame) -> DataFrame:
    """Live listings that once asked more in the same currency and transaction."""
    highs = (observations.groupBy(F.col("property_id").alias("id"), "currency", "transaction_type")
             .agg(F.max("price").alias("_high")))
    # One row per context: the semi-join never meets a listing's whole history.
    return (listings.where(~inactive()).join(highs, ["id", "currency", "transaction_type"], "left")
            .where(F.col("_high") > F.col("price")).drop("_high"))
