"""Archive search: filters, orders, pages, facets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.expr import days, inactive, missing, stamp
from ..functions.ranks import with_position

SORTS = {
    "score": lambda: [F.desc("priority_score"), F.desc("last_seen"), F.asc("id")],
    "price": lambda: [F.asc("currency"), F.asc_nulls_last("price"), F.asc("id")],
    "latest": lambda: [F.desc("last_seen"), F.asc("id")],
    "newest": lambda: [F.desc("first_seen"), F.asc("id")],
    "listed": lambda: [F.asc("first_seen"), F.asc("id")],
    "quality": lambda: [F.desc("completeness"), F.asc("id")],
    "due": lambda: [F.asc_nulls_last("due_date"), F.asc("id")],
}
SEARCHED = ["title", "city", "zone", "address", "listing_key"]


def _stage_open() -> Column:
    return ~F.col("review_status").isin("acquired", "discarded")


def literal_search(q: str, fields=SEARCHED) -> Column:
    """The text as written, in any of the fields; wildcards have no meaning."""
    hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q.strip().lower()) for c in fields]
    test = hits[0]
    for h in hits[1:]:
        test = test | h
    return test


def availability_filter(value: str) -> Column:
    if value == "all":
        return F.lit(True)
    return ~inactive() if value == "open" else F.col("availability") == value


def catalog_filter(df: DataFrame, *, as_of=None, q: str = "", city: str = "", type: str = "", status: str = "",
                   source_id: str = "", currency: str = "", availability: str = "open", missing_field: str = "",
                   min_price=None, max_price=None, min_surface=None, max_surface=None, starred: bool = False,
                   focus: str = "all", strategy: str = "", strategies: DataFrame | None = None, agent_id: str = "",
                   qualified: bool = False, memberships: DataFrame | None = None, observations: DataFrame | None = None) -> DataFrame:
    """Conjunction of the given filters; only those asked for reach the plan."""
    for low, high, name in ((min_price, max_price, "price"), (min_surface, max_surface, "surface")):
        if low is not None and high is not None and low > high:
            raise ValueError(f"minimum {name} above maximum")
    if (min_price is not None or max_price is not None) and not currency:
        raise ValueError("a price range needs a currency")
    out = df.where(availability_filter(availability))
    if missing_field:
        out = out.where(missing(missing_field))
    for column, value in (("city", city), ("property_type", type), ("review_status", status), ("source_id", source_id),
                          ("currency", currency)):
        if value:
            out = out.where(F.lower(column) == value.lower())
    if q.strip():
        out = out.where(literal_search(q))
    if starred:
        out = out.where("starred")
    for name, low, high in (("price", min_price, max_price), ("surface", min_surface, max_surface)):
        if low is not None:
            out = out.where(F.col(name) >= low)
        if high is not None:
            out = out.where(F.col(name) <= high)
    if strategy:
        out = strategy_semi(out, strategies, strategy)
    if agent_id or qualified:
        out = agent_semi(out, memberships, agent_id, qualified)
    return focus_filter(out, focus, as_of, observations)


def focus_filter(df: DataFrame, focus: str, as_of, observations: DataFrame | None = None) -> DataFrame:
    """One work view: new, stale, reduced, below, unbenchmarked, overdue, unassigned or portal."""
    if focus == "all":
        return df
    if focus == "reduced":
        from .history import reduced_semi
        return reduced_semi(df, observations)
    tests = {
        "new": lambda: F.col("first_seen") >= stamp(as_of) - days(7),
        "stale": lambda: F.col("last_seen") < stamp(as_of) - days(7),
        "below": lambda: F.col("discount") >= 10,
        "unbenchmarked": lambda: F.col("benchmark_id").isNull(),
        "overdue": lambda: (F.col("due_date") < F.date_format(stamp(as_of), "yyyy-MM-dd")) & _stage_open(),
        "unassigned": lambda: F.col("owner_id").isNull() & _stage_open(),
        "portal": lambda: pending_card() & _stage_open(),
    }
    return df.where(tests[focus]())


def pending_card() -> Column:
    """Known only from a portal card and still to be opened."""
    return F.coalesce(F.col("portal_card.incomplete"), F.lit(False))


def strategy_semi(df: DataFrame, strategies: DataFrame, strategy: str) -> DataFrame:
    wanted = strategies.where(F.col("strategy") == strategy).select(F.col("property_id").alias("id"))
    return df.join(wanted, "id", "left_semi")


def agent_semi(df: DataFrame, memberships: DataFrame, agent_id: str = "", qualified: bool = False) -> DataFrame:
    """Listings linked to a search; agent and fit must hold on the same link."""
    links = memberships
    if agent_id:
        links = links.where(F.col("agent_id") == agent_id)
    if qualified:
        links = links.where("fit")
    return df.join(links.select("id"), "id", "left_semi")


def catalog_sort(df: DataFrame, key: str = "score") -> DataFrame:
    return df.orderBy(*SORTS[key]())


def catalog_page(df: DataFrame, page: int, size: int, key: str = "score") -> DataFrame:
    """One page in a total order. A page past the end shows the last one.

    The driver sees one count; rows up to the page end are found by a distributed top-k.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(page, 1), pages)
    return (catalog_sort(df, key).offset((at - 1) * size).limit(size)
            .withColumn("total", F.lit(total).cast("bigint")).withColumn("page", F.lit(at).cast("bigint"))
            .withColumn("pages", F.lit(pages).cast("bigint")))


def keyset_page(df: DataFrame, at: str, ident: str, limit: int, before: tuple | None = None) -> DataFrame:
    """Newest rows after a cursor, one more than asked so that a next page shows."""
    if before is not None:
        t, i = (stamp(before[0]), F.lit(before[1]))
        df = df.where((F.col(at) < t) | ((F.col(at) == t) & (F.col(ident) < i)))
    return df.orderBy(F.desc(at), F.desc(ident)).limit(limit + 1)


def export_guard(df: DataFrame, limit: int = 2000) -> DataFrame:
    """Refuse an export above the limit instead of cutting it."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} listings: narrow the filters, no export is cut")
    return df


def select_by_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """The named listings in the order asked for."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, ident) for i, ident in enumerate(ids)], "pos int, id string")
    return df.join(wanted, "id").orderBy("pos")


def short_list(df: DataFrame, *, city: str = "", q: str = "", status: str = "", starred: bool = False, agent_id: str = "",
               memberships: DataFrame | None = None) -> DataFrame:
    """Short form of the search: three text fields, best score first, unscored last."""
    out = df
    if city:
        out = out.where(F.lower("city") == city.lower())
    if q:
        out = out.where(literal_search(q, ["title", "address", "city"]))
    if starred:
        out = out.where("starred")
    if status:
        out = out.where(F.col("review_status") == status)
    if agent_id:
        out = agent_semi(out, memberships, agent_id)
    return out.orderBy(F.desc_nulls_last("score"), F.desc("last_seen"), F.asc("id"))


def facets(df: DataFrame) -> DataFrame:
    """Cities without regard to case, known currencies and the archive total, as rows."""
    cities = (df.where(F.col("city") != "").groupBy(F.lower("city").alias("_k")).agg(F.min("city").alias("value"), F.count(F.lit(1)).alias("n"))
              .select(F.lit("city").alias("facet"), "value", "n"))
    currencies = (df.where(F.col("currency") != "XXX").groupBy(F.col("currency").alias("value")).agg(F.count(F.lit(1)).alias("n"))
                  .select(F.lit("currency").alias("facet"), "value", "n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("facet"), F.lit("").alias("value"), "n")
    return cities.unionByName(currencies).unionByName(total)


def benchmark_catalog(benchmarks: DataFrame, q: str = "", condition: str = "", currency: str = "") -> DataFrame:
    """Benchmark inventory in report order."""
    out = benchmarks
    if q.strip():
        out = out.where(literal_search(q, ["city", "zone", "source_label"]))
    if condition:
        out = out.where(F.col("condition") == condition)
    if currency:
        out = out.where(F.col("currency") == currency)
    return out.orderBy("city", "zone", F.desc("period"), "id")


def listing_source_work(listings: DataFrame, sources: DataFrame, work: DataFrame) -> DataFrame:
    """Listings with source name and the team's work row, if any."""
    w = work.select(F.col("property_id").alias("id"), "owner_id", "due_date", F.col("version").alias("_version"))
    return (listings.join(sources.select("source_id", "source_name"), "source_id").join(w, "id", "left")
            .withColumn("work_version", F.coalesce("_version", F.lit(0).cast("bigint"))).drop("_version"))


def work_listing(listings: DataFrame, work: DataFrame, team: DataFrame, as_of) -> DataFrame:
    """Work board: stage, owner name and whether the due date has passed."""
    w = work.select(F.col("property_id").alias("id"), "owner_id", "due_date")
    t = team.select(F.col("user_id").alias("owner_id"), "user_name")
    out = listings.join(w, "id", "left").join(t, "owner_id", "left")
    late = _stage_open() & F.coalesce(F.col("due_date") < F.date_format(stamp(as_of), "yyyy-MM-dd"), F.lit(False))
    owner = F.when(F.col("owner_id").isNull(), "").otherwise(F.coalesce("user_name", F.lit("Responsabile non disponibile")))
    return out.withColumn("owner", owner).withColumn("late", late)


def pipeline_order(board: DataFrame) -> DataFrame:
    """The board with ``position``: open before closed, late first, then due date, priority, id."""
    return with_position(board, [F.asc(~_stage_open()), F.desc("late"), F.asc(F.coalesce("due_date", F.lit("9999"))),
                                 F.desc(F.coalesce("priority_score", F.lit(-1))), F.asc("id")])


def next_best(listings: DataFrame, queued: DataFrame, n: int = 5) -> DataFrame:
    """Best listings by priority that are not in the queue yet."""
    return (listings.where(~inactive() & _stage_open()).join(queued.select("id"), "id", "left_anti")
            .orderBy(F.desc("priority_score"), F.asc("id")).limit(n))


def overdue_list(listings: DataFrame, work: DataFrame, team: DataFrame, as_of, n: int = 20) -> DataFrame:
    board = listings.join(work.select(F.col("property_id").alias("id"), "owner_id", "due_date"), "id")
    return (board.where(_stage_open() & (F.col("due_date") < F.date_format(stamp(as_of), "yyyy-MM-dd")))
            .join(team.select(F.col("user_id").alias("owner_id"), "user_name"), "owner_id", "left")
            .select("id", "title", "city", "due_date", F.col("user_name").alias("owner"))
            .orderBy("due_date", "id").limit(n))


def due_for_refresh(listings: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """Known listings to read again: not closed, incomplete or read too long ago."""
    now = stamp(as_of)
    joined = listings.where(~F.col("availability").isin(*rules.CLOSED)).join(sources.select("source_id", "refresh_hours"), "source_id")
    cutoff = now - F.make_dt_interval(F.lit(0), F.col("refresh_hours"))
    gap = ((F.col("availability") == "unknown") | F.col("city").isNull() | (F.col("city") == "")
           | F.col("price").isNull() | (F.col("price") == 0) | F.col("surface").isNull() | (F.col("surface") == 0))
    return joined.where(gap | F.col("last_detail_at").isNull() | (F.col("last_detail_at") <= cutoff))


def attach_memberships(listings: DataFrame, memberships: DataFrame, searches: DataFrame) -> DataFrame:
    """Listings with their searches: name, fit and reasons, in search order.

    Links of one listing are few: one per saved search of its city.
    """
    links = memberships.join(searches.select("agent_id", "agent_name", "custom_prompt"), "agent_id")
    grouped = links.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        "agent_id", "agent_name", "fit", "reasons", "custom_prompt"))).alias("search_matches"))
    return listings.join(grouped, "id", "left")
