"""Versioned upserts: batches of listings, detail pages and portal cards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.expr import all_of, closed, known, stamp
from ..session import over_tasks

CONTENT = ["url", "title", "city", "zone", "address", "property_type", "condition", "price", "surface", "rooms", "bathrooms",
           "latitude", "longitude", "area_basis", "currency", "transaction_type", "description", "availability", "is_auction"]


def content_hash(*extra: str) -> Column:
    """Hash of the listing as stated, nulls kept apart from empty text."""
    return F.sha2(F.to_json(F.struct(*CONTENT, *extra), {"ignoreNullFields": "false"}), 256)


def sticky_closed(old: Column, new: Column) -> Column:
    """A closed listing is not reopened by a weaker statement."""
    return F.when(closed(old) & ~closed(new), old).otherwise(new)


def gone_page(availability: Column, http_status: Column) -> Column:
    """A known page that answers 404 or 410 is to be checked, not sold."""
    return F.when(http_status.isin(404, 410), F.lit("review")).otherwise(availability)


KEY = ["source_id", "listing_key"]


def _statements(batch: DataFrame) -> tuple[DataFrame, list[str]]:
    """Each different statement of a batch once, with what the batch itself said of its key up to there, and the
    columns that order the statements of one key.

    ``gone``: the page is missing. ``held``: the content of the last page read so far, null if there is none yet, with
    ``held._prior``, the availability that a closed statement or a missing page of this batch had set before it.
    """
    order = [c for c in ("batch_order", "read_at") if c in batch.columns]
    if "http_status" not in batch.columns:
        batch = batch.withColumn("http_status", F.lit(200))
    columns = [*order, *CONTENT, "http_status"]
    in_order = Window.partitionBy(*KEY).orderBy(*columns)
    before, so_far = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.col("http_status").isin(404, 410), F.lit(False))
    said = F.when(gone, F.lit("review")).when(closed(), F.col("availability"))
    # Equal statements of a key stand side by side in this order and go there: an aggregate would hold whole rows of the input in
    # each task ahead of the shuffle. Adding zero makes -0.0 the 0.0 that it equals.
    zero = {f.name: F.lit(0).cast(f.dataType) for f in batch.select(*columns).schema if f.dataType.typeName() in ("double", "float")}
    # Text that packs well would else be put together to a few tasks that sort far more than they read.
    rows = over_tasks(batch.select(*KEY, *[(F.col(c) + zero[c]).alias(c) if c in zero else F.col(c) for c in columns]), *KEY)
    # Column by column: a struct of them would be sorted beside them.
    again = all_of([F.row_number().over(in_order) > 1, *[F.lag(c).over(in_order).eqNullSafe(F.col(c)) for c in columns]])
    rows = rows.withColumn("_again", again).where("NOT _again").drop("_again")
    rows = rows.withColumn("gone", gone).withColumn("_prior", F.last(said, ignorenulls=True).over(before))
    return rows.withColumn("held", F.last(F.when(~F.col("gone"), F.struct(*CONTENT, "_prior")), ignorenulls=True).over(so_far)), columns


def _resolved(both: DataFrame, *keep: str) -> DataFrame:
    """Statements beside what the archive knew (``o_`` columns): content, availability and hash as they then stand.

    A missing page moves the availability of a known listing and says nothing about a listing nobody knows.
    """
    read = F.col("held").isNotNull()
    both = both.where(~(F.coalesce("gone", F.lit(False)) & ~read & F.col("o_content_hash").isNull()))
    columns = {c: F.when(read, F.col("held")[c]).otherwise(F.col("o_" + c)) for c in CONTENT}
    prior = F.coalesce(F.col("held._prior"), F.col("o_availability"))
    columns["availability"] = F.when(read, sticky_closed(prior, F.col("held.availability"))).otherwise(F.col("o_availability"))
    rows = both.select(*KEY, *keep, *[v.alias(c) for c, v in columns.items()], "o_first_seen", "o_last_seen", F.col("o_content_hash").alias("previous_hash"),
                       F.col("o_price").alias("previous_price"), F.col("o_availability").alias("previous_availability"),
                       F.coalesce("gone", F.lit(False)).alias("_gone"), read.alias("_read"))
    hashed = rows.withColumn("content_hash", F.when(F.col("_read"), content_hash()).otherwise(F.col("previous_hash")))
    return hashed.withColumn("availability", F.when(F.col("_gone"), "review").otherwise(F.col("availability")))


def _known(current: DataFrame) -> DataFrame:
    return current.select(*KEY, *[F.col(c).alias("o_" + c) for c in (*CONTENT, "first_seen", "last_seen", "content_hash")])


def _changed() -> Column:
    moved = F.col("_gone") & ~F.col("availability").eqNullSafe(F.col("previous_availability"))
    return F.col("previous_hash").isNull() | (F.col("_read") & (F.col("content_hash") != F.col("previous_hash"))) | moved


def merge_listings(current: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """Full-outer merge on (source_id, listing_key) into the new current table.

    ``batch`` may state a key more than once; statements go by ``batch_order``, then ``read_at``, then content, so that
    reruns agree, and the last one stands, except that a closed listing is not reopened by a later statement of the same
    batch either. Added columns: ``in_batch``, ``created``, ``changed`` and ``previous_price``/``previous_availability``.
    Rows with an HTTP status of 404/410 only move the availability of a known listing. The statements of one key are
    sorted in one task.
    """
    stated, order = _statements(batch)
    newest = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in order])
    last = stated.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select(*KEY, "gone", "held", F.lit(True).alias("_new"))
    rows = _resolved(_known(current).join(last, KEY, "full"), "_new")
    now = stamp(as_of)
    return (rows.withColumn("first_seen", F.coalesce("o_first_seen", now)).withColumn("last_seen", F.when(F.col("_read"), now).otherwise(F.col("o_last_seen")))
            .withColumn("in_batch", F.coalesce("_new", F.lit(False))).withColumn("created", F.col("previous_hash").isNull()).withColumn("changed", _changed())
            .drop("_read", "_gone", "_new", "o_first_seen", "o_last_seen"))


def version_observations(current: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """Observation rows to append for a batch that may state a key more than once: one per statement that changed what
    stood before it, in the archive or in the batch, with ``version`` (from 1) per key. ``observed_at`` is the
    statement's ``read_at`` where the batch has it, else ``as_of``."""
    stated, order = _statements(batch)
    in_order = Window.partitionBy(*KEY).orderBy(*order)
    placed = stated.withColumn("_place", F.row_number().over(in_order))
    when = F.coalesce(F.col("read_at"), stamp(as_of)) if "read_at" in order else stamp(as_of)
    rows = _resolved(placed.withColumn("_when", when).join(_known(current), KEY, "left"), "_place", "_when")
    by_place = Window.partitionBy(*KEY).orderBy("_place")
    rows = (rows.withColumn("_h", F.lag("content_hash").over(by_place)).withColumn("_a", F.lag("availability").over(by_place))
            .withColumn("previous_availability", F.when(F.col("_h").isNull(), F.col("previous_availability")).otherwise(F.col("_a")))
            .withColumn("previous_hash", F.coalesce("_h", "previous_hash")))
    changed = rows.where(_changed()).withColumn("version", F.row_number().over(by_place).cast("bigint"))
    ident = F.sha2(F.concat_ws("|", "source_id", "listing_key", "content_hash", F.lit(str(as_of)), "version"), 256)
    return changed.select(ident.alias("observation_id"), *KEY, "version", F.col("_when").alias("observed_at"), "price", "availability", "currency", "transaction_type",
                          "area_basis", "surface", "content_hash", F.struct(*[F.col(c) for c in rules.OBSERVED_FIELDS]).alias("fields"))


def new_observations(merged: DataFrame, as_of) -> DataFrame:
    """Observation rows to append: one per created or changed listing of the batch."""
    fields = F.struct(*[F.col(c) for c in rules.OBSERVED_FIELDS])
    ident = F.sha2(F.concat_ws("|", "source_id", "listing_key", "content_hash", F.lit(str(as_of))), 256)
    return merged.where("in_batch and changed").select(
        ident.alias("observation_id"), "source_id", "listing_key", stamp(as_of).alias("observed_at"), "price", "currency",
        "transaction_type", "area_basis", "surface", "content_hash", fields.alias("fields"))


def notifications(merged: DataFrame, run_id: str | Column) -> DataFrame:
    """Messages a merge gives rise to, each with the key that keeps it unique."""
    run_id = F.lit(run_id) if isinstance(run_id, str) else run_id
    pid = F.concat_ws(":", "source_id", "listing_key")
    moved = ~F.col("availability").eqNullSafe(F.col("previous_availability")) & ~F.col("created")
    priced = ~F.col("price").eqNullSafe(F.col("previous_price"))
    kinds = F.filter(F.array(
        F.when(F.col("created"), F.struct(F.lit("new_property").alias("kind"), F.concat_ws(":", F.lit("new_property"), pid, "content_hash", run_id).alias("dedupe_key"))),
        F.when(~F.col("created") & F.col("changed") & priced, F.struct(F.lit("price_change").alias("kind"), F.concat_ws(":", F.lit("price_change"), pid, "content_hash", run_id).alias("dedupe_key"))),
        F.when(moved & closed(), F.struct(F.lit("availability_change").alias("kind"), F.concat_ws(":", F.lit("availability"), pid, "content_hash").alias("dedupe_key"))),
        F.when(moved & (F.col("availability") == "review"), F.struct(F.lit("availability_change").alias("kind"), F.concat_ws(":", F.lit("unavailable"), pid, "content_hash").alias("dedupe_key"))),
    ), lambda x: x.isNotNull())
    return merged.where("in_batch").select("source_id", "listing_key", "title", F.explode(kinds).alias("n")).select(
        "source_id", "listing_key", "title", "n.kind", "n.dedupe_key")


def page_snapshots(merged: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw pages to keep: only those whose content is new or changed."""
    keep = merged.where("in_batch and changed").select("source_id", "listing_key", "content_hash")
    return pages.join(keep, ["source_id", "listing_key"])


def complete_from_detail(cards: DataFrame, details: DataFrame) -> DataFrame:
    """A detail page over an earlier card: the page wins, the card fills blanks, "incomplete" closes."""
    key = ["source_id", "listing_key"]
    fields = [c for c in rules.CARD_FIELDS if c != "title"]
    card = cards.select(*key, *[F.col(c).alias("c_" + c) for c in fields], F.col("incomplete").alias("_card"))
    joined = details.join(card, key, "left")
    for c in fields:
        value = F.col(c)
        empty = value.isNull() if c in ("price", "surface", "rooms", "bathrooms") else ~known(c)
        joined = joined.withColumn(c, F.when(empty & F.coalesce("_card", F.lit(False)), F.coalesce("c_" + c, value)).otherwise(value))
    return (joined.withColumn("from_card", F.col("_card").isNotNull()).withColumn("incomplete", F.lit(False))
            .drop("_card", *["c_" + c for c in fields]))


def merge_card(listings: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards into listings. A row known only from cards takes every field a newer card states;
    a row read from its detail page takes the price and what it lacks. A title changes only for
    one found at least as reliably.

    Several cards of one listing apply in order of ``seen_at``: per field the last stated value,
    for the title the last of the best rank. Implausible cards are left out.
    """
    cards = cards.where(plausible_card())
    key = ["source_id", "listing_key"]
    stated = lambda c: F.col(c).isNotNull() if c in ("price", "surface", "rooms", "bathrooms") else known(c)
    order = F.struct("seen_at", "card_id")
    rank = F.array_position(F.array(*[F.lit(x) for x in rules.TITLE_RANK]), F.col("title_how"))
    aggs = [F.max_by(F.when(stated(c), F.col(c)), F.when(stated(c), order)).alias("c_" + c) for c in rules.CARD_FIELDS if c != "title"]
    folded = cards.withColumn("title_rank", rank).groupBy(*key).agg(
        *aggs, F.max_by("title", F.struct("title_rank", "seen_at", "card_id")).alias("c_title"), F.max("title_rank").alias("c_rank"),
        F.min("seen_at").alias("first_card_at"), F.max("seen_at").alias("last_card_at"), F.count(F.lit(1)).alias("cards"))
    base = listings.select(*key, *[F.col(c).alias("o_" + c) for c in rules.CARD_FIELDS], F.col("incomplete").alias("o_incomplete"),
                           F.col("title_rank").alias("o_rank"), F.lit(True).alias("_old"))
    both = base.join(folded, key, "full")
    partial = F.col("_old").isNull() | F.coalesce("o_incomplete", F.lit(False))
    out = []
    for c in rules.CARD_FIELDS:
        o, n = F.col("o_" + c), F.col("c_" + c)
        blank = o.isNull() if c in ("price", "surface", "rooms", "bathrooms") else ~F.coalesce(known(o), F.lit(False))
        take = n.isNotNull() & (partial | blank | F.lit(c == "price"))
        if c == "title":
            take = take & (F.col("_old").isNull() | (F.col("c_rank") >= F.coalesce("o_rank", F.lit(99))))
        out.append(F.when(take, n).otherwise(o).alias(c))
    changed = F.col("cards").isNotNull() & F.col("_old").isNotNull()
    merged = both.select(*key, *out, F.when(F.col("cards").isNotNull(), partial).otherwise(F.col("o_incomplete")).alias("incomplete"),
                         F.col("_old").isNull().alias("created"), changed.alias("_touched"),
                         *[F.col("o_" + c) for c in rules.CARD_FIELDS], "first_card_at", "last_card_at", "cards")
    differs = F.lit(False)
    for c in rules.CARD_FIELDS:
        differs = differs | ~F.col(c).eqNullSafe(F.col("o_" + c))
    return merged.withColumn("updated", F.col("_touched") & differs).drop("_touched", *["o_" + c for c in rules.CARD_FIELDS])


def plausible_card() -> Column:
    """Whether a card can be a listing: numbers and texts within the bounds of the listing model."""
    within = lambda c, low, high: F.coalesce((F.col(c) >= low) & (F.col(c) <= high), F.lit(True))
    short = lambda c, most: F.coalesce(F.length(c) <= most, F.lit(True))
    return (F.coalesce((F.col("price") > 0) & (F.col("price") <= 1e9), F.lit(True)) & within("surface", 0.1, 1e7) & within("rooms", 0, 10_000) & within("bathrooms", 0, 10_000)
            & F.coalesce(F.length("title").between(1, 500), F.lit(False)) & short("address", 500) & short("city", 100) & short("zone", 100))


def card_summary(cards: DataFrame, merged: DataFrame) -> DataFrame:
    """Counters of one card batch; ``merged`` is the merge of its plausible cards."""
    good = plausible_card()
    c = cards.agg(F.count(F.lit(1)).alias("cards"), F.count(F.when(~good, 1)).alias("rejected"), F.count(F.when(good & F.col("price").isNull(), 1)).alias("no_price"),
                  F.count(F.when(good & F.col("price_drop") & F.col("price").isNotNull(), 1)).alias("price_drops"))
    touched = merged.where("cards is not null")
    count = lambda cond: touched.where(cond).agg(F.count(F.lit(1))).scalar()
    return c.select("*", count("created").alias("created"), count("updated").alias("updated"),
                    count("not created and not updated").alias("unchanged"))
