"""Exact duplicates with a heavy-hitter split; DataFrame operations only.

1. Every text gets its SHA-256; (row, id, digest) is written once.
2. Misra-Gries counters find all digests that may hold more than ``1 / HEAVY`` of the rows. ``freqItems`` keeps at
   most ``HEAVY`` counters per task and merges them, so what reaches the driver is at most ``HEAVY`` digests.
3. Their exact counts and winners come from one grouping with map-side combine ("verified": a candidate that is in
   fact rare only costs its line). At most ``HEAVY`` lines, so the table of winners is broadcast and the copies of
   frequent texts are decided where they lie, without a shuffle.
4. All other digests are grouped by an ordinary shuffle; none of them can hold more than ``1 / HEAVY`` of the rows.

Rules: a null text counts as empty. Of equal texts the row with the largest id stays; a null id is smaller than any
other. Rows that also repeat the id are told apart, exactly one of them stays. An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut_lineage

#: Counters per task and most lines ever broadcast.
HEAVY = 1000


def digest_of(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def frequent(digests: DataFrame) -> list[str]:
    """Digests that may hold more than 1 / HEAVY of the rows (a superset, at most HEAVY of them)."""
    found = digests.stat.freqItems(["_digest"], 1.0 / HEAVY).first()[0]
    return sorted(x for x in found or [] if x is not None)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = cut_lineage(docs.select(F.col(id_col).alias("_id"), digest_of(F.col(text_col)).alias("_digest"))
                          .withColumn("_row", F.monotonically_increasing_id()))
    heavy = frequent(digests)
    order = F.struct("_id", "_row")
    winners = (digests.where(F.col("_digest").isin(heavy)).groupBy("_digest")
               .agg(F.max(order).alias("_best"), F.count(F.lit(1)).alias("_size")))
    hot = digests.where(F.col("_digest").isin(heavy)).join(F.broadcast(winners), "_digest")
    rest = digests.where(~F.col("_digest").isin(heavy))
    group = Window.partitionBy("_digest")
    cold = rest.withColumn("_best", F.max(order).over(group)).withColumn("_size", F.count(F.lit(1)).over(group))
    both = hot.select("_id", "_digest", "_row", "_best", "_size").unionByName(cold)
    return both.select(F.col("_id").alias("doc_id"), F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size"),
                       (F.col("_best._row") == F.col("_row")).alias("kept"), F.col("_digest").alias("text_sha256"))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``docs`` has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    digests = cut_lineage(docs.select(F.col(id_col).alias("_id"), digest_of(F.col(text_col)).alias("_digest")))
    heavy = frequent(digests)
    digest, best, rank = (unused(docs, name) for name in ("_digest", "_best", "_rank"))
    rows = docs.withColumn(digest, digest_of(F.col(text_col)))
    winners = (digests.where(F.col("_digest").isin(heavy)).groupBy(F.col("_digest").alias(digest)).agg(F.max("_id").alias(best)))
    # Copies of frequent texts go in the scan; what is left of them are rows that repeat the winner's id as well.
    hot = (rows.where(F.col(digest).isin(heavy)).join(F.broadcast(winners), digest)
           .where(F.col(id_col).eqNullSafe(F.col(best))).dropDuplicates([digest]))
    last = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    cold = rows.where(~F.col(digest).isin(heavy)).withColumn(rank, F.row_number().over(last)).where(F.col(rank) == 1)
    return hot.select(*docs.columns).unionByName(cold.select(*docs.columns))
