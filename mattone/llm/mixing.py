"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame operations only.

1. Size of a row: its words. Every source has a weight and a cap of ``max_repeats`` times its size; targets share all
   sizes by weight, what a cap cuts off is shared among the others until none is above (solved in closed form over the
   sources, sorted by cap per weight).
2. All tokens are counted in blocks of equal size (a 2^23rd of the total, but at most a 256th of the smallest target, one token at least). Sources get whole blocks
   by the highest quotients target / (2 k + 1); a source is dealt by a seeded hash into shards of bounded size, and the
   source's blocks go to its shards by the highest quotients size / (2 k + 1). Only quotients near the rounding point are
   listed: seats lie within ``n / (2 * seats)`` of the exact share, so the list is at most a few rows per claimant.
3. In a shard the rows lie one after another in seeded order, cut into its blocks. A quota of q blocks takes every block
   ``q div blocks`` times and the first ``q mod blocks`` of a seeded permutation once more. What a row gives is what
   those blocks cover of it.

Rules: a null text has size 0; null is a source of its own, last in order. Rows that repeat an id are rows of their own
(told apart by their place in the written table of sizes). The seed fixes the result: reruns agree. An empty table gives
an empty result; where all sizes are 0, nothing is taken. No row is in more than ``max_repeats`` passes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut_lineage

BLOCKS = 1 << 23
#: Blocks of the smallest target, at least (if it has so many tokens), so that rounding to whole blocks is small for every source.
LEAST_BLOCKS = 256
SHARD_TOKENS = 1 << 20
SHARD_BLOCKS = 64
#: A prime above any number of blocks in a shard, hence coprime to it: b -> PRIME * b + c permutes the blocks.
PRIME = 2_147_483_647


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: list[int], max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> also weight, cap, target. One row per source, so the windows over all are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weighed = (sources.withColumn("_place", place)
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("double"))
               .withColumn("cap", F.col("source_size").cast("double") * max_repeats))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = ((F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
             / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))))
    # The first source (in rising cap per weight) that the level does not fill fixes the level for all that follow.
    leveled = weighed.withColumn("_level", level).withColumn("_open", F.col("cap") >= F.col("_level") * F.col("weight"))
    final = F.coalesce(F.min(F.when(F.col("_open"), F.struct(F.col("cap") / F.col("weight"), "_place", "_level"))).over(all_rows)["_level"], F.lit(0.0))
    return (leveled.withColumn("target", F.least(F.col("cap"), final * F.col("weight")))
            .select("source", "source_size", "weight", "cap", "target"))


def sainte_lague(claims: DataFrame, group: list[str], claim: str, seats: str, order: list[str]) -> DataFrame:
    """``claims`` plus ``won``: the seats of each group, given to the highest quotients claim / (2 k + 1).

    ``seats`` is the group's number of seats. Equal quotients go in ``order``. Claims of 0 win nothing.
    """
    w = Window.partitionBy(*group)
    share = F.col(seats) * F.col(claim) / F.sum(claim).over(w)
    slack = F.when(F.col(seats) > 0, F.count(F.lit(1)).over(w) / (2.0 * F.col(seats))).otherwise(0.0)
    near = (claims.withColumn("_share", F.when(F.col(claim) > 0, share).otherwise(0.0)).withColumn("_slack", slack)
            .withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") * (1 - F.col("_slack"))) - 1).cast("bigint"))
            .withColumn("_most", F.when((F.col(claim) > 0) & (F.col(seats) > 0), F.ceil(F.col("_share") * (1 + F.col("_slack"))) + 1).otherwise(0).cast("bigint"))
            .withColumn("_left", F.col(seats) - F.sum("_sure").over(w)))
    listed = near.withColumn("_k", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))))
    best = Window.partitionBy(*group).orderBy((F.col(claim) / (2 * F.col("_k") + 1)).desc_nulls_last(), *order, "_k")
    ranked = listed.withColumn("_rank", F.row_number().over(best))
    won = F.col("_sure") + F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    return (ranked.groupBy(*claims.columns, "_sure").agg(won.alias("_won"))
            .select(*claims.columns, F.col("_won").cast("bigint").alias("won")))


def mix(docs: DataFrame, weights: list[int], seed: int = 7, max_repeats: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken."""
    sizes = cut_lineage(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words_in(F.col(text_col)).alias("_size"))
                        .withColumn("_row", F.monotonically_increasing_id()))
    sources = targets(sizes.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), weights, max_repeats)
    everything = Window.partitionBy()
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.least(F.floor(F.sum("source_size").over(everything) / BLOCKS), F.floor(smallest / LEAST_BLOCKS))).cast("bigint")
    sources = (sources.withColumn("_block", block)
               .withColumn("_seats", F.round(F.sum("source_size").over(everything) / F.col("_block")).cast("bigint"))
               .withColumn("_all", F.lit(0)))
    won = sainte_lague(sources, ["_all"], "target", "_seats", [F.col("source").asc_nulls_last()])
    shard_tokens = F.greatest(F.lit(SHARD_TOKENS), SHARD_BLOCKS * F.col("_block"))
    won = cut_lineage(won.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("bigint"))
                      .withColumnRenamed("won", "_source_quota"))
    shuffled = F.xxhash64(F.lit(seed), "_id", "_row")
    # One line per source; Spark broadcasts it if it is small.
    placed = (sizes.join(won, sizes["_source"].eqNullSafe(won["source"])).withColumn("_at", shuffled)
              .withColumn("_shard", F.pmod("_at", F.col("_shards"))))
    shards = (placed.groupBy("source", "_shard", "_source_quota", "_block").agg(F.sum("_size").alias("_shard_size")))
    quotas = (sainte_lague(shards, ["source"], "_shard_size", "_source_quota", [F.col("_shard")])
              .withColumn("_blocks", F.greatest(F.lit(1), F.round(F.col("_shard_size") / F.col("_block"))).cast("bigint"))
              .withColumn("_quota", F.least(F.col("won"), max_repeats * F.col("_blocks")))
              .select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "_shard_size", "_blocks", "_quota"))
    lying = (placed.join(quotas, placed["source"].eqNullSafe(quotas["_s"]) & (placed["_shard"] == quotas["_sh"]))
             .withColumn("_end", F.sum("_size").over(Window.partitionBy("_s", "_sh").orderBy("_at", "_id", "_row").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_begin", F.col("_end") - F.col("_size"))
             .withColumn("_turn", F.pmod(F.xxhash64(F.lit(seed), "_s", "_sh"), F.col("_blocks"))))

    def cut(b: Column) -> Column:
        """Where block b of the shard begins: blocks differ by a token at most."""
        return F.floor(b * F.col("_shard_size") / F.col("_blocks")).cast("bigint")

    def covered(total: Column, b: Column) -> Column:
        drawn = (F.pmod(b * PRIME + F.col("_turn"), F.col("_blocks")) < F.pmod(F.col("_quota"), F.col("_blocks")))
        part = F.greatest(F.lit(0), F.least(F.col("_end"), cut(b + 1)) - F.greatest(F.col("_begin"), cut(b)))
        return total + F.when(drawn, part).otherwise(0).cast("bigint")

    low = F.greatest(F.lit(0), F.floor(F.col("_begin") * F.col("_blocks") / F.col("_shard_size")) - 1)
    high = F.least(F.col("_blocks") - 1, F.floor(F.col("_end") * F.col("_blocks") / F.col("_shard_size")) + 1)
    whole = F.floor(F.col("_quota") / F.col("_blocks")) * F.col("_size")
    extra = F.aggregate(F.sequence(low.cast("bigint"), high.cast("bigint")), F.lit(0).cast("bigint"), covered)
    taken = F.when(F.col("_size") > 0, whole + extra).otherwise(0)
    return lying.select(F.col("_id").alias("doc_id"), "source", F.col("_size").alias("size"), "source_size", "target",
                        taken.cast("bigint").alias("taken"))
