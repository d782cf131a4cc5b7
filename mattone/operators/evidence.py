"""Claims about listings checked against the text they were read from."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def quote_check(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Each claim (claim_id, doc_id, quote) with whether its text contains the quote.

    Texts are folded once, before they meet their claims.
    """
    folded = texts.select("doc_id", T.fold(F.col("text")).alias("_text"))
    joined = claims.join(folded, "doc_id", "left")
    ok = (F.length(F.trim("quote")) >= 2) & F.col("_text").contains(T.fold(F.col("quote")))
    return joined.withColumn("supported", F.coalesce(ok, F.lit(False))).drop("_text")


def classify_texts(texts: DataFrame) -> DataFrame:
    """Documented strategies of each text, one row per strategy with its quote."""
    found = T.strategies(T.listing_text())
    return texts.select("id", F.explode(found).alias("s")).select("id", "s.strategy", "s.evidence")


def supported_numbers(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Claims (claim_id, doc_id, value) with whether the figure is printed and on which area basis.

    What holds of a text whatever the claim is found once per text, before it meets its claims.
    """
    joined = claims.join(texts.select("doc_id", "text", T.bases_named(F.col("text")).alias("_named")), "doc_id")
    return joined.select("claim_id", "doc_id", "value", T.number_supported(F.col("value"), F.col("text")).alias("printed"),
                         F.array_join(T.basis_supported(F.col("value"), F.col("text"), F.col("_named")), ",").alias("bases"))


def supported_conditions(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Claims (claim_id, doc_id, condition, quote) with whether the quote states that condition of the unit."""
    pages = texts.select("doc_id", T.fold(F.col("text")).alias("_page"))
    joined = claims.withColumn("_q", T.fold(F.col("quote"))).join(pages, "doc_id")
    # One branch per condition, each with its own few rules.
    parts = [joined.where(F.col("condition") == name).withColumn("supported", T.condition_supported(name, F.col("_q"), F.col("_page")))
             for name in ("renovated", "to_renovate", "good", "new", "shell")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("claim_id", "doc_id", "condition", "quote", "supported")
