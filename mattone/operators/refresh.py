"""Refresh after a change: only listings that a change reaches are scored and screened again, the rest is carried over.

What a listing's score rests on is its own content and the newest benchmark of its seven keys (and the month of ``as_of``: when
that turns, validity of every benchmark may change, and a full run is due).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..session import cut_lineage
from .scoring import period_latest, score_listings
from .screening import screen

_KEYS = ["_" + k for k in rules.SEGMENT_KEYS]


def changed_series(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lowered keys of the benchmark series whose newest row is not what it was."""
    a, b = period_latest(old), period_latest(new)
    values = F.struct("period", "benchmark_id", "min_sqm", "max_sqm")
    both = a.select(*_KEYS, values.alias("old")).join(b.select(*_KEYS, values.alias("new")), _KEYS, "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*_KEYS)


def touched(previous: DataFrame, listings: DataFrame, old_benchmarks: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Ids of the listings that are new, state something else than before (``content_hash``), or whose benchmark changed."""
    same = listings.join(previous.select("id", "content_hash"), ["id", "content_hash"], "left_semi")
    own = listings.select("id").join(same.select("id"), "id", "left_anti")
    keyed = listings.select("id", *[F.lower(k).alias("_" + k) for k in rules.SEGMENT_KEYS])
    return own.union(keyed.join(changed_series(old_benchmarks, benchmarks), _KEYS, "left_semi").select("id")).distinct()


def refresh_changed(previous: DataFrame, listings: DataFrame, old_benchmarks: DataFrame, benchmarks: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(scored, ids): the scores of all present listings, and the listings that were scored again.

    ``previous`` is the last result over ``old_benchmarks``; listings that are gone fall away. Equal to scoring everything.
    """
    ids = cut_lineage(touched(previous, listings, old_benchmarks, benchmarks))
    again = score_listings(listings.join(ids, "id", "left_semi"), benchmarks, as_of)
    kept = previous.join(ids, "id", "left_anti").join(listings.select("id"), "id", "left_semi")
    return kept.select(*again.columns).unionByName(again), ids


def refresh_memberships(memberships: DataFrame, scored: DataFrame, ids: DataFrame, searches: DataFrame, links: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Memberships after ``refresh_changed``: links of the listings scored again are screened again, those of the others stay."""
    again = screen(scored.join(ids, "id", "left_semi"), searches, links.join(ids, "id", "left_semi"), checks)
    kept = memberships.join(ids, "id", "left_anti").join(links, ["agent_id", "id"], "left_semi")
    return kept.select(*again.columns).unionByName(again)
