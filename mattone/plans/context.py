"""Named inputs for one run: each dataset is built on first use."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clusters, history, market, quality, queue, scoring, screening, signals
from . import adapter
from .adapter import AS_OF, EVENTS_AS_OF


class Archive:
    """The listing archive over one folder of tables."""

    as_of, events_as_of = AS_OF, EVENTS_AS_OF

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        build = getattr(adapter, name, None)
        if build is None or name.startswith("_"):
            raise AttributeError(name)
        value = build(self.spark, self.folder)
        self.__dict__[name] = value
        return value

    def table(self, name: str) -> DataFrame:
        return adapter.table(self.spark, self.folder, name)

    @cached_property
    def matched(self):
        return scoring.match_benchmark(scoring.describe(self.listings), self.benchmarks, AS_OF)

    @cached_property
    def scored(self):
        return scoring.priority(scoring.opportunity(self.matched))

    @cached_property
    def clusters(self):
        return clusters.asset_clusters(self.reviews)

    @cached_property
    def no_clusters(self):
        return self.listings.select("id", F.col("id").alias("root")).limit(0)

    @cached_property
    def contradictions(self):
        return clusters.cluster_contradictions(self.reviews, self.clusters)

    @cached_property
    def conflicts(self):
        return clusters.cross_source_conflicts(self.listings, self.clusters, self.contradictions)

    @cached_property
    def references(self):
        return market.market_references(self.listings, self.clusters, self.conflicts, self.sources, AS_OF)

    @cached_property
    def links(self):
        return screening.agent_city_link(self.listings, self.saved_searches)

    @cached_property
    def memberships(self):
        return screening.screen(self.scored, self.saved_searches, self.links)

    @cached_property
    def freshness(self):
        return signals.freshness(self.listings, self.sources, AS_OF)

    @cached_property
    def reductions(self):
        return history.price_reductions(self.observations, self.listings)

    @cached_property
    def last_calls(self):
        return queue.latest_contact(self.contact_actions)

    @cached_property
    def run_summary(self):
        return quality.run_summary(self.runs, self.run_events)


def flat(df: DataFrame) -> DataFrame:
    """Plain result columns: text for times and lists, long integers, doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "; ")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)
