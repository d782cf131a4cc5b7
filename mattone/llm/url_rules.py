"""URL verdicts from pattern rules, found through their rarest literal token; DataFrame operations only.

Every rule is a regular expression over ``host + path`` with the literal tokens that any match must contain. Tokens
of the given URLs are counted, each rule is filed under its rarest token, and a URL's own tokens fetch its candidate
rules; only those run their expression. Work follows the number of (URL, candidate) pairs, not URLs times rules.

Rules: equal URLs are judged once. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end; without ``://``, or null, both are empty. Of the rules that match, the
highest rank wins, then the smallest name. A URL that no rule matches is allowed. A rule without a literal token is
refused. Empty tables give an empty result.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules are written out in the caller's code; beyond this number they are not sent along with a plan.
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """``literals``: lower-case alphanumeric tokens that host + path (lower-cased) must hold if the pattern matches."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int
    listed: bool = False


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with all its subdomains, if the path starts with ``path``; longer rules win over all others."""
    name = host + path
    tokens = tuple(dict.fromkeys(re.findall("[a-z0-9]+", host)))  # a path may end inside a token, a host may not
    return Rule(name, verdict, r"^([^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", name), tokens, 1000 + len(name), True)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """The word as a whole token of host or path, in any case."""
    return Rule(f"word:{word}", verdict, rf"(?i)(^|[^a-z0-9]){word}([^a-z0-9]|$)", (word,), 1)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    if len(rules) > MOST_RULES or not all(r.literals for r in rules):
        raise ValueError(f"at most {MOST_RULES} rules, each with a literal token")
    lines = ", ".join(f"({r.rank}, {_text(r.name)}, {_text(r.verdict)}, {_text(r.pattern)}, {str(r.listed).lower()}, array({', '.join(map(_text, r.literals))}))" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t(rank, name, verdict, pattern, listed, literals)")


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule (listed rules only) and verdict; no other column is touched or moved.

    Columns of ``pages`` with these names are replaced.
    """
    spark = pages.sparkSession
    urls = pages.select(pages[url_col].alias("_url")).where("_url IS NOT NULL").distinct()
    parsed = urls.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    whole = F.concat("_host", "_path")
    tokens = (parsed.withColumn("_whole", whole)
              .withColumn("_token", F.explode(F.array_distinct(F.split(F.lower("_whole"), "[^a-z0-9]+")))).where("_token <> ''"))
    known = rule_table(spark, rules).withColumn("_literal", F.explode("literals"))
    literals = known.select(F.col("_literal").alias("_token")).distinct()
    counts = tokens.join(F.broadcast(literals), "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    # A token that no URL holds is the rarest of all: its rule can match nothing.
    rarest = (known.join(F.broadcast(counts), known["_literal"] == counts["_token"], "left")
              .groupBy("rank", "name", "verdict", "pattern", "listed")
              .agg(F.min_by("_literal", F.struct(F.coalesce("_n", F.lit(0)), "_literal")).alias("_token")))
    candidates = tokens.join(F.broadcast(rarest), "_token").where(F.expr("_whole RLIKE pattern"))
    best = (candidates.groupBy("_url").agg(F.min_by(F.struct("name", "verdict", "listed"), F.struct(-F.col("rank"), F.col("name"))).alias("_best")))
    # The page's own columns travel in one struct, so that no name of theirs meets a name of this join.
    rows = pages.select(pages[url_col].alias("_url"), F.struct("*").alias("_row"))
    judged = rows.join(best.withColumnRenamed("_url", "_known"), F.col("_url") == F.col("_known"), "left")
    out = {"host": host_of(F.col("_url")), "path": path_of(F.col("_url")),
           "rule": F.when(F.col("_best.listed"), F.col("_best.name")), "verdict": F.coalesce("_best.verdict", F.lit("allow"))}
    own = [out.pop(c).alias(c) if c in out else F.col("_row").getField(c).alias(c) for c in pages.columns]
    return judged.select(*own, *[column.alias(c) for c, column in out.items()])
