"""Place names in free text: a trie of known names as a table, longest match by one join per level."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..session import cut_lineage

_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ’", "aaaaaaceeeeiiiinooooouuuuyy'"
# Words with inner dots ("v.le"), and marks, which no name runs across.
_TOKEN = r"((?U)[\w'’]+(?:\.[\w'’]+)*|[,;:|/()\n\r])"


def fold(c: Column) -> Column:
    """Lower case without accents, single spaces."""
    plain = F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_TOKEN), F.lit(1))


def known_places(spark: SparkSession, *named: DataFrame) -> DataFrame:
    """city: the provincial capitals and the cities of the given tables, one spelling each."""
    out = spark.createDataFrame([(c,) for c in rules.CAPITALS], "city string")
    for df in named:
        out = out.unionByName(df.select("city"))
    return out.where(F.trim("city") != "").groupBy(fold(F.col("city")).alias("folded")).agg(F.min("city").alias("city"))


def place_trie(places: DataFrame) -> DataFrame:
    """depth, prefix (folded words joined by spaces), city where a name ends, deeper where longer names go on."""
    words = places.select("city", F.transform(tokens(F.col("city")), fold).alias("w")).where(F.size("w") > 0)
    nodes = words.select("city", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("depth"))
    ends = F.col("depth") == F.size("w")
    prefix = F.array_join(F.slice("w", F.lit(1), F.col("depth")), " ")
    return nodes.groupBy("depth", prefix.alias("prefix")).agg(F.min(F.when(ends, F.col("city"))).alias("city"), F.max(~ends).alias("deeper"))


def places_named(texts: DataFrame, key: list[str], places: DataFrame) -> DataFrame:
    """key, city: known places that a text (``text``) names, each once.

    A name begins with a capital letter and does not follow a street word ("corso Lodi"). Words meet the first level of the
    trie; only what a level matches and a longer name continues goes to the next one. The longest name counts, and words inside
    it begin no other.
    """
    # Written, so that its size is known and every level is a join with a small table; popular names would crowd one task otherwise.
    trie = cut_lineage(place_trie(places))
    deepest = trie.agg(F.max("depth")).first()[0] or 0  # words of the longest name
    cut = texts.select(*key, tokens(F.col("text")).alias("w"))

    def begin(word, pos):
        before = F.lower(F.get("w", pos - 1))
        begins = word.rlike(r"^\p{Lu}") & ~F.coalesce(before.isin(rules.STREET_WORDS), F.lit(False))
        return F.when(begins, F.struct(pos.alias("pos"), F.transform(F.slice("w", pos + 1, F.lit(max(deepest, 1))), fold).alias("next")))

    open_ = cut.select(*key, F.explode(F.filter(F.transform("w", begin), lambda x: x.isNotNull())).alias("b")).select(*key, "b.pos", "b.next")
    found = None
    for depth in range(1, deepest + 1):
        level = trie.where(F.col("depth") == depth).drop("depth")
        met = open_.withColumn("prefix", F.array_join(F.slice("next", 1, depth), " ")).where(F.size("next") >= depth).join(level, "prefix")
        ended = met.where("city IS NOT NULL").select(*key, "pos", F.lit(depth).alias("depth"), "city")
        found = ended if found is None else found.unionByName(ended)
        open_ = met.where("deeper").select(*key, "pos", "next")
    if found is None:
        return texts.select(*key, F.lit(None).cast("string").alias("city")).limit(0)
    longest = found.groupBy(*key, "pos").agg(F.max_by("city", "depth").alias("city"), F.max("depth").alias("depth"))
    reach = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.col("pos") + F.col("depth")).over(reach) > F.col("pos"), F.lit(False))
    return longest.withColumn("_inside", covered).where("NOT _inside").select(*key, "city").distinct()
