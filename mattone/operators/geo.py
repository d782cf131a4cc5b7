"""Points on the map and in official zones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import half_up
from ..session import cut_lineage

CELL = 0.05  # degrees; zones are cut in cells of this size for the join
_METRES = 111320.0


def located() -> Column:
    return (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
            & (F.abs("latitude") <= 85) & (F.abs("longitude") <= 180))


def map_grid(listings: DataFrame, bounds=(6.0, 36.0, 19.3, 48.0), width: int = 640, height: int = 390) -> DataFrame:
    """Listings projected on the map and counted in 32-pixel cells with their mean position."""
    import math
    left, bottom, right, top = bounds
    cos = math.cos((top + bottom) / 2 * math.pi / 180)
    scale = min((width - 60) / ((right - left) * cos), (height - 40) / (top - bottom))
    x = width / 2 + (F.col("longitude") - (left + right) / 2) * (scale * cos)
    y = height / 2 - (F.col("latitude") - (top + bottom) / 2) * scale
    rows = listings.where(located()).select(half_up(x, 6).alias("x"), half_up(y, 6).alias("y"))
    shown = rows.where(F.col("x").between(16, width - 16) & F.col("y").between(16, height - 16))
    cell = lambda c: F.floor(F.col(c) / 32 + 0.5).cast("bigint")
    mean = lambda c: half_up(F.sum(F.col(c).cast("decimal(20,6)")) / F.count(F.lit(1)), 3)
    return (shown.groupBy(cell("x").alias("cell_x"), cell("y").alias("cell_y"))
            .agg(F.count(F.lit(1)).alias("n"), mean("x").alias("x"), mean("y").alias("y")))


#: Latitude bands in which edges are looked up for the even-odd rule; small, so a point meets few edges of a large polygon.
BAND = 0.005
#: Metres up to which the distance to the border is stated.
REACH_M = 1000.0


def zone_edges(zones: DataFrame) -> DataFrame:
    """zone_key, polygon, ax, ay, bx, by: the edges of all rings, closed. ``zones``: zone_key, polygons."""
    rings = zones.select("zone_key", F.posexplode("polygons").alias("polygon", "rings")).select("zone_key", "polygon", F.explode("rings").alias("ring"))
    nxt = F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", 1, 1))
    edges = rings.where(F.size("ring") > 0).select("zone_key", "polygon", F.explode(F.arrays_zip(F.col("ring").alias("a"), nxt.alias("b"))).alias("e"))
    return edges.select("zone_key", "polygon", F.col("e.a")[0].alias("ax"), F.col("e.a")[1].alias("ay"), F.col("e.b")[0].alias("bx"), F.col("e.b")[1].alias("by"))


def _between(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def border_cells(edges: DataFrame, margin_m: float) -> DataFrame:
    """The edges with each grid cell that they touch or come within the margin of. An edge is cut into rows of cells first, so a
    long one is filed along its line and not over its whole box."""
    south, north = F.least("ay", "by"), F.greatest("ay", "by")
    high = margin_m / _METRES * 1.01
    # Degrees of longitude that the margin is at most, at the edge's latitude farthest from the equator.
    wide = F.lit(high) / F.greatest(F.cos(F.radians(F.least(F.lit(85.0), F.greatest(F.abs(south), F.abs(north)) + high))), F.lit(0.01))
    rows = edges.withColumn("_wide", wide).withColumn("cell_y", _between(south - high, north + high, CELL))
    bottom, top = F.greatest(south, F.col("cell_y") * CELL - high), F.least(north, (F.col("cell_y") + 1) * CELL + high)
    at = lambda y: F.when(F.col("by") == F.col("ay"), F.col("ax")).otherwise(F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")))
    flat = F.col("ay") == F.col("by")
    west = F.when(flat, F.least("ax", "bx")).otherwise(F.least(at(bottom), at(top)))
    east = F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(at(bottom), at(top)))
    return rows.withColumn("cell_x", _between(west - F.col("_wide"), east + F.col("_wide"), CELL)).drop("_wide")


def holding(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct (zone_key, px, py) of ``points`` that a polygon of their zone holds: even-odd rule, so holes need no order.

    Edges are filed by zone and latitude band; crossings are summed per polygon.
    """
    filed = edges.where("ay <> by").withColumn("band", _between(F.least("ay", "by"), F.greatest("ay", "by"), BAND))
    met = points.withColumn("band", F.floor(F.col("py") / BAND)).join(filed, ["zone_key", "band"])
    lat, lon = F.col("py"), F.col("px")
    crossed = met.where(((F.col("ay") > lat) != (F.col("by") > lat)) & (lon < (F.col("bx") - F.col("ax")) * (lat - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")))
    return crossed.groupBy("zone_key", "px", "py", "polygon").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").select("zone_key", "px", "py").distinct()


def distance_m(lon: Column, lat: Column) -> Column:
    """Metres from a point to the edge (ax, ay) to (bx, by), on a local flat grid."""
    east = F.cos(F.radians(lat)) * _METRES
    ax, ay = (F.col("ax") - lon) * east, (F.col("ay") - lat) * _METRES
    bx, by = (F.col("bx") - lon) * east, (F.col("by") - lat) * _METRES
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return F.hypot(ax + t * dx, ay + t * dy)


def zone_join(listings: DataFrame, zones: DataFrame, margin_m: float = 20.0) -> DataFrame:
    """The one zone (``zone_code``, ``polygons``) that holds each point well inside its border; none where zones overlap.

    Cells of a grid that no edge comes within reach of lie wholly in or out of a zone: their middle is tested once for all points in them.
    Points in the other cells are tested themselves, against the edges of their latitude band, and measured against
    the edges near their cell. ``border_m`` is the distance to the nearest edge, null beyond ``REACH_M`` (or the margin, if that is
    larger). Polygons of any size: no ring is ever read whole per point.
    """
    spots = listings.where(located()).select("latitude", "longitude").distinct()
    spots = spots.withColumn("cell_x", F.floor(F.col("longitude") / CELL)).withColumn("cell_y", F.floor(F.col("latitude") / CELL))
    keyed = zones.where(F.size("polygons") > 0).select("zone_code", "polygons", F.xxhash64("zone_code", "polygons").alias("zone_key"))
    edges = cut_lineage(zone_edges(keyed.select("zone_key", "polygons").dropDuplicates(["zone_key"])))
    reach = max(margin_m, REACH_M)
    border = cut_lineage(border_cells(edges, reach))
    marked = border.select("zone_key", "cell_x", "cell_y").distinct().withColumn("border", F.lit(True))
    # Cells of a zone's box that hold points.
    box = edges.groupBy("zone_key").agg(F.min("ax").alias("west"), F.max("ax").alias("east"), F.min("ay").alias("south"), F.max("ay").alias("north"))
    boxed = box.withColumn("cell_x", _between(F.col("west"), F.col("east"), CELL)).withColumn("cell_y", _between(F.col("south"), F.col("north"), CELL)).select("zone_key", "cell_x", "cell_y")
    met = spots.join(boxed, ["cell_x", "cell_y"]).join(marked, ["zone_key", "cell_x", "cell_y"], "left")
    own = F.col("border").isNotNull()
    met = cut_lineage(met.withColumn("px", F.when(own, F.col("longitude")).otherwise((F.col("cell_x") + 0.5) * CELL))
                      .withColumn("py", F.when(own, F.col("latitude")).otherwise((F.col("cell_y") + 0.5) * CELL)))
    hits = met.join(holding(met.select("zone_key", "px", "py").distinct(), edges), ["zone_key", "px", "py"])
    near = (hits.where("border").join(border, ["zone_key", "cell_x", "cell_y"]).groupBy("zone_key", "latitude", "longitude")
            .agg(half_up(F.min(distance_m(F.col("longitude"), F.col("latitude"))), 1).alias("border_m")).where(F.col("border_m") <= reach))
    spot_zone = (hits.select("zone_key", "latitude", "longitude").join(near, ["zone_key", "latitude", "longitude"], "left").join(keyed.select("zone_key", "zone_code"), "zone_key")
                 .groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("_zones"), F.min("zone_code").alias("zone_code"), F.min("border_m").alias("border_m"))
                 .where((F.col("_zones") == 1) & (F.col("border_m").isNull() | (F.col("border_m") >= margin_m))).drop("_zones"))
    return listings.select("id", "latitude", "longitude").join(spot_zone, ["latitude", "longitude"])


def zone_quote_join(zoned: DataFrame, quotes: DataFrame) -> DataFrame:
    """Official quotes of the zone, for the use that fits the property type."""
    usage = (F.when(F.col("property_type") == "residential", "R").when(F.col("property_type") == "commercial", "C")
             .when(F.col("property_type") == "office", "T").when(F.col("property_type") == "logistics", "P"))
    return zoned.withColumn("usage", usage).join(quotes, ["zone_code", "usage"])
