"""Points against lines and polygons.

Lines and polygons are edge tables. Points meet them in grid joins; a broadcast is left to Spark's size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.sources.shared import staged

ON_M, NEAR_M = 150, 500


def level(metres: Column) -> Column:
    return F.when(metres <= ON_M, "on").when(metres <= NEAR_M, "near").otherwise("far")


FIRST_CELL_M, WIDER = 2_000.0, 4.0


def _covered(axes: DataFrame, cell: float) -> DataFrame:
    """(variant, gx, gy, axis): the cells that an axis passes, found piece by piece, and those around them."""
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("axis.bx") - F.col("axis.ax")), F.abs(F.col("axis.by") - F.col("axis.ay"))) / cell)).cast("int")
    cut = axes.withColumn("pieces", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    along = lambda c, k: F.col(f"axis.a{c}") + (F.col(f"axis.b{c}") - F.col(f"axis.a{c}")) * k / F.col("pieces")

    def cells(c: str) -> Column:
        ends = [F.floor(along(c, F.col("k") + e) / cell) for e in (0, 1)]
        return F.sequence(F.least(*ends) - 1, F.greatest(*ends) + 1)

    return cut.withColumn("gx", F.explode(cells("x"))).withColumn("gy", F.explode(cells("y"))).select("variant", "axis", "gx", "gy").distinct()


def nearest_lines(points: DataFrame, lines: DataFrame, first_cell_m: float = FIRST_CELL_M) -> DataFrame:
    """(listing_id, variant, road, metres, level): the nearest axis of every variant, to the millimetre; ties by road.

    Points meet the axes of their grid cell and of those around it; an axis nearer than a cell is wide is the nearest of
    all. Points without one look again in cells four times as wide, the last ones in cells that hold every axis. The names
    of the variants, and their scales, are few and come to the driver.
    """
    ends = lines.select("variant", F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).unionAll(lines.select("variant", "b_lat", "b_lon"))
    found = ends.groupBy("variant").agg((F.lit(geo.M_A_DEGREE) * F.cos(F.radians(F.avg("lat")))).alias("kx")).collect()
    if not found:
        return points.select("listing_id", F.lit("").alias("variant"), F.lit("").alias("road"), F.lit(0.0).alias("metres")).withColumn("level", level(F.col("metres"))).limit(0)
    variants = F.array(*[F.struct(F.lit(r.variant).alias("variant"), F.lit(r.kx).alias("kx")) for r in sorted(found, key=lambda r: str(r.variant))])
    scale, m = F.filter(variants, lambda v: v.variant.eqNullSafe(F.col("variant")))[0].kx, F.lit(geo.M_A_DEGREE)
    axes = staged(lines.withColumn("kx", scale).select("variant", F.struct(
        "road", "seg_no", (F.col("a_lon") * F.col("kx")).alias("ax"), (F.col("a_lat") * m).alias("ay"), (F.col("b_lon") * F.col("kx")).alias("bx"), (F.col("b_lat") * m).alias("by")).alias("axis")))
    located = points.where("lat is not null and lon is not null").select("listing_id", "lat", "lon", F.explode(variants).alias("v"))
    left = staged(located.select("listing_id", "v.variant", (F.col("lon") * F.col("v.kx")).alias("px"), (F.col("lat") * m).alias("py")))
    metres = F.floor(geo.segment_metres(F.col("px"), F.col("py"), F.col("axis.ax"), F.col("axis.ay"), F.col("axis.bx"), F.col("axis.by")) * 1000 + 0.5) / 1000
    cell, out = first_cell_m, None
    while not left.isEmpty():
        last = cell > 80_000_000  # wider than the earth: every axis is in reach
        grid = left.withColumn("gx", F.floor(F.col("px") / cell)).withColumn("gy", F.floor(F.col("py") / cell))
        near = grid.join(_covered(axes, cell), ["variant", "gx", "gy"]).select("listing_id", "variant", F.struct(metres.alias("metres"), F.col("axis.road").alias("road"), F.col("axis.seg_no").alias("seg_no")).alias("b"))
        best = near.groupBy("listing_id", "variant").agg(F.min("b").alias("b"))
        best = staged(best if last else best.where(F.col("b.metres") <= cell - 1))
        out = best if out is None else out.unionAll(best)
        if last:
            break
        left, cell = staged(left.join(best, ["listing_id", "variant"], "left_anti")), cell * WIDER
    if out is None:
        out = left.select("listing_id", "variant", F.struct(F.lit(0.0).alias("metres"), F.lit("").alias("road"), F.lit(0).alias("seg_no")).alias("b"))
    return out.select("listing_id", "variant", "b.road", "b.metres", level(F.col("b.metres")).alias("level"))


def nearest_first(near: DataFrame) -> DataFrame:
    """Each point's variants in order of distance."""
    return near.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("metres", "variant", "road"))).alias("routes"))


def near_corridor(near: DataFrame, variants: list[str], metres: float, beyond: bool = False) -> DataFrame:
    """Points within (or beyond) so many metres of the nearest of the enabled variants; unlocated ones never match."""
    best = near.where(F.col("variant").isin(variants)).groupBy("listing_id").agg(F.min("metres").alias("metres"))
    return best.where((F.col("metres") > metres) if beyond else (F.col("metres") <= metres))


def _crosses(lat: Column, lon: Column) -> Column:
    """Whether a ray from the point to the east crosses the edge."""
    return ((F.col("a_lat") > lat) != (F.col("b_lat") > lat)) & (lon < (F.col("b_lon") - F.col("a_lon")) * (lat - F.col("a_lat")) / F.nullif(F.col("b_lat") - F.col("a_lat"), F.lit(0.0)) + F.col("a_lon"))


CELL, STRIP = 0.1, 0.01  # degrees


def containing_units(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(listing_id, terc) of every ring that contains the point.

    Points meet the rings whose boxes cover their cell, and of those rings the edges of their own latitude strip only; a
    ray to the east crosses a ring that contains its point an odd number of times.
    """
    boxes = edges.groupBy("terc", "ring").agg(F.min("a_lat").alias("s"), F.max("a_lat").alias("n"), F.min("a_lon").alias("w"), F.max("a_lon").alias("e"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL)))
    boxes = boxes.withColumn("y", cells("s", "n")).withColumn("x", cells("w", "e"))
    located = points.where("lat is not null and lon is not null").select("listing_id", "lat", "lon", F.floor(F.col("lat") / CELL).alias("y"), F.floor(F.col("lon") / CELL).alias("x"))
    met = located.join(boxes, ["y", "x"]).where(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
    met = met.select("listing_id", "lat", "lon", "terc", "ring", F.floor(F.col("lat") / STRIP).alias("strip"))
    ends = [F.floor(F.col(c) / STRIP) for c in ("a_lat", "b_lat")]
    strips = edges.where("a_lat <> b_lat").select("terc", "ring", "a_lat", "a_lon", "b_lat", "b_lon", F.explode(F.sequence(F.least(*ends), F.greatest(*ends))).alias("strip"))
    crossed = met.join(strips, ["terc", "ring", "strip"]).groupBy("listing_id", "terc", "ring").agg(F.count_if(_crosses(F.col("lat"), F.col("lon"))).alias("n"))
    return crossed.where("n % 2 = 1").select("listing_id", "terc")


def nearest_centres(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(listing_id, terc) of the nearest centre (terc, c_lat, c_lon); ties, to the millimetre, by terc.

    Points and centres meet in grid cells. A round settles the points whose nearest centre lies within a cell's width;
    the rest meet in cells four times as wide.
    """
    left, done, step = staged(points), None, 4 * CELL
    while True:
        last = step >= 360
        cell = lambda c, name: F.floor(F.col(c) / step).alias(name)  # noqa: B023, E731
        near = centres.select("terc", "c_lat", "c_lon", cell("c_lat", "y"), cell("c_lon", "x")).withColumn("y", geo.neighbours(F.col("y"))).withColumn("x", geo.neighbours(F.col("x")))
        met = left.select("listing_id", "lat", "lon", cell("lat", "y"), cell("lon", "x")).join(near, ["y", "x"])
        km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
        best = met.groupBy("listing_id").agg(F.min(F.struct(F.floor(km * 1_000_000 + 0.5).alias("d"), "terc")).alias("n"), F.first("lat").alias("lat"))
        reach = F.lit(step * geo.KM_A_DEGREE * 0.99) * F.cos(F.radians(F.least(F.abs("lat") + step, F.lit(89.0))))
        found = staged(best.where(F.lit(last) | (F.col("n.d") / 1_000_000 <= reach)).select("listing_id", "n.terc"))
        done = found if done is None else done.unionAll(found)
        if last:
            return done
        left = staged(left.join(found, "listing_id", "left_anti"))
        if left.isEmpty():
            return done
        step *= 4


def unit_of_point(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The first unit that contains a point, else the one with the nearest centroid."""
    located = staged(points.where("lat is not null and lon is not null").select("listing_id", "lat", "lon"))
    inside = staged(containing_units(located, edges).groupBy("listing_id").agg(F.min("terc").alias("terc")))
    near = nearest_centres(located.join(inside, "listing_id", "left_anti"), edges.select("terc", "c_lat", "c_lon").distinct())
    return inside.withColumn("contained", F.lit(True)).unionByName(near.withColumn("contained", F.lit(False)))


def units_meeting(edges: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Units that meet a rectangle: a vertex in it, a corner of it in a ring, or crossing sides."""
    s, w, n, e = area
    corners = [(s, w), (s, e), (n, e), (n, w)]
    vertex = F.col("a_lat").between(s, n) & F.col("a_lon").between(w, e)

    def turn(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0

    a_lat, a_lon, b_lat, b_lon = (F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon"))
    crossing = F.lit(False)
    for (p_lat, p_lon), (q_lat, q_lon) in zip(corners, corners[1:] + corners[:1], strict=True):
        p_lat, p_lon, q_lat, q_lon = map(F.lit, (p_lat, p_lon, q_lat, q_lon))
        crossing = crossing | ((turn(a_lon, a_lat, b_lon, b_lat, p_lon, p_lat) != turn(a_lon, a_lat, b_lon, b_lat, q_lon, q_lat)) & (turn(p_lon, p_lat, q_lon, q_lat, a_lon, a_lat) != turn(p_lon, p_lat, q_lon, q_lat, b_lon, b_lat)))
    inside = [(F.count_if(F.coalesce(_crosses(F.lit(lat), F.lit(lon)), F.lit(False))) % 2 == 1) for lat, lon in corners]
    rings = edges.groupBy("terc", "ring").agg(F.bool_or(vertex).alias("v"), F.bool_or(crossing).alias("x"), (inside[0] | inside[1] | inside[2] | inside[3]).alias("c"))
    return rings.where("v or x or c").select("terc").distinct()


def select_units(found: DataFrame, excluded: DataFrame, home: str) -> DataFrame:
    """Units found less the excluded ones; the home unit if none is left."""
    left = found.join(excluded, "terc", "left_anti")
    fallback = found.sparkSession.createDataFrame([(home,)], "terc string")
    return left.unionByName(fallback.join(left.limit(1).select(F.lit(True).alias("some")), F.lit(True), "left_anti"))
