"""Map elements to line features, a snapped graph, points near lines, stations by code, corridor routes.

Everything that is near something is found through cells: points and pieces of lines go to cells of
a grid, equal cells join, and the exact distance decides. Cells are no smaller than the distance
that is looked for below 60 degrees of latitude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.names import folded
from amperline.functions.numeric import half_up
from amperline.operators.graph import routes
from amperline.operators.joins import haversine_km, nearest_places
from amperline.sources.tables import written

KM_A_DEGREE = 111.0
ELEMENTS = "elements array<struct<id long, tags map<string, string>, geometry array<struct<lat double, lon double>>, lat double, lon double, center struct<lat double, lon double>>>"
#: Fixed voltages of line classes, the first that a tag holds counts.
VOLTAGES = (("350000", "hvdc"), ("500000", "ac500"), ("230000", "ac230"), ("138000", "ac138"))


def elements(texts: DataFrame, text: str) -> DataFrame:
    """(id, tags, geometry, lat, lon) of each element of JSON texts; a text that is no such JSON has none. The place of an element without one is its center."""
    rows = texts.select(F.explode(F.from_json(text, ELEMENTS)["elements"]).alias("e")).select("e.*")
    return rows.select("id", "tags", "geometry", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"))


def line_class(tags: Column) -> Column:
    """Class of a line by its frequency and voltage tags."""
    v = F.coalesce(tags["voltage"], F.lit(""))
    kind = F.when(tags["frequency"] == "0", "hvdc")
    for volts, name in VOLTAGES:
        kind = kind.when(F.contains(v, F.lit(volts)), name)
    return kind.otherwise("cable")


def line_features(found: DataFrame) -> DataFrame:
    """(id, name, kind, lon, lat, place) of each vertex of the elements that have a geometry; of elements with one id the first by geometry counts."""
    once = found.where(F.size("geometry") > 0).groupBy("id").agg(F.min_by(F.struct("tags", "geometry"), F.to_json("geometry")).alias("e"))
    points = once.select("id", F.col("e.tags")["name"].alias("name"), line_class(F.col("e.tags")).alias("kind"), F.posexplode("e.geometry").alias("place", "p"))
    return points.select("id", "name", "kind", half_up(F.col("p.lon"), 5).alias("lon"), half_up(F.col("p.lat"), 5).alias("lat"), "place")


def _cell(c: Column, side: float) -> Column:
    return F.floor(c / side)


def near_lines(points: DataFrame, vertices: DataFrame, line: str, place: str, km: float) -> DataFrame:
    """The points less than `km` from some line, each once: segments go to all the cells that they pass, points to theirs.

    The distance to a segment is taken on the plane that touches the earth at the point.
    """
    side = km / KM_A_DEGREE * 2
    w = Window.partitionBy(line).orderBy(place)
    ends = vertices.select("lon", "lat", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"), F.count("*").over(Window.partitionBy(line)).alias("n"))
    segments = ends.where("lon2 IS NOT NULL OR n = 1").select("lon", "lat", F.coalesce("lon2", "lon").alias("lon2"), F.coalesce("lat2", "lat").alias("lat2"))
    west, east = F.least("lon", "lon2"), F.greatest("lon", "lon2")
    columns = segments.withColumn("cx", F.explode(F.sequence(_cell(west, side) - 1, _cell(east, side) + 1)))
    # the part of the segment over this column of cells and the two beside it
    left, right = F.greatest(west, (F.col("cx") - 1) * side), F.least(east, (F.col("cx") + 2) * side)
    slope = F.coalesce(F.try_divide(F.col("lat2") - F.col("lat"), F.col("lon2") - F.col("lon")), F.lit(0.0))
    y1, y2 = (F.when(F.col("lon") == F.col("lon2"), F.col(end)).otherwise(F.col("lat") + (x - F.col("lon")) * slope) for x, end in ((left, "lat"), (right, "lat2")))
    cells = columns.withColumns({"y1": y1, "y2": y2}).withColumn("cy", F.explode(F.sequence(_cell(F.least("y1", "y2"), side) - 1, _cell(F.greatest("y1", "y2"), side) + 1)))
    parts = cells.select("cx", "cy", *(F.col(c).alias(f"_{c}") for c in ("lon", "lat", "lon2", "lat2")))
    own = points.withColumns({"cx": _cell(F.col("lon"), side), "cy": _cell(F.col("lat"), side)})
    hit = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (segment_km(*(F.col(c) for c in ("lon", "lat", "_lon", "_lat", "_lon2", "_lat2"))) < km)
    return own.alias("a").join(parts.alias("b"), hit, "left_semi").drop("cx", "cy")


def segment_km(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance of a point to a segment on the plane that touches the earth at the point."""
    k = F.lit(6371.0) * F.radians(F.lit(1.0))
    x1, y1, x2, y2 = (lon1 - lon) * k * F.cos(F.radians(lat)), (lat1 - lat) * k, (lon2 - lon) * k * F.cos(F.radians(lat)), (lat2 - lat) * k
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(x1 * dx + y1 * dy), dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(x1 + t * dx, 2) + F.pow(y1 + t * dy, 2))


def node_key(lon: Column, lat: Column, digits: int) -> Column:
    """A node's name by its rounded place, in whole steps of 10**-digits degrees."""
    scale = float(10**digits)
    return F.concat_ws(",", *(F.floor(x * scale + 0.5).cast("long").cast("string") for x in (lon, lat)))


def snapped_graph(vertices: DataFrame, line: str, place: str, stations: DataFrame, station: str, snap_km: float, digits: int = 3) -> DataFrame:
    """(line, u, v, metres): lines between nodes. An end within `snap_km` of a station is the node of the nearest one, else that of its own place; lines that end where they begin are dropped.

    Of stations equally near the least counts. Length goes along all vertices.
    """
    w = Window.partitionBy(line).orderBy(place)
    step = haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    lengths = vertices.withColumn("km", step).groupBy(line).agg(F.round(F.sum(half_up(F.coalesce("km", F.lit(0.0)), 6).cast("decimal(18,6)")) * 1000).cast("long").alias("metres"), F.min_by(F.struct("lon", "lat"), place).alias("a"), F.max_by(F.struct("lon", "lat"), place).alias("b"))
    both = lengths.select(line, "metres", F.explode(F.array(F.struct(F.lit("u").alias("end"), "a.lon", "a.lat"), F.struct(F.lit("v").alias("end"), "b.lon", "b.lat"))).alias("p")).select(line, "metres", "p.*")
    both = written(both, "line-ends")
    near = nearest_places(both, stations, station, snap_km, lambda km: half_up(km, 6) < snap_km).select("lon", "lat", F.col(station).alias("_s"))
    at = stations.select(F.col(station).alias("_s"), node_key(F.col("lon"), F.col("lat"), digits).alias("_node"))
    nodes = both.join(near.join(at, "_s"), ["lon", "lat"], "left").select(line, "metres", "end", F.coalesce("_node", node_key(F.col("lon"), F.col("lat"), digits)).alias("node"))
    edges = nodes.groupBy(line, "metres").agg(F.max(F.when(F.col("end") == "u", F.col("node"))).alias("u"), F.max(F.when(F.col("end") == "v", F.col("node"))).alias("v"))
    return edges.where("u <> v").select(line, "u", "v", "metres")


def prefix_candidates(codes: DataFrame, code: str, stations: DataFrame, station: str, name: str, least: int = 3, most: int = 24) -> DataFrame:
    """(code, station) where the folded station name starts with the folded code of at least `least` letters; names give all their prefixes, so it is an equi-join."""
    plain = folded(F.col(name))
    prefixes = stations.select(F.col(station), plain.alias("_n")).where(F.length("_n") >= least)
    prefixes = prefixes.select(station, F.explode(F.transform(F.sequence(F.lit(least), F.least(F.length("_n"), F.lit(most))), lambda n: F.substring("_n", F.lit(1), n))).alias("_p"))
    wanted = codes.select(code).distinct().withColumn("_p", folded(F.col(code)))
    return wanted.join(prefixes, "_p").select(code, station).distinct()


def best_pairs(items: DataFrame, item: str, near_a: DataFrame, near_b: DataFrame, paths: DataFrame, places: DataFrame, factor: float = 1.2, same_km: float = 3.0) -> DataFrame:
    """(item, a, b, metres): the candidate pair of stations with the shortest path, unless another pair within `factor` of it is a different place.

    near_a and near_b: (item, a) and (item, b); paths: (a, b, metres); places: (station, lon, lat).
    Another pair is the same place if both its stations are less than `same_km` from the best pair's.
    """
    scored = items.select(item).join(near_a, item).join(paths, "a").join(near_b, [item, "b"])
    first = Window.partitionBy(item)
    best = F.min(F.struct("metres", "a", "b")).over(first)
    close = scored.withColumn("best", best).where(F.col("metres") < F.col("best.metres") * factor).select(item, "a", "b", "best")
    for side in ("a", "b"):
        for at, of in (("", F.col(side)), ("best_", F.col(f"best.{side}"))):
            p = places.select(F.col("station").alias("_s"), F.col("lon").alias(f"{at}{side}_lon"), F.col("lat").alias(f"{at}{side}_lat"))
            close = close.join(p, of == F.col("_s"), "left").drop("_s")
    apart = [haversine_km(F.col(f"{s}_lon"), F.col(f"{s}_lat"), F.col(f"best_{s}_lon"), F.col(f"best_{s}_lat")) >= same_km for s in ("a", "b")]
    judged = close.groupBy(item).agg(F.first("best").alias("best"), F.max(F.coalesce(apart[0] | apart[1], F.lit(True))).alias("unclear"))
    return judged.where("NOT unclear").select(item, "best.a", "best.b", "best.metres")


def corridor_routes(edges: DataFrame, nodes: DataFrame, corridors: DataFrame, corridor: str, place: str, end_km: float = 25.0, most_metres: int = 500_000) -> DataFrame:
    """(corridor, step, line, forward, metres): chained shortest paths between the nodes nearest to a corridor's points, in order.

    `nodes`: (node, lon, lat). A corridor is left out if a point has no node within `end_km`, two
    points in a row have the same, or a leg has no path or one longer than four times the straight
    line and than it and 80 km. `forward`: the line goes from its u to its v.
    """
    near = nearest_places(corridors, nodes, "node", end_km, lambda km: half_up(km, 6) < end_km)
    near = corridors.join(near, ["lon", "lat"]).select(corridor, place, F.col("node").alias("a"))
    w = Window.partitionBy(corridor).orderBy(place)
    legs = corridors.select(corridor, place).join(near, [corridor, place], "left").select(corridor, F.col(place).alias("leg"), "a", F.lead("a").over(w).alias("b"), F.lead(place).over(w).isNull().alias("last"))
    legs = written(legs, "legs")
    wanted = legs.where("NOT last AND a <> b").select("a", "b").distinct()
    paths = written(routes(edges, wanted, most_metres), "leg-paths")
    places = {s: nodes.select(F.col("node").alias(s), F.col("lon").alias(f"{s}_lon"), F.col("lat").alias(f"{s}_lat")) for s in "ab"}
    lengths = paths.select("a", "b", "metres").distinct().join(places["a"], "a").join(places["b"], "b")
    straight = haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    fine = lengths.where(F.col("metres") / 1000 <= F.greatest(4 * straight, straight + 80)).select("a", "b", F.lit(True).alias("fine"))
    whole = legs.where("NOT last").join(fine, ["a", "b"], "left").groupBy(corridor).agg(F.min(F.coalesce("fine", F.lit(False))).alias("whole")).where("whole").select(corridor)
    steps = legs.where("NOT last").join(whole, corridor).join(paths, ["a", "b"])
    return steps.select(corridor, F.row_number().over(Window.partitionBy(corridor).orderBy("leg", "hop")).alias("step"), "line", "forward", F.col("line_metres").alias("metres"))


def without_detours(paths: DataFrame, metres: str, factor: float = 3.0, more_km: float = 60.0, most_km: float = 200.0) -> DataFrame:
    """Paths (with lon_a, lat_a, lon_b, lat_b of their ends) that are no longer than `factor` times the straight line, or than it and `more_km`, and in any case `most_km`."""
    straight = haversine_km(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return paths.where(F.col(metres) / 1000 <= F.least(F.greatest(factor * straight, straight + more_km), F.lit(most_km)))
