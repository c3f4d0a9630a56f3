"""Maps over the driver's tables: suppliers are stations, parts are lines between two of them.

Coordinates are whole numbers of 10**-5 degrees divided by 10**5, the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.operators import geometry, graph
from amperline.plans.common import r, table
from amperline.sources.tables import written

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


#: x and y of a station; a line goes from one station to another by a vertex between them, ends off by up to 0.006 degrees.
_SX, _SY = "(s_suppkey * 7919 % 40009 + 12000000)", "(s_suppkey * 104729 % 40009 + 1000000)"
_HAVERSINE = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))"


def _km(a: str, b: str) -> str:
    return _HAVERSINE.format(a=a, b=b)


_STATIONS = f"""n AS (SELECT count(*) AS n FROM supplier), st AS (SELECT s_suppkey AS station, s_name AS name, {_SX} AS sx, {_SY} AS sy, CAST({_SX} AS DOUBLE) / 100000 AS lon, CAST({_SY} AS DOUBLE) / 100000 AS lat FROM supplier)"""
_VERTICES = f"""{_STATIONS}, e AS (SELECT p_partkey AS id, p_partkey % n AS a, (p_partkey * 13 + p_partkey // n + 1) % n AS b, p_partkey * 17 % 1200 - 600 AS off FROM part, n),
    xy AS (SELECT id, 0 AS place, s.sx + off AS x, s.sy - off AS y FROM e JOIN st s ON s.station = e.a UNION ALL SELECT id, 2, s.sx - off, s.sy + off FROM e JOIN st s ON s.station = e.b
    UNION ALL SELECT id, 1, (s.sx + t.sx) // 2 + off, (s.sy + t.sy) // 2 FROM e JOIN st s ON s.station = e.a JOIN st t ON t.station = e.b),
    lv AS (SELECT id, place, CAST(x AS DOUBLE) / 100000 AS lon, CAST(y AS DOUBLE) / 100000 AS lat FROM xy)"""


def _stations(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("station"), F.col("s_name").alias("name"), (k * 7919 % 40009 + 12_000_000).alias("sx"), (k * 104729 % 40009 + 1_000_000).alias("sy")).withColumns(
        {"lon": F.col("sx").cast("double") / 100_000, "lat": F.col("sy").cast("double") / 100_000}
    )


def _texts(spark, d):
    """The lines as map texts of 100 elements; every tenth text is no JSON."""
    st = _stations(spark, d)
    n = st.count()
    k = F.col("p_partkey")
    e = table(spark, d, "part").select(k.alias("id"), (k % n).alias("a"), ((k * 13 + F.floor(k / n) + 1) % n).alias("b"), (k * 17 % 1200 - 600).alias("off"))
    s, t = (st.select(F.col("station").alias(x), F.col("sx").alias(f"x{x}"), F.col("sy").alias(f"y{x}")) for x in "ab")
    own = e.join(s, "a").join(t, "b")
    off = F.col("off")
    xy = [(F.col("xa") + off, F.col("ya") - off), (F.floor((F.col("xa") + F.col("xb")) / 2) + off, F.floor((F.col("ya") + F.col("yb")) / 2)), (F.col("xb") - off, F.col("yb") + off)]
    points = F.array(*(F.struct((y.cast("double") / 100_000).alias("lat"), (x.cast("double") / 100_000).alias("lon")) for x, y in xy))
    volts = F.when(F.col("id") % 5 == 0, "350000").when(F.col("id") % 5 == 1, "500000;230000").when(F.col("id") % 5 == 2, "230000").when(F.col("id") % 5 == 3, "138000")
    tags = F.map_from_arrays(F.array(F.lit("name"), F.lit("voltage"), F.lit("frequency")), F.array(F.concat(F.lit("line "), "id"), F.coalesce(volts, F.lit("")), F.when(F.col("id") % 11 == 0, "0").otherwise("60")))
    row = own.select("id", F.struct("id", tags.alias("tags"), points.alias("geometry")).alias("e"))
    texts = row.groupBy(F.floor(F.col("id") / 100).alias("file")).agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value"))
    return texts.unionByName(texts.where("file % 10 = 0").select("file", F.lit("no json {").alias("value")))


def _features(spark, d):
    return geometry.line_features(geometry.elements(_texts(spark, d), "value"))


@query(
    "q_map_lines",
    f"""WITH {_VERTICES} SELECT id, 'line ' || id AS name, CASE WHEN id % 11 = 0 OR id % 5 = 0 THEN 'hvdc' WHEN id % 5 = 1 THEN 'ac500' WHEN id % 5 = 2 THEN 'ac230' WHEN id % 5 = 3 THEN 'ac138' ELSE 'cable' END AS kind,
    lon, lat, place FROM lv""",
)
def map_lines(spark, d):
    """Line features of map JSON."""
    return _features(spark, d)


_ROUND = "floor({x} * 1000 + 0.5)"
_GRAPH = f"""{_VERTICES}, st2 AS (SELECT id, place, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM lv WINDOW w AS (PARTITION BY id ORDER BY place)),
    len AS (SELECT id, CAST(round(sum(CAST({r("coalesce(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))), 0.0)", 6)} AS DECIMAL(18,6))) * 1000) AS BIGINT) AS metres FROM st2 GROUP BY id),
    nr AS (SELECT l.id, l.place, s.station, s.lon, s.lat, {r(_km('l.', 's.'), 6)} AS km FROM lv l JOIN st s ON abs(l.lon - s.lon) < 0.05 AND abs(l.lat - s.lat) < 0.05 WHERE l.place <> 1),
    sn AS (SELECT id, place, lon, lat FROM nr WHERE km < 0.6 QUALIFY row_number() OVER (PARTITION BY id, place ORDER BY km, station) = 1),
    nd AS (SELECT l.id, l.place, CAST(CAST(floor(coalesce(s.lon, l.lon) * 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(coalesce(s.lat, l.lat) * 1000.0 + 0.5) AS BIGINT) AS VARCHAR) AS node FROM lv l LEFT JOIN sn s ON s.id = l.id AND s.place = l.place WHERE l.place <> 1),
    ed AS (SELECT a.id AS line, a.node AS u, b.node AS v, metres FROM nd a JOIN nd b ON a.id = b.id AND a.place = 0 AND b.place = 2 JOIN len ON len.id = a.id WHERE a.node <> b.node)"""


def _graph(spark, d):
    return geometry.snapped_graph(_features(spark, d).withColumnRenamed("id", "line"), "line", "place", _stations(spark, d), "station", 0.6)


@query("q_snapped_graph", f"WITH {_GRAPH} SELECT line, u, v, metres FROM ed")
def snapped_graph(spark, d):
    return _graph(spark, d)


_SEGMENT = """sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2))"""


@query(
    "q_near_lines",
    f"""WITH {_VERTICES}, sg AS (SELECT lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM lv WINDOW w AS (PARTITION BY id ORDER BY place)), k AS (SELECT 6371.0 * radians(1.0) AS k),
    pt AS (SELECT c_custkey AS point, CAST(c_custkey * 6151 % 40009 + 12000000 AS DOUBLE) / 100000 AS plon, CAST(c_custkey * 3571 % 40009 + 1000000 AS DOUBLE) / 100000 AS plat FROM customer),
    pl AS (SELECT point, (lon - plon) * k * cos(radians(plat)) AS x1, (lat - plat) * k AS y1, (lon2 - plon) * k * cos(radians(plat)) AS x2, (lat2 - plat) * k AS y2 FROM pt JOIN sg ON plon BETWEEN least(lon, lon2) - 0.01 AND greatest(lon, lon2) + 0.01 AND plat BETWEEN least(lat, lat2) - 0.01 AND greatest(lat, lat2) + 0.01, k WHERE lon2 IS NOT NULL),
    tt AS (SELECT *, greatest(0.0, least(1.0, coalesce(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0.0))) AS t FROM pl)
    SELECT DISTINCT point FROM tt WHERE {_SEGMENT} < 0.2""",
)
def near_lines(spark, d):
    """Points less than 200 m from any point of any line."""
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("point"), ((k * 6151 % 40009 + 12_000_000).cast("double") / 100_000).alias("lon"), ((k * 3571 % 40009 + 1_000_000).cast("double") / 100_000).alias("lat"))
    return geometry.near_lines(points, _features(spark, d), "id", "place", 0.2).select("point")


def _routes_sql(sources: str, pairs: str, most: int, rounds: int = 14) -> str:
    """CTEs rt (a, b, hop, line, forward, line_metres, metres) for `pairs` (a, b) of the sources: a round for each hop, then the ways read backwards."""
    steps = [f"w2 AS (SELECT line, u, v, metres, true AS forward FROM ed UNION ALL SELECT line, v, u, metres, false FROM ed), d0 AS (SELECT DISTINCT a, a AS node, CAST(0 AS BIGINT) AS far FROM {sources})"]
    for i in range(rounds):
        steps.append(f"d{i + 1} AS MATERIALIZED (SELECT a, node, min(far) AS far FROM (SELECT * FROM d{i} UNION ALL SELECT a, v, far + metres FROM d{i} JOIN w2 ON node = u WHERE far + metres <= {most}) GROUP BY ALL)")
    last = f"d{rounds}"
    steps.append(f"""wy AS (SELECT x.a, x.node, arg_min({{'prev': y.node, 'line': line, 'forward': forward, 'own': metres}}, (y.node, line, forward)) AS way FROM {last} x JOIN w2 ON v = x.node JOIN {last} y ON y.a = x.a AND y.node = u AND y.far + metres = x.far WHERE x.node <> x.a GROUP BY ALL),
    pw AS (SELECT p.a, p.b, p.b AS node, x.far AS total, 0 AS back FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> b) p JOIN {last} x ON x.a = p.a AND x.node = p.b
    UNION ALL SELECT pw.a, pw.b, wy.way.prev, total, back + 1 FROM pw JOIN wy ON wy.a = pw.a AND wy.node = pw.node WHERE pw.node <> pw.a),
    rt AS (SELECT pw.a, pw.b, max(back) OVER (PARTITION BY pw.a, pw.b) - back AS hop, way.line AS line, way.forward AS forward, way.own AS line_metres, total AS metres FROM pw JOIN wy ON wy.a = pw.a AND wy.node = pw.node WHERE pw.node <> pw.a)""")
    return ", ".join(steps)


_NODE = "CAST(CAST(floor(lon * 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(lat * 1000.0 + 0.5) AS BIGINT) AS VARCHAR)"
_STATION_NODES = f"sn2 AS (SELECT station, name, lon, lat, {_NODE} AS node FROM st)"


def _station_nodes(spark, d):
    return _stations(spark, d).withColumn("node", geometry.node_key(F.col("lon"), F.col("lat"), 3))


@query(
    "q_routes",
    f"""WITH RECURSIVE {_GRAPH}, {_STATION_NODES}, pr AS (SELECT x.node AS a, y.node AS b FROM sn2 x, n JOIN sn2 y ON y.station = (x.station * 3 + 1) % n), {_routes_sql('pr', 'pr', 100_000)}
    SELECT a, b, CAST(hop AS INTEGER) AS hop, line, forward, line_metres, metres FROM rt""",
)
def routes(spark, d):
    """The lines of a shortest path from each station to another."""
    st = _station_nodes(spark, d)
    n = st.count()
    pairs = st.select(F.col("node").alias("a"), ((F.col("station") * 3 + 1) % n).alias("to")).join(st.select(F.col("station").alias("to"), F.col("node").alias("b")), "to").select("a", "b")
    edges = written(_graph(spark, d), "graph")
    return graph.routes(edges, pairs, 100_000, _graph_nodes(edges))


_GRAPH_NODES = "gn AS (SELECT node, CAST(split_part(node, ',', 1) AS DOUBLE) / 1000 AS lon, CAST(split_part(node, ',', 2) AS DOUBLE) / 1000 AS lat FROM (SELECT u AS node FROM ed UNION SELECT v FROM ed))"


def _graph_nodes(edges):
    xy = F.split("node", ",")
    return edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", (xy[0].cast("double") / 1000).alias("lon"), (xy[1].cast("double") / 1000).alias("lat"))


@query(
    "q_corridor_routes",
    f"""WITH RECURSIVE {_GRAPH}, {_STATION_NODES}, {_GRAPH_NODES}, cp AS (SELECT n_nationkey AS corridor, k AS place, lon + 0.0005 AS lon, lat - 0.0005 AS lat FROM nation, n, (SELECT unnest([0, 1, 2]) AS k), sn2 WHERE station = (n_nationkey * 7 + k * 11 + (n_nationkey % 4) * k) % n),
    ck AS (SELECT c.corridor, c.place, g.node, {r(_km('c.', 'g.'), 6)} AS km FROM cp c CROSS JOIN gn g), cn AS (SELECT corridor, place, node FROM ck WHERE km < 25 QUALIFY row_number() OVER (PARTITION BY corridor, place ORDER BY km, node) = 1),
    lg AS (SELECT c.corridor, c.place, x.node AS a, y.node AS b FROM cp c LEFT JOIN cn x USING (corridor, place) LEFT JOIN cn y ON y.corridor = c.corridor AND y.place = c.place + 1 WHERE c.place < 2),
    pr AS (SELECT a, b FROM lg WHERE a <> b), {_routes_sql('pr', 'pr', 500_000)},
    fi AS (SELECT DISTINCT rt.a, rt.b FROM rt JOIN gn x ON x.node = rt.a JOIN gn y ON y.node = rt.b WHERE rt.metres / 1000 <= greatest(4 * ({_km('x.', 'y.')}), ({_km('x.', 'y.')}) + 80)),
    wh AS (SELECT corridor FROM lg LEFT JOIN fi ON fi.a = lg.a AND fi.b = lg.b GROUP BY corridor HAVING count(*) = count(fi.a))
    SELECT corridor, CAST(row_number() OVER (PARTITION BY corridor ORDER BY place, hop) AS INTEGER) AS step, line, forward, line_metres AS metres FROM wh JOIN lg USING (corridor) JOIN rt ON rt.a = lg.a AND rt.b = lg.b""",
)
def corridor_routes(spark, d):
    """Corridors of three points routed over the lines."""
    st = _stations(spark, d)
    n = st.count()
    c = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("corridor"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("place"))
    c = c.withColumn("station", (F.col("corridor") * 7 + F.col("place") * 11 + (F.col("corridor") % 4) * F.col("place")) % n)
    points = c.join(st, "station").select("corridor", "place", (F.col("lon") + 0.0005).alias("lon"), (F.col("lat") - 0.0005).alias("lat"))
    edges = written(_graph(spark, d), "graph")
    return geometry.corridor_routes(edges, _graph_nodes(edges), points, "corridor", "place")


_CODES = "cd AS (SELECT n_nationkey AS item, 'SUPPLIER_' || lpad(CAST(n_nationkey % (n // 10) AS VARCHAR), 8, '0') AS code_a, 'Supplier-' || lpad(CAST((n_nationkey * 3 + 1) % (n // 10) AS VARCHAR), 8, '0') AS code_b FROM nation, n)"


def _codes(spark, d):
    n = F.floor(F.lit(_stations(spark, d).count()) / 10)
    k = F.col("n_nationkey").cast("long")
    code = lambda x: F.lpad((x % n).cast("string"), 8, "0")
    return table(spark, d, "nation").select(k.alias("item"), F.concat(F.lit("SUPPLIER_"), code(k)).alias("code_a"), F.concat(F.lit("Supplier-"), code(k * 3 + 1)).alias("code_b"))


_PREFIX = "px AS (SELECT item, side, code, station, node FROM (SELECT item, 'a' AS side, code_a AS code FROM cd UNION ALL SELECT item, 'b', code_b FROM cd) JOIN sn2 ON starts_with(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(code), '[^a-z0-9]', '', 'g')))"


@query("q_station_prefix", f"WITH {_STATIONS}, {_STATION_NODES}, {_CODES}, {_PREFIX} SELECT DISTINCT code, station FROM px")
def station_prefix(spark, d):
    """Stations whose names begin with a code."""
    codes = _codes(spark, d)
    every = codes.select(F.explode(F.array("code_a", "code_b")).alias("code"))
    return geometry.prefix_candidates(every, "code", _stations(spark, d), "station", "name")


@query(
    "q_best_pair",
    f"""WITH RECURSIVE {_GRAPH}, {_STATION_NODES}, {_CODES}, {_PREFIX},
    ab AS (SELECT x.item, x.station AS sa, y.station AS sb, x.node AS a, y.node AS b FROM px x JOIN px y ON x.item = y.item AND x.side = 'a' AND y.side = 'b'), {_routes_sql('ab', 'ab', 60_000)},
    sc AS (SELECT DISTINCT ab.item, ab.sa, ab.sb, rt.metres FROM ab JOIN rt ON rt.a = ab.a AND rt.b = ab.b), be AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY metres, sa, sb) AS i FROM sc),
    cl AS (SELECT be.item, NOT ({_km('p.', 'q.')} < 3 AND {_km('t.', 'w.')} < 3) AS apart FROM be JOIN be z ON z.item = be.item AND z.i = 1 AND be.metres < z.metres * 1.2
    JOIN st p ON p.station = be.sa JOIN st q ON q.station = z.sa JOIN st t ON t.station = be.sb JOIN st w ON w.station = z.sb)
    SELECT item, sa AS a, sb AS b, metres FROM be WHERE i = 1 AND item NOT IN (SELECT item FROM cl WHERE apart)""",
)
def best_pair(spark, d):
    """The pair of candidate stations with the shortest path, if no other pair rivals it."""
    st, codes = _station_nodes(spark, d), _codes(spark, d)
    near = {}
    for side in "ab":
        found = geometry.prefix_candidates(codes.select(F.col(f"code_{side}").alias("code")), "code", st, "station", "name")
        near[side] = written(codes.select("item", F.col(f"code_{side}").alias("code")).join(found, "code").select("item", F.col("station").alias(side)).join(st.select(F.col("station").alias(side), F.col("node").alias(f"node_{side}")), side), f"near-{side}")
    ends = {side: near[side].select("item", F.col(f"node_{side}").alias(side)) for side in "ab"}
    close = graph.closest_pairs(_graph(spark, d), ends["a"], ends["b"], 60_000, 1.2).withColumnsRenamed({"a": "node_a", "b": "node_b"})
    paths = close.join(near["a"], ["item", "node_a"]).join(near["b"], ["item", "node_b"]).groupBy("a", "b").agg(F.min("metres").alias("metres"))
    return geometry.best_pairs(codes, "item", near["a"].select("item", "a"), near["b"].select("item", "b"), paths, st)
