"""Map features, snapping, lines near points, routes and pairs of stations on small hand-made maps."""

import json

import pytest
from pyspark.sql import functions as F

from amperline.operators import geometry, graph, joins

EDGES = "line long, u string, v string, metres long"


def test_elements_and_classes(spark):
    line = {"type": "way", "id": 1, "tags": {"voltage": "138000", "name": "L"}, "geometry": [{"lat": 10.123456, "lon": 120.0}, {"lat": 10.2, "lon": 120.1}]}
    others = [{"id": 2, "tags": {"frequency": "0", "voltage": "500000"}, "geometry": [{"lat": 1, "lon": 2}]}, {"id": 3, "lat": 5.0, "lon": 6.0, "tags": {}}, {"id": 4, "center": {"lat": 7.0, "lon": 8.0}}]
    texts = spark.createDataFrame([(json.dumps({"elements": [line, *others]}),), (json.dumps({"elements": [line]}),), ("{broken",), (None,)], "value string")
    found = geometry.elements(texts, "value")
    assert sorted((r.id, r.lat, r.lon) for r in found.where("id > 2").collect()) == [(3, 5.0, 6.0), (4, 7.0, 8.0)]
    assert sorted(map(tuple, geometry.line_features(found).collect())) == [(1, "L", "ac138", 120.0, 10.12346, 0), (1, "L", "ac138", 120.1, 10.2, 1), (2, None, "hvdc", 2.0, 1.0, 0)]


def test_snapping(spark):
    """Ends go to the nearest station within the radius, stubs go, lengths follow all vertices."""
    stations = spark.createDataFrame([(1, 120.0, 10.0), (2, 120.004, 10.0), (3, 121.0, 10.0)], "station long, lon double, lat double")
    lines = {10: [(120.003, 10.0), (120.5, 10.0), (121.0, 10.001)], 11: [(120.0, 10.0), (120.001, 10.001)], 12: [(125.0, 5.0), (125.5, 5.0)], 13: [(120.002, 10.0), (121.0, 10.0)]}
    vertices = spark.createDataFrame([(k, i, x, y) for k, own in lines.items() for i, (x, y) in enumerate(own)], "line long, place long, lon double, lat double")
    got = {r.line: (r.u, r.v, r.metres) for r in geometry.snapped_graph(vertices, "line", "place", stations, "station", 0.5).collect()}
    assert set(got) == {10, 12, 13}
    assert got[10][:2] == ("120004,10000", "121000,10000") and got[12][:2] == ("125000,5000", "125500,5000")
    assert got[13][0] == "120000,10000"  # of two stations equally near the least
    assert abs(got[12][2] - 55_390) < 30


def test_points_near_lines(spark):
    """Between far vertices, beside ends, at one-vertex lines; brute force over all segments of random lines."""
    import random

    r = random.Random(7)
    lines = {k: [(120 + r.random(), 10 + r.random()) for _ in range(r.choice([1, 2, 4]))] for k in range(60)}
    lines[99] = [(121.2, 10.0), (121.2, 10.9)]
    points = [(i, 119.9 + 1.4 * r.random(), 9.9 + 1.2 * r.random()) for i in range(1500)] + [(9001, 121.205, 10.45), (9002, 121.25, 10.45)]
    vertices = spark.createDataFrame([(k, i, x, y) for k, own in lines.items() for i, (x, y) in enumerate(own)], "line long, place long, lon double, lat double")
    frame = spark.createDataFrame(points, "point long, lon double, lat double")
    got = {r.point for r in geometry.near_lines(frame, vertices, "line", "place", 1.0).collect()}
    segments = spark.createDataFrame([(*a, *b) for own in lines.values() for a, b in zip(own, own[1:] or own, strict=False)], "x1 double, y1 double, x2 double, y2 double")
    far = geometry.segment_km(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    want = {r.point for r in frame.crossJoin(segments).where(far < 1.0).select("point").distinct().collect()}
    assert got == want and 9001 in got and 9002 not in got and 50 < len(got) < 1400


def test_routes_with_ties_and_limits(spark):
    edges = spark.createDataFrame([(1, "a", "b", 5), (2, "b", "d", 5), (3, "a", "c", 5), (4, "c", "d", 5), (5, "a", "d", 11), (6, "d", "e", 90), (7, "x", "y", 1), (8, "b", "a", 5), (9, "d", "c", 5)], EDGES)
    pairs = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "e"), ("a", "x"), ("a", "a"), ("q", "a"), ("a", "b")], "a string, b string")
    got = {}
    for r in graph.routes(edges, pairs, 50).orderBy("hop").collect():
        got.setdefault((r.a, r.b, r.metres), []).append((r.line, r.forward))
    assert got == {("a", "d", 10): [(1, True), (2, True)], ("d", "a", 10): [(2, False), (1, False)], ("a", "b", 5): [(1, True)]}
    assert graph.routes(edges, pairs.limit(0), 50).count() == 0


def test_routes_against_dijkstra(spark):
    import heapq
    import random

    r = random.Random(3)
    edges = [(i, f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.randrange(1, 60)) for i in range(90)]
    edges = [e for e in edges if e[1] != e[2]]
    got = {}
    nodes = sorted({n for e in edges for n in e[1:3]})
    for x in graph.routes(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(a, b) for a in nodes[:6] for b in nodes], "a string, b string"), 10**6).collect():
        got.setdefault((x.a, x.b), []).append(x)
    by = {e[0]: e for e in edges}
    for a in nodes[:6]:
        dist, todo = {a: 0}, [(0, a)]
        while todo:
            d, u = heapq.heappop(todo)
            for _, x, y, w in edges:
                for p, q in ((x, y), (y, x)):
                    if p == u and d + w < dist.get(q, 10**9):
                        dist[q] = d + w
                        heapq.heappush(todo, (d + w, q))
        for b in nodes:
            if b != a:
                assert (b in dist) == ((a, b) in got)
                at, total = a, 0
                for x in sorted(got.get((a, b), []), key=lambda x: x.hop):
                    _, u, v, w = by[x.line]
                    assert at == (u if x.forward else v) and x.metres == dist[b]
                    at, total = v if x.forward else u, total + w
                assert b not in dist or (at == b and total == dist[b])


@pytest.mark.parametrize("second, want", [((3, 4, 119), []), ((3, 4, 121), [(7, 1, 2, 100)]), ((5, 6, 101), [(7, 1, 2, 100)])])
def test_rival_pairs(spark, second, want):
    """A pair within 20 percent rejects the match unless its stations stand beside the best pair's."""
    places = spark.createDataFrame([(1, 120.0, 10.0), (2, 121.0, 10.0), (3, 122.0, 10.0), (4, 123.0, 10.0), (5, 120.01, 10.0), (6, 121.01, 10.0)], "station long, lon double, lat double")
    items = spark.createDataFrame([(7,), (8,)], "item long")
    a, b = (spark.createDataFrame([(7, x) for x in own], f"item long, {side} long") for side, own in (("a", {1, second[0]}), ("b", {2, second[1]})))
    paths = spark.createDataFrame([(1, 2, 100), second], "a long, b long, metres long")
    assert list(map(tuple, geometry.best_pairs(items, "item", a, b, paths, places).collect())) == want


def test_prefixes(spark):
    stations = spark.createDataFrame([(1, "San José"), (2, "San Roque"), (3, "SANTA"), (4, None), (5, "Sa")], "station long, name string")
    codes = spark.createDataFrame([("SAN",), ("sanjo",), ("Sa",), ("XYZ",), (None,)], "code string")
    assert sorted(map(tuple, geometry.prefix_candidates(codes, "code", stations, "station", "name").collect())) == [("SAN", 1), ("SAN", 2), ("SAN", 3), ("sanjo", 1)]


def test_copies_at_one_place_are_looked_up_once(spark):
    """The nearest of many: equal places take the least station, and the pairs compared do not grow with the square of the copies."""
    places = [(120.0, 10.0), (120.001, 10.0), (120.1, 10.0), (121.0, 12.0)]
    stations = spark.createDataFrame([(1000 - i, *places[i % 4]) for i in range(800)], "station long, lon double, lat double")
    points = spark.createDataFrame([(i, 120.0004 + (i % 3) * 0.04, 10.0) for i in range(900)] + [(900, 121.0, 12.19), (901, None, 10.0)], "point long, lon double, lat double")
    got = {r.point: (r.station, r.km) for r in joins.nearest(points, "point", stations, "station", 20.0).collect()}
    least = {p: min(1000 - i for i in range(800) if i % 4 == p) for p in range(4)}
    assert len(got) == 900 and got[0] == (least[0], 0.044) and got[1] == (least[1], 4.315) and got[2] == (least[2], 2.146)
    looked = joins.nearest_places(points, stations, "station", 22.0, lambda km: km < 22.0)
    assert looked.count() == 4 and looked.where("lat > 11").first().station == least[3]


def test_ends_spread_over_half_a_path(spark):
    """A pair close together on a long chain reaches a few nodes, not the chain."""
    edges = spark.createDataFrame([(i, f"n{i:03}", f"n{i + 1:03}", 10) for i in range(120)], EDGES)
    left, right = (spark.createDataFrame([(1, x)], f"item long, {s} string") for s, x in (("a", "n050"), ("b", "n054")))
    met, labels, _ = graph._meetings(edges, left, right, 10**6, 1.0, lambda own: own)
    assert met.agg({"metres": "min"}).first()[0] == 40 and labels.count() < 20


def test_routes_with_ties_everywhere(spark):
    """On a grid of equal lines the path goes back from its end by the least node, then the least line, of those on a shortest path."""
    at = lambda x, y: f"{x}{y}"
    lines = [(at(x, y), at(x + dx, y + dy)) for x in range(5) for y in range(5) for dx, dy in ((1, 0), (0, 1)) if x + dx < 5 and y + dy < 5] * 2
    edges = spark.createDataFrame([(100 - i, *(e if i % 3 else e[::-1]), 7) for i, e in enumerate(lines)], EDGES)
    pairs = [("00", "44"), ("40", "04"), ("12", "33"), ("44", "00")]
    got = {}
    for r in graph.routes(edges, spark.createDataFrame(pairs, "a string, b string"), 10**6).orderBy("hop").collect():
        got.setdefault((r.a, r.b), []).append((r.line, r.forward))
    ways = [(u, v, 100 - i, i % 3 > 0) for i, (u, v) in enumerate(lines)]
    ways += [(v, u, line, not f) for u, v, line, f in ways]
    far = lambda a, b: abs(int(a[0]) - int(b[0])) + abs(int(a[1]) - int(b[1]))
    for a, b in pairs:
        want, node = [], b
        while node != a:
            u, line, f = min((u, line, f) for u, v, line, f in ways if v == node and far(a, u) + 1 == far(a, node))
            want.insert(0, (line, f))
            node = u
        assert got[a, b] == want


def test_closest_pairs(spark):
    """All pairs within the factor of their item's shortest; pairs that do not count leave the shortest to others; none where no path is."""
    lines = [("a", "m", 10), ("m", "b", 10), ("m", "c", 13), ("m", "d", 30), ("x", "y", 5)]
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(lines)], EDGES)
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "m"), (4, "b")], "item long, a string")
    right = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d"), (2, "x"), (3, "c"), (3, "d"), (4, "b"), (4, "m"), (5, "a")], "item long, b string")
    found = lambda *more: sorted(map(tuple, graph.closest_pairs(edges, left, right, 1000, 1.2, *more).select("item", "a", "b", "metres").collect()))
    assert found() == [(1, "a", "b", 20), (1, "a", "c", 23), (3, "a", "c", 23), (4, "b", "m", 10), (4, "m", "b", 10)]
    assert found(lambda pairs: pairs.where("metres > 25")) == [(1, "a", "d", 40), (3, "a", "d", 40)]


def test_searches_leave_out_what_lies_too_far_off(spark):
    """On a dense map of lines between far places, some shorter than straight: no way undercuts the bound, and pairs reach and cross a small part of what they do without places, to the same paths."""
    import heapq
    import math
    import random

    r = random.Random(5)
    places = [(f"n{i:03}", 120 + r.random() / 3, 10 + r.random() / 3) for i in range(240)]
    km = lambda p, q: 6371 * math.sqrt(((p[1] - q[1]) * math.cos(math.radians(10))) ** 2 + (p[2] - q[2]) ** 2) * math.pi / 180
    ends = [r.sample(range(240), 2) for _ in range(2400)]
    lines = [(i, places[a][0], places[b][0], max(40, int(1000 * km(places[a], places[b]) * r.choice([1, 1.02, 1.05])) - r.randrange(300))) for i, (a, b) in enumerate(ends)]
    edges, at = spark.createDataFrame(lines, EDGES), spark.createDataFrame(places, "node string, lon double, lat double")
    pairs = spark.createDataFrame([(places[i][0], places[-i][0]) for i in range(1, 40)], "a string, b string")
    with_places, without = ({tuple(x) for x in graph.routes(edges, pairs, 10**6, p).collect()} for p in (at, None))
    assert with_places == without and len({x[:2] for x in without}) == 39
    nodes = spark.createDataFrame([(p[0], i) for i, p in enumerate(places)], "node string, id long")
    placed = graph._placed(nodes, at)
    ways = spark.createDataFrame([(a, b, m) for (x, y), (*_, m) in zip(ends, lines, strict=True) for a, b in ((x, y), (y, x))], "u long, v long, metres long")
    to = ways.groupBy("u", "v").agg(F.min("metres").alias("metres")).join(placed.select(F.col("id").alias("v"), "x", "y", "z"), "v").cache()
    rate, slack = graph._least_rate(to, placed, 3000)
    assert 0.5 < rate <= 1 and 0 <= slack < 1000
    xyz = {p.id: (p.x, p.y, p.z) for p in placed.collect()}
    near = {}
    for e in to.collect():
        near.setdefault(e.u, []).append((e.v, e.metres))
    for a in range(0, 240, 20):
        dist, todo = {a: 0}, [(0, a)]
        while todo:
            d, u = heapq.heappop(todo)
            for v, m in near[u] if d == dist[u] else []:
                if d + m < dist.get(v, 10**9):
                    dist[v] = d + m
                    heapq.heappush(todo, (d + m, v))
        assert all(d >= rate * math.dist(xyz[a], xyz[b]) - slack for b, d in dist.items())
    asked = spark.createDataFrame([(2 * i, i, 30_000, *xyz[239 - i]) for i in range(20)], "search long, node long, budget long, x int, y int, z int")
    seen = []
    for search in (graph._Searches(to, rate, slack), graph._Searches(to)):
        reached = search.reached(asked).cache()
        seen.append((reached.count(), search.crossings(reached, asked).count()))
    assert seen[0][0] < seen[1][0] and seen[0][1] < seen[1][1] / 3
    late = graph._Searches(to, rate, slack)
    late.SMALL = 60
    again = late.reached(asked)
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in graph._Searches(to, rate, slack).reached(asked).collect()}
