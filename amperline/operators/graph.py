"""Networks: components, shortest paths and routes, parallel circuits, injections."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.sources.tables import written


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    return edges.select("u", "v", *extra).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *extra))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. Labels pass to neighbours and jump to their label's label, so rounds grow with the logarithm of the longest chain."""
    ends = written(both_ways(edges).distinct(), "ends")
    labels = ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "node")
    labels = written(labels, "labels")
    while True:
        near = ends.join(labels, ends.v == labels.node).groupBy("u").agg(F.min("c").alias("m"))
        lower = labels.join(near, labels.node == near.u).select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = lower.select(F.col("node").alias("_n"), F.col("c").alias("_c"))
        new = written(lower.join(jump, lower.c == jump._n).select("node", F.least("c", "_c").alias("c"), "old"), "labels")
        labels = new.select("node", "c")
        if new.where("c <> old").isEmpty():
            return labels.withColumnRenamed("c", "component")


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """(node, dist): least sum of w from the source; each round only spreads what the last one improved."""
    out = written(both_ways(edges, "w"), "edges")
    spark = edges.sparkSession
    dist = written(spark.createDataFrame([(source, 0.0)], "node long, dist double"), "dist")
    front = dist
    while not front.isEmpty():
        step = out.join(front, out.u == front.node).groupBy("v").agg(F.min(F.col("dist") + F.col("w")).alias("d"))
        joined = step.join(dist, step.v == dist.node, "left")
        front = written(joined.where(F.col("dist").isNull() | (F.col("d") < F.col("dist"))).select(F.col("v").cast("long").alias("node"), F.col("d").cast("double").alias("dist")), "front")
        dist = written(dist.unionByName(front).groupBy("node").agg(F.min("dist").alias("dist")), "dist")
    return dist


def parallel_circuits(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Circuits between the same buses as one: 1 / sum(1 / x), ratings added."""
    return branches.groupBy(*keys).agg(F.count("*").alias("circuits"), (1.0 / F.sum(1.0 / F.col("x"))).alias("x"), F.sum("rating").alias("rating"))


def injections(located: DataFrame, unlocated: DataFrame, grid: str, bus: str, mw: str) -> DataFrame:
    """MW per bus; what has no bus is spread over its grid's buses in proportion."""
    own = located.groupBy(grid, bus).agg(F.sum(mw).alias("mw"))
    rest = unlocated.groupBy(grid).agg(F.sum(mw).alias("rest"))
    share = F.col("mw") / F.sum("mw").over(Window.partitionBy(grid))
    return own.join(rest, grid, "left").select(grid, bus, (F.col("mw") + F.coalesce("rest", F.lit(0.0)) * share).alias("mw"))


def _ways(edges: DataFrame) -> DataFrame:
    """(u, v, metres, line, forward) of each line in both directions; between two nodes only the shortest, of equal ones the least, as no other is ever on a way."""
    own = written(edges.select("line", "u", "v", "metres"), "lines")
    both = own.select("u", "v", "line", "metres", F.lit(True).alias("forward")).unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v"), "line", "metres", F.lit(False).alias("forward")))
    least = both.groupBy("u", "v").agg(F.min(F.struct(F.col("metres").cast("long").alias("metres"), F.col("line").cast("long").alias("line"), "forward")).alias("w"))
    return written(least.select("u", "v", "w.*"), "ways")


def _spread(labels: DataFrame, ways: DataFrame, over: int, most: int) -> DataFrame:
    """(s, node, way) one line on from labels (s, node, far), where that is more than `over` and at most `most` metres from s."""
    on = labels.select("s", "node", "far").join(ways, F.col("node") == F.col("u")).where((F.col("far") + F.col("metres") > over) & (F.col("far") + F.col("metres") <= most))
    way = F.struct((F.col("far") + F.col("metres")).alias("far"), F.col("u").alias("prev"), "line", "forward", F.col("metres").alias("own"))
    return on.groupBy("s", F.col("v").alias("node")).agg(F.min(way).alias("way"))


def _grown(labels: DataFrame, begun: DataFrame, ways: DataFrame, over: int, most: int) -> DataFrame:
    """The labels (s, node, far, way) over `over` and up to `most`, where `labels` are all up to `over` and `begun` those of them that go on."""
    def unknown(came):
        return came.join(labels.select("s", "node"), ["s", "node"], "left_anti")

    new = written(unknown(_spread(begun, ways, over, most)).withColumn("moved", F.lit(True)), "reached")
    while True:
        front = new.where("moved").select("s", "node", F.col("way.far").alias("far"))
        came = unknown(_spread(front, ways, over, most)).select("s", "node", "way", F.lit(True).alias("came"))
        both = new.select("s", "node", "way", F.lit(False).alias("came")).unionByName(came).groupBy("s", "node").agg(F.min("way").alias("way"), F.min(F.when(~F.col("came"), F.col("way.far"))).alias("old"))
        # a way that is as short as the known one, but comes by a lesser node, changes the path and not the distance
        new = written(both.select("s", "node", "way", (F.col("old").isNull() | (F.col("way.far") < F.col("old"))).alias("moved")), "reached")
        if new.where("moved").isEmpty():
            return new.select("s", "node", F.col("way.far").alias("far"), "way")


def _ends(left: DataFrame, right: DataFrame, items: DataFrame) -> DataFrame:
    every = left.select("item", F.col("a").alias("s")).unionByName(right.select("item", F.col("b").alias("s")))
    return every.join(items, "item", "left_semi").select("s").distinct()


def _meetings(edges: DataFrame, left: DataFrame, right: DataFrame, most: int, factor: float, met_at: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(meetings, labels, ways) of the pairs of nodes (item, a) of `left` and (item, b) of `right`, a <> b: at least those within `factor` of their item's least.

    `met_at` makes of a step's meetings (item, a, b, node, way, left, metres) the rows (item, metres and others) that count.

    Distances grow around all ends at once, in steps up to `reach`; a pair is looked up over the
    lines that leave the distance of the step before around a and end within `reach` around b, which
    gives every path of up to the sum of the two. So an end is spread over half a path, not over the
    graph. An item ends when that sum passes `factor` times its least; those without a pair
    end at `most` or where nothing is left to reach.
    """
    ways = _ways(edges)
    step, longest = ways.groupBy("u").agg(F.min("metres").alias("least"), F.max("metres").alias("most")).agg(F.avg("least"), F.max("most")).first()
    left, right = written(left.select("item", "a").distinct(), "left"), written(right.select("item", "b").distinct(), "right")
    items = written(left.select("item").intersect(right.select("item")), "items")
    labels = written(_ends(left, right, items).select("s", F.col("s").alias("node"), F.lit(0).cast("long").alias("far"), F.lit(None).cast("struct<far: bigint, prev: string, line: bigint, forward: boolean, own: bigint>").alias("way")), "labels")
    size, reach, last, found, met = labels.count(), 0, 0, None, None
    step = max(1.0, step or 1.0)
    while longest is not None and not items.isEmpty():
        before, reach = reach, min(most, reach + math.ceil(step))
        ends = _ends(left, right, items)
        new = _grown(labels, labels.join(ends, "s", "left_semi"), ways, before, reach)
        n = new.count()
        labels, size, last = labels.unionByName(new), size + n, reach if n else last
        step = step * 2 if n < size / 4 else step
        own_a = left.join(items, "item", "left_semi")
        out = _spread(labels.where(F.col("far") <= before).join(own_a.select(F.col("a").alias("s")).distinct(), "s", "left_semi"), ways, before, min(most, before + reach))
        out = out.join(own_a, F.col("s") == F.col("a")).select("item", "a", "node", "way")
        back = labels.join(right.join(items, "item", "left_semi"), F.col("s") == F.col("b")).select("item", "b", "node", F.col("far").alias("left"))
        total = F.col("way.far") + F.col("left")
        meet = out.join(back, ["item", "node"]).where((F.col("a") != F.col("b")) & (total <= min(most, before + reach))).withColumn("metres", total)
        own = written(met_at(meet).withColumn("before", F.lit(before).cast("long")), "meetings")
        met = own if met is None else met.unionByName(own)
        found = met.groupBy("item").agg(F.min("metres").alias("least")).where(F.col("least") * factor <= before + reach)
        if before + reach >= most or reach - last > longest:
            break
        items = written(items.join(found, "item", "left_anti"), "items")
    return met, labels, ways


def closest_pairs(edges: DataFrame, left: DataFrame, right: DataFrame, most: int, factor: float, counts: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(item, a, b, metres) of the pairs of an (item, a) of `left` and an (item, b) of `right` whose shortest path is within `factor` of their item's shortest and `most`, a <> b.

    Pairs farther apart are not looked up. `counts` may leave out pairs or put others (item, metres and more) in their place before the shortest is taken; its other columns are then the pair's.
    """
    seen: list[DataFrame] = []

    def met_at(own: DataFrame) -> DataFrame:
        new = own.groupBy("item", "a", "b").agg(F.min("metres").alias("metres"))
        # a pair met before can be met again by a longer way
        seen.append(written(reduce(lambda df, old: df.join(old, ["item", "a", "b"], "left_anti"), seen, new), "close-pairs"))
        return counts(seen[-1])

    met, _, _ = _meetings(edges, left, right, most, factor, met_at)
    if met is None:
        return counts(left.join(right, "item").withColumn("metres", F.lit(0).cast("long")).limit(0))
    pair = [c for c in met.columns if c not in ("metres", "before")]
    least = F.min("metres").over(Window.partitionBy("item"))
    return met.groupBy(*pair).agg(F.min("metres").alias("metres")).withColumn("_least", least).where(F.col("metres") <= F.col("_least") * factor).drop("_least")


def _placed(nodes: DataFrame, places: DataFrame | None) -> DataFrame:
    """`nodes` (node, id) with x, y, z, whole metres from the middle of the earth; null without a place."""
    at = nodes.select("node").limit(0).select("node", F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat")) if places is None else places.groupBy("node").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    lon, lat = F.radians("lon"), F.radians("lat")
    xyz = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    return nodes.join(at, "node", "left").select("node", "id", *(F.round(c * 6_371_000).cast("int").alias(k) for k, c in xyz.items()))


def _straight(one: str, other: str) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (F.pow((F.col(f"{one}{k}") - F.col(f"{other}{k}")).cast("double"), 2) for k in "xyz")))


def _broadcast(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n < most else df


class _Searches:
    """Spreads from a node towards a target, each within half a budget and only to where the budget may still reach the target.

    `lines`: (u, v, metres, x, y, z), place of v. A way from any node to a target is at least `rate`
    times their straight line less `slack` metres; rate 0 where places are not known.
    """

    SMALL = 100_000

    def __init__(self, lines: DataFrame, rate: float = 0.0, slack: float = 0.0) -> None:
        self.lines, self.rate, self.slack = lines, rate, slack

    def _on(self, front: DataFrame, searches: DataFrame, within: Callable[[Column, Column], Column]) -> DataFrame:
        """(search, node, u, far) one line on from `front` (search, node, far), where `within` holds for the distance and the search's half."""
        asked = searches.select("search", "budget", *(F.col(k).alias(f"t{k}") for k in "xyz"))
        # of an odd budget the second of a pair's two searches has the greater half
        half = F.floor((F.col("budget") + F.col("search") % 2) / 2)
        far = F.col("far") + F.col("metres")
        on = front.join(asked, "search").join(self.lines, F.col("node") == F.col("u")).where(within(far, half))
        if self.rate:
            on = on.where(far + F.greatest(F.lit(0.0), self.rate * _straight("", "t") - self.slack) <= F.col("budget"))
        return on.select("search", F.col("v").alias("node"), "u", far.alias("far"))

    def reached(self, searches: DataFrame) -> DataFrame:
        """(search, node, far) of `searches` (search, node, budget, x, y, z), x, y, z the target's; far is least for all nodes on shortest ways to the target within the budget."""
        state = written(searches.select("search", "node", F.lit(0).cast("long").alias("far")), "reached")
        front, size, late = state, state.count(), False
        moved = size
        while moved:
            came = self._on(_broadcast(front, moved, self.SMALL), searches, lambda far, half: far <= half).select("search", "node", "far")
            if late := self.SMALL < size and moved < min(self.SMALL, size / 20):
                # few are left: they are looked up among the others, which stay where they are
                came = written(came.groupBy("search", "node").agg(F.min("far").alias("far")), "came")
                same = state.join(_broadcast(came.select("search", "node"), came.count(), 4 * self.SMALL), ["search", "node"], "left_semi")
                was = same.groupBy("search", "node").agg(F.min("far").alias("was"))
                front = written(came.join(was, ["search", "node"], "left").where("was IS NULL OR far < was").select("search", "node", "far"), "reached")
                state, moved = state.unionByName(front), front.count()
                continue
            both = state.withColumn("old", F.lit(True)).unionByName(came.withColumn("old", F.lit(False))).repartition("search")
            least = both.groupBy("search", "node").agg(F.min("far").alias("far"), F.min(F.when(F.col("old"), F.col("far"))).alias("was"))
            new = written(least.select("search", "node", "far", (F.col("was").isNull() | (F.col("far") < F.col("was"))).alias("moved")), "reached")
            state, front = new.select("search", "node", "far"), new.where("moved").select("search", "node", "far")
            size, moved = new.agg(F.count("*"), F.count_if("moved")).first()
        return written(state.repartition("search").groupBy("search", "node").agg(F.min("far").alias("far")), "reached") if late else state

    def crossings(self, reached: DataFrame, searches: DataFrame) -> DataFrame:
        """(search, node, u, far) over the lines that leave the half of a search's budget."""
        return self._on(reached, searches, lambda far, half: far > half)


def _least_rate(lines: DataFrame, placed: DataFrame, within: int) -> tuple[float, float]:
    """(rate, slack): no way is shorter than `rate` times the straight line between its ends less `slack`.

    A shortest way falls into stretches that first pass `within` metres with their last line, and a rest of at most
    `within`. `rate` is the least length of such a stretch over its straight line, `slack` what a rest lacks at most.
    """
    if placed.where("x IS NULL").limit(1).count():
        return 0.0, 0.0
    starts = placed.select((2 * F.col("id")).alias("search"), F.col("id").alias("node"), F.lit(2 * within).cast("long").alias("budget"), "x", "y", "z")
    near = _Searches(lines).reached(starts)
    own = placed.select((2 * F.col("id")).alias("search"), *(F.col(k).alias(f"t{k}") for k in "xyz"))
    length, straight = F.col("far") + F.col("metres"), _straight("", "t")
    stretches = near.join(own, "search").join(lines, F.col("node") == F.col("u")).where(length > within)
    rate = stretches.agg(F.min(F.try_divide(length, straight))).first()[0]
    if rate is None:
        return 0.0, 0.0
    rate = min(1.0, rate) * (1 - 1e-9)
    rest = near.join(own, "search").join(placed.select(F.col("id").alias("node"), "x", "y", "z"), "node")
    return rate, rest.agg(F.max(rate * straight - F.col("far"))).first()[0] + 1e-3


def routes(edges: DataFrame, pairs: DataFrame, most: int, places: DataFrame | None = None) -> DataFrame:
    """(a, b, hop, line, forward, line_metres, metres): the lines of a shortest path of at most `most` metres for each pair, in order from a.

    `edges`: (line, u, v, metres), metres a whole number over 0. Of equally short ways to a node the
    one by the least node counts, then the least line. Pairs without a path have no rows.
    `places` (node, lon, lat) of all nodes lets searches leave out what lies too far off (see `_least_rate`); the paths are the same without.

    Each pair has a budget of metres. Its ends spread over half of it and meet over the lines between
    the halves; pairs that do not meet try again with a larger budget, which grows faster as long as it reaches few more nodes.
    What lies on a shortest path beyond the half around a is then marked from the meetings on towards
    b, and paths are read backwards from b.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "a string, b string, hop int, line long, forward boolean, line_metres long, metres long")
    nodes = written(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    placed = written(_placed(nodes, places), "places")
    ends = {s: placed.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}{c}") for c in ("id", "x", "y", "z"))) for s in "ab"}
    by_id = edges.join(nodes.select(F.col("node").alias("u"), F.col("id").alias("_u")), "u").join(nodes.select(F.col("node").alias("v"), F.col("id").alias("_v")), "v").select("line", F.col("_u").alias("u"), F.col("_v").alias("v"), "metres")
    ways = _ways(by_id)
    step = ways.groupBy("u").agg(F.min("metres").alias("least")).agg(F.avg("least")).first()[0]
    if step is None:
        return none
    step = math.ceil(step)
    lines = written(ways.join(placed.select(F.col("id").alias("v"), "x", "y", "z"), "v").select("u", "v", "metres", "x", "y", "z"), "lines-to")
    part = components(ways.select("u", "v"))
    wanted = pairs.select("a", "b").where("a <> b").distinct().join(ends["a"], "a").join(ends["b"], "b")
    for s in "ab":
        wanted = wanted.join(part.select(F.col("node").alias(f"{s}id"), F.col("component").alias(f"{s}part")), f"{s}id")
    wanted = written(wanted.where("apart = bpart").drop("apart", "bpart").withColumn("item", F.monotonically_increasing_id()), "pairs")
    search = _Searches(lines, *_least_rate(lines, placed, 2 * step))
    straight = F.coalesce(_straight("a", "b"), F.lit(0.0)) if search.rate else F.lit(0.0)
    budget = F.least(F.lit(most), F.ceil(straight) + 2 * step).cast("long").alias("budget")
    items = written(wanted.select("item", budget, F.lit(step).cast("long").alias("more"), F.lit(0).cast("long").alias("before")), "budgets")
    item = F.expr("shiftright(search, 1)").alias("item")
    met, known = [], []
    while not items.isEmpty():
        own = items.join(wanted, "item")
        both = own.select((2 * F.col("item")).alias("search"), F.col("aid").alias("node"), "budget", *(F.col(f"b{k}").alias(k) for k in "xyz"))
        both = written(both.unionByName(own.select((2 * F.col("item") + 1).alias("search"), F.col("bid").alias("node"), "budget", *(F.col(f"a{k}").alias(k) for k in "xyz"))), "searches")
        reached = search.reached(both)
        out = search.crossings(reached.where("search % 2 = 0"), both).select(item, "node", "u", "far")
        # where b is within the half around a
        out = out.unionByName(reached.where("search % 2 = 0").select(item, "node", "far").join(own.select("item", F.col("bid").alias("node")), ["item", "node"]).select("item", "node", F.lit(None).cast("long").alias("u"), "far"))
        back = reached.where("search % 2 = 1").select(item, "node", F.col("far").alias("left"))
        meet = out.join(back, ["item", "node"]).withColumn("metres", F.col("far") + F.col("left")).join(items.select("item", "budget"), "item").where("metres <= budget")
        meet = written(meet.select("item", "u", "node", "left", "metres"), "meetings")
        least = meet.groupBy("item").agg(F.min("metres").alias("metres"))
        met.append(meet.join(least, ["item", "metres"]))
        known.append(written(reached.withColumn("item", item).join(least.select("item"), "item", "left_semi").repartition("item"), "labels"))
        n = reached.groupBy(item).agg(F.count("*").alias("n"))
        left = items.where(F.col("budget") < most).join(least, "item", "left_anti").join(n, "item").withColumn("more", F.when(F.col("n") < 2 * F.col("before"), 2 * F.col("more")).otherwise(F.col("more")))
        items = written(left.select("item", F.least(F.lit(most), F.col("budget") + F.col("more")).cast("long").alias("budget"), "more", F.col("n").alias("before")), "budgets")
    if not met:
        return none
    met, known = written(reduce(DataFrame.unionByName, met), "met"), reduce(DataFrame.unionByName, known)
    around = {s: known.where(F.col("search") % 2 == k).select("item", "node", "far") for k, s in enumerate("ab")}
    ways = written(ways.join(nodes.select(F.col("id").alias("u"), F.col("node").alias("prev")), "u"), "ways")
    came = F.struct("prev", "line", "forward", "metres", "u")
    by = [met.select("item", "node", F.col("u").alias("_u")).join(ways, (F.col("_u") == F.col("u")) & (F.col("node") == F.col("v"))).select("item", "node", came.alias("way"))]
    front, few = met.where("u IS NOT NULL").select("item", "node", "left").distinct(), search.SMALL // 20
    while n := front.count():
        on = _broadcast(front, n, search.SMALL).where("left > 0").join(ways, F.col("node") == F.col("u")).where("metres <= left").select("item", F.col("v").alias("node"), came.alias("way"), (F.col("left") - F.col("metres")).alias("far"))
        on = written(around["b"].join(_broadcast(on, n, few), ["item", "node", "far"]), "path-ways")
        by.append(on.select("item", "node", "way"))
        front = on.select("item", "node", F.col("far").alias("left")).distinct()
    beyond = written(reduce(DataFrame.unionByName, by).groupBy("item", "node").agg(F.min("way").alias("way")), "path-tree")
    total = met.groupBy("item").agg(F.min("metres").alias("far"))
    at = written(total.join(wanted, "item").select("item", "aid", F.col("bid").alias("node"), "far", F.lit(0).alias("back")), "path-ends")
    found, inner = [], []
    while not at.isEmpty():
        own = written(at.join(beyond, ["item", "node"], "left"), "path-steps")
        found.append(own.where("way IS NOT NULL").select("item", "back", "way"))
        inner.append(own.where("way IS NULL AND node <> aid").select("item", "aid", "node", "far", "back"))
        at = own.where("way IS NOT NULL").select("item", "aid", F.col("way.u").alias("node"), (F.col("far") - F.col("way.metres")).alias("far"), (F.col("back") + 1).alias("back"))
    at = written(reduce(DataFrame.unionByName, inner), "path-halves")
    while n := at.count():
        into = _broadcast(at, n, search.SMALL).join(ways, F.col("node") == F.col("v")).where("metres <= far").select("item", "aid", "back", came.alias("way"), F.col("u").alias("node"), (F.col("far") - F.col("metres")).alias("far"))
        own = written(around["a"].join(_broadcast(into, n, few), ["item", "node", "far"]).groupBy("item", "aid", "back").agg(F.min(F.struct("way", "far")).alias("x")).select("item", "aid", "back", "x.*"), "path-steps")
        found.append(own.select("item", "back", "way"))
        at = own.where("way.u <> aid").select("item", "aid", F.col("way.u").alias("node"), "far", (F.col("back") + 1).alias("back"))
    hops = F.max("back").over(Window.partitionBy("item"))
    steps = reduce(DataFrame.unionByName, found).select("item", (hops - F.col("back")).alias("hop"), "way")
    return steps.join(wanted.select("item", "a", "b"), "item").join(total, "item").select("a", "b", "hop", "way.line", "way.forward", F.col("way.metres").alias("line_metres"), F.col("far").alias("metres"))
