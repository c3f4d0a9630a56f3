"""Names inside names, ladders, draws, replays and lost units on small and random inputs against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from amperline.operators import desk, layers, matching, scenario, stack, windows


def test_one_in_the_other(spark):
    r = random.Random(9)
    word = lambda a, b: "".join(r.choice("abc") for _ in range(r.randrange(a, b)))
    left, right = [(i, word(0, 12)) for i in range(120)], [(i, word(0, 7)) for i in range(90)] + [(90, None)]
    got = matching.one_in_the_other(spark.createDataFrame(left, "l long, lt string"), "l", "lt", spark.createDataFrame(right, "r long, rt string"), "r", "rt").collect()
    want = {(i, j) for i, a in left for j, b in right if a and b and (a in b or b in a)}
    assert {(x.l, x.r) for x in got} == want and len(got) == len(want)


def test_sure_sources(spark):
    """A source with candidates far apart or in another grid is passed over."""
    own = spark.createDataFrame([(1, "n"), (2, "n"), (3, "s")], "res long, grid string")
    kind = "res long, site long, lon double, lat double, grid string"
    first = spark.createDataFrame([(1, 7, 120.0, 10.0, "n"), (1, 8, 121.0, 10.0, "n"), (2, 9, 120.0, 10.0, "n"), (2, 5, 120.1, 10.0, "n"), (3, 6, 120.0, 10.0, "n")], kind)
    second = spark.createDataFrame([(1, 4, 122.0, 11.0, "n"), (2, 3, 123.0, 11.0, "n")], kind)
    got = {x.res: (x.source, x.site) for x in matching.located(own, "res", "grid", [("a", first), ("b", second)]).collect()}
    assert got == {1: ("b", 4), 2: ("a", 5), 3: (None, None)}


def test_null_model_extremes(spark):
    pool = spark.createDataFrame([(k, v) for k in range(30) for v in range(20)], "k long, v long")
    marginal = spark.createDataFrame([(k, 0) for k in range(30)], "k long, v long")
    named = spark.createDataFrame([(k, 0) for k in range(30)], "k long, v long")
    x = matching.overlap_null_model(pool, named, marginal, "k", "v", 99, 1).first()
    assert (x.keys, x.agree, x.as_high, x.p_value) == (30, 30, 0, 0.01) and 0.5 < x.null_mean < 2.5
    x = matching.overlap_null_model(pool, pool, marginal, "k", "v", 9, 1).first()
    assert (x.agree, x.null_mean, x.p_value) == (30, 30.0, 1.0)  # who names all is right by chance


def test_replay(spark):
    r = random.Random(4)
    books = {k: sorted((r.randrange(12), r.randrange(1, 40)) for _ in range(r.randrange(1, 9))) for k in range(12)}
    asked = [(k, i, r.randrange(-5, 260)) for i in range(300) for k in [r.randrange(14)]]
    blocks = spark.createDataFrame([(k, i, c, m) for k, b in books.items() for i, (c, m) in enumerate(b)], "k long, i long, cost long, mw long")
    out = stack.replay(stack.running_stack(blocks, ["k"], "cost", "mw", ["i"]), spark.createDataFrame(asked, "k long, label long, mw long"), ["k"], "cost", "label", "mw")

    def clear(k, mw):
        if k not in books or mw <= 0:
            return None, False
        total = 0
        for cost, own in books[k]:
            total += own
            if total >= mw:
                return float(cost), False
        return 32.0, True

    assert {(x.k, x.label): (x.price, x.short) for x in out.collect()} == {(k, i): clear(k, mw) for k, i, mw in asked}


def test_lost_units(spark):
    r = random.Random(8)
    blocks = [(g, u, r.randrange(6), r.randrange(1, 50)) for g in range(6) for u in range(g + 1) for _ in range(r.randrange(1, 6))]
    want = {}
    for g in range(6):
        for lost in {u for a, u, _, _ in blocks if a == g}:
            left = sorted((c, m) for a, u, c, m in blocks if a == g and u != lost)
            if left:
                total, price = 0, 32.0
                for c, m in left:
                    total += m
                    if total >= 120 and price == 32.0:
                        price = float(c)
                want[g, lost] = (total, max(0, 120 - total), price)
    out = scenario.each_unit_out(spark.createDataFrame(blocks, "g long, u long, c long, m long"), "g", "u", "c", "m", 120)
    assert {(x.g, x.lost): (x.available, x.shortfall, x.price) for x in out.collect()} == want


def test_close_events(spark):
    r = random.Random(6)
    times = {k: sorted(r.sample(range(4000), 150)) for k in "ab"}
    rows = [(k, t) for k, own in times.items() for t in own + own[:20]]
    frame = spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    want = set()
    for k, own in times.items():
        last = None
        for t in own:
            if last is None or t - last > 60:
                want.add((k, t))
                last = t
    assert {(x.k, x.kept_at) for x in windows.dedupe_close(frame, ["k"], "ts", 60).collect()} == want


@pytest.mark.parametrize("full", [3, 2])
def test_rolling_over_midnight(spark, full):
    rows = [("a", 86_400 * 3 + h * 3600, float(h % 5)) for h in range(-5, 6) if h != 2]
    got = windows.rolling_trigger(spark.createDataFrame(rows, "k string, e long, v double"), ["k"], "e", "v", 3 * 3600, full, 1.5).first()
    by = {e: v for _, e, v in rows}
    means = {e: sum(own) / full for e in by for own in [[by[x] for x in by if e - 3 * 3600 < x <= e]] if len(own) == full}
    best = max(means.values())
    assert (got.windows, got.breaches) == (len(means), sum(m > 1.5 for m in means.values()))
    assert got.max_mean == pytest.approx(best, abs=1e-4) and got.max_at == min(e for e, m in means.items() if m == best)


def test_outages_count_units_once(spark):
    rows = [("d", "07BDPP_U1", "verified", "v", "oil", "BOHOL", 5.0), ("d", "07BIDPP_U1", "verified", "v", "oil", "BOHOL", 5.0), ("d", "07BDPP_U2", "verified", "v", "oil", "BOHOL", 5.0), ("d", "07BDPP_U2", "verified", "v", "oil", "BOHOL", 5.0), ("d", "X_U1", "unmatched", None, None, None, None), ("e", "07BIDPP_U1", "verified", None, "oil", "BOHOL", 5.0)]
    mw, counts = layers.outages_by_day(spark.createDataFrame(rows, "day string, res string, match string, grid string, fuel string, plant string, mw double"), "day", "res", "match", "grid", "fuel", "plant", "mw")
    assert list(map(tuple, mw.collect())) == [("d", "v", "oil", 10.0)]
    assert sorted(map(tuple, counts.collect())) == [("d", 4, 1), ("e", 1, 0)]


def test_fisher_interval(spark):
    import math

    rows = [(0.5, 30), (1.0, 30), (0.5, 3), (None, 30)]
    low, high = desk.fisher_interval(F.col("r"), F.col("n"))
    got = [tuple(x) for x in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, r double, n long").orderBy("i").select(low, high).collect()]
    z, half = math.atanh(0.5), 1.96 / math.sqrt(27)
    assert got[0] == pytest.approx((math.tanh(z - half), math.tanh(z + half)), abs=6e-4) and got[1:] == [(None, None)] * 3


def test_storage_goes_down_the_day(spark):
    r = random.Random(2)
    hours = [(d, h, r.randrange(10), r.randrange(3)) for d in range(4) for h in range(24)]
    out = desk.storage_schedule(spark.createDataFrame(hours, "d long, h int, p long, q long"), ["d"], "h", "p", "q", 50, 120, 0.8).collect()
    held = defaultdict(float)
    for x in sorted(out, key=lambda x: (x.d, x.h)):
        held[x.d] += x.charge * 0.8 - x.discharge
        assert x.held == pytest.approx(held[x.d], abs=0.06) and -1e-6 <= held[x.d] <= 120 + 1e-6 and min(x.charge, x.discharge) == 0
    for d in range(4):
        order = [h for _, _, h in sorted((p, q, h) for a, h, p, q in hours if a == d)]
        assert {x.h for x in out if x.d == d and x.charge > 0} <= set(order[:3]) and {x.h for x in out if x.d == d and x.discharge > 0} <= set(order[-3:])


def test_null_model_in_rows_and_by_sorts(spark):
    """Pools drawn from in their row and pools too large for that give the same draws; odd rows count as they do in the sets."""
    rows = [(k, (k * 7 + i * 3) % 23, i) for k in range(30) for i in range(k % 9 + 1)] + [(None, 1, 0), (3, None, 0), (4, 2, 1)]
    every = spark.createDataFrame(rows, "k long, v long, i int")
    named, marginal = every.where("i < 3"), every.where("v % 3 = 0")
    found = [tuple(matching.overlap_null_model(every, named, marginal, "k", "v", 20, 7, n).first()) for n in (0, 4, 2000)]
    pool, names, hits = ({(k, v) for k, v, i in rows if k is not None and keep(v, i)} for keep in (lambda v, i: True, lambda v, i: i < 3, lambda v, i: v is not None and v % 3 == 0))
    keys = {k for k, _ in names} & {k for k, _ in hits}
    assert found[0] == found[1] == found[2]
    assert found[0][:2] == (len(keys), sum(bool({x for x in names if x[0] == k} & hits) for k in keys))


def test_plants_of_one_name_are_looked_up_once(spark):
    """Copies of a plant match as their least does: the rows compared do not grow with the copies."""
    own = spark.createDataFrame([("R1", "COLD5", "a"), ("R2", "COLD5", "b"), ("R3", "LONGCOLD5NAME", "a"), ("R4", "COLX", "a")], "res string, core string, grid string")
    plants = spark.createDataFrame([(900 - i, "Cold 5 Plant" if i % 2 else "Cold-5", "a") for i in range(400)], "plant long, name string, grid string")
    got = {r.res: (r.outcome, r.plant) for r in matching.classify(own, "res", "core", "grid", plants, {}, {}, set(), ["ZZ"]).collect()}
    assert got == {"R1": ("matched", "502"), "R2": ("unclassified", None), "R3": ("matched", "502"), "R4": ("unclassified", None)}
