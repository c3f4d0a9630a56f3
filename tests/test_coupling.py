"""Coupling of three zones against every pair of whole flows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from amperline.operators import coupling

WHEEL = 1


def cost_and_price(blocks, need):
    cost, left, price = 0, need, None
    for p, mw in sorted(blocks):
        take = max(0, min(mw, left))
        cost, left = cost + take * p, left - take
        if price is None and left <= 0:
            price = p
    return (cost + left * coupling.SHORT, coupling.SHORT if price is None else price)


def cheapest(blocks, d, c1, c2):
    """(f1, f2, prices) of the cheapest whole flows, of equals the smallest."""
    best = None
    for f1 in range(-c1, c1 + 1):
        for f2 in range(-c2, c2 + 1):
            need = (d[0] + f1, d[1] + f2 - f1, d[2] - f2)
            if min(need) < 0:
                continue
            zones = [cost_and_price(blocks[i], need[i]) for i in range(3)]
            key = (sum(z[0] for z in zones) + WHEEL * (abs(f1) + abs(f2)), abs(f1) + abs(f2), f1, f2)
            if best is None or key < best[0]:
                best = (key, [z[1] for z in zones])
    return best[0][2], best[0][3], best[1]


@pytest.fixture(scope="module")
def market():
    """Intervals with (blocks, demands, limits): ties, a closed corridor, one too small to serve."""
    rng = random.Random(5)
    out = {}
    for hour in range(24):
        blocks = [sorted({rng.randint(1, 9): rng.randint(1, 6) for _ in range(rng.randint(1, 4))}.items()) for _ in range(3)]
        out[hour] = (blocks, [rng.randint(0, 9) for _ in range(3)], 0 if hour % 6 == 0 else rng.randint(1, 7), rng.randint(1, 7))
    return out


@pytest.fixture(scope="module")
def cleared(spark, market):
    blocks = [(h, z + 1, p, mw) for h, (b, _, _, _) in market.items() for z in range(3) for p, mw in b[z]] + [(99, 1, 3, 5)]
    demand = [(h, z + 1, d[z]) for h, (_, d, _, _) in market.items() for z in range(3)] + [(99, 1, 2)]
    zones = coupling.zones(spark.createDataFrame(blocks, "hour int, zone int, price long, mw long"), ["hour"], "zone", "price", "mw", spark.createDataFrame(demand, "hour int, zone int, d long"))
    limits = spark.createDataFrame([(h, x[2], x[3]) for h, x in market.items()] + [(99, 5, 5)], "hour int, c1 long, c2 long")
    return zones.join(limits, "hour")


def test_flows_prices_and_rents(cleared, market):
    rows = {r.hour: r for r in coupling.priced(cleared, ["hour"], "c1", "c2", WHEEL).collect()}
    assert set(rows) == set(market)  # hour 99 has one zone only
    for h, (blocks, d, c1, c2) in market.items():
        f1, f2, prices = cheapest(blocks, d, c1, c2)
        r = rows[h]
        assert (r.f1, r.f2, [r.p1, r.p2, r.p3]) == (f1, f2, prices)
        for f, c, full, rent, gap in ((f1, c1, r.saturated1, r.rent1, prices[1] - prices[0]), (f2, c2, r.saturated2, r.rent2, prices[2] - prices[1])):
            assert full == (c > 0 and abs(f) == c)
            assert rent == ((gap if f > 0 else -gap) if full else 0)


def half_up(x, digits):
    return (x * 10**digits + 0.5) // 1 / 10**digits


def test_summaries(spark, cleared, market):
    report = coupling.priced(cleared, ["hour"], "c1", "c2", WHEEL).withColumn("scenario", F.lit("base"))
    found = [(h, *cheapest(*x), x[2], x[3]) for h, x in market.items()]
    rents = {r.corridor: r for r in coupling.rents(report, ["scenario"], (5, 5), "c1", "c2").collect()}
    for i in (1, 2):
        flow, cap = [abs(x[i]) for x in found], [x[3 + i] for x in found]
        gaps = [(x[3][i] - x[3][i - 1]) * (1 if x[i] > 0 else -1) for x in found if x[3 + i] > 0 and abs(x[i]) == x[3 + i]]
        r = rents[i]
        assert (r.n, r.capped, r.peak_flow) == (24, sum(c < 5 for c in cap), max(flow))
        assert r.saturated_pct == half_up(100 * len(gaps) / 24, 1) and r.mean_rent == (half_up(sum(gaps) / len(gaps), 3) if gaps else 0.0)
        assert r.mean_flow == half_up(sum(flow) / 24, 1) and r.mean_cap == half_up(sum(cap) / 24, 1)
    # hour 3 lacks an observation; zone 3 is seen at zone 1's price, so its spread explains nothing
    seen = spark.createDataFrame([(h, 4, 6 + h % 3, None if h == 3 else 4) for h in market], "hour int, o1 long, o2 long, o3 long")
    rows = {r.zone: r for r in coupling.spreads(report, ["scenario", "hour"], ["scenario"], seen).collect()}
    own = [x for x in found if x[0] != 3]
    modelled = half_up(sum(x[3][1] - x[3][0] for x in own) / 23, 3)
    observed = half_up(sum(2 + x[0] % 3 for x in own) / 23, 3)
    assert (rows[2].n, rows[2].observed_spread, rows[2].modelled_spread, rows[2].explained) == (23, observed, modelled, half_up(modelled / observed, 3))
    assert rows[2].mae == half_up(sum(abs(x[3][1] - 6 - x[0] % 3) for x in own) / 23, 3)
    assert rows[3].explained is None and rows[1].modelled_spread == 0.0


def test_outage_takes_the_dearest_first(spark):
    blocks = [("a", 1, 2, 10), ("a", 1, 5, 10), ("a", 1, 9, 10), ("b", 1, 2, 3), ("b", 2, 2, 7)]
    df = spark.createDataFrame(blocks, "day string, zone int, price long, mw long")
    out = coupling.outage(df, ["day", "zone"], "price", "mw", (F.col("zone") == 1) & (F.col("price") <= 5), 14)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 2, 6), ("a", 1, 9, 10), ("b", 2, 2, 7)]


def test_first_load_that_binds(cleared, market):
    found = {r.hour: (r.base, r.binds_at) for r in coupling.binding_threshold(cleared, ["hour"], 0, 12, 3, "c1", "c2", WHEEL).collect()}
    want = defaultdict(lambda: None)
    for h, (blocks, d, c1, c2) in market.items():
        for add in range(12, -1, -3):
            if c1 > 0 and abs(cheapest(blocks, [d[0], d[1] + add, d[2]], c1, c2)[0]) == c1:
                want[h] = add
    assert found == {h: (x[1][1], want[h]) for h, x in market.items()}
    assert {None} < set(want[h] for h in market)


def test_empty(spark, cleared):
    none = cleared.where("false")
    assert coupling.rents(coupling.priced(none, ["hour"], "c1", "c2", WHEEL), [], (5, 5), "c1", "c2").count() == 0
    assert coupling.binding_threshold(none, ["hour"], 0, 6, 3, "c1", "c2", WHEEL).count() == 0
