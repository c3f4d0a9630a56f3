"""The market queries over all suppliers, lines and hours give what brute force gives."""

import datetime
from collections import defaultdict
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from amperline.operators import scenario
from amperline.plans import catalog, market_plans

SF = "/root/testdata/sf0.01"


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def lines():
    return pq.read_table(f"{SF}/lineitem.parquet").to_pylist()


@pytest.fixture(scope="module")
def books(lines):
    out = defaultdict(list)
    for x in lines:
        out[x["l_suppkey"]].append((round(x["l_discount"] * 100), int(x["l_quantity"]), x["l_returnflag"], x["l_partkey"] % 5))
    assert len(out) > 60
    return out


def price(blocks, demand):
    cum = 0
    for cost, mw in sorted(blocks):
        cum += mw
        if cum >= demand:
            return cost
    return 32


def test_n1(spark, books):
    want = {}
    for g, book in books.items():
        for lost in {b[3] for b in book}:
            left = [(c, mw) for c, mw, _, u in book if u != lost]
            if left:
                have = sum(mw for _, mw in left)
                want[g, lost] = have, max(0, 9000 - have), float(price(left, 9000))
    got = run(spark, "q_n1_all")
    assert len(got) == len(want) and {(r.grid, r.lost): (r.available, r.shortfall, r.price) for r in got} == want


def test_load_sweep(spark, books):
    want = {}
    for g, book in books.items():
        at = [(add, price([b[:2] for b in book], 8000 + add)) for add in range(0, 3001, 25)]
        want[g] = next((a for a, p in at if p > 7), -1), next((a for a, p in at if p == 32), -1)
    assert {r.grid: (r.first_over, r.first_short) for r in run(spark, "q_load_sweep_all")} == want


def test_tornado(spark, books):
    levers = {"base": (0, "", 1), "load +5%": (400, "", 1), "load -5%": (-400, "", 1), "A costs double": (0, "A", 2), "N costs double": (0, "N", 2)}
    sums = {k: sum(price([(c * s if f == fuel else c, mw) for c, mw, f, _ in b], 8000 + add) for b in books.values()) for k, (add, fuel, s) in levers.items()}
    assert {r.lever: r.delta for r in run(spark, "q_tornado_all")} == {k: v - sums["base"] for k, v in sums.items() if k != "base"}


def test_monte_carlo(spark):
    units = [(u, int(abs(b)), 5 + u % 10) for u, b in zip(*pq.read_table(f"{SF}/supplier.parquet", columns=["s_suppkey", "s_acctbal"]).to_pydict().values(), strict=True)]

    def step(x):
        return (x * 1103515245 + 12345) % 2147483648

    load = sum(mw for _, mw, _ in units) * 9 // 10
    short = [max(0, load - sum(mw for u, mw, pct in units if step(step(draw * 7919 + u * 104729 + 42)) // 65536 % 100 >= pct)) for draw in range(2000)]
    assert [tuple(r) for r in run(spark, "q_monte_carlo_all")] == [(2000, sum(x > 0 for x in short), sum(short), max(short))]


def test_compact_book(spark, books):
    got = defaultdict(dict)
    for r in run(spark, "q_compact_book"):
        got[r.grid][r.cost] = r.mw
    assert set(got) == set(books)
    for g, book in books.items():
        own = defaultdict(float)
        for c, mw, _, _ in book:
            own[float(c)] += mw
        p, q = sorted(own), [own[c] for c in sorted(own)]
        while len(p) > 6:
            i = min(range(len(p) - 1), key=lambda k: (p[k + 1] - p[k], k))
            p[i : i + 2], q[i : i + 2] = [round((p[i] * q[i] + p[i + 1] * q[i + 1]) / (q[i] + q[i + 1]), 3)], [q[i] + q[i + 1]]
        assert got[g] == dict(zip(p, q, strict=True))


def test_complete_sets(spark, lines):
    own = defaultdict(set)
    for x in lines:
        own[x["l_suppkey"]].add(x["l_discount"])
    assert {r.l_suppkey: r.parts for r in run(spark, "q_complete_sets_all")} == {k: 11 for k, v in own.items() if len(v) == 11}


def test_affine_fit(spark, lines):
    own = defaultdict(list)
    for x in lines:
        own[x["l_returnflag"]].append((Fraction(x["l_quantity"]), Fraction(x["l_extendedprice"]) / 100))
    got = {r.l_returnflag: r for r in run(spark, "q_affine_fit_all")}
    assert set(got) == set(own)
    for k, xy in own.items():
        n, sx, sy = len(xy), sum(x for x, _ in xy), sum(y for _, y in xy)
        cov, vx, vy = n * sum(x * y for x, y in xy) - sx * sy, n * sum(x * x for x, _ in xy) - sx * sx, n * sum(y * y for _, y in xy) - sy * sy
        r = got[k]
        want = float(cov) / float(vx) ** 0.5 / float(vy) ** 0.5, float(cov / vx), float((sy - cov / vx * sx) / n)
        assert r.n == n and all(abs(a - b) < 0.0002 for a, b in zip((r.corr, r.slope, r.intercept), want, strict=True))


def test_hours_reach_from_the_first_to_the_last(spark, tmp_path):
    day = datetime.datetime(2025, 6, 1)
    rows = [(1, day, "a", 1, 5.0), (2, day + datetime.timedelta(days=40, minutes=59), "b", 1, 7.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.grid, r.epoch): r.value for r in market_plans._hours(spark, str(tmp_path)).where(F.col("value") > 0).collect()}
    first = int(day.replace(tzinfo=datetime.UTC).timestamp())
    assert got == {("a", first): 5.0, ("b", first + 40 * 86400): 7.0}
    assert market_plans._hours(spark, str(tmp_path)).count() == 2 * (40 * 24 + 1)


def test_levers_over_books_of_equal_costs(spark):
    """Blocks of one cost, also where a lever moves one fuel onto another's cost, reach the demand at one price."""
    rows = [("g", "A", 2, 5), ("g", "A", 2, 5), ("g", "N", 4, 10), ("g", "N", 4, 5), ("h", "N", 3, 40)]
    blocks = spark.createDataFrame(rows, "grid string, fuel string, cost int, mw long")
    levers = spark.createDataFrame([("base", 0, "", 1), ("up", 10, "", 1), ("A", 0, "A", 2), ("N", 0, "N", 2)], "lever string, add int, lever_fuel string, scale int")
    got = {r.lever: r.delta for r in scenario.tornado(blocks, "grid", "fuel", "cost", "mw", 20, levers).collect()}
    assert got == {"up": 28, "A": 0, "N": 7}
