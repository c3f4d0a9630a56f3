"""The interval queries over all events give what brute force gives; no grid is left out."""

import math
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from statistics import median

import pyarrow.parquet as pq
import pytest

from amperline.operators import interval as op
from amperline.plans import catalog

SF = "/root/testdata/sf0.001"


def money(x):
    return Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)


def half_up(x):
    return math.floor(x * 10000 + 0.5) / 10000


def mean(values):
    return half_up(float(sum(map(money, values))) / len(values))


@pytest.fixture(scope="module")
def events():
    return pq.read_table(f"{SF}/events.parquet").to_pylist()


def by(events, key):
    out = defaultdict(list)
    for e in events:
        out[key(e)].append(e["value"])
    return out


def day_grid(e):
    return e["ts"].strftime("%Y-%m-%d"), e["event_type"]


def pairs(events):
    return {(d, g) for d in {day_grid(e)[0] for e in events} for g in {e["event_type"] for e in events}}


def daily(events):
    own, out = by(events, day_grid), {}
    for k in pairs(events):
        v = own.get(k, [])
        mw = float(sum(money(x / 4) for x in v))
        out[k] = (float(max(map(money, v), default=0)), half_up(mw * 5 / 60), float(min((money(x - 20) for x in v), default=0)), sum(x - 20 < 0 for x in v))
    return out


def test_day_slots(spark, events):
    # stamps end their five minutes
    own = by(events, lambda e: (*day_grid(e), (e["ts"].hour * 60 + e["ts"].minute - 5) // 60 % 24))
    want = {(*k, h): mean(own[(*k, h)]) if (*k, h) in own else None for k in {day_grid(e) for e in events} for h in range(24)}
    got = catalog.QUERIES["q_day_slots_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r.day, r.grid, r.hour): r.mean for r in got} == want


def test_reliability_daily(spark, events):
    got = catalog.QUERIES["q_reliability_daily_all"](spark, SF).collect()
    want = daily(events)
    assert len(got) == len(want)
    assert {(r.day, r.grid): (r.peak, r.curtailed_mwh, r.min_slack, r.short_rows) for r in got} == want


def test_reliability_totals(spark, events):
    rows = daily(events)
    got = {r.grid: r for r in catalog.QUERIES["q_reliability_totals_all"](spark, SF).collect()}
    assert set(got) == {g for _, g in rows}
    for g, r in got.items():
        own = {d: x for (d, k), x in rows.items() if k == g}
        assert r.curtailed_mwh == half_up(float(sum(money(x[1]) for x in own.values()))) and r.short_rows == sum(x[3] for x in own.values())
        assert r.median_min_slack == half_up(median(x[2] for x in own.values()))
        assert r.peak_day == min((-x[0], d) for d, x in own.items())[1]


def test_dense_grid_fill(spark, events):
    own = by(events, day_grid)
    got = {(r.day, r.grid): r.mean for r in catalog.QUERIES["q_dense_grid_fill_all"](spark, SF).collect()}
    assert got == {k: mean(own[k]) if k in own else None for k in pairs(events)}


def test_more_than_64_grids(spark):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i % 2}", f"g{i}", float(i), 1.0, -1.0) for i in range(100)], "day string, grid string, bid double, curtailed double, slack double")
    got = op.reliability_daily(rows, "day", "grid", "bid", "curtailed", "slack").collect()
    assert len(got) == 200 and sum(r.short_rows for r in got) == 100
