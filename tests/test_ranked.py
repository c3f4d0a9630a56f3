"""Places, ranks and quantiles over many ranges against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from amperline.operators import ranked, windows

SCHEMA = "g string, v double, t long, _c string"


@pytest.fixture(scope="module")
def many(spark):
    """Small ranges stay apart, so that a key spreads over several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows():
    """Key a has most rows, a third of them one value; null values and a null key; repeated rows."""
    rnd = random.Random(5)
    rows = [("a", 7.0 if i % 3 == 0 else float(rnd.randint(-50, 50)), i, "x") for i in range(900)]
    rows += [("b", float(i % 5), i, "y") for i in range(40)] + [("b", None, 99, "y"), (None, 1.5, 1, None), (None, 2.5, 2, None), ("c", None, 1, "z"), ("d", 4.0, 1, "z"), ("d", 4.0, 1, "z")]
    return rows


def _of(rows):
    out = {}
    for g, v, *_ in rows:
        out.setdefault(g, []).append(v)
    return out


def _low(v):
    return -math.inf if v is None else v


def test_places(many):
    rows = _rows()
    df = many.createDataFrame(rows, SCHEMA).repartition(6).select("g", "v", "t")
    got = {}
    for r in ranked.placed(df, ["g"], [F.desc("v"), F.asc("t")]).collect():
        got.setdefault(r.g, []).append((r._place, r.v, r.t, r._n))
    assert sum(map(len, got.values())) == len(rows)
    for g, found in got.items():
        mine = sorted(((v, t) for k, v, t, _ in rows if k == g), key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))
        assert [(v, t) for _, v, t, _ in sorted(found, key=lambda x: x[0])] == mine
        assert sorted(p for p, *_ in found) == list(range(len(mine)))
        assert {n for *_, n in found} == {len(mine)}


def test_quantiles(many):
    rows = _rows()
    df = many.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.g: r for r in windows.percentile_kinds(df, ["g"], "v", 0.9).collect()}
    band = {r.g: r for r in windows.hour_band(df, ["g"], "v").collect()}
    assert set(got) == set(band) == {"a", "b", "c", "d", None}

    def line(s, q):
        at = q * (len(s) - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        return math.floor((lo + (hi - lo) * (at - math.floor(at))) * 1e4 + 0.5) / 1e4

    for g, values in _of(rows).items():
        s = sorted(v for v in values if v is not None)
        if not s:
            assert got[g][1:] == (None,) * 6
            continue
        n = len(s)
        assert (got[g].p_low, got[g].p_clipped, got[g].p_near) == (s[math.floor(0.9 * (n - 1))], s[min(n - 1, math.floor(0.9 * n))], s[math.floor(0.9 * (n - 1) + 0.5)])
        assert (got[g].median_upper, got[g]["median"]) == (s[n // 2], line(s, 0.5))
        assert abs(got[g].p_linear - line(s, 0.9)) < 2e-4
        assert all(abs(band[g][f"p{q}"] - line(s, q / 100)) < 2e-4 for q in (10, 50, 90))


def test_average_ranks(many):
    rows = _rows()
    df = many.createDataFrame(rows, SCHEMA).repartition(6)
    out = windows.average_ranks(df, ["g"], "v", "rank")
    assert out.columns == ["g", "v", "t", "_c", "rank"]
    found = out.collect()
    assert len(found) == len(rows)
    by = {g: [_low(v) for v in values] for g, values in _of(rows).items()}
    for r in found:
        assert r["rank"] == sum(v < _low(r.v) for v in by[r.g]) + 1 + (by[r.g].count(_low(r.v)) - 1) / 2


def test_empty_table(many):
    df = many.createDataFrame([], SCHEMA)
    assert windows.duration_curve(df, ["g"], "v", "t").count() == 0
    assert windows.percentile_kinds(df, ["g"], "v", 0.9).count() == 0
    assert windows.average_ranks(df, ["g"], "v", "rank").count() == 0
