"""Nodes by hour and the reference price, on rows made by hand."""

from pyspark.sql import functions as F

from amperline.operators import desk

COLUMNS = "day string, grid string, node string, hour int, slot string, price double, ref double, loss double, cong double, mw double"


def rows(spark):
    return spark.createDataFrame(
        [
            ("d1", "g", "a", 0, "00:05", 105.0, 100.0, 5.0, 0.0, 10.0),
            ("d1", "g", "a", 0, "00:10", 109.0, 100.0, 5.0, 4.0, 20.0),
            ("d1", "g", "b", 0, "00:10", 211.0, 200.0, 9.0, 2.0, 1.0),
            ("d1", "g", "c", 0, "00:10", 200.0, 200.0, 0.0, 0.0, 1.0),
            ("d1", "g", "a", 1, "01:05", 50.0, 50.0, 0.0, 0.0, 7.0),
            ("d1", "g", "b", 1, "01:05", 60.0, 60.0, 0.0, 0.0, 7.0),
            ("d2", "g", "a", 0, "00:05", 100.0, 100.0, 0.0, 0.0, 1.0),  # one hour only
            ("d3", "g", "a", 0, "00:05", 100.0, 100.0, 0.0, 0.0, 1.0),
            ("d3", "g", "a", 1, "01:05", 100.0, 90.0, 9.9, 0.0, 1.0),  # 0.1 is missing
        ],
        COLUMNS,
    )


def sound(df, most=0.05):
    return desk.sound_days(df, "day", "hour", F.col("price"), [F.col("ref"), F.col("loss"), F.col("cong")], most, 2)


def test_sound_days(spark):
    df = rows(spark)
    assert {r.day for r in sound(df).collect()} == {"d1"}
    assert {r.day for r in sound(df, 0.1).collect()} == {"d1", "d3"}
    assert sound(df.where("false")).count() == 0


def test_nodes(spark):
    found = {(r.node, r.hour): (r.n, r.deviation, r.mw, r.congestion) for r in desk.nodal_hours(sound(rows(spark)), ["day", "grid", "node", "hour"], "price", "ref", "cong", "mw").collect()}
    assert found == {("a", 0): (2, 7.0, 15.0, 4.0), ("b", 0): (1, 11.0, 1.0, 2.0), ("c", 0): (1, 0.0, 1.0, None), ("a", 1): (1, 0.0, 7.0, None), ("b", 1): (1, 0.0, 7.0, None)}


def test_reference(spark):
    found = {r.hour: (r.intervals, r.multimodal, r.reference) for r in desk.reference_hours(sound(rows(spark)), ["day", "grid", "hour"], "slot", "ref").collect()}
    # 00:10 has 200 twice and 100 once; 01:05 has 50 and 60 once each, so the lesser counts
    assert found == {0: (2, 1, 150.0), 1: (1, 1, 50.0)}
