"""Streams over several batches, restarted between them, with rows out of order and late ones, against one batch over all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from amperline.functions.numeric import half_up
from amperline.operators import windows
from amperline.streaming import flows, outages

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
KIND = "event_id long, ts timestamp, grid string, equipment long, value double"


def rows(spark, values):
    return spark.createDataFrame([(i, DAY + datetime.timedelta(minutes=m), g, e, float(v)) for i, m, g, e, v in values], KIND)


class Feed:
    """A folder of files that grows, as a stream of one file a batch."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, f"{path}/in"
        self.out, self.state = f"{path}/out", f"{path}/state"

    def add(self, values):
        rows(self.spark, values).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(self.path)

    def every(self):
        return self.spark.read.parquet(self.path)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_outages_out_of_order_over_restarts(feed):
    r = random.Random(2)
    events = [(i, 37 * i + r.randrange(30), r.choice(["error", "purchase", "view"]), i % 3, 1) for i in range(150)]
    files = [events[i : i + 15] for i in range(0, 150, 15)]
    files[2], files[3] = files[3], files[2]  # ten hours of disorder, a day is waited for
    for lo, hi in ((0, 3), (3, 4), (4, 10), (10, 10)):
        for f in files[lo:hi]:
            r.shuffle(f)
            feed.add(f)
        error, clear = F.col("grid") == "error", F.col("grid") == "purchase"
        got = outages.outage_windows(feed.stream(), "equipment", "ts", "event_id", error, clear, "1 day", feed.out, feed.state)
        want = windows.outage_windows(feed.every(), ["equipment"], "ts", ["ts", "event_id"], error, clear)
        assert found(got) == found(want)
    assert got.where("open").count() >= 1


def test_events_later_than_the_delay_are_left_out(feed):
    feed.add([(1, 0, "error", 1, 1), (2, 60, "purchase", 1, 1)])
    feed.add([(3, 10_000, "error", 1, 1)])
    error, clear = F.col("grid") == "error", F.col("grid") == "purchase"
    for late in ((), ((4, 30, "purchase", 1, 1),)):
        if late:
            feed.add(late)
        got = found(outages.outage_windows(feed.stream(), "equipment", "ts", "event_id", error, clear, "1 hour", feed.out, feed.state))
    at = lambda m: (DAY + datetime.timedelta(minutes=m)).replace(tzinfo=None)
    assert [(a, b.replace(tzinfo=None), c.replace(tzinfo=None), o) for a, b, c, o in got] == [(1, at(0), at(60), False), (1, at(10_000), at(10_060), True)]


def test_a_key_s_state_is_written_once_a_step():
    """The open block and what waits go into one row of state; a timer is set for the first waiting event."""
    import pandas as pd

    class State:
        exists, puts, timers, watermark = False, 0, [], 0

        def getCurrentWatermarkMs(self):
            return self.watermark

        def update(self, value):
            self.get, self.exists, self.puts = value, True, self.puts + 1

        def setTimeoutTimestamp(self, at):
            self.timers = [*self.timers, at]

    state, s = State(), 1_000_000
    frames = [pd.DataFrame({"us": [5 * s, 2 * s], "place": [2, 1], "block": [False, True]}), pd.DataFrame({"us": [9 * s], "place": [3], "block": [True]})]
    (out,) = outages.step((7,), iter(frames), state)
    assert out[["version", "start_us", "open", "final"]].values.tolist() == [[1, 2 * s, False, False], [1, 9 * s, True, False]]
    assert state.puts == 1 and state.timers == [2001]
    state.watermark = 6000
    (out,) = outages.step((7,), iter([]), state)
    assert out[["version", "start_us", "open", "final"]].values.tolist() == [[2, 2 * s, False, True], [2, 9 * s, True, False]]
    assert state.puts == 2 and state.timers == [2001, 9001]


def test_late_and_revised_rows_correct_their_days(feed):
    first = [(i, 240 * i, "a", 1, i) for i in range(30)]
    late = [(100 + i, 60 + 240 * i, "a", 2, 5) for i in range(3)]
    revised = [(200, 0, "a", 1, 90), (201, 240 * 29, "b", 1, 1)]
    for came in (first[12:], first[:12] + late, revised):
        feed.add(came)
        got, fixes = flows.corrected_days(feed.stream(), ["grid"], "ts", "value", "event_id", 2, feed.out, feed.state)
    newest = feed.every().groupBy("grid", "ts").agg(F.max_by("value", "event_id").alias("value"))
    want = newest.groupBy("grid", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), half_up(F.avg("value")).alias("mean"))
    assert found(got.select("grid", "day", "n", "mean")) == found(want)
    days = {(r.batch, r.day.day): (r.days_late, r.over_budget) for r in fixes.collect()}
    assert days == {(1, 1): (4, True), (1, 2): (3, True), (2, 1): (4, True)}


def test_hours_and_revisions_are_kept_up(feed):
    r = random.Random(4)
    values = [(i, r.randrange(6000), r.choice("ab"), r.randrange(4), r.randrange(100)) for i in range(200)]
    for i in range(0, 200, 50):
        feed.add(values[i : i + 50])
        hour = F.date_trunc("hour", "ts").alias("hour")
        stream = feed.stream().select("grid", hour, "value")
        got = flows.hourly_means(stream, ["grid"], "hour", "value", f"{feed.out}/h", f"{feed.state}/h")
        want = feed.every().groupBy("grid", hour).agg(F.count("*").alias("n"), half_up(F.avg("value")).alias("mean"))
        assert found(got) == found(want)
        got = flows.latest_revisions(feed.stream().select("equipment", "ts", "event_id"), ["equipment"], ["ts", "event_id"], f"{feed.out}/r", f"{feed.state}/r", 4)
        want = feed.every().groupBy("equipment").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("equipment", "x.*")
        assert found(got) == found(want)


def test_rolling_three_days_every_five_minutes(feed):
    """Windows of 864 five-minute slots; a slot that comes later completes the windows over it."""
    slots = [(i, 5 * i, "a", 1, i % 7) for i in range(864 + 300)]
    gap = 500
    want = lambda missing: {i + 1: round(sum(k % 7 for k in range(i - 863, i + 1)) / 864, 4) for i in range(863, len(slots)) if missing is None or missing not in range(i - 863, i + 1)}
    for came, missing in ((slots[:gap] + slots[gap + 1 :], gap), ([slots[gap]], None)):
        feed.add(came)
        got = flows.rolling_full(feed.stream().select("grid", "ts", "value"), ["grid"], "ts", "value", 72 * 3600, 300, feed.out, feed.state)
        minutes = {int((x.until.replace(tzinfo=datetime.UTC) - DAY).total_seconds()) // 300: (x.n, x.mean) for x in got.collect()}
        assert {k: v for k, (_, v) in minutes.items()} == pytest.approx(want(missing), abs=1e-4)
        assert all(n == 864 for n, _ in minutes.values())


def test_streaks(feed):
    days = {1: [0, 1, 2, 5, 6, 20], 2: [3, 20]}
    values = [(10 * d + e, 1440 * d + 13 * e, "a", e, 1) for e, own in days.items() for d in own]
    values.sort(key=lambda v: v[1])
    for lo, hi in ((0, 3), (3, 6), (6, 8)):
        feed.add(values[lo:hi])
        got = flows.streaks(feed.stream().select("equipment", "ts"), ["equipment"], "ts", "1 day", feed.out, feed.state)
    assert [(e, a.day, b.day, n, k) for e, a, b, n, k in found(got)] == [(1, 1, 3, 3, 3), (1, 6, 7, 2, 2), (2, 4, 4, 1, 1)]


def test_days_are_derived_once_when_complete(feed):
    def gate(df):
        return df.withColumn("day", F.to_date("ts")).groupBy("day").agg(F.count("*").alias("n")).where("n >= 3")

    def derive(df):
        return df.groupBy("day").agg(F.count("*").alias("n"))

    day = lambda d, n, at: [(100 * d + at + i, 1440 * d + at + i, "a", 1, 1) for i in range(n)]
    out = []
    for came in (day(0, 3, 0) + day(1, 2, 0), day(1, 2, 10) + day(2, 5, 0) + day(3, 3, 0), day(0, 4, 20), day(9, 1, 0)):
        feed.add(came)
        stream = feed.stream().withColumn("day", F.to_date("ts"))
        out.append([(r.day.day, r.n) for r in flows.derive_days(stream, "day", gate, derive, feed.out, feed.state, limit=2).orderBy("day").collect()])
    # day 4 waits for the next batch, and day 1's later rows do not change it
    assert out == [[(1, 3)], [(1, 3), (2, 4), (3, 5)], [(1, 3), (2, 4), (3, 5), (4, 3)], [(1, 3), (2, 4), (3, 5), (4, 3)]]
