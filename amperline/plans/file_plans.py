"""Files, exports and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, lenient, money
from amperline.plans.common import EVENTS, intervals, mean, r, table
from amperline.plans.market_plans import _WINDOWS
from amperline.sources import files, sinks
from amperline.sources.tables import shared_folder
from amperline.streaming import flows, outages

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _day_files(spark, d):
    """The events as day files, each with a blank row and an EOF mark, and some values that are no numbers."""
    e = intervals(spark, d)
    file = F.concat(F.lit("RTDSUM_"), F.date_format("ts", "yyyyMMdd"))
    value = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), "grid", F.col("equipment").cast("string").alias("equipment"), value.alias("value"), file.alias("file"))
    ends = rows.select("file").distinct().select(F.explode(F.array(F.lit("EOF"), F.lit(" "))).alias("event_id"), F.lit("").alias("grid"), F.lit("").alias("equipment"), F.lit(" ").alias("value"), "file")
    folder = _fresh(spark, "day-files")
    files.write_day_files(rows.unionByName(ends), folder, "file")
    return folder


@query("q_day_files", f"WITH {EVENTS} SELECT event_id, CAST(ts AS DATE) AS day, grid, equipment, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS value FROM e")
def day_files(spark, d):
    rows = files.read_day_files(spark, _day_files(spark, d), ["event_id", "grid", "equipment", "value"])
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "day", "grid", F.col("equipment").cast("long").alias("equipment"), lenient(F.col("value")).alias("value"))


@query("q_file_listing", "SELECT DISTINCT 'RTDSUM_' || strftime(ts, '%Y%m%d') AS file, CAST(ts AS DATE) AS day FROM events")
def file_listing(spark, d):
    return files.listing(spark, _day_files(spark, d)).where("bytes > 0").select("file", "day").distinct()


@query("q_tidy_export", "SELECT 'nations' AS name, (SELECT count(*) FROM nation) AS rows, 'n_nationkey,n_name' AS columns, 'nations by key' AS description UNION ALL SELECT 'suppliers', (SELECT count(*) FROM supplier), 's_suppkey,s_nationkey,s_acctbal', 'suppliers and their balance'")
def tidy_export(spark, d):
    tables = {
        "nations": (table(spark, d, "nation").select("n_nationkey", "n_name"), "nations by key"),
        "suppliers": (table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "suppliers and their balance"),
    }
    return sinks.export_tables(spark, tables, _fresh(spark, "export"))


@query("q_map_features", "SELECT 'Feature' AS type, 'Point' AS kind, CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(s_suppkey % 360 - 180 AS BIGINT) AS lon, CAST(s_suppkey % 180 - 90 AS BIGINT) AS lat FROM supplier")
def map_features(spark, d):
    k = F.col("s_suppkey")
    text = sinks.features(table(spark, d, "supplier"), "Point", F.array(k % 360 - 180, k % 180 - 90), ["s_suppkey"])
    folder = _fresh(spark, "features")
    text.write.text(folder)
    x = F.from_json("value", "type string, geometry struct<type string, coordinates array<long>>, properties struct<s_suppkey long>")
    back = spark.read.text(folder).select(x.alias("x"))
    return back.select("x.type", F.col("x.geometry.type").alias("kind"), "x.properties.s_suppkey", F.col("x.geometry.coordinates")[0].alias("lon"), F.col("x.geometry.coordinates")[1].alias("lat"))


def _stream(spark, d):
    """The events as a stream, with the columns of `intervals`."""
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_trunc("hour", "ts").cast("timestamp").alias("hour_ts"), F.col("event_type").alias("grid"), F.col("user_id").alias("equipment"), "value")


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("q_stream_hourly", f"WITH {EVENTS} SELECT grid, hour_ts, count(*) AS n, {r(mean('value'))} AS mean FROM e GROUP BY ALL")
def stream_hourly(spark, d):
    return _ntz(flows.hourly_means(_stream(spark, d), ["grid"], "hour_ts", "value", _fresh(spark, "hourly"), _fresh(spark, "hourly-state")), "hour_ts")


@query(
    "q_stream_rolling",
    f"""WITH {EVENTS}, s AS (SELECT grid, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, sum(CAST(value AS DECIMAL(18,4))) AS v, count(*) AS n, count(value) AS k FROM e GROUP BY ALL),
    w AS (SELECT grid, slot, sum(v) OVER x AS v, sum(n) OVER x AS n, sum(k) OVER x AS k, count(*) OVER x AS slots FROM s WINDOW x AS (PARTITION BY grid ORDER BY slot RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT grid, TIMESTAMP '1970-01-01 00:00:00' + to_hours(CAST((slot + 1) * 6 AS INTEGER)) AS until, CAST(n AS BIGINT) AS n, {r('CAST(v AS DOUBLE) / CAST(k AS DOUBLE)')} AS mean FROM w WHERE slots = 12""",
)
def stream_rolling(spark, d):
    return _ntz(flows.rolling_full(_stream(spark, d), ["grid"], "ts", "value", 72 * 3600, 6 * 3600, _fresh(spark, "rolling"), _fresh(spark, "rolling-state")), "until")


@query("q_stream_revisions", f"WITH {EVENTS} SELECT equipment, ts, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY equipment ORDER BY ts DESC, event_id DESC) = 1")
def stream_revisions(spark, d):
    rows = _stream(spark, d).select("equipment", "ts", "event_id", "value")
    return _ntz(flows.latest_revisions(rows, ["equipment"], ["ts", "event_id"], _fresh(spark, "revisions"), _fresh(spark, "revisions-state")), "ts")


@query("q_stream_once", f"WITH {EVENTS} SELECT DISTINCT equipment, grid, hour_ts FROM e")
def stream_once(spark, d):
    return _ntz(flows.counted_once(_stream(spark, d), ["equipment", "grid", "hour_ts"], "hour_ts", "45 days", _fresh(spark, "once"), _fresh(spark, "once-state")), "hour_ts")


@query("q_stream_append", f"WITH {EVENTS} SELECT event_id, day, value FROM e WHERE value > 1")
def stream_append(spark, d):
    """Run twice over one checkpoint: the second run finds nothing new and adds nothing."""
    folder, state = _fresh(spark, "append"), _fresh(spark, "append-state")
    for _ in range(2):
        out = flows.append_days(_stream(spark, d).select("event_id", "day", "value"), "day", F.col("value") > 1, folder, state)
    return out


@query("q_stream_join", f"WITH {EVENTS} SELECT a.equipment, a.event_id AS left_id, b.event_id AS right_id FROM e a JOIN e b ON a.equipment = b.equipment AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.grid = 'click' AND b.grid = 'purchase'")
def stream_join(spark, d):
    s = _stream(spark, d)
    return flows.interval_join(s.where("grid = 'click'"), _stream(spark, d).where("grid = 'purchase'"), "equipment", "ts", "6 HOURS", "45 days", _fresh(spark, "pairs"), _fresh(spark, "pairs-state"))


@query("q_stream_outages", f'WITH {_WINDOWS} SELECT equipment, "start", "end", "open" FROM w')
def stream_outages(spark, d):
    """The windows of q_gaps_islands_windows, by keyed state."""
    e = _stream(spark, d)
    return _ntz(outages.outage_windows(e, "equipment", "ts", "event_id", F.col("grid") == "error", F.col("grid") == "purchase", "2 days", _fresh(spark, "outages"), _fresh(spark, "outages-state")), "start", "end")


@query(
    "q_stream_streaks",
    f"""WITH {EVENTS}, d AS (SELECT equipment, CAST(ts AS DATE) AS day, count(*) AS n FROM e WHERE grid = 'error' GROUP BY ALL),
    i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY equipment ORDER BY day) AS INTEGER) AS island FROM d),
    s AS (SELECT equipment, min(day) AS first_day, max(day) AS last_day, CAST(count(*) AS INTEGER) AS days, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY equipment, island)
    SELECT * FROM s WHERE last_day + INTERVAL 36 HOUR <= (SELECT max(day) FROM d) - INTERVAL 2 DAY""",
)
def stream_streaks(spark, d):
    """Runs of days with alerts that had ended when the stream did."""
    alerts = _stream(spark, d).where("grid = 'error'").select("equipment", "ts")
    return flows.streaks(alerts, ["equipment"], "ts", "2 days", _fresh(spark, "streaks"), _fresh(spark, "streaks-state"))


_DAILY = f"WITH {EVENTS}, n AS (SELECT grid, hour_ts, arg_max(value, (event_id, value)) AS value FROM e GROUP BY ALL) SELECT grid, CAST(hour_ts AS DATE) AS day, count(*) AS n, {r(mean('value'))} AS mean FROM n GROUP BY ALL"


@query("q_stream_corrected", _DAILY)
def stream_corrected(spark, d):
    """Daily means of each hour's newest revision."""
    rows = _stream(spark, d).select("grid", "hour_ts", "value", "event_id")
    return flows.corrected_days(rows, ["grid"], "hour_ts", "value", "event_id", 4, _fresh(spark, "corrected"), _fresh(spark, "corrected-state"))[0]


@query("q_stream_derived", f"WITH {EVENTS}, g AS (SELECT day FROM e GROUP BY day HAVING count(DISTINCT (grid, date_part('hour', ts))) >= 30) SELECT day, grid, count(*) AS n, {r(mean('value'))} AS mean FROM e JOIN g USING (day) GROUP BY day, grid")
def stream_derived(spark, d):
    """A derived day for each day that at least 30 hours of grids cover; run twice, the second run finds nothing new."""
    def gate(rows):
        return rows.groupBy("day").agg(F.count_distinct("grid", F.hour("ts")).alias("slots")).where("slots >= 30")

    def derive(rows):
        return rows.groupBy("day", "grid").agg(F.count("*").alias("n"), half_up(exact_mean(money("value"))).alias("mean"))

    folder, state = _fresh(spark, "derived"), _fresh(spark, "derived-state")
    for _ in range(2):
        out = flows.derive_days(_stream(spark, d), "day", gate, derive, folder, state)
    return out


@query("q_stream_orders_lines", "SELECT o_orderkey AS k, o_custkey AS left_id, CAST(l_linenumber AS BIGINT) AS right_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY")
def stream_orders_lines(spark, d):
    """Two sources with a key and a time each: orders, and the lines that ship within 60 days."""
    def stream(name):
        return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)

    o = stream("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_custkey").alias("id"))
    li = stream("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linenumber").cast("long").alias("id"))
    return flows.interval_join(o, li, "k", "at", "60 DAYS", "3650 days", _fresh(spark, "orders-lines"), _fresh(spark, "orders-lines-state"), "id")
