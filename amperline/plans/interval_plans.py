"""Interval aggregations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.functions import clock
from amperline.functions.numeric import exact_mean, half_up, money
from amperline.operators import interval as op
from amperline.plans.common import EVENTS, dsum, intervals, mean, r, table

QUERIES, ORACLE = {}, {}
_HOUR = "CAST(((CAST(floor((hour(ts) * 60 + minute(ts) - 5) / 60.0) AS INTEGER) % 24) + 24) % 24 AS INTEGER)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("q_interval_hour", f"WITH {EVENTS} SELECT day, grid, {_HOUR} AS hour, count(*) AS n, {r(mean('value'))} AS mean FROM e GROUP BY ALL")
def interval_hour(spark, d):
    return op.hourly_mean(intervals(spark, d), ["day", "grid"], clock.hour_of_stamp(F.col("ts")), "value")


@query(
    "q_day_slots",
    f"""WITH {EVENTS}, h AS (SELECT grid, {_HOUR} AS hour, count(*) AS n, {r(mean('value'))} AS mean FROM e GROUP BY ALL)
    SELECT g.grid, s.hour, h.mean FROM (SELECT DISTINCT grid FROM h) g CROSS JOIN (SELECT unnest(range(24))::INTEGER AS hour) s LEFT JOIN h USING (grid, hour)""",
)
def day_slots(spark, d):
    rows = intervals(spark, d)
    return op.day_slots(op.hourly_mean(rows, ["grid"], clock.hour_of_stamp(F.col("ts")), "value"), ["grid"], "mean")


@query(
    "q_day_slots_all",
    f"""WITH {EVENTS}, h AS (SELECT day, grid, {_HOUR} AS hour, count(*) AS n, {r(mean('value'))} AS mean FROM e GROUP BY ALL)
    SELECT g.day, g.grid, s.hour, h.mean FROM (SELECT DISTINCT day, grid FROM h) g CROSS JOIN (SELECT unnest(range(24))::INTEGER AS hour) s LEFT JOIN h USING (day, grid, hour)""",
)
def day_slots_all(spark, d):
    """The slots of every day, over all equipment."""
    return op.day_slots(op.hourly_mean(intervals(spark, d), ["day", "grid"], clock.hour_of_stamp(F.col("ts")), "value"), ["day", "grid"], "mean")


_LEAGUE = f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN grid IN ('click','view','error') THEN 'RTD' ELSE 'DAP' END AS src FROM e)
    SELECT equipment, count(DISTINCT day) AS days, count(DISTINCT CASE WHEN src='RTD' THEN day END) AS rtd_days, count(DISTINCT CASE WHEN src='DAP' THEN day END) AS dap_days,
    count(*) FILTER (WHERE src='RTD') AS rtd_intervals, count(*) FILTER (WHERE src='DAP') AS dap_rows, greatest(max(value), 0.0) AS max_overload, greatest(max(value / 4), 0.0) AS max_percent,
    count(*) FILTER (WHERE grid = 'error') AS base_case_rows FROM s GROUP BY equipment"""


@query("q_congestion_league", _LEAGUE)
def congestion_league(spark, d):
    rows = intervals(spark, d).withColumns({"src": F.when(F.col("grid").isin("click", "view", "error"), "RTD").otherwise("DAP"), "pct": F.col("value") / 4})
    return op.congestion_league(rows, ["equipment"], "src", "day", "value", "pct", F.col("grid") == "error")


@query("q_congestion_top30", _LEAGUE + " ORDER BY days DESC, rtd_days DESC, dap_days DESC, equipment LIMIT 30")
def congestion_top30(spark, d):
    return op.league_top(congestion_league(spark, d), "equipment")


@query(
    "q_corridor_receipts",
    """WITH p(corridor, pattern) AS (VALUES ('A','small'), ('A','red'), ('B','blue'), ('B','sm'), ('C','green'), ('C','large')),
    rows AS (SELECT p_name, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey),
    hit AS (SELECT corridor, p_name, day, count(*) AS n, count(DISTINCT pattern) AS k FROM rows JOIN p ON starts_with(p_name, pattern) GROUP BY ALL)
    SELECT corridor, CAST(sum(n / k) AS BIGINT) AS intervals, count(DISTINCT day) AS days, count(DISTINCT p_name) AS equipment FROM hit GROUP BY corridor""",
)
def corridor_receipts(spark, d):
    patterns = spark.createDataFrame([("A", "small"), ("A", "red"), ("B", "blue"), ("B", "sm"), ("C", "green"), ("C", "large")], "corridor string, pattern string")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_name", F.to_date("l_shipdate").alias("day"))
    return op.corridor_receipts(rows, "p_name", patterns, "day")


@query(
    "q_equipment_collapse",
    """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    m AS (SELECT l_suppkey, l_returnflag AS voltage FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1)
    SELECT l_suppkey, max(l_quantity) AS days, CAST(sum(l_linenumber) AS BIGINT) AS intervals, any_value(voltage) AS voltage FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey""",
)
def equipment_collapse(spark, d):
    return op.equipment_collapse(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_linenumber", "l_returnflag")


_DAILY = f"""d0 AS (SELECT day, grid, CAST(max(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS peak, {r(dsum('value / 4') + ' * 5 / 60')} AS curtailed_mwh,
    CAST(min(CAST(value - 20 AS DECIMAL(18,4))) AS DOUBLE) AS min_slack, count(*) FILTER (WHERE value - 20 < 0) AS short_rows FROM e GROUP BY ALL),
    daily AS (SELECT a.day, b.grid, coalesce(peak, 0.0) AS peak, coalesce(curtailed_mwh, 0.0) AS curtailed_mwh, coalesce(min_slack, 0.0) AS min_slack, coalesce(short_rows, 0) AS short_rows
    FROM (SELECT DISTINCT day FROM e) a CROSS JOIN (SELECT DISTINCT grid FROM e) b LEFT JOIN d0 USING (day, grid))"""


@query("q_reliability_daily", f"WITH {EVENTS}, {_DAILY} SELECT * FROM daily")
def reliability_daily(spark, d):
    return _reliability(intervals(spark, d))


def _reliability(e):
    rows = e.withColumns({"curtailed": F.col("value") / 4, "slack": F.col("value") - 20})
    return op.reliability_daily(rows, "day", "grid", "value", "curtailed", "slack")


@query("q_reliability_daily_all")
def reliability_daily_all(spark, d):
    """q_reliability_daily over all equipment."""
    return _reliability(intervals(spark, d))


@query(
    "q_reliability_totals",
    f"""WITH {EVENTS}, {_DAILY} SELECT grid, {r(dsum('curtailed_mwh'))} AS curtailed_mwh, CAST(sum(short_rows) AS BIGINT) AS short_rows, {r('median(min_slack)')} AS median_min_slack,
    arg_min(day, (-peak, day)) AS peak_day FROM daily GROUP BY grid""",
)
def reliability_totals(spark, d):
    return op.reliability_totals(reliability_daily(spark, d), "day", "grid")


@query("q_reliability_totals_all")
def reliability_totals_all(spark, d):
    """q_reliability_totals over all equipment."""
    return op.reliability_totals(reliability_daily_all(spark, d), "day", "grid")


_SPREAD = f"m AS (SELECT day, grid, {mean('value')} AS mean FROM e GROUP BY ALL), spread AS (SELECT day, count(mean) AS grids, CASE WHEN count(mean) >= 2 THEN {r('max(mean) - min(mean)')} END AS spread FROM m GROUP BY day)"


@query("q_daily_price_spread", f"WITH {EVENTS}, {_SPREAD} SELECT * FROM spread")
def daily_price_spread(spark, d):
    return op.price_spread(intervals(spark, d), "day", "grid", "value")


@query(
    "q_regime_stats",
    f"""WITH {EVENTS}, {_SPREAD}, a AS (SELECT CASE WHEN day >= '2024-01-16' THEN 'market' ELSE 'administered' END AS regime, {r(mean('value'))} AS mean_price, count(*) AS rows FROM e GROUP BY 1),
    b AS (SELECT CASE WHEN day >= '2024-01-16' THEN 'market' ELSE 'administered' END AS regime, count(*) AS days, count(*) FILTER (WHERE spread > 10) AS wide_days, max(spread) AS max_spread FROM spread GROUP BY 1)
    SELECT * FROM a JOIN b USING (regime)""",
)
def regime_stats(spark, d):
    rows = intervals(spark, d)
    return op.regime_stats(rows, op.price_spread(rows, "day", "grid", "value"), "day", "grid", "value", "2024-01-16", 10.0)


@query(
    "q_equal_width_hist",
    f"""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT CAST(least(17, floor((l_quantity - lo) / ((hi - lo) / 18))) AS INTEGER) AS bin, count(*) AS n, {r(mean('l_extendedprice'))} AS mean, {r('median(l_extendedprice)')} AS median FROM lineitem, s GROUP BY 1""",
)
def equal_width_hist(spark, d):
    return op.equal_width_bins(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", 18)


@query(
    "q_widest_swing_day",
    f"""WITH {EVENTS}, s AS (SELECT grid, day, count(*) AS n, CAST(max(CAST(value AS DECIMAL(18,4))) - min(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS swing FROM e GROUP BY ALL HAVING count(*) >= 5)
    SELECT grid, day, swing, n FROM s QUALIFY row_number() OVER (PARTITION BY grid ORDER BY swing DESC, day) = 1""",
)
def widest_swing_day(spark, d):
    return op.widest_swing(intervals(spark, d), ["grid"], "day", "value", 5)


@query(
    "q_mean_of_means",
    f"WITH {EVENTS}, i AS (SELECT grid, hour_ts, {mean('value')} AS m FROM e GROUP BY ALL) SELECT grid, count(*) AS intervals, {r('CAST(sum(CAST(m AS DECIMAL(28,10))) AS DOUBLE) / count(*)')} AS mean FROM i GROUP BY grid",
)
def mean_of_means(spark, d):
    return op.mean_of_means(intervals(spark, d), ["grid"], "hour_ts", "value")


@query(
    "q_fractional_credit",
    f"""WITH {EVENTS}, t AS (SELECT grid, hour_ts, count(DISTINCT equipment) AS k FROM e GROUP BY ALL), a AS (SELECT grid, count(*) AS alln FROM t GROUP BY grid),
    p AS (SELECT grid, hour_ts, equipment, sum(CAST(value AS DECIMAL(18,4))) AS p, count(*) AS n FROM e GROUP BY ALL),
    s AS (SELECT grid, equipment, CAST(sum(CAST(CAST(1.0 AS DOUBLE) / k AS DECIMAL(20,12))) AS DOUBLE) AS credit, sum(p) AS p, sum(n) AS n FROM p JOIN t USING (grid, hour_ts) GROUP BY ALL)
    SELECT grid, equipment, {r('credit')} AS credit, {r('100 * (credit / alln)')} AS share, {r('CAST(p AS DOUBLE) / CAST(n AS DOUBLE)')} AS mean_price FROM s JOIN a USING (grid)
    QUALIFY row_number() OVER (PARTITION BY grid ORDER BY {r('credit')} DESC, equipment) <= 12""",
)
def fractional_credit(spark, d):
    return op.fractional_credit(intervals(spark, d), ["grid"], "hour_ts", "equipment", "value", 12)


@query(
    "q_dense_grid_fill",
    f"""WITH {EVENTS}, f AS (SELECT * FROM e), o AS (SELECT day, grid, {r(mean('value'))} AS mean FROM f GROUP BY ALL)
    SELECT a.day, b.grid, mean FROM (SELECT DISTINCT day FROM f) a CROSS JOIN (SELECT DISTINCT grid FROM f) b LEFT JOIN o USING (day, grid)""",
)
def dense_grid_fill(spark, d):
    return op.dense_daily(intervals(spark, d), "day", ["grid"], "value")


@query("q_dense_grid_fill_all")
def dense_grid_fill_all(spark, d):
    """q_dense_grid_fill over all equipment."""
    return op.dense_daily(intervals(spark, d), "day", ["grid"], "value")


@query("q_full_coverage_days", f"WITH {EVENTS} SELECT day, count(DISTINCT {_HOUR}) AS slots FROM e GROUP BY day HAVING count(DISTINCT {_HOUR}) = 24")
def full_coverage_days(spark, d):
    rows = intervals(spark, d).withColumn("hour", clock.hour_of_stamp(F.col("ts")))
    return op.full_days(rows, "day", ["hour"], 24)


@query(
    "q_pinned_windows",
    """WITH l AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'MAX' ELSE 'MIN' END AS side, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem)
    SELECT l_orderkey, arg_max(l_quantity, (pos, l_quantity)) FILTER (WHERE side='MAX') AS most, arg_max(l_quantity, (pos, l_quantity)) FILTER (WHERE side='MIN') AS least,
    coalesce(arg_max(l_quantity, (pos, l_quantity)) FILTER (WHERE side='MAX') = arg_max(l_quantity, (pos, l_quantity)) FILTER (WHERE side='MIN'), false) AS pinned FROM l GROUP BY l_orderkey""",
)
def pinned_windows(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"side": F.when(F.col("l_linenumber") % 2 == 0, "MAX").otherwise("MIN"), "pos": F.col("l_linenumber") * 1000000 + F.col("l_partkey")})
    return op.pinned_windows(rows, ["l_orderkey"], "side", "l_quantity", "pos")


@query("q_latest_revision", "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_revision(spark, d):
    return op.latest_revision(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "q_deviation_from_mean",
    f"""WITH j AS (SELECT strftime(o_orderdate, '%Y-%m') AS day, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
    o AS (SELECT day, c_mktsegment, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS v FROM j GROUP BY ALL), m AS (SELECT c_mktsegment, sum(v) AS alls FROM o GROUP BY 1), n AS (SELECT count(DISTINCT day) AS n FROM j)
    SELECT d.day, m.c_mktsegment, {r('coalesce(CAST(v AS DOUBLE), 0.0) - CAST(alls AS DOUBLE) / CAST(n AS DOUBLE)')} AS deviation FROM (SELECT DISTINCT day FROM j) d CROSS JOIN m CROSS JOIN n LEFT JOIN o ON o.day = d.day AND o.c_mktsegment = m.c_mktsegment
    WHERE abs({r('coalesce(CAST(v AS DOUBLE), 0.0) - CAST(alls AS DOUBLE) / CAST(n AS DOUBLE)')}) >= 100000""",
)
def deviation_from_mean(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.date_format("o_orderdate", "yyyy-MM").alias("day"), "c_mktsegment", "o_totalprice")
    return op.deviation_from_mean(rows, "day", ["c_mktsegment"], "o_totalprice", 100000)


@query(
    "q_modal_then_mean",
    f"""WITH {EVENTS}, c AS (SELECT grid, hour_ts, floor(value / 10) AS v, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT grid, hour_ts, v FROM c QUALIFY row_number() OVER (PARTITION BY grid, hour_ts ORDER BY n DESC, v) = 1)
    SELECT grid, count(*) AS intervals, {r(mean('v'))} AS mean FROM m GROUP BY grid""",
)
def modal_then_mean(spark, d):
    return op.modal_then_mean(intervals(spark, d).withColumn("v", F.floor(F.col("value") / 10)), ["grid"], "hour_ts", "v")


@query(
    "q_weighted_price",
    f"SELECT l_returnflag, l_linestatus, {r('CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / ' + dsum('l_quantity'))} AS price, {dsum('l_quantity')} AS weight FROM lineitem GROUP BY ALL",
)
def weighted_price(spark, d):
    return op.weighted_price(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")


@query(
    "q_pooled_percent",
    f"""WITH p AS (SELECT l_returnflag, year(l_shipdate) AS y, {r("100.0 * count(*) FILTER (WHERE l_discount >= 0.05) / count(*)")} AS pct, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, {r('CAST(sum(CAST(pct AS DECIMAL(18,4)) * n) AS DOUBLE) / sum(n)')} AS percent, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY l_returnflag""",
)
def pooled_percent(spark, d):
    pct = half_up(100.0 * F.count_if(F.col("l_discount") >= 0.05) / F.count("*"))
    daily = table(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(pct.alias("pct"), F.count("*").alias("n"))
    return op.pooled_percent(daily, ["l_returnflag"], "pct", "n")


@query(
    "q_hhi",
    f"""WITH f AS (SELECT s_nationkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
    s AS (SELECT CAST(CAST(v AS DOUBLE) / (SELECT CAST(sum(v) AS DOUBLE) FROM f) AS DECIMAL(20,14)) AS s FROM f), t AS (SELECT sum(s) AS top2 FROM (SELECT s FROM s ORDER BY s DESC LIMIT 2)),
    h AS (SELECT count(*) AS firms, {r('CAST(sum(CAST(CAST(s AS DOUBLE) * CAST(s AS DOUBLE) AS DECIMAL(30,20))) AS DOUBLE) * 10000')} AS hhi FROM s)
    SELECT firms, hhi, {r('100 * CAST(top2 AS DOUBLE)')} AS top2_share, CASE WHEN hhi < 1500 THEN 'unconcentrated' WHEN hhi < 2500 THEN 'moderate' ELSE 'high' END AS band FROM h, t""",
)
def hhi(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return op.concentration(rows, "s_nationkey", "l_extendedprice")


@query(
    "q_binding_causes",
    f"""WITH {EVENTS}, c AS (SELECT grid, CASE WHEN value > 100 THEN 'shortage' WHEN value > 40 THEN 'corridor' WHEN value > 10 THEN 'reserve' ELSE 'fuel' END AS cause, count(*) AS n FROM e GROUP BY ALL)
    SELECT grid, cause, n, {r('100 * (CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY grid) AS DOUBLE))')} AS share FROM c""",
)
def binding_causes(spark, d):
    cause = F.when(F.col("value") > 100, "shortage").when(F.col("value") > 40, "corridor").when(F.col("value") > 10, "reserve").otherwise("fuel")
    return op.binding_causes(intervals(spark, d), ["grid"], cause)


@query(
    "q_emissions",
    f"""WITH f(l_shipmode, factor) AS (VALUES ('A', 0.874), ('N', 0.36), ('R', 0.0)) SELECT l_returnflag AS fuel, {dsum('l_quantity')} AS mwh,
    {r('CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) * CAST(any_value(factor) AS DECIMAL(10,4)) AS DOUBLE)')} AS tonnes FROM lineitem JOIN f ON l_shipmode = l_returnflag GROUP BY 1""",
)
def emissions(spark, d):
    factors = spark.createDataFrame([("A", "0.8740"), ("N", "0.3600"), ("R", "0.0000")], "fuel string, f string").select("fuel", F.col("f").cast("decimal(10,4)").alias("factor"))
    return op.emissions(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "fuel"), "fuel", "l_quantity", factors)


@query(
    "q_clean_days",
    f"""WITH {EVENTS}, f AS (SELECT day, CASE WHEN value < 100 THEN 'OK' ELSE 'PEN' END AS flag, count(*) AS n FROM e GROUP BY ALL)
    SELECT day, {r("CAST(sum(CASE WHEN flag='OK' THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE)")} AS ok_share FROM f GROUP BY day HAVING {r("CAST(sum(CASE WHEN flag='OK' THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE)")} >= 0.9""",
)
def clean_days(spark, d):
    flags = intervals(spark, d).groupBy("day", F.when(F.col("value") < 100, "OK").otherwise("PEN").alias("flag")).agg(F.count("*").alias("n"))
    return op.clean_days(flags, "day", "flag", "n", 0.9)


@query("q_present_nodes", f"WITH {EVENTS} SELECT equipment, count(DISTINCT day) AS days FROM e GROUP BY equipment HAVING count(DISTINCT day) >= greatest(1, floor(0.8 * (SELECT count(DISTINCT day) FROM e)))")
def present_nodes(spark, d):
    return op.present_nodes(intervals(spark, d), "equipment", "day", 0.8)


@query(
    "q_thinning",
    f"""WITH {EVENTS}, i AS (SELECT event_id, grid, row_number() OVER (PARTITION BY grid ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY grid) AS n FROM e),
    k AS (SELECT grid, n, CAST(floor(g.g * n / 100.0) AS BIGINT) AS i FROM (SELECT DISTINCT grid, n FROM i) CROSS JOIN (SELECT unnest(range(100)) AS g) g WHERE n > 100)
    SELECT i.event_id, i.grid FROM i WHERE n <= 100 OR EXISTS (SELECT 1 FROM k WHERE k.grid = i.grid AND k.i = i.i)""",
)
def thinning(spark, d):
    return op.thin(intervals(spark, d).select("event_id", "grid", "ts"), ["grid"], ["ts", "event_id"], 100).select("event_id", "grid")


@query("q_topk_per_group", "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 3")
def topk_per_group(spark, d):
    return op.top_k(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3)


@query("q_json_props", f"SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, {r(mean('value'))} AS mean FROM events GROUP BY event_type")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"), half_up(exact_mean(money("value"))).alias("mean"))
