"""Joins and summaries of market feeds over the driver's tables: event types as grids, users as resources, order lines as blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.functions import names
from amperline.functions.numeric import half_up, money
from amperline.operators import feeds, stack
from amperline.plans.common import EVENTS, dsum, intervals, mean, r, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


def _hour_text(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:00")


_SIDES = f"""{EVENTS}, p AS (SELECT strftime(ts, '%Y-%m-%d %H:00') AS interval, equipment % 7 AS zone, {r(mean('value'))} AS price FROM e WHERE grid IN ('click', 'view') GROUP BY ALL),
    g AS (SELECT strftime(ts, '%Y-%m-%d %H:00') AS interval, equipment % 7 AS zone, {dsum('value')} AS mw FROM e WHERE grid NOT IN ('click', 'view') GROUP BY ALL)"""


def _sides(spark, d):
    """Prices from one kind of events, generation from the others, both by interval and zone."""
    e = intervals(spark, d).select(_hour_text().alias("interval"), (F.col("equipment") % 7).alias("zone"), "grid", "value")
    price = e.where("grid IN ('click', 'view')").groupBy("interval", "zone").agg(half_up(F.sum(money("value")).cast("double") / F.count("value")).alias("price"))
    return price, e.where("grid NOT IN ('click', 'view')").groupBy("interval", "zone").agg(F.sum(money("value")).cast("double").alias("mw"))


@query("q_price_generation", f"WITH {_SIDES} SELECT interval, zone, mw, price FROM g JOIN p USING (interval, zone)")
def price_generation(spark, d):
    price, gen = _sides(spark, d)
    return feeds.price_with_generation(price, gen, ["interval", "zone"])


@query("q_replay_join", f"WITH {_SIDES} SELECT interval, zone, mw, price FROM g LEFT JOIN p USING (interval, zone)")
def replay_join(spark, d):
    price, gen = _sides(spark, d)
    return feeds.price_with_generation(price, gen, ["interval", "zone"], "left")


@query("q_flow_score", f"WITH {_SIDES} SELECT zone, count(*) AS n, {r(mean('abs(CAST(price - 50 AS DECIMAL(18,4)) - CAST(mw - 50 AS DECIMAL(18,4)))'))} AS mae, {r('100.0 * count(*) FILTER (WHERE abs(mw - 50) > 5 AND sign(mw - 50) = sign(price - 50)) / nullif(count(*) FILTER (WHERE abs(mw - 50) > 5), 0)')} AS direction FROM g JOIN p USING (interval, zone) GROUP BY zone")
def flow_score(spark, d):
    return feeds.flow_score(price_generation(spark, d), ["zone"], F.col("mw") - 50, F.col("price") - 50, 5)


@query(
    "q_pool_validation",
    f"""WITH {_SIDES}, j AS (SELECT zone, mw, abs(CAST(price AS DECIMAL(18,4)) - CAST(mw AS DECIMAL(18,4))) AS gap FROM g JOIN p USING (interval, zone))
    SELECT zone, count(*) AS hours, {r('100.0 * count(*) FILTER (WHERE gap <= 10.0) / count(*)')} AS exact_percent, count(*) FILTER (WHERE mw > 150) AS scarce_hours, {r(mean('CASE WHEN NOT mw > 150 THEN gap END'))} AS mae FROM j GROUP BY zone""",
)
def pool_validation(spark, d):
    return feeds.pool_validation(price_generation(spark, d), ["zone"], F.col("mw"), F.col("price"), 10.0, F.col("mw") > 150)


@query("q_nonzero_share", "SELECT l_returnflag, count(*) AS n, floor(100.0 * count(*) FILTER (WHERE abs(l_tax - 0.04) > 1e-9) / count(*) * CAST(10000.0 AS DOUBLE) + 0.5) / CAST(10000.0 AS DOUBLE) AS nonzero_share, max(abs(l_tax - 0.04)) AS max_abs FROM lineitem GROUP BY l_returnflag")
def nonzero_share(spark, d):
    return feeds.nonzero_share(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_tax") - 0.04)


@query("q_constrained_roster", f"WITH {EVENTS} SELECT equipment, grid, count(*) AS n, {r(mean('value'))} AS mean, max(value) AS max FROM e GROUP BY ALL")
def constrained_roster(spark, d):
    return feeds.roster(intervals(spark, d), ["equipment", "grid"], "value")


@query(
    "q_registered_offered",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS registered FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS offered FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    c AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS out FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT day, CAST(registered AS DOUBLE) AS registered, CAST(offered AS DOUBLE) AS offered, CAST(coalesce(out, 0) AS DOUBLE) AS out, CAST(greatest(0, registered - offered - coalesce(out, 0)) AS DOUBLE) AS unexplained FROM a JOIN b USING (day) LEFT JOIN c USING (day)""",
)
def registered_offered(spark, d):
    l = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("mw"), "l_returnflag")
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("mw"))
    return feeds.registered_offered(o, l.where("l_returnflag <> 'R'"), l.where("l_returnflag = 'R'"), "day", "day", "mw")


@query(
    "q_native_load",
    f"""SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) + sum(CAST(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS DECIMAL(18,4))) - sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18,4))) + sum(greatest(0, CAST(l_quantity - 25 AS DECIMAL(18,4)))) AS DOUBLE) AS load,
    CAST(sum(CAST(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS DECIMAL(18,4))) - sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18,4))) AS DOUBLE) AS net_import FROM lineitem GROUP BY 1""",
)
def native_load(spark, d):
    q = F.col("l_quantity")
    def side(flag):
        return F.when(F.col("l_returnflag") == flag, q).otherwise(0.0)

    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), q.alias("gen"), side("A").alias("imp"), side("R").alias("exp"), (q - 25).alias("curt"))
    return feeds.native_load(rows, ["day"], "gen", "imp", "exp", "curt")


@query("q_instruction_weeks", f"WITH {EVENTS} SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(DISTINCT equipment) AS resources, max(value) AS max FROM e GROUP BY 1")
def instruction_weeks(spark, d):
    return feeds.weekly_numbers(intervals(spark, d), F.to_date(F.date_trunc("week", "ts")), "value", "equipment")


@query(
    "q_outage_newest",
    f"WITH {EVENTS}, l AS (SELECT equipment, grid, value FROM e QUALIFY row_number() OVER (PARTITION BY equipment ORDER BY ts DESC, event_id DESC) = 1) SELECT grid, count(*) AS resources, {dsum('value')} AS mw FROM l GROUP BY grid",
)
def outage_newest(spark, d):
    return feeds.newest_outages(intervals(spark, d), "equipment", ["ts", "event_id"], "grid", "value")


@query("q_corridor_flow", f"WITH {EVENTS} SELECT grid, hour_ts, {r(mean('value'))} AS flow, count(*) FILTER (WHERE value > 100) AS binding, count(*) AS n FROM e GROUP BY ALL")
def corridor_flow(spark, d):
    return feeds.corridor_flow(intervals(spark, d), ["grid", "hour_ts"], "value", F.col("value") > 100)


@query("q_cap_fraction", f"WITH {EVENTS} SELECT grid, day, {r(mean('CASE WHEN value > 40 THEN least(1.0, greatest(0.0, value / 100)) END'))} AS fraction, count(*) FILTER (WHERE value > 40) AS flagged FROM e GROUP BY ALL")
def cap_fraction(spark, d):
    return feeds.flagged_fraction(intervals(spark, d), ["grid", "day"], F.col("value") > 40, F.col("value") / 100)


@query(
    "q_energy_reconciliation",
    f"""WITH p AS (SELECT l_orderkey AS k, sum(CAST({r('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS DECIMAL(18,4))) AS p FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS t FROM orders GROUP BY 1)
    SELECT k, CAST(p AS DOUBLE) AS parts, CAST(t AS DOUBLE) AS total, {r('100 * (CAST(p - t AS DOUBLE) / nullif(CAST(t AS DOUBLE), 0))')} AS off_percent FROM p JOIN t USING (k)""",
)
def energy_reconciliation(spark, d):
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("mwh"))
    whole = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("reported"))
    return feeds.energy_reconciliation(parts, whole, ["k"], "mwh", "reported")


@query("q_reserve_layer", f"WITH {EVENTS} SELECT grid, equipment % 4 AS commodity, {r(mean('value'))} AS mean, min(value) AS min, max(value) AS max, {r('100.0 * count(*) FILTER (WHERE value >= 100.0) / count(*)')} AS cap_percent FROM e GROUP BY ALL")
def reserve_layer(spark, d):
    return feeds.reserve_layer(intervals(spark, d).withColumn("commodity", F.col("equipment") % 4), ["grid", "commodity"], "value", 100.0)


@query("q_settlement_ranges", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {r(mean('l_extendedprice'))} AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL")
def settlement_ranges(spark, d):
    return feeds.ranges(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("q_marginal_frequency", f"WITH {EVENTS}, n AS (SELECT grid, equipment, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT grid, sum(n) AS a FROM n GROUP BY grid) SELECT grid, equipment, n, {r('100.0 * n / CAST(a AS DOUBLE)')} AS share FROM n JOIN t USING (grid)")
def marginal_frequency(spark, d):
    return feeds.marginal_frequency(intervals(spark, d), ["grid"], "equipment")


@query(
    "q_price_decomposition",
    f"""WITH m AS (SELECT l_suppkey, {mean('l_extendedprice / l_quantity')} AS o, {mean('l_quantity * 20')} AS c, {mean('l_discount * 1000')} AS p FROM lineitem GROUP BY 1), x AS (SELECT l_suppkey, {r('o')} AS observed, {r('c')} AS cost, {r('p')} AS premium, {r('o - c - p')} AS residual FROM m)
    SELECT *, CASE greatest(abs(cost), abs(premium), abs(residual)) WHEN abs(cost) THEN 'cost' WHEN abs(premium) THEN 'premium' ELSE 'residual' END AS dominant FROM x""",
)
def price_decomposition(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("o"), (F.col("l_quantity") * 20).alias("c"), (F.col("l_discount") * 1000).alias("p"))
    return feeds.decomposition(rows, ["l_suppkey"], "o", "c", "p")


@query("q_pipeline_adds", f"WITH x AS (SELECT p_brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 2020 + p_size % 20 END AS y, p_retailprice AS mw FROM part) SELECT p_brand, CASE WHEN y IS NULL THEN 'no year' WHEN y <= 2030 THEN 'by horizon' ELSE 'later' END AS \"when\", count(*) AS n, {dsum('mw')} AS mw FROM x GROUP BY ALL")
def pipeline_adds(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") % 7 != 0, 2020 + F.col("p_size") % 20).alias("year"), F.col("p_retailprice").alias("mw"))
    return feeds.additions(rows, ["p_brand"], "year", "mw", 2030)


@query("q_observed_limit", f"WITH {EVENTS} SELECT equipment, max(value - 50) AS \"limit\", count(*) AS n FROM e WHERE value - 50 > 0 GROUP BY equipment")
def observed_limit(spark, d):
    return feeds.observed_limit(intervals(spark, d).withColumn("room", F.col("value") - 50), "equipment", "room")


@query("q_admin_raise", f"WITH {EVENTS}, m AS (SELECT grid, hour_ts, minute(ts) AS k, sum(CAST(value AS DECIMAL(18,4))) AS s FROM e GROUP BY ALL) SELECT grid, hour_ts, count(*) AS minutes, {r('CAST(sum(s) AS DOUBLE) / count(s)')} AS mw FROM m GROUP BY ALL")
def admin_raise(spark, d):
    return feeds.mean_over_minutes(intervals(spark, d), ["grid", "hour_ts"], F.minute("ts"), "value")


@query("q_fuel_mix", f"WITH v AS (SELECT l_suppkey, l_returnflag, sum(CAST(l_quantity AS DECIMAL(18,4))) AS v FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey, sum(v) AS a FROM v GROUP BY 1) SELECT l_suppkey, l_returnflag, CAST(v AS DOUBLE) AS mw, {r('100 * (CAST(v AS DOUBLE) / CAST(a AS DOUBLE))')} AS percent FROM v JOIN t USING (l_suppkey)")
def fuel_mix(spark, d):
    return feeds.shares(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity")


@query(
    "q_resolution_scoreboard",
    f"WITH s AS (SELECT s_nationkey % 5 AS grid, CASE s_suppkey % 3 WHEN 0 THEN 'alias' WHEN 1 THEN 'name' ELSE 'none' END AS source, abs(s_acctbal) AS mw FROM supplier), v AS (SELECT grid, source, sum(CAST(mw AS DECIMAL(18,4))) AS v FROM s GROUP BY ALL), t AS (SELECT grid, sum(v) AS a FROM v GROUP BY 1) SELECT grid, source, CAST(v AS DOUBLE) AS mw, {r('100 * (CAST(v AS DOUBLE) / CAST(a AS DOUBLE))')} AS percent FROM v JOIN t USING (grid)",
)
def resolution_scoreboard(spark, d):
    s = table(spark, d, "supplier")
    source = F.when(F.col("s_suppkey") % 3 == 0, "alias").when(F.col("s_suppkey") % 3 == 1, "name").otherwise("none")
    return feeds.shares(s.select((F.col("s_nationkey") % 5).alias("grid"), source.alias("source"), F.abs("s_acctbal").alias("mw")), ["grid"], "source", "mw")


@query("q_load_pool", f"WITH m AS (SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS s, CAST(sum(CAST(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4)) AS DECIMAL(38,8))) AS DOUBLE) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, n, {r('s / n', 2)} AS mean, {r('sqrt(greatest(0.0, q / n - (s / n) * (s / n)))', 2)} AS std FROM m")
def load_pool(spark, d):
    return feeds.load_pool(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query(
    "q_demand_growth",
    f"""WITH y AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS v FROM orders GROUP BY ALL), z AS (SELECT o_orderpriority, max(y) - min(y) AS years, arg_min(v, y) AS a, arg_max(v, y) AS z FROM y GROUP BY 1)
    SELECT o_orderpriority, years, {r('CASE WHEN years > 0 THEN 100 * (pow(z / a, 1.0 / years) - 1) END', 3)} AS cagr FROM z""",
)
def demand_growth(spark, d):
    return feeds.growth_rate(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_orderpriority"], "y", "o_totalprice")


@query("q_week_windows", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), w AS (SELECT day AS first_day, lead(day, 6) OVER (ORDER BY day) AS last_day FROM d) SELECT * FROM w WHERE date_diff('day', first_day, last_day) = 6")
def week_windows(spark, d):
    return feeds.consecutive_windows(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", 7)


@query("q_keep_first", f"WITH {EVENTS} SELECT equipment, grid, ts, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY equipment, grid ORDER BY ts, event_id) = 1")
def keep_first(spark, d):
    return feeds.keep_first(intervals(spark, d).select("equipment", "grid", "ts", "event_id", "value"), ["equipment", "grid"], ["ts", "event_id"])


@query("q_price_takers", "SELECT l_orderkey, l_linenumber, l_quantity AS mw, l_discount * 100 AS price FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, -10.0 FROM lineitem WHERE l_linestatus <> 'O'")
def price_takers(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("mw"), "l_linestatus", (F.col("l_discount") * 100).alias("price"))
    return feeds.with_price_takers(l.where("l_linestatus = 'O'").drop("l_linestatus"), l.where("l_linestatus <> 'O'").drop("l_linestatus", "price"), -10.0, "price")


@query("q_two_feeds", f"WITH {EVENTS} SELECT 'RTD' AS feed, equipment, day, count(*) AS n FROM e WHERE grid IN ('click', 'view', 'error') GROUP BY ALL UNION ALL SELECT 'DAP', equipment, day, count(*) FROM e WHERE grid NOT IN ('click', 'view', 'error') GROUP BY ALL")
def two_feeds(spark, d):
    e, near = intervals(spark, d), F.col("grid").isin("click", "view", "error")
    both = e.where(near).withColumn("feed", F.lit("RTD")).unionByName(e.where(~near).withColumn("feed", F.lit("DAP")))
    return both.groupBy("feed", "equipment", "day").agg(F.count("*").alias("n"))


@query("q_seeded_sample", f"WITH {EVENTS} SELECT grid, event_id FROM e QUALIFY row_number() OVER (PARTITION BY grid ORDER BY md5('42|' || CAST(event_id AS VARCHAR))) <= 50")
def seeded_sample(spark, d):
    return feeds.seeded_sample(intervals(spark, d).select("grid", "event_id"), ["grid"], F.col("event_id").cast("string"), 42, 50)


@query("q_stack_invariants", "SELECT l_suppkey, count(*) AS blocks, true AS sound FROM lineitem GROUP BY 1")
def stack_invariants(spark, d):
    order = ["l_discount", "l_orderkey", "l_linenumber", "l_partkey"]
    return feeds.stack_invariants(stack.running_stack(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity", order[1:]), ["l_suppkey"], order, "l_quantity")


@query(
    "q_ramp_capability",
    f"""WITH u AS (SELECT l_returnflag, l_suppkey, max(l_tax * 100) AS r, max(l_quantity) AS room FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, CAST(sum(CAST(least(r * 10, room) AS DECIMAL(18,4))) AS DOUBLE) AS mw, {r('100.0 * count(*) FILTER (WHERE r * 10 >= room) / count(*)')} AS inert_percent FROM u GROUP BY 1""",
)
def ramp_capability(spark, d):
    return feeds.ramp_capability(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", F.col("l_tax") * 100, F.col("l_quantity"), 10)


@query(
    "q_firm_margin",
    f"""WITH s AS (SELECT s_nationkey AS k, {dsum('abs(s_acctbal)')} AS firm FROM supplier GROUP BY 1), l AS (SELECT c_nationkey AS k, max(abs(c_acctbal)) AS peak FROM customer GROUP BY 1)
    SELECT k, firm, peak, {r('100 * ((firm - peak) / nullif(peak, 0))')} AS margin, {r('100 * ((firm - peak - 1500.0) / (peak + 1500.0))')} AS margin_with_more FROM s JOIN l USING (k)""",
)
def firm_margin(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.abs("s_acctbal").alias("mw"))
    return feeds.firm_margin(s, table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.abs("c_acctbal").alias("load")), ["k"], "mw", 1500.0)


@query(
    "q_polyline_km",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, 120 + CAST(l_partkey * 37 % 1000 AS DOUBLE) / 200 AS lon, 10 + CAST(l_partkey * 91 % 1000 AS DOUBLE) / 200 AS lat FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
    s AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    k AS (SELECT l_orderkey, CAST({r('2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))))', 3)} AS DECIMAL(18,3)) AS km FROM s)
    SELECT l_orderkey, count(*) AS points, coalesce(CAST(sum(km) AS DOUBLE), 0.0) AS km FROM k GROUP BY 1""",
)
def polyline_km(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    p = l.select("l_orderkey", "l_linenumber", (120 + (F.col("k") * 37 % 1000).cast("double") / 200).alias("lon"), (10 + (F.col("k") * 91 % 1000).cast("double") / 200).alias("lat"))
    return feeds.polyline_km(p, ["l_orderkey"], "l_linenumber", "lon", "lat")


@query(
    "q_resource_names",
    """WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey % 17 AS VARCHAR), 2, '0') || upper(split_part(p_name, ' ', 1)) || CASE p_partkey % 4 WHEN 0 THEN 'SOL' WHEN 1 THEN 'WIND' ELSE '' END || '_U' || CAST(p_size AS VARCHAR) AS code FROM part)
    SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 3 THEN 'luzon' WHEN n BETWEEN 4 AND 8 THEN 'visayas' WHEN n BETWEEN 9 AND 14 THEN 'mindanao' END AS grid,
    CASE WHEN contains(code, 'SOL') OR contains(code, 'SPV') THEN 'solar' WHEN contains(code, 'WIND') OR contains(code, 'WPP') OR contains(code, 'BURGOS') THEN 'wind' END AS fuel, regexp_replace(split_part(code, '_', 1), '^[0-9]+', '') AS token FROM (SELECT *, CAST(left(code, 2) AS INTEGER) AS n FROM c)""",
)
def resource_names(spark, d):
    mark = F.when(F.col("p_partkey") % 4 == 0, "SOL").when(F.col("p_partkey") % 4 == 1, "WIND").otherwise("")
    code = F.concat(F.lpad((F.col("p_partkey") % 17).cast("string"), 2, "0"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), mark, F.lit("_U"), F.col("p_size").cast("string"))
    c = table(spark, d, "part").select("p_partkey", code.alias("code"))
    return c.select("p_partkey", names.grid_of_code(F.col("code")).alias("grid"), names.fuel_of_code(F.col("code")).alias("fuel"), names.token(F.col("code")).alias("token"))


@query("q_folded_names", "SELECT p_partkey, regexp_replace(lower(strip_accents(replace(replace(p_name, 'e', 'é'), 'n', 'Ñ') || '-' || p_partkey)), '[^a-z0-9]', '', 'g') AS name FROM part")
def folded_names(spark, d):
    marked = F.translate("p_name", "en", "éÑ")
    return table(spark, d, "part").select("p_partkey", names.folded(F.concat(marked, F.lit("-"), F.col("p_partkey").cast("string"))).alias("name"))


@query(
    "q_region_grids",
    "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'luzon' WHEN 1 THEN 'luzon' WHEN 2 THEN 'visayas' WHEN 3 THEN 'mindanao' END AS grid, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 4 < 2 THEN 'leyte-cebu' WHEN s_suppkey % 4 = 2 THEN 'hvdc' ELSE 'other' END AS cause, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 24 * 60 + 30 AS INTEGER) END AS minute FROM supplier",
)
def region_grids(spark, d):
    from amperline.functions import clock

    k = F.col("s_suppkey")
    region = F.when(k % 5 == 0, "CLUZ").when(k % 5 == 1, " luzon ").when(k % 5 == 2, "Visayas").when(k % 5 == 3, "cmin").otherwise("elsewhere")
    place = F.when(k % 4 == 0, "Leyte - Cebu").when(k % 4 == 1, "LEYTE CEBU HVDC").when(k % 4 == 2, "Luzon HVDC").otherwise("bus")
    remark = F.concat(F.when(k % 7 == 0, "work on the ").otherwise("Limitation of "), place)
    mark = F.when(k % 3 != 0, F.concat(F.lit("issued at "), (k % 24).cast("string"), F.lit("30H"))).otherwise("issued later")
    return table(spark, d, "supplier").select("s_suppkey", names.grid_of(region).alias("grid"), names.limitation_cause(remark).alias("cause"), clock.advisory_minute(mark).alias("minute"))


@query(
    "q_build_stack",
    """WITH p AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'coal' WHEN 1 THEN 'gas' ELSE 'hydro' END AS fuel, s_acctbal AS mw, 6.0 + s_suppkey % 4 AS cost FROM supplier)
    SELECT s_suppkey, fuel, mw * 0.4 AS mw, 4.14 AS cost FROM p WHERE fuel = 'coal' AND mw * 0.4 > 0 UNION ALL SELECT s_suppkey, fuel, mw * (1 - 0.4), CAST(cost AS DOUBLE) FROM p WHERE fuel = 'coal' AND mw > 0 UNION ALL SELECT s_suppkey, fuel, mw, CAST(cost AS DOUBLE) FROM p WHERE fuel <> 'coal' AND mw > 0""",
)
def build_stack(spark, d):
    k = F.col("s_suppkey")
    fuel = F.when(k % 3 == 0, "coal").when(k % 3 == 1, "gas").otherwise("hydro")
    p = table(spark, d, "supplier").select("s_suppkey", fuel.alias("fuel"), F.col("s_acctbal").alias("mw"), (6.0 + k % 4).cast("double").alias("cost"))
    return stack.build_stack(p, ["s_suppkey"], "cost", "mw", "fuel", 0.4, 4.14)


@query(
    "q_corridor_report",
    f"WITH {_SIDES}, f AS (SELECT interval, zone, mw, price, mw - 60 AS flow FROM g JOIN p USING (interval, zone)) SELECT interval, zone, flow, abs(flow) >= 39.5 AS saturated, CASE WHEN abs(flow) >= 39.5 THEN CASE WHEN flow > 0 THEN price - 20 ELSE 20 - price END ELSE 0.0 END AS rent FROM f",
)
def corridor_report(spark, d):
    f = price_generation(spark, d).select("interval", "zone", (F.col("mw") - 60).alias("flow"), F.lit(20.0).alias("from"), F.col("price").alias("to"))
    return stack.corridor_report(f, "flow", 40.0, "from", "to").drop("from", "to")


@query(
    "q_price_label",
    f"WITH {_SIDES} SELECT interval, zone, CASE WHEN mw > 300 THEN 'shortage' WHEN abs(floor(mw) - floor(price)) <= 0.025 THEN 'gas' WHEN zone = 1 THEN 'storage' WHEN zone = 2 THEN 'hydro' WHEN floor(price) > floor(mw) THEN 'export' ELSE 'import' END AS label FROM g JOIN p USING (interval, zone)",
)
def price_label(spark, d):
    own, price = F.floor("mw").cast("double"), F.floor("price").cast("double")
    return price_generation(spark, d).select("interval", "zone", stack.price_label(F.col("mw") > 300, own, price, F.col("zone") == 1, F.col("zone") == 2, F.lit("gas")).alias("label"))
