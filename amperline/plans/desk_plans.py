"""A desk's reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.functions.numeric import half_up
from amperline.operators import desk, geometry, graph, stack
from amperline.operators import windows as win
from amperline.plans.common import EVENTS, intervals, mean, r, table
from amperline.plans.map_plans import _GRAPH, _STATION_NODES, _graph, _km, _routes_sql, _station_nodes
from amperline.sources.tables import written

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


#: Station names of letters only: the digits of a supplier's number as A to J.
_LETTERS = "translate(lpad(CAST({k} AS VARCHAR), 4, '0'), '0123456789', 'ABCDEFGHIJ')"
_EQUIPMENT = f"""eq AS (SELECT c_custkey % 400 AS k, CASE c_custkey % 400 % 5 WHEN 0 THEN '05' || left({_LETTERS.format(k='(c_custkey % 400 * 7) % n')}, 4) || '_TR' || c_custkey % 400 % 9 WHEN 1 THEN left({_LETTERS.format(k='(c_custkey % 400 * 7) % n')}, 3) || '2_TR1'
    WHEN 2 THEN left({_LETTERS.format(k='(c_custkey % 400 * 3) % n')}, 4) || '_7' || left({_LETTERS.format(k='(c_custkey % 400 * 11 + 1) % n')}, 4) || '3' WHEN 3 THEN '5ZZZZ_' || left({_LETTERS.format(k='(c_custkey % 400 * 5) % n')}, 4) || '1' ELSE 'bad-' || c_custkey % 400 END AS code,
    CASE WHEN c_custkey % 400 % 2 = 0 THEN '230' ELSE '138' END AS volts FROM customer, n GROUP BY ALL),
    sv AS (SELECT station, node, lon, lat, {_LETTERS.format(k='station')} AS name, CASE WHEN station % 2 = 0 THEN '230000;69000' ELSE '69000' END AS voltage FROM sn2),
    ps AS (SELECT eq.*, regexp_extract(code, '^\\d{{0,2}}([A-Z]+?)\\d*_TR\\d*$', 1) AS t, regexp_extract(code, '^\\d{{0,2}}([A-Z]+?)\\d*_\\d{{0,2}}([A-Z]+?)(\\d+)?$', 1) AS x, regexp_extract(code, '^\\d{{0,2}}([A-Z]+?)\\d*_\\d{{0,2}}([A-Z]+?)(\\d+)?$', 2) AS y FROM eq),
    ca AS (SELECT code, volts, station, contains(voltage, volts || '000') AS fit FROM ps JOIN sv ON t <> '' AND starts_with(name, t)), cf AS (SELECT *, max(fit) OVER (PARTITION BY code) AS anyfit FROM ca), cs AS (SELECT code, count(*) AS n, min(station) AS station FROM cf WHERE fit OR NOT anyfit GROUP BY code),
    sa AS (SELECT code, station AS s, node FROM ps JOIN sv ON t = '' AND x <> '' AND starts_with(name, x)), sb AS (SELECT code, station AS s, node FROM ps JOIN sv ON t = '' AND x <> '' AND starts_with(name, y)), ab AS (SELECT sa.code, sa.s AS sa, sb.s AS sb, sa.node AS a, sb.node AS b FROM sa JOIN sb USING (code))"""


def _letters(c):
    return F.translate(F.lpad(c.cast("string"), 4, "0"), "0123456789", "ABCDEFGHIJ")


@query(
    "q_equipment_match",
    f"""WITH RECURSIVE {_GRAPH}, {_STATION_NODES}, {_EQUIPMENT}, {_routes_sql('ab', 'ab', 200_000)},
    sc AS (SELECT DISTINCT ab.code, ab.sa, ab.sb, rt.metres FROM ab JOIN rt ON rt.a = ab.a AND rt.b = ab.b JOIN sv p ON p.station = ab.sa JOIN sv q ON q.station = ab.sb WHERE rt.metres / 1000 <= least(greatest(3 * ({_km('p.', 'q.')}), ({_km('p.', 'q.')}) + 60), 200)),
    be AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY metres, sa, sb) AS i FROM sc), cl AS (SELECT be.code FROM be JOIN be z ON z.code = be.code AND z.i = 1 AND be.metres < z.metres * 1.2 JOIN st p ON p.station = be.sa JOIN st q ON q.station = z.sa JOIN st t ON t.station = be.sb JOIN st w ON w.station = z.sb WHERE NOT ({_km('p.', 'q.')} < 3 AND {_km('t.', 'w.')} < 3)),
    bb AS (SELECT * FROM be WHERE i = 1 AND code NOT IN (SELECT code FROM cl))
    SELECT ps.code, CASE WHEN t <> '' THEN 'station' WHEN x <> '' THEN 'line' ELSE 'unparsed' END AS kind, CASE WHEN t <> '' THEN CASE WHEN cs.n = 1 THEN cs.station END ELSE bb.sa END AS a, bb.sb AS b, bb.metres,
    CASE WHEN t = '' AND x = '' THEN 'unparsed code' WHEN t <> '' THEN CASE WHEN cs.n IS NULL THEN 'station token unresolved' WHEN cs.n > 1 THEN 'station token ambiguous' END WHEN ps.code NOT IN (SELECT code FROM ab) THEN 'station token unresolved' WHEN bb.sa IS NULL THEN 'no plausible path in the graph' END AS why
    FROM ps LEFT JOIN cs USING (code) LEFT JOIN bb USING (code)""",
)
def equipment_match(spark, d):
    """What equipment codes stand for: a transformer's station, a circuit's pair of stations, or the reason that they match nothing."""
    st = _station_nodes(spark, d)
    n = st.count()
    k = F.col("k")
    code = (
        F.when(k % 5 == 0, F.concat(F.lit("05"), _letters(k * 7 % n), F.lit("_TR"), (k % 9).cast("string"))).when(k % 5 == 1, F.concat(F.substring(_letters(k * 7 % n), 1, 3), F.lit("2_TR1")))
        .when(k % 5 == 2, F.concat(_letters(k * 3 % n), F.lit("_7"), _letters((k * 11 + 1) % n), F.lit("3"))).when(k % 5 == 3, F.concat(F.lit("5ZZZZ_"), _letters(k * 5 % n), F.lit("1"))).otherwise(F.concat(F.lit("bad-"), k.cast("string")))
    )
    own = table(spark, d, "customer").select((F.col("c_custkey") % 400).alias("k")).distinct().select(code.alias("code"), F.when(k % 2 == 0, "230").otherwise("138").alias("volts"))
    named = st.select("station", "node", "lon", "lat", _letters(F.col("station")).alias("name"), F.when(F.col("station") % 2 == 0, "230000;69000").otherwise("69000").alias("voltage"))
    tokens = own.select(F.explode(F.array(F.regexp_extract("code", desk.TRANSFORMER, 1), F.regexp_extract("code", desk.CIRCUIT, 1), F.regexp_extract("code", desk.CIRCUIT, 2))).alias("token")).where("token <> ''")
    candidates = geometry.prefix_candidates(tokens, "token", named, "station", "name").join(named.select("station", "voltage"), "station")
    lines = own.where(F.regexp_extract("code", desk.TRANSFORMER, 1) == "").select("code", F.regexp_extract("code", desk.CIRCUIT, 1).alias("x"), F.regexp_extract("code", desk.CIRCUIT, 2).alias("y"))
    a, b = (lines.join(candidates, F.col(x) == F.col("token")).select("code", F.col("station").alias(s)) for x, s in (("x", "a"), ("y", "b")))
    sides = {}
    for side, own_side in (("a", a), ("b", b)):
        at = named.select(F.col("station").alias(side), F.col("node").alias(f"node_{side}"), F.col("lon").alias(f"lon_{side}"), F.col("lat").alias(f"lat_{side}"))
        sides[side] = written(own_side.withColumnRenamed("code", "item").join(at, side), f"sides-{side}")

    def plausible(found):
        pairs = found.withColumnsRenamed({"a": "node_a", "b": "node_b"}).join(sides["a"], ["item", "node_a"]).join(sides["b"], ["item", "node_b"])
        return geometry.without_detours(pairs, "metres").select("item", "a", "b", "metres")

    ends = {s: sides[s].select("item", F.col(f"node_{s}").alias(s)) for s in "ab"}
    # only pairs within 1.2 times a code's best can be its best one or that one's rivals
    close = graph.closest_pairs(_graph(spark, d), ends["a"], ends["b"], 200_000, 1.2, plausible)
    paths = close.groupBy("a", "b").agg(F.min("metres").alias("metres"))
    return desk.match_report(own, "code", "volts", candidates, paths, named)


_ADEQUATE = """av AS (SELECT s_nationkey % 3 AS grid, s_suppkey % 4 AS fuel, hour, abs(s_acctbal) * CASE WHEN s_suppkey % 4 = 0 THEN greatest(0.0, 1 - abs(hour - 12) / 6.0) ELSE 1.0 END AS mw FROM supplier, (SELECT unnest(range(24)) AS hour)),
    de AS (SELECT l_suppkey % 3 AS grid, l_orderkey % 24 AS hour, l_quantity / 5 AS mw FROM lineitem), ou AS (SELECT c_custkey % 3 AS grid, c_custkey % 4 AS fuel, CAST(c_custkey % 30 AS DOUBLE) AS mw FROM customer)"""


@query(
    "q_adequacy",
    f"""WITH {_ADEQUATE}, f AS (SELECT grid, fuel, hour, sum(CAST(mw AS DECIMAL(18,4))) AS mw FROM av GROUP BY ALL), o AS (SELECT grid, fuel, sum(CAST(mw AS DECIMAL(18,4))) AS gone FROM ou GROUP BY ALL), h AS (SELECT grid, hour, CAST(sum(greatest(0, mw - coalesce(gone, 0))) AS DOUBLE) AS have FROM f LEFT JOIN o USING (grid, fuel) GROUP BY ALL),
    n AS (SELECT grid, hour, CAST(sum(CAST(mw AS DECIMAL(18,4))) AS DOUBLE) + 1500 AS need FROM de GROUP BY ALL), b AS (SELECT grid, CAST(hour AS INTEGER) AS hour, have, need, {r('have - need', 1)} AS spare FROM h JOIN n USING (grid, hour))
    SELECT grid, {r('arg_max(have, (need, -hour))', 1)} AS firm, {r('max(need)', 1)} AS peak, {r('100 * (arg_max(have, (need, -hour)) - max(need)) / max(need)', 1)} AS margin, arg_min(hour, (spare, hour)) AS tight_hour, min(spare) AS tight_mw FROM b GROUP BY grid""",
)
def adequacy(spark, d):
    """Firm margin and tightest hour with scheduled outages and 1500 MW more load."""
    c = F.col
    shape = F.when(c("s_suppkey") % 4 == 0, F.greatest(F.lit(0.0), 1 - F.abs(c("hour") - 12) / 6.0)).otherwise(1.0)
    av = table(spark, d, "supplier").select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")).select((c("s_nationkey") % 3).alias("grid"), (c("s_suppkey") % 4).alias("fuel"), "hour", (F.abs("s_acctbal") * shape).alias("mw"))
    de = table(spark, d, "lineitem").select((c("l_suppkey") % 3).alias("grid"), (c("l_orderkey") % 24).cast("int").alias("hour"), (c("l_quantity") / 5).alias("mw"))
    ou = table(spark, d, "customer").select((c("c_custkey") % 3).alias("grid"), (c("c_custkey") % 4).alias("fuel"), (c("c_custkey") % 30).cast("double").alias("mw"))
    return desk.adequacy(av, de, ou, "grid", "fuel", "hour", 1500.0)


_MOMENTS = "count(*) AS n, CAST(sum(CAST(x AS DECIMAL(16,4))) AS DOUBLE) AS sx, CAST(sum(CAST(y AS DECIMAL(16,4))) AS DOUBLE) AS sy, CAST(sum(CAST(x AS DECIMAL(16,4)) * CAST(x AS DECIMAL(16,4))) AS DOUBLE) AS sxx, CAST(sum(CAST(y AS DECIMAL(16,4)) * CAST(y AS DECIMAL(16,4))) AS DOUBLE) AS syy, CAST(sum(CAST(x AS DECIMAL(16,4)) * CAST(y AS DECIMAL(16,4))) AS DOUBLE) AS sxy"


@query(
    "q_fisher_ci",
    f"""WITH p AS (SELECT l_suppkey AS g, l_quantity AS x, l_extendedprice / 100 AS y FROM lineitem), m AS (SELECT g, {_MOMENTS} FROM p GROUP BY g),
    c AS (SELECT g, n, {r('CASE WHEN n >= 3 AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt(n * sxx - sx * sx) / sqrt(n * syy - sy * sy) END')} AS corr FROM m)
    SELECT g, n, corr, CASE WHEN n > 3 AND abs(corr) < 1 THEN {r('tanh(atanh(corr) - 1.96 / sqrt(n - 3))', 3)} END AS low, CASE WHEN n > 3 AND abs(corr) < 1 THEN {r('tanh(atanh(corr) + 1.96 / sqrt(n - 3))', 3)} END AS high FROM c""",
)
def fisher_ci(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 100).alias("y"))
    own = win.correlation(pairs, ["g"], F.col("x"), F.col("y"))
    low, high = desk.fisher_interval(F.col("corr"), F.col("n"))
    return own.select("g", "n", "corr", low.alias("low"), high.alias("high"))


@query("q_instructions", f"WITH i AS (SELECT l_partkey % 12 AS week, l_suppkey AS resource, l_quantity * 3 AS mw FROM lineitem) SELECT week, count(*) AS n_rows, count(DISTINCT resource) AS n_resources, {r('quantile_cont(mw, 0.5)', 1)} AS median, {r('max(mw)', 1)} AS most, count(*) FILTER (WHERE mw >= 100) AS large FROM i GROUP BY week")
def instructions(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 12).alias("week"), F.col("l_suppkey").alias("resource"), (F.col("l_quantity") * 3).alias("mw"))
    return desk.instruction_weeks(rows, "week", "resource", "mw")


@query("q_hour_peaks", f"WITH i AS (SELECT l_suppkey % 3 AS region, l_partkey % 40 AS day, l_orderkey % 24 AS hour, max(l_quantity) AS p FROM lineitem GROUP BY ALL) SELECT region, CAST(count(*) AS INTEGER) AS hours, {r('quantile_cont(p, 0.5)', 1)} AS median FROM i GROUP BY region")
def hour_peaks(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select((c("l_suppkey") % 3).alias("region"), (c("l_partkey") % 40).alias("day"), (c("l_orderkey") % 24).alias("hour"), c("l_quantity").alias("mw"))
    return desk.peak_then_median(rows, "region", ["day", "hour"], "mw")


_NODES = """x AS (SELECT day, grid, equipment % 50 AS node, CAST(date_part('hour', ts) AS INTEGER) AS hour, value, value - 60 AS mw FROM e)"""


@query(
    "q_node_observation",
    f"""WITH {EVENTS}, {_NODES}, q AS (SELECT day, grid, node, CAST({mean('value')} AS DECIMAL(18,4)) AS v, CAST({mean('CASE WHEN hour = 19 THEN value END')} AS DECIMAL(18,4)) AS e19, CAST({mean('CASE WHEN hour = 12 THEN value END')} AS DECIMAL(18,4)) AS n12, CAST({mean('abs(mw)')} AS DECIMAL(18,4)) AS m FROM x GROUP BY ALL),
    o AS (SELECT grid, node, count(*) AS days, {r('CAST(sum(v) AS DOUBLE) / count(v)')} AS mean, {r('CAST(sum(e19) AS DOUBLE) / nullif(count(e19), 0)')} AS evening, {r('CAST(sum(n12) AS DOUBLE) / nullif(count(n12), 0)')} AS noon, {r('CAST(sum(m) AS DOUBLE) / count(m)')} AS mw FROM q GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY mean, node) - 1 AS i, count(*) OVER (PARTITION BY grid) AS n FROM o) SELECT grid, node, days, mean, evening, noon, mw, CASE WHEN i < 8 THEN 'low' ELSE 'high' END AS side FROM p WHERE i < 8 OR i >= n - 8""",
)
def node_observation(spark, d):
    e = intervals(spark, d)
    x = e.select("day", "grid", (F.col("equipment") % 50).alias("node"), F.hour("ts").alias("hour"), "value", (F.col("value") - 60).alias("mw"))
    return desk.node_observation(x, "day", "grid", "node", "hour", "value", "mw", 8)


@query(
    "q_system_reserve",
    f"""WITH x AS (SELECT l_partkey % 4 AS commodity, l_orderkey % 500 AS interval, l_quantity AS mw, round(l_discount * 100) AS price FROM lineitem), s AS (SELECT commodity, interval, sum(CAST(mw AS DECIMAL(18,4))) AS mw FROM x GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY mw DESC, interval) AS i, count(*) OVER (PARTITION BY commodity) AS n FROM s),
    d AS (SELECT commodity, {r('CAST(sum(mw) AS DOUBLE) / count(*)', 1)} AS system_mean, {r('CAST(sum(mw) FILTER (WHERE i <= greatest(1, n // 10)) AS DOUBLE) / count(*) FILTER (WHERE i <= greatest(1, n // 10))', 1)} AS top_decile FROM o GROUP BY commodity)
    SELECT commodity, count(*) AS n, {r(mean('price'))} AS mean, min(price) AS least, max(price) AS most, {r('100.0 * count(*) FILTER (WHERE price >= 9 - 1e-9) / count(*)', 1)} AS cap_share, any_value(system_mean) AS system_mean, any_value(top_decile) AS top_decile FROM x JOIN d USING (commodity) GROUP BY commodity""",
)
def system_reserve(spark, d):
    c = F.col
    x = table(spark, d, "lineitem").select((c("l_partkey") % 4).alias("commodity"), (c("l_orderkey") % 500).alias("interval"), c("l_quantity").alias("mw"), F.round(c("l_discount") * 100).alias("price"))
    return desk.system_reserve(x, "interval", "commodity", "mw", "price", 9.0)


@query(
    "q_storage_schedule",
    """WITH RECURSIVE h AS (SELECT l_suppkey AS grid, CAST(l_orderkey % 24 AS INTEGER) AS hour, CAST(sum(l_quantity) AS BIGINT) AS price, count(*) AS demand FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY price, demand, hour) AS i, count(*) OVER (PARTITION BY grid) AS n, row_number() OVER (PARTITION BY grid ORDER BY hour) AS seq FROM h),
    x AS (SELECT grid, hour, seq, CASE WHEN i <= 5 THEN 1 WHEN i > n - least(4, greatest(0, n - least(n, 5))) THEN -1 ELSE 0 END AS role FROM k),
    s AS (SELECT grid, CAST(0 AS BIGINT) AS seq, CAST(NULL AS INTEGER) AS hour, 0.0::DOUBLE AS charge, 0.0::DOUBLE AS discharge, 0.0::DOUBLE AS held FROM (SELECT DISTINCT grid FROM x)
    UNION ALL SELECT grid, seq, hour, c, e, held + c * 0.8 - e FROM (SELECT s.grid, x.seq, x.hour, s.held, CASE WHEN role = 1 AND s.held < 400 - 1e-9 THEN floor(least(100.0::DOUBLE, (400 - s.held) / 0.8::DOUBLE) * 10 + 1e-9) / 10 ELSE 0.0::DOUBLE END AS c, CASE WHEN role = -1 AND s.held > 1e-9 THEN floor(least(100.0::DOUBLE, s.held) * 10 + 1e-9) / 10 ELSE 0.0::DOUBLE END AS e FROM s JOIN x ON x.grid = s.grid AND x.seq = s.seq + 1))
    SELECT grid, hour, floor(charge * 10 + 0.5) / 10.0 AS charge, floor(discharge * 10 + 0.5) / 10.0 AS discharge, floor(held * 10 + 0.5) / 10.0 AS held FROM s WHERE seq > 0""",
)
def storage_schedule(spark, d):
    """A store of 100 MW and 400 MWh on each grid's hours."""
    h = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("grid"), (F.col("l_orderkey") % 24).cast("int").alias("hour")).agg(F.sum("l_quantity").cast("long").alias("price"), F.count("*").alias("demand"))
    return desk.storage_schedule(h, ["grid"], "hour", "price", "demand", 100, 400, 0.8)


@query("q_raised_share", f"WITH ra AS (SELECT l_suppkey % 3 AS grid, l_partkey % 40 AS day, l_orderkey % 24 AS hour, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity - 20 ELSE 0 END) AS mw FROM lineitem GROUP BY ALL), ge AS (SELECT l_suppkey % 3 AS grid, l_partkey % 40 AS day, l_orderkey % 24 AS hour, sum(l_quantity) AS mw FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL) SELECT grid, count(*) AS hours, {r('100 * CAST(sum(CAST(ra.mw AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(ge.mw AS DECIMAL(18,4))) AS DOUBLE)', 2)} AS share FROM ra JOIN ge USING (grid, day, hour) WHERE ra.mw > 0 AND ge.mw <> 0 GROUP BY grid")
def raised_share(spark, d):
    c = F.col
    keys = [(c("l_suppkey") % 3).alias("grid"), (c("l_partkey") % 40).alias("day"), (c("l_orderkey") % 24).alias("hour")]
    li = table(spark, d, "lineitem")
    raised = li.groupBy(*keys).agg(F.sum(F.when(c("l_returnflag") == "R", c("l_quantity") - 20).otherwise(0.0)).alias("mw"))
    return desk.raised_share(raised, li.where("l_linenumber < 4").groupBy(*keys).agg(F.sum("l_quantity").alias("mw")), "grid", ["day", "hour"])


@query("q_both_known", "WITH m AS (SELECT l_partkey AS k, max(CASE WHEN l_linenumber = 1 THEN l_tax END) AS modeled FROM lineitem GROUP BY 1), o AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS observed FROM part) SELECT k, modeled, observed FROM m JOIN o USING (k) WHERE modeled IS NOT NULL AND observed IS NOT NULL")
def both_known(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_tax"))).alias("modeled"))
    o = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("observed"))
    return desk.both_known(m, o, ["k"])


@query("q_commodities", "SELECT CASE s_suppkey % 7 WHEN 0 THEN 'En' WHEN 1 THEN 'Fr' WHEN 2 THEN 'Dr' WHEN 3 THEN 'Ru' WHEN 4 THEN 'Rd' END AS commodity, count(*) AS n FROM supplier GROUP BY 1")
def commodities(spark, d):
    k = F.col("s_suppkey") % 7
    text = F.when(k == 0, "EN").when(k == 1, " fr ").when(k == 2, "DR").when(k == 3, "ru").when(k == 4, "Rd").when(k == 5, "Xx").otherwise("")
    return table(spark, d, "supplier").groupBy(desk.commodity(text).alias("commodity")).agg(F.count("*").alias("n"))


@query("q_first_interval", f"WITH {EVENTS} SELECT event_id, grid, hour_ts FROM e QUALIFY ts = min(ts) OVER (PARTITION BY grid, hour_ts)")
def first_interval(spark, d):
    return desk.first_interval(intervals(spark, d), ["grid", "hour_ts"], "ts").select("event_id", "grid", "hour_ts")


@query(
    "q_levers",
    f"""WITH b AS (SELECT l_suppkey AS grid, l_returnflag AS fuel, l_discount * 100 AS cost, l_quantity AS mw FROM lineitem), v AS (SELECT grid, fuel, {r("cost + 2.5 * CASE fuel WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.4 ELSE 0.0 END")} AS cost, {r("mw * CASE fuel WHEN 'N' THEN 0.5 ELSE 1.0 END")} AS mw FROM b),
    k AS (SELECT grid, cost, sum(CAST(mw AS DECIMAL(18,4))) AS mw FROM v WHERE mw > 0 GROUP BY ALL), c AS (SELECT *, CAST(sum(mw) OVER (PARTITION BY grid ORDER BY cost) AS DOUBLE) AS cum FROM k)
    SELECT grid, coalesce(min(cost) FILTER (WHERE cum >= 8000), 32.0) AS price, CAST(sum(mw) AS DOUBLE) AS available FROM c GROUP BY grid""",
)
def levers(spark, d):
    """Prices with carbon at 2.5 and half the gas."""
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grid"), F.col("l_returnflag").alias("fuel"), (F.col("l_discount") * 100).alias("cost"), F.col("l_quantity").alias("mw"))
    v = desk.apply_levers(b, "fuel", "cost", "mw", 2.5, {"A": 0.9, "N": 0.4}, {"N": 0.5})
    levels = v.groupBy("grid", "cost").agg(F.sum(F.col("mw").cast("decimal(18,4)")).cast("double").alias("mw"))
    out = stack.clear(stack.running_stack(levels, ["grid"], "cost", "mw", []), ["grid"], "cost", "mw", F.lit(8000.0), [])
    return out.select("grid", F.col("price").cast("double").alias("price"), half_up(F.col("available")).alias("available"))


#: Prices of nodes from their parts: the value's twenties as reference, 2 of congestion at every third node, the rest losses; on every fifth of the month one row in 99 does not add up.
_PARTS = f"""{EVENTS}, pt AS (SELECT *, equipment % 40 AS node, hour(ts) AS hour, strftime(ts, '%Y-%m-%d %H:') || lpad(CAST(minute(ts) // 20 AS VARCHAR), 2, '0') AS slot, floor(value / 20) * 20 AS smp, CASE WHEN equipment % 3 = 0 THEN 2.0 ELSE 0.0 END AS cong FROM e),
    pl AS (SELECT *, value - smp - cong + CASE WHEN event_id % 99 = 0 AND day(ts) % 5 = 0 THEN 1 ELSE 0 END AS loss FROM pt), sd AS (SELECT day FROM pl GROUP BY day HAVING max(abs(CAST(value AS DECIMAL(18,4)) - CAST(smp AS DECIMAL(18,4)) - CAST(loss AS DECIMAL(18,4)) - CAST(cong AS DECIMAL(18,4)))) <= 0.05 AND count(DISTINCT hour) >= 12), nx AS (SELECT * FROM pl SEMI JOIN sd USING (day))"""


def _nodal(spark, d):
    c = F.col
    rows = intervals(spark, d).select(
        "day", "grid", (c("equipment") % 40).alias("node"), F.hour("ts").alias("hour"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:"), F.lpad(F.floor(F.minute("ts") / 20).cast("string"), 2, "0")).alias("slot"),
        "value", (F.floor(c("value") / 20) * 20).alias("smp"), F.when(c("equipment") % 3 == 0, 2.0).otherwise(0.0).alias("cong"), ((c("event_id") % 99 == 0) & (F.dayofmonth("ts") % 5 == 0)).cast("int").alias("off"),
    )
    parts = rows.withColumn("loss", c("value") - c("smp") - c("cong") + c("off"))
    return desk.sound_days(parts, "day", "hour", c("value"), [c("smp"), c("loss"), c("cong")], 0.05, 12)


@query(
    "q_nodal_hours",
    f"WITH {_PARTS} SELECT day, grid, node, hour, count(*) AS n, {r(mean('(value - smp)'), 3)} AS deviation, {r(mean('value'), 2)} AS mw, {r(mean('CASE WHEN cong <> 0 THEN cong END'), 3)} AS congestion FROM nx GROUP BY ALL",
)
def nodal_hours(spark, d):
    """Nodes by hour on days whose prices add up and that are covered."""
    return desk.nodal_hours(_nodal(spark, d), ["day", "grid", "node", "hour"], "value", "smp", "cong", "value")


@query(
    "q_reference_hours",
    f"""WITH {_PARTS}, c AS (SELECT day, grid, hour, slot, smp AS v, count(*) AS k FROM nx GROUP BY ALL), m AS (SELECT day, grid, hour, slot, v, count(*) OVER (PARTITION BY day, grid, hour, slot) AS kinds FROM c QUALIFY row_number() OVER (PARTITION BY day, grid, hour, slot ORDER BY k DESC, v) = 1)
    SELECT day, grid, hour, count(*) AS intervals, count(*) FILTER (WHERE kinds > 1) AS multimodal, {r(mean('v'))} AS reference FROM m GROUP BY ALL""",
)
def reference_hours(spark, d):
    """The reference price by hour, from each interval's most frequent one."""
    return desk.reference_hours(_nodal(spark, d), ["day", "grid", "hour"], "slot", "smp")
