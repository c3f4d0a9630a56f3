"""Names, places, stamps, book replays and draws over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.functions import clock
from amperline.functions.numeric import half_up
from amperline.operators import geometry, matching, scenario, stack
from amperline.plans.common import r, table
from amperline.plans.map_plans import _STATIONS, _km, _stations

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


@query(
    "q_stamps",
    """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS kind, o_orderdate + to_minutes(CAST(o_orderkey % 288 * 5 AS INTEGER)) AS ts FROM orders),
    s AS (SELECT o_orderkey, kind, CASE WHEN kind < 3 THEN ts WHEN kind = 3 THEN date_trunc('day', ts) END AS stamp FROM t)
    SELECT o_orderkey, stamp, CAST(CASE WHEN kind = 3 THEN 23 ELSE ((date_part('hour', stamp) * 60 + date_part('minute', stamp) - 5 + 1440) // 60) % 24 END AS INTEGER) AS hour, CAST(stamp - INTERVAL 5 MINUTE AS DATE) AS day FROM s""",
)
def stamps(spark, d):
    """Stamps of four formats as texts, and texts that are none."""
    k, ts = F.col("o_orderkey"), F.col("o_orderdate") + F.make_interval(mins=(F.col("o_orderkey") % 288 * 5).cast("int"))
    text = F.when(k % 5 == 0, F.date_format(ts, "M/d/yyyy h:mm:ss a")).when(k % 5 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 2, F.date_format(ts, "M/d/yyyy HH:mm")).when(k % 5 == 3, F.date_format(ts, "M/d/yyyy")).otherwise("not given")
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    stamp = clock.parse_stamp(F.col("text"))
    return rows.select("o_orderkey", stamp.alias("stamp"), clock.hour_of_text(F.col("text")).alias("hour"), clock.day_of_stamp(stamp).alias("day"))


_GRID = "CASE {k} % 3 WHEN 0 THEN 'luzon' WHEN 1 THEN 'visayas' ELSE 'mindanao' END"
_RESOURCES = f"""rs AS (SELECT p_partkey AS k, {_GRID.format(k='p_partkey')} AS grid, CASE p_partkey % 6 WHEN 0 THEN 'KAL' WHEN 1 THEN 'SROQUE' WHEN 2 THEN 'PULANAI' WHEN 3 THEN upper(split_part(p_name, ' ', 1)) || p_partkey % 20 WHEN 4 THEN 'HYDROX' || p_partkey ELSE 'ZZ' || p_partkey END AS core FROM part),
    re AS (SELECT *, core || CASE WHEN k % 7 = 0 THEN '_BAT' ELSE '_U' || k END AS res, regexp_replace(upper(core), '[^A-Z0-9]', '', 'g') AS n FROM rs),
    pn AS (SELECT s_suppkey AS plant, {_GRID.format(k='s_suppkey')} AS grid, regexp_replace(upper(['Cold', 'Small', 'Large', 'Hot'][CAST(s_suppkey % 4 + 1 AS INTEGER)] || ' ' || s_suppkey % 20 || CASE WHEN s_suppkey % 2 = 0 THEN ' Hydro Plant' ELSE '' END), '[^A-Z0-9]', '', 'g') AS name FROM supplier)"""


def _grid(k):
    return F.when(k % 3 == 0, "luzon").when(k % 3 == 1, "visayas").otherwise("mindanao")


@query(
    "q_hydro_ladder",
    f"""WITH {_RESOURCES}, hit AS (SELECT re.res, arg_min(pn.plant, (pn.name, pn.plant)) AS plant FROM re JOIN pn ON pn.grid = re.grid AND (contains(pn.name, re.n) OR contains(re.n, pn.name)) WHERE length(re.n) >= 4 GROUP BY re.res)
    SELECT re.res, CASE WHEN res LIKE '%\\_BAT' ESCAPE '\\' OR core = 'KAL' THEN 'excluded' WHEN core = 'SROQUE' AND grid = 'luzon' THEN 'alias' WHEN core = 'PULANAI' AND grid = 'mindanao' THEN 'extra' WHEN core NOT IN ('SROQUE', 'PULANAI') AND hit.plant IS NOT NULL THEN 'matched' WHEN contains(core, 'HYDRO') OR contains(core, 'SROQ') THEN 'suspect' ELSE 'unclassified' END AS outcome,
    CASE WHEN res LIKE '%\\_BAT' ESCAPE '\\' OR core = 'KAL' THEN NULL WHEN core = 'SROQUE' AND grid = 'luzon' THEN 'SAN ROQUE' WHEN core = 'PULANAI' AND grid = 'mindanao' THEN core WHEN core NOT IN ('SROQUE', 'PULANAI') THEN CAST(hit.plant AS VARCHAR) END AS plant FROM re LEFT JOIN hit USING (res)""",
)
def hydro_ladder(spark, d):
    k = F.col("p_partkey")
    core = F.when(k % 6 == 0, "KAL").when(k % 6 == 1, "SROQUE").when(k % 6 == 2, "PULANAI").when(k % 6 == 3, F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), (k % 20).cast("string"))).when(k % 6 == 4, F.concat(F.lit("HYDROX"), k.cast("string"))).otherwise(F.concat(F.lit("ZZ"), k.cast("string")))
    own = table(spark, d, "part").select(k.alias("k"), _grid(k).alias("grid"), core.alias("core"))
    own = own.withColumn("res", F.concat("core", F.when(F.col("k") % 7 == 0, "_BAT").otherwise(F.concat(F.lit("_U"), F.col("k").cast("string")))))
    s = F.col("s_suppkey")
    word = F.element_at(F.array(*map(F.lit, ("Cold", "Small", "Large", "Hot"))), (s % 4 + 1).cast("int"))
    name = F.concat(word, F.lit(" "), (s % 20).cast("string"), F.when(s % 2 == 0, " Hydro Plant").otherwise(""))
    plants = table(spark, d, "supplier").select(s.alias("plant"), name.alias("name"), _grid(s).alias("grid"))
    return matching.classify(own, "res", "core", "grid", plants, {"SROQUE": ("SAN ROQUE", "luzon")}, {"PULANAI": "mindanao"}, {"KAL"}, ["HYDRO", "SROQ"])


_RUNGS = ("substation", "plant", "named", "place")


@query(
    "q_located",
    f"""WITH {_STATIONS}, rs AS (SELECT c_custkey AS res, {_GRID.format(k='c_custkey')} AS grid, 'supplier0' || lpad(CAST(c_custkey % (n // 10) AS VARCHAR), 7, '0') AS code FROM customer, n),
    cd AS (SELECT rs.res, s.station % 4 AS rung, s.station AS site, s.lon, s.lat FROM rs JOIN st s ON starts_with(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), code) WHERE {_GRID.format(k='s.station')} = rs.grid),
    fi AS (SELECT res, rung, arg_min({{'site': site, 'lon': lon, 'lat': lat}}, site) AS f FROM cd GROUP BY ALL),
    su AS (SELECT cd.res, cd.rung, any_value(fi.f) AS f FROM cd JOIN fi USING (res, rung) GROUP BY ALL HAVING max({_km('f.', 'cd.')}) <= 25),
    be AS (SELECT res, arg_min(f, rung) AS f, min(rung) AS rung FROM su GROUP BY res)
    SELECT rs.res, ['substation', 'plant', 'named', 'place'][CAST(rung + 1 AS INTEGER)] AS source, f.site AS site, f.lon AS lon, f.lat AS lat FROM rs LEFT JOIN be USING (res)""",
)
def located(spark, d):
    """Places of customers' codes among four kinds of sites."""
    st = _stations(spark, d).withColumn("grid", _grid(F.col("station")))
    n = st.count() // 10
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(k.alias("res"), _grid(k).alias("grid"), F.concat(F.lit("supplier0"), F.lpad((k % n).cast("string"), 7, "0")).alias("code"))
    sites = geometry.prefix_candidates(own, "code", st, "station", "name").join(st, "station").select("code", F.col("station").alias("site"), "lon", "lat", "grid")
    rungs = [(name, own.select("res", "code").join(sites.where(F.col("site") % 4 == i), "code").drop("code")) for i, name in enumerate(_RUNGS)]
    return matching.located(own, "res", "grid", rungs)


@query(
    "q_null_model",
    """WITH po AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 50 AS v FROM lineitem), nm AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 50 AS v FROM lineitem WHERE l_linenumber <= 2), ma AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 50 AS v FROM lineitem WHERE l_discount > 0.06),
    ks AS (SELECT nm.k, count(*) AS n, max(CASE WHEN ma.v IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM nm LEFT JOIN ma USING (k, v) WHERE nm.k IN (SELECT k FROM ma) GROUP BY nm.k),
    dr AS (SELECT po.k, d, ks.n, hit, CASE WHEN ma.v IS NOT NULL THEN 1 ELSE 0 END AS m, row_number() OVER (PARTITION BY po.k, d ORDER BY md5('42:' || d || ':' || po.k || ':' || po.v), po.v) AS i FROM po JOIN ks USING (k) LEFT JOIN ma USING (k, v), (SELECT unnest(range(20)) AS d)),
    pk AS (SELECT k, d, max(m) AS m, max(hit) AS hit FROM dr WHERE i <= n GROUP BY ALL), t AS (SELECT d, count(*) AS keys, CAST(sum(hit) AS BIGINT) AS agree, CAST(sum(m) AS BIGINT) AS null_agree FROM pk GROUP BY d)
    SELECT max(keys) AS keys, max(agree) AS agree, CAST(sum(null_agree) AS DOUBLE) / count(*) AS null_mean, count(*) FILTER (WHERE null_agree >= agree) AS as_high, CAST(count(*) FILTER (WHERE null_agree >= agree) + 1 AS DOUBLE) / (count(*) + 1) AS p_value FROM t""",
)
def null_model(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("v"), "l_linenumber", "l_discount")
    return matching.overlap_null_model(rows, rows.where("l_linenumber <= 2"), rows.where("l_discount > 0.06"), "k", "v", 20, 42)


@query(
    "q_book_replay",
    """WITH b AS (SELECT l_suppkey AS book, CAST(round(l_discount * 100) AS BIGINT) AS cost, CAST(sum(l_quantity) AS BIGINT) AS mw FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL), c AS (SELECT *, sum(mw) OVER (PARTITION BY book ORDER BY cost) AS cum FROM b),
    q AS (SELECT l_suppkey AS book, l_orderkey * 10 + l_linenumber AS label, CAST(floor(l_extendedprice) AS BIGINT) % 12000 - 20 AS mw FROM lineitem)
    SELECT q.book, label, CAST(q.mw AS DOUBLE) AS mw, CASE WHEN q.mw > 0 AND count(c.book) > 0 THEN CAST(coalesce(min(cost) FILTER (WHERE cum >= q.mw), 32) AS DOUBLE) END AS price, q.mw > 0 AND count(c.book) > 0 AND coalesce(max(cum), 0) < q.mw AS short FROM q LEFT JOIN c USING (book) GROUP BY q.book, label, q.mw, q""",
)
def book_replay(spark, d):
    """Each supplier's book of new lines cleared at the MW of all its lines."""
    li = table(spark, d, "lineitem")
    blocks = li.where("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("book"), F.round(F.col("l_discount") * 100).cast("long").alias("cost")).agg(F.sum("l_quantity").cast("long").alias("mw"))
    asked = li.select(F.col("l_suppkey").alias("book"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label"), (F.floor("l_extendedprice").cast("long") % 12000 - 20).alias("mw"))
    return stack.replay(stack.running_stack(blocks, ["book"], "cost", "mw", []), asked, ["book"], "cost", "label", "mw")


_DRAWS = """u AS (SELECT s_suppkey AS unit, s_nationkey % 3 AS grid, CAST(floor(abs(s_acctbal)) AS BIGINT) AS mw, 5 + s_suppkey % 10 AS pct FROM supplier),
    l AS (SELECT grid, CAST(sum(mw) * 9 // 10 AS BIGINT) AS mean, CAST(sum(mw) // 20 AS BIGINT) AS sd FROM u GROUP BY grid), dr AS (SELECT unnest(range(1000)) AS draw),
    av AS (SELECT grid, draw, CAST(sum(CASE WHEN ((((draw * 7919 + unit * 104729 + 42) * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648) // 65536 % 100 >= pct THEN mw ELSE 0 END) AS BIGINT) AS up FROM u, dr GROUP BY ALL),
    z AS (SELECT draw, sqrt(-2 * ln(((((draw * 15485863 + 1303) % 2147483648 * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648 // 65536 % 32768 + 1) / 32769.0::DOUBLE)) * cos(((((draw * 15485863 + 1304) % 2147483648 * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648 // 65536 % 32768 + 1) / 32769.0::DOUBLE * 6.283185307179586::DOUBLE) AS z FROM dr),
    sh AS (SELECT grid, draw, greatest(0, CAST(floor(mean + sd * z + 0.5) AS BIGINT) - up) AS short FROM av JOIN l USING (grid) JOIN z USING (draw))"""


def _units(spark, d):
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_nationkey") % 3).alias("grid"), F.floor(F.abs("s_acctbal")).cast("long").alias("mw"), (5 + F.col("s_suppkey") % 10).alias("pct"))
    total = F.sum("mw")
    return u, u.groupBy("grid").agg(F.floor(total * 9 / 10).cast("long").alias("mean"), F.floor(total / 20).cast("long").alias("sd"))


@query(
    "q_noisy_outages",
    f"""WITH {_DRAWS}, o AS (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY short) - 1 AS i, count(*) OVER (PARTITION BY grid) AS n FROM sh)
    SELECT grid, count(*) AS draws, count(*) FILTER (WHERE short > 0) AS short_draws, {r('CAST(sum(short) AS DOUBLE) / count(*)', 3)} AS expected, max(short) AS worst,
    max(short) FILTER (WHERE i = floor(0.5 * (n - 1))) AS p50, max(short) FILTER (WHERE i = floor(0.9 * (n - 1))) AS p90, max(short) FILTER (WHERE i = floor(0.99 * (n - 1))) AS p99 FROM o GROUP BY grid""",
)
def noisy_outages(spark, d):
    units, loads = _units(spark, d)
    return scenario.noisy_outages(units, "grid", "unit", "mw", "pct", loads, 1000, 42)


@query("q_buy_back", f"WITH {_DRAWS} SELECT grid, {r('100.0 * count(*) FILTER (WHERE short > 0) / count(*)')} AS lolp_without, {r('100.0 * count(*) FILTER (WHERE short > 500) / count(*)')} AS lolp_with, {r('CAST(sum(least(short, 500)) AS DOUBLE) / count(*)')} AS bought_back FROM sh GROUP BY grid")
def buy_back(spark, d):
    """What 500 MW of storage buys back of the draws' shortfalls."""
    units, loads = _units(spark, d)
    return scenario.buy_back(scenario.shortfalls(units, "grid", "unit", "mw", "pct", loads, 1000, 42), ["grid"], "short", 500, "draw")


@query(
    "q_availability",
    f"""WITH p AS (SELECT s_suppkey AS plant, CASE s_suppkey % 4 WHEN 0 THEN 'solar' WHEN 1 THEN 'coal' WHEN 2 THEN 'hydro' ELSE 'gas' END AS fuel, s_acctbal AS mw FROM supplier), h AS (SELECT unnest(range(24)) AS hour)
    SELECT plant, CAST(hour AS INTEGER) AS hour, {r("mw * CASE fuel WHEN 'solar' THEN 0.9 * greatest(0.0, 1 - abs(hour - 12) / 6.0) WHEN 'coal' THEN 0.85 WHEN 'hydro' THEN 0.5 ELSE 1.0 END")} AS available FROM p, h WHERE mw > 0""",
)
def availability(spark, d):
    k = F.col("s_suppkey")
    fuel = F.when(k % 4 == 0, "solar").when(k % 4 == 1, "coal").when(k % 4 == 2, "hydro").otherwise("gas")
    plants = table(spark, d, "supplier").select(k.alias("plant"), fuel.alias("fuel"), F.col("s_acctbal").alias("mw")).where("mw > 0")
    return stack.availability(plants, "fuel", "mw", {"solar": 0.9, "coal": 0.85, "hydro": 0.5}, "solar", [max(0.0, 1 - abs(h - 12) / 6.0) for h in range(24)]).select("plant", "hour", half_up(F.col("available")).alias("available"))
