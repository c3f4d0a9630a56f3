"""Daily layers over the driver's tables: order lines as intervals and offers, events as advisories, file names from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, money
from amperline.operators import layers
from amperline.plans.common import EVENTS, dsum, intervals, mean, r, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


_INTERVALS = "iv AS (SELECT l_partkey % 6 AS day, l_suppkey % 3 AS grid, l_orderkey % 24 AS hour, l_quantity - 2 AS gen, l_discount * 100 AS imp, l_tax * 100 AS exp, CAST(l_linenumber - 3 AS DOUBLE) AS cur FROM lineitem)"
_D = "CAST({x} AS DECIMAL(18,4))"
_PROFILES = f"""{_INTERVALS}, pr AS (SELECT day, grid, hour, {r(f"CAST(sum({_D.format(x='gen')} + ({_D.format(x='imp')} - {_D.format(x='exp')}) + greatest({_D.format(x='cur')}, 0)) AS DOUBLE) / count(*)", 1)} AS demand,
    {r(f"CAST(sum({_D.format(x='imp')} - {_D.format(x='exp')}) AS DOUBLE) / count(*)", 1)} AS net_import FROM iv WHERE gen > 0 GROUP BY ALL), wh AS (SELECT day FROM pr GROUP BY day HAVING count(*) = 72), pf AS (SELECT * FROM pr WHERE day IN (SELECT day FROM wh))"""


def _profiles(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select((c("l_partkey") % 6).alias("day"), (c("l_suppkey") % 3).alias("grid"), (c("l_orderkey") % 24).alias("hour"), (c("l_quantity") - 2).alias("gen"), (c("l_discount") * 100).alias("imp"), (c("l_tax") * 100).alias("exp"), (c("l_linenumber") - 3).cast("double").alias("cur"))
    return layers.load_profiles(rows, "day", "grid", "hour", 3)


@query("q_load_profiles", f"WITH {_PROFILES} SELECT * FROM pf")
def load_profiles(spark, d):
    return _profiles(spark, d)


@query("q_chain_flows", f"WITH {_PROFILES} SELECT day, hour, -max(net_import) FILTER (WHERE grid = 0) AS out_of_first, max(net_import) FILTER (WHERE grid = 2) AS into_last, {r(dsum('net_import'), 1)} AS imbalance FROM pf GROUP BY day, hour")
def chain_flows(spark, d):
    return layers.chain_flows(_profiles(spark, d), "day", "grid", "hour", 0, 2)


_OFFERS = """rg AS (SELECT s_suppkey % 10 AS day, s_nationkey % 3 AS grid, s_nationkey % 4 AS commodity, s_acctbal * 3 AS mw FROM supplier), bk AS (SELECT l_suppkey % 10 AS day, l_suppkey % 3 AS grid, l_partkey % 4 AS commodity, l_orderkey % 24 AS hour, l_quantity AS mw FROM lineitem),
    ou AS (SELECT c_custkey % 10 AS day, c_custkey % 3 AS grid, CAST(c_custkey % 40 AS DOUBLE) AS mw FROM customer WHERE c_custkey % 10 <> 3)"""


def _not_offered_sql(keys: str, out: str) -> str:
    return f"""{_OFFERS}, rs AS (SELECT day, {keys}, sum(CAST(mw AS DECIMAL(18,4))) AS registered FROM rg GROUP BY ALL), bh AS (SELECT day, {keys}, hour, sum(CAST(mw AS DECIMAL(18,4))) AS mw FROM bk GROUP BY ALL), bm AS (SELECT day, {keys}, max(mw) AS book_max FROM bh GROUP BY ALL),
    os AS (SELECT day, {keys}, {out} AS gone FROM {'ou GROUP BY ALL' if 'sum' in out else 'rs'}), no AS (SELECT day, {keys}, {r('CAST(registered AS DOUBLE)', 1)} AS registered, {r('CAST(book_max AS DOUBLE)', 1)} AS book_max, {r('CAST(coalesce(gone, 0) AS DOUBLE)', 1)} AS "out",
    {r('CAST(greatest(registered - book_max - coalesce(gone, 0), 0) AS DOUBLE)', 1)} AS not_offered FROM rs JOIN bm USING (day, {keys}) LEFT JOIN os USING (day, {keys}))"""


def _stats_sql(keys: str) -> str:
    return f"SELECT {keys}, CAST(count(*) AS INTEGER) AS days, list_sort(list(not_offered))[count(*) // 2 + 1] AS median_upper, max(not_offered) AS most, {r(f'100 * list_sort(list(not_offered))[count(*) // 2 + 1] / nullif({mean('registered')}, 0)', 1)} AS share FROM no GROUP BY {keys}"


def _offers(spark, d):
    c = F.col
    reg = table(spark, d, "supplier").select((c("s_suppkey") % 10).alias("day"), (c("s_nationkey") % 3).alias("grid"), (c("s_nationkey") % 4).alias("commodity"), (c("s_acctbal") * 3).alias("mw"))
    books = table(spark, d, "lineitem").select((c("l_suppkey") % 10).alias("day"), (c("l_suppkey") % 3).alias("grid"), (c("l_partkey") % 4).alias("commodity"), (c("l_orderkey") % 24).alias("hour"), c("l_quantity").alias("mw"))
    out = table(spark, d, "customer").where("c_custkey % 10 <> 3").select((c("c_custkey") % 10).alias("day"), (c("c_custkey") % 3).alias("grid"), (c("c_custkey") % 40).cast("double").alias("mw"))
    return reg, books, out


@query("q_not_offered", f"WITH {_not_offered_sql('grid', 'sum(CAST(mw AS DECIMAL(18,4)))')} SELECT * FROM no")
def not_offered(spark, d):
    reg, books, out = _offers(spark, d)
    return layers.not_offered(reg, books, out, "day", ["grid"], "hour")


@query("q_not_offered_stats", f"WITH {_not_offered_sql('grid', 'sum(CAST(mw AS DECIMAL(18,4)))')} {_stats_sql('grid')}")
def not_offered_stats(spark, d):
    return layers.not_offered_stats(not_offered(spark, d), ["grid"])


@query("q_reserve_registration", f"WITH {_not_offered_sql('grid, commodity', 'NULL')} SELECT day, grid, commodity, registered, book_max, not_offered FROM no")
def reserve_registration(spark, d):
    """Registered reserve against the reserve book."""
    reg, books, _ = _offers(spark, d)
    return layers.not_offered(reg, books, None, "day", ["grid", "commodity"], "hour").drop("out")


_PASA = """pa AS (SELECT DISTINCT o_orderdate AS day, lpad(CAST(o_custkey % 15 AS VARCHAR), 2, '0') || 'P' || o_custkey % 9 || CASE WHEN o_custkey % 2 = 0 THEN 'X' ELSE '' END || '_U' || o_custkey % 3 AS res, o_custkey % 3 AS u, o_custkey % 9 AS plant, o_custkey % 2 AS two FROM orders),
    pm AS (SELECT *, CASE WHEN plant < 6 THEN 'verified' WHEN plant = 6 THEN 'storage' ELSE 'unmatched' END AS match, CASE WHEN plant = 5 THEN NULL ELSE plant % 3 END AS grid, plant % 2 AS fuel, 50.5 + plant AS mw FROM pa)"""


def _pasa(spark, d):
    k = F.col("o_custkey")
    code = F.concat(F.lpad((k % 15).cast("string"), 2, "0"), F.lit("P"), (k % 9).cast("string"), F.when(k % 2 == 0, "X").otherwise(""), F.lit("_U"), (k % 3).cast("string"))
    plant = k % 9
    rows = table(spark, d, "orders").select(F.col("o_orderdate").alias("day"), code.alias("res"), plant.alias("plant"), F.when(plant < 6, "verified").when(plant == 6, "storage").otherwise("unmatched").alias("match"), F.when(plant != 5, plant % 3).alias("grid"), (plant % 2).alias("fuel"), (50.5 + plant).alias("mw"))
    return layers.outages_by_day(rows, "day", "res", "match", "grid", "fuel", "plant", "mw")


@query("q_outage_mw", f"WITH {_PASA}, x AS (SELECT *, row_number() OVER (PARTITION BY day, plant, u ORDER BY res) AS i FROM pm WHERE match = 'verified' AND grid IS NOT NULL) SELECT day, grid, fuel, {r(dsum('mw'), 1)} AS mw FROM x WHERE i = 1 GROUP BY ALL")
def outage_mw(spark, d):
    return _pasa(spark, d)[0]


@query("q_outage_counts", f"WITH {_PASA} SELECT day, count(DISTINCT res) AS n_out, count(DISTINCT res) FILTER (WHERE match = 'unmatched') AS n_unmatched FROM pm GROUP BY day")
def outage_counts(spark, d):
    return _pasa(spark, d)[1]


_RESERVE = f"""bo AS (SELECT l_suppkey AS day, l_partkey % 3 AS grid, l_orderkey % 24 AS hour, CAST(round(l_discount * 100) AS BIGINT) AS cost, CAST(sum(l_quantity) AS BIGINT) AS mw FROM lineitem GROUP BY ALL), cu AS (SELECT *, sum(mw) OVER (PARTITION BY day, grid, hour ORDER BY cost) AS cum FROM bo),
    sc AS (SELECT day, grid, hour, CAST((day * 7 + hour * 13 + grid) % 90 - 5 AS DOUBLE) AS mw, CASE WHEN hour % 4 <> 0 THEN CAST((day * 7 + hour * 11 + grid) % 60 AS DOUBLE) END AS required FROM (SELECT DISTINCT day, grid, hour FROM bo)),
    ob AS (SELECT day, grid, hour, CAST((day + hour * 3 + grid) % 10 AS DOUBLE) AS observed FROM sc WHERE (day + hour) % 5 <> 0),
    rp AS (SELECT sc.day, sc.grid, sc.hour, sc.mw AS scheduled, CAST(coalesce(min(cost) FILTER (WHERE cum >= sc.mw), 32) AS DOUBLE) AS modeled, any_value(observed) AS observed, max(cum) < sc.mw AS short, coalesce(sc.mw < any_value(sc.required) - 0.1, false) AS scarce FROM sc JOIN cu USING (day, grid, hour) JOIN ob USING (day, grid, hour) WHERE sc.mw > 0 GROUP BY sc.day, sc.grid, sc.hour, sc.mw)"""


def _reserve(spark, d):
    c = F.col
    books = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("day"), (c("l_partkey") % 3).alias("grid"), (c("l_orderkey") % 24).alias("hour"), F.round(c("l_discount") * 100).cast("long").alias("cost")).agg(F.sum("l_quantity").cast("long").alias("mw"))
    keys = books.select("day", "grid", "hour").distinct()
    schedules = keys.select("*", ((c("day") * 7 + c("hour") * 13 + c("grid")) % 90 - 5).cast("double").alias("mw"), F.when(c("hour") % 4 != 0, ((c("day") * 7 + c("hour") * 11 + c("grid")) % 60).cast("double")).alias("required"))
    prices = keys.where("(day + hour) % 5 <> 0").select("*", ((c("day") + c("hour") * 3 + c("grid")) % 10).cast("double").alias("price"))
    return layers.reserve_pairs(books, schedules, prices, ["day", "grid", "hour"], "cost", "mw")


@query("q_reserve_pairs", f"WITH {_RESERVE} SELECT * FROM rp")
def reserve_pairs(spark, d):
    return _reserve(spark, d)


_SCORES = f"""{_RESERVE}, ps AS (SELECT grid, count(*) AS n, {r(mean('observed'), 3)} AS observed, {r(mean('modeled'), 3)} AS modeled, {r(mean('abs(modeled - observed)'), 3)} AS mae, {r(mean('modeled - observed'), 3)} AS bias, count(*) FILTER (WHERE NOT scarce) AS calm,
    {r(mean('CASE WHEN NOT scarce THEN abs(modeled - observed) END'), 3)} AS calm_mae, count(*) FILTER (WHERE modeled > observed) AS over, count(*) FILTER (WHERE short) AS short FROM rp GROUP BY grid)"""


@query("q_reserve_pools", f'WITH {_SCORES} SELECT grid, n, observed, modeled, mae, bias, calm, calm_mae, "over", short FROM ps')
def reserve_pools(spark, d):
    return layers.pool_scores(_reserve(spark, d), ["grid"])


@query("q_reserve_aware", f"WITH {_SCORES}, en AS (SELECT s_nationkey % 4 AS grid, {r(mean('s_acctbal'), 3)} AS energy FROM supplier GROUP BY 1) SELECT grid, energy, modeled AS reserve_clear, {r('observed - modeled', 3)} AS wedge, observed AS reserve_total, {r('energy + observed', 3)} AS total FROM ps LEFT JOIN en USING (grid)")
def reserve_aware(spark, d):
    energy = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 4).alias("grid")).agg(half_up(exact_mean(money("s_acctbal")), 3).alias("price"))
    return layers.reserve_aware(reserve_pools(spark, d), "grid", energy)


_TEXTS = f"""{EVENTS}, ad AS (SELECT event_id, day, CASE event_id % 6 WHEN 0 THEN 'Luzon YELLOW  alert raised' WHEN 1 THEN 'HVDC link blocked' WHEN 2 THEN '  ' WHEN 3 THEN 'red Alert and hvdc trip' ELSE 'unit ' || equipment || ' tripped' END AS text FROM e),
    af AS (SELECT event_id, day, event_id % 6 IN (1, 3) AS hvdc, CASE event_id % 6 WHEN 0 THEN 'yellow' WHEN 3 THEN 'red' END AS level FROM ad WHERE trim(text) <> '')"""


def _advisories(spark, d):
    k = F.col("event_id")
    text = F.when(k % 6 == 0, "Luzon YELLOW  alert raised").when(k % 6 == 1, "HVDC link blocked").when(k % 6 == 2, "  ").when(k % 6 == 3, "red Alert and hvdc trip").otherwise(F.concat(F.lit("unit "), F.col("equipment").cast("string"), F.lit(" tripped")))
    return layers.advisories(intervals(spark, d).select("event_id", "day", text.alias("text")), "day", "event_id", "text", 400)


_COUNTS = "ac AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE hvdc) AS n_hvdc, count(level) AS n_alert FROM af GROUP BY day)"


@query("q_advisory_counts", f"WITH {_TEXTS}, {_COUNTS} SELECT * FROM ac")
def advisory_counts(spark, d):
    return _advisories(spark, d)[0]


@query("q_advisory_events", f"WITH {_TEXTS}, k AS (SELECT 'hvdc' AS kind, day, event_id, NULL AS level FROM af WHERE hvdc UNION ALL SELECT 'alert', day, event_id, level FROM af WHERE level IS NOT NULL) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY day, event_id) <= 400")
def advisory_events(spark, d):
    return _advisories(spark, d)[1]


@query(
    "q_drivers",
    f"""WITH {_TEXTS}, {_COUNTS}, pr AS (SELECT day, {r(mean('value'))} AS price FROM e GROUP BY day), cu AS (SELECT day, {r(dsum('value'), 1)} AS curtailed FROM e WHERE grid = 'error' AND value > 60 GROUP BY day),
    bn AS (SELECT day, equipment, count(*) AS n FROM e WHERE grid = 'view' GROUP BY ALL), bt AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, equipment) AS i FROM bn), bd AS (SELECT day, CAST(sum(n) AS BIGINT) AS binding_rows, string_agg(CAST(equipment AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 3) AS top FROM bt GROUP BY day)
    SELECT pr.day, price, curtailed, n, n_hvdc, n_alert, binding_rows, top FROM pr LEFT JOIN cu USING (day) LEFT JOIN ac USING (day) LEFT JOIN bd USING (day)""",
)
def drivers(spark, d):
    """What moved prices, one row a day."""
    e = intervals(spark, d)
    prices = e.groupBy("day").agg(half_up(exact_mean(money("value"))).alias("price"))
    curtailed = e.where("grid = 'error' AND value > 60").groupBy("day").agg(half_up(F.sum(money("value")).cast("double"), 1).alias("curtailed"))
    return layers.drivers(prices, "day", [curtailed, advisory_counts(spark, d), layers.binding_by_day(e.where("grid = 'view'"), "day", "equipment")])


_FILES = """fl AS (SELECT 'K' || o_custkey % 12 AS key, 'K_' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 3 = 0 THEN '-' || strftime(o_orderdate + INTERVAL 6 DAY, '%Y%m%d') ELSE '' END || '_' || o_orderkey || '.csv' AS name, o_orderkey % 900 AS bytes, o_orderdate AS dt, o_orderkey FROM orders)"""


def _files(spark, d):
    k = F.col("o_orderkey")
    ymd = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.concat(F.lit("K_"), ymd("o_orderdate"), F.when(k % 3 == 0, F.concat(F.lit("-"), ymd(F.col("o_orderdate") + F.expr("INTERVAL 6 DAY")))).otherwise(""), F.lit("_"), k.cast("string"), F.lit(".csv"))
    return table(spark, d, "orders").select(F.concat(F.lit("K"), (F.col("o_custkey") % 12).cast("string")).alias("key"), name.alias("name"), (k % 900).alias("bytes"), k.alias("k"))


_MANIFEST = f"{_FILES}, mf AS (SELECT key, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, min(least(CASE WHEN dt >= DATE '2000-01-01' THEN strftime(dt, '%Y%m%d') END, CASE WHEN o_orderkey % 3 = 0 AND dt >= DATE '1999-12-26' THEN strftime(dt + INTERVAL 6 DAY, '%Y%m%d') END)) AS oldest, max(CASE WHEN o_orderkey % 3 = 0 AND dt >= DATE '1999-12-26' THEN strftime(dt + INTERVAL 6 DAY, '%Y%m%d') WHEN dt >= DATE '2000-01-01' THEN strftime(dt, '%Y%m%d') END) AS newest FROM fl GROUP BY key)"


@query("q_manifest", f"WITH {_MANIFEST} SELECT * FROM mf")
def manifest(spark, d):
    return layers.manifest(_files(spark, d))


@query(
    "q_staleness",
    f"""WITH {_MANIFEST}, ks AS (SELECT DISTINCT 'K' || s_nationkey AS key, CASE s_nationkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 45 WHEN 2 THEN 3 END AS budget FROM supplier), td AS (SELECT CAST(max(o_orderdate) AS DATE) + 10 AS today FROM orders)
    SELECT key, CAST(today - CAST(strptime(newest, '%Y%m%d') AS DATE) AS INTEGER) AS age, coalesce(budget, 4) AS budget, CASE WHEN newest IS NULL THEN 'missing' WHEN today - CAST(strptime(newest, '%Y%m%d') AS DATE) > coalesce(budget, 4) THEN 'stale' ELSE 'ok' END AS status FROM ks LEFT JOIN mf USING (key), td WHERE coalesce(budget, 4) >= 0""",
)
def staleness(spark, d):
    """Ages of data sets against their budgets; `today` is ten days after the last order."""
    n = F.col("s_nationkey")
    keys = table(spark, d, "supplier").select(F.concat(F.lit("K"), n.cast("string")).alias("key"), F.when(n % 4 == 0, -1).when(n % 4 == 1, 45).when(n % 4 == 2, 3).alias("budget")).distinct()
    today = table(spark, d, "orders").agg(F.date_add(F.max("o_orderdate").cast("date"), 10)).first()[0]
    return layers.staleness(keys, manifest(spark, d), F.lit(today), 4)


@query(
    "q_wanted_files",
    f"""WITH {_FILES}, dk AS (SELECT key, name, bytes FROM fl WHERE dt < (SELECT max(o_orderdate) FROM orders) - INTERVAL 200 DAY AND key <> 'K7' AND o_orderkey % 2 = 0), nd AS (SELECT key, max(substr(name, 3, 8)) AS disk FROM dk GROUP BY key), nl AS (SELECT key, max(substr(name, 3, 8)) AS top FROM fl GROUP BY key),
    td AS (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders), w AS (SELECT fl.*, disk, top, today, CASE WHEN key IN ('K1', 'K5') THEN 'sample' WHEN key = 'K2' THEN 'revision' END AS kind FROM fl LEFT JOIN nd USING (key) JOIN nl USING (key), td)
    SELECT key, name FROM w WHERE CASE WHEN kind = 'sample' THEN CAST(strptime(top, '%Y%m%d') AS DATE) - CAST(dt AS DATE) < 30 WHEN kind = 'revision' THEN true WHEN disk IS NOT NULL THEN substr(name, 3, 8) > disk ELSE today - CAST(dt AS DATE) BETWEEN 0 AND 1 END
    AND NOT EXISTS (SELECT 1 FROM dk WHERE dk.key = w.key AND dk.name = w.name AND dk.bytes > 0)""",
)
def wanted_files(spark, d):
    """Orders as listed files, of which the older half is on disk."""
    listing = _files(spark, d)
    last = table(spark, d, "orders").agg(F.max("o_orderdate").cast("date")).first()[0]
    old = F.to_date(F.substring("name", 3, 8), "yyyyMMdd") < F.date_sub(F.lit(last), 200)
    on_disk = listing.where(old & (F.col("key") != "K7") & (F.col("k") % 2 == 0)).select("key", "name", "bytes")
    kinds = listing.select("key").distinct().withColumn("kind", F.when(F.col("key").isin("K1", "K5"), "sample").when(F.col("key") == "K2", "revision"))
    return layers.wanted_files(listing.select("key", "name"), on_disk, kinds, 30, F.lit(last))


@query(
    "q_solar_wind",
    f"""WITH x AS (SELECT l_shipdate AS day, CASE WHEN l_partkey % 3 = 0 THEN 'solar' ELSE 'wind' END AS fuel, l_suppkey % 3 AS grid, l_quantity AS mwh FROM lineitem WHERE l_partkey % 3 <> 2), dd AS (SELECT day, fuel, grid, sum(CAST(mwh AS DECIMAL(18,4))) AS mwh FROM x GROUP BY ALL),
    ob AS (SELECT fuel, grid, count(*) AS days, {r('CAST(sum(mwh) AS DOUBLE) / count(*)', 1)} AS observed FROM dd GROUP BY ALL), mo AS (SELECT 'solar' AS fuel, s_nationkey % 3 AS grid, {r('CAST(sum(CAST(s_acctbal AS DECIMAL(18,4))) AS DOUBLE) / 100', 1)} AS modeled FROM supplier GROUP BY ALL)
    SELECT fuel, grid, days, observed, modeled, {r('observed / nullif(modeled, 0)', 3)} AS ratio FROM ob LEFT JOIN mo USING (fuel, grid)""",
)
def solar_wind(spark, d):
    """Observed daily energy of solar and wind beside the solar that a model credits."""
    c = F.col
    x = table(spark, d, "lineitem").where("l_partkey % 3 <> 2").select(c("l_shipdate").alias("day"), F.when(c("l_partkey") % 3 == 0, "solar").otherwise("wind").alias("fuel"), (c("l_suppkey") % 3).alias("grid"), c("l_quantity").alias("mwh"))
    model = table(spark, d, "supplier").groupBy(F.lit("solar").alias("fuel"), (c("s_nationkey") % 3).alias("grid")).agg(half_up(F.sum(money("s_acctbal")).cast("double") / 100, 1).alias("mwh"))
    return layers.against_model(x, "day", ["fuel", "grid"], "mwh", model)
