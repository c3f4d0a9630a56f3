"""Coupling of three zones: parts of a number modulo 3 stand for zones, discounts for cost, taxes for observed prices, quarters and line numbers for intervals, suppliers by eights for blocked minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.operators import coupling
from amperline.plans.common import r, table

QUERIES, ORACLE = {}, {}

#: Limits of the two corridors, wheeling cost, MW lost in zone 2, the hour that the sweep looks at.
LIMITS, WHEEL, LOST, HOUR = (250, 450), 1, 935, 4


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


_LINES = """li AS (SELECT 1 + l_partkey % 3 AS zone, CAST(round(l_discount * 100) AS BIGINT) + 1 + l_partkey % 3 AS price, CAST(l_quantity AS BIGINT) AS mw, CAST(round(l_tax * 100) AS BIGINT) + CASE l_partkey % 3 WHEN 1 THEN 4 ELSE 1 END AS seen, l_suppkey,
    CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter, l_linenumber AS hour FROM lineitem)"""


def _demand_sql(keys: str) -> str:
    return f"SELECT {keys}, zone, CAST(floor(sum(mw) * (CASE zone WHEN 1 THEN 4 WHEN 2 THEN 9 ELSE 6 END) / 10.0) AS BIGINT) AS d FROM b0 GROUP BY {keys}, zone"


def _flows_sql(k: str) -> str:
    """CTE w (keys, c1, c2, f1, f2): the cheapest flows, from all crossings of break lines of b, dm and caps."""
    return f"""ok AS (SELECT {k} FROM b GROUP BY {k} HAVING count(DISTINCT zone) = 3), cu AS (SELECT {k}, zone, price, mw, CAST(sum(mw) OVER (PARTITION BY {k}, zone ORDER BY price) AS BIGINT) AS cum FROM b JOIN ok USING ({k})),
    st AS (SELECT {k}, zone, cum FROM cu UNION SELECT {k}, zone, 0 FROM cu), cz AS (SELECT {k}, c1, c2 FROM caps JOIN ok USING ({k})),
    fa AS (SELECT {k}, cum - d AS f1 FROM st JOIN dm USING ({k}, zone) WHERE zone = 1 UNION SELECT {k}, unnest([0, c1, -c1]) FROM cz), fb AS (SELECT {k}, d - cum AS f2 FROM st JOIN dm USING ({k}, zone) WHERE zone = 3 UNION SELECT {k}, unnest([0, c2, -c2]) FROM cz),
    fd AS (SELECT {k}, cum - d AS w FROM st JOIN dm USING ({k}, zone) WHERE zone = 2),
    f AS (SELECT {k}, f1, f2 FROM fa JOIN fb USING ({k}) UNION SELECT {k}, f1, f1 + w FROM fa JOIN fd USING ({k}) UNION SELECT {k}, f2 - w, f2 FROM fb JOIN fd USING ({k})),
    g AS (SELECT {k}, f1, f2, zone, d + CASE zone WHEN 1 THEN f1 WHEN 2 THEN f2 - f1 ELSE -f2 END AS need FROM f JOIN cz USING ({k}) JOIN dm USING ({k}) WHERE abs(f1) <= c1 AND abs(f2) <= c2),
    kk AS (SELECT {k}, f1, f2, zone, any_value(need) AS need, sum(greatest(0, least(mw, need - (cum - mw))) * price) + greatest(0, any_value(need) - sum(mw)) * 3200 AS cost FROM g JOIN cu USING ({k}, zone) GROUP BY {k}, f1, f2, zone),
    t AS (SELECT {k}, f1, f2, sum(cost) + {WHEEL} * (abs(f1) + abs(f2)) AS cost FROM kk GROUP BY {k}, f1, f2 HAVING min(need) >= 0),
    w AS (SELECT {k}, c1, c2, f1, f2 FROM t JOIN cz USING ({k}) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY cost, abs(f1) + abs(f2), f1, f2) = 1)"""


_K = "scenario, year, quarter, hour"
_REPORT = f"""{_LINES}, b0 AS (SELECT year, quarter, hour, zone, price, CAST(sum(mw) AS BIGINT) AS mw FROM li GROUP BY ALL), dq AS ({_demand_sql('year, quarter, hour')}), sc(scenario) AS (VALUES ('base'), ('open'), ('outage')),
    dm AS (SELECT * FROM sc CROSS JOIN dq), cd AS (SELECT *, sum(mw) OVER (PARTITION BY year, quarter, hour, zone, price <= 8 ORDER BY price DESC) AS dear FROM b0),
    b AS (SELECT * FROM (SELECT {_K}, zone, price, CAST(CASE WHEN scenario = 'outage' AND zone = 2 AND price <= 8 THEN greatest(0, least(mw, dear - {LOST})) ELSE mw END AS BIGINT) AS mw FROM sc CROSS JOIN cd) WHERE mw > 0),
    caps AS (SELECT {_K}, CAST(CASE WHEN scenario = 'open' THEN 1000000 ELSE floor({LIMITS[0]} * open / n) END AS BIGINT) AS c1, CAST(CASE WHEN scenario = 'open' THEN 1000000 ELSE {LIMITS[1]} END AS BIGINT) AS c2
        FROM sc CROSS JOIN (SELECT year, quarter, hour, count(*) FILTER (WHERE l_suppkey % 8 <> 0) AS open, count(*)::DOUBLE AS n FROM li GROUP BY ALL)), {_flows_sql(_K)},
    pz AS (SELECT {_K}, zone, c1, c2, f1, f2, coalesce(min(price) FILTER (WHERE cum >= d + CASE zone WHEN 1 THEN f1 WHEN 2 THEN f2 - f1 ELSE -f2 END), 3200) AS p FROM w JOIN dm USING ({_K}) JOIN cu USING ({_K}, zone) GROUP BY ALL)"""
_CORRIDORS = f"""pv AS (SELECT {_K}, c1, c2, f1, f2, max(p) FILTER (WHERE zone = 1) AS p1, max(p) FILTER (WHERE zone = 2) AS p2, max(p) FILTER (WHERE zone = 3) AS p3 FROM pz GROUP BY ALL),
    co AS (SELECT scenario, 1 AS corridor, {LIMITS[0]} AS fixed, c1 AS cap, f1 AS f, p2 - p1 AS gap FROM pv UNION ALL SELECT scenario, 2, {LIMITS[1]}, c2, f2, p3 - p2 FROM pv),
    cs AS (SELECT *, cap > 0.5 AND abs(f) >= cap - 0.5 AS sat FROM co)"""


def _lines(spark, d):
    zone = 1 + F.col("l_partkey") % 3
    return table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), F.col("l_linenumber").alias("hour"), zone.alias("zone"), (F.round(F.col("l_discount") * 100).cast("long") + zone).alias("price"),
        F.col("l_quantity").cast("long").alias("mw"), (F.round(F.col("l_tax") * 100).cast("long") + F.when(zone == 2, 4).otherwise(1)).alias("seen"), (F.col("l_suppkey") % 8 != 0).alias("open"),
    )


def _demand(blocks, keys):
    share = F.when(F.col("zone") == 1, 4).when(F.col("zone") == 2, 9).otherwise(6)
    return blocks.groupBy(*keys, "zone").agg(F.sum("mw").alias("all")).select(*keys, "zone", F.floor(F.col("all") * share / 10.0).cast("long").alias("d"))


def _report(spark, d):
    """Base, open corridors and an outage in zone 2, cleared in one pass over all intervals."""
    at = ["year", "quarter", "hour"]
    lines = _lines(spark, d)
    blocks = lines.groupBy(*at, "zone", "price").agg(F.sum("mw").alias("mw"))
    demand = _demand(blocks, at)
    limits = lines.groupBy(*at).agg(F.floor(LIMITS[0] * F.count_if("open") / F.count("*").cast("double")).cast("long").alias("c1"))
    hit = (F.col("zone") == 2) & (F.col("price") <= 8)
    out = coupling.outage(blocks, [*at, "zone"], "price", "mw", hit, LOST)
    each = F.explode(F.array(F.lit("base"), F.lit("open")))
    rows = blocks.withColumn("scenario", each).unionByName(out.withColumn("scenario", F.lit("outage")))
    keys = ["scenario", *at]
    wanted = demand.withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("open"), F.lit("outage"))))
    free = F.col("scenario") == "open"
    cleared = coupling.zones(rows, keys, "zone", "price", "mw", wanted).join(limits, at).withColumns({"c1": F.when(free, coupling.OPEN).otherwise(F.col("c1")).cast("long"), "c2": F.when(free, coupling.OPEN).otherwise(LIMITS[1]).cast("long")})
    return coupling.priced(cleared, keys, "c1", "c2", WHEEL), lines, keys


@query(
    "q_corridor_rents",
    f"""WITH {_REPORT}, {_CORRIDORS} SELECT scenario, corridor, count(*) AS n, count(*) FILTER (WHERE cap < fixed) AS capped, {r('100.0 * count(*) FILTER (WHERE sat) / count(*)', 1)} AS saturated_pct,
    coalesce({r('CAST(sum(CASE WHEN f > 0 THEN gap ELSE -gap END) FILTER (WHERE sat) AS DOUBLE) / nullif(count(*) FILTER (WHERE sat), 0)', 3)}, 0.0) AS mean_rent, {r('CAST(sum(abs(f)) AS DOUBLE) / count(*)', 1)} AS mean_flow, max(abs(f)) AS peak_flow, {r('CAST(sum(cap) AS DOUBLE) / count(*)', 1)} AS mean_cap FROM cs GROUP BY scenario, corridor""",
)
def corridor_rents(spark, d):
    """How often each corridor is full and what it costs then: as limited, without limits, with an outage."""
    report, _, _ = _report(spark, d)
    return coupling.rents(report, ["scenario"], LIMITS, "c1", "c2")


@query(
    "q_coupling_spreads",
    f"""WITH {_REPORT}, ob AS (SELECT year, quarter, hour, zone, CAST(floor(sum(seen) / count(*)::DOUBLE) AS BIGINT) AS o FROM li GROUP BY ALL),
    x AS (SELECT pz.scenario, pz.zone, o, p, o - first_value(o) OVER z AS so, p - first_value(p) OVER z AS sp FROM pz JOIN ob USING (year, quarter, hour, zone) WINDOW z AS (PARTITION BY pz.scenario, year, quarter, hour ORDER BY zone)),
    y AS (SELECT scenario, CAST(zone AS INTEGER) AS zone, count(*) AS n, {r('CAST(sum(o) AS DOUBLE) / count(*)', 3)} AS observed, {r('CAST(sum(p) AS DOUBLE) / count(*)', 3)} AS modelled, {r('CAST(sum(so) AS DOUBLE) / count(*)', 3)} AS observed_spread, {r('CAST(sum(sp) AS DOUBLE) / count(*)', 3)} AS modelled_spread, {r('CAST(sum(abs(p - o)) AS DOUBLE) / count(*)', 3)} AS mae FROM x GROUP BY scenario, zone)
    SELECT *, {r('modelled_spread / nullif(observed_spread, 0)', 3)} AS explained FROM y""",
)
def coupling_spreads(spark, d):
    """How much of the observed spread between zones the limits explain, in each scenario."""
    report, lines, keys = _report(spark, d)
    seen = lines.groupBy("year", "quarter", "hour").agg(*(F.floor(F.sum(F.when(F.col("zone") == i, F.col("seen"))) / F.count_if(F.col("zone") == i).cast("double")).cast("long").alias(f"o{i}") for i in (1, 2, 3)))
    return coupling.spreads(report, keys, ["scenario"], seen)


@query(
    "q_binding_threshold",
    f"""WITH {_LINES}, bb AS (SELECT year, zone, price, CAST(sum(mw) AS BIGINT) AS mw FROM li WHERE hour = {HOUR} GROUP BY ALL), b0 AS (SELECT * FROM bb), dy AS ({_demand_sql('year')}), ad AS (SELECT unnest(range(0, 3001, 25)) AS add),
    dm AS (SELECT year, add, zone, d + CASE WHEN zone = 2 THEN add ELSE 0 END AS d FROM dy CROSS JOIN ad), b AS (SELECT year, add, zone, price, mw FROM bb CROSS JOIN ad), caps AS (SELECT DISTINCT year, add, CAST({LIMITS[0]} AS BIGINT) AS c1, CAST({LIMITS[1]} AS BIGINT) AS c2 FROM b), {_flows_sql('year, add')}
    SELECT year, CAST(any_value(d) AS BIGINT) AS base, min(add) FILTER (WHERE abs(f1) >= c1 - 0.5) AS binds_at FROM w JOIN (SELECT year, d FROM dy WHERE zone = 2) USING (year) GROUP BY year""",
)
def binding_threshold(spark, d):
    """The load that zone 2 may gain at the reference hour before its corridor binds, by year."""
    blocks = _lines(spark, d).where(F.col("hour") == HOUR).groupBy("year", "zone", "price").agg(F.sum("mw").alias("mw"))
    cleared = coupling.zones(blocks, ["year"], "zone", "price", "mw", _demand(blocks, ["year"])).withColumns({"c1": F.lit(LIMITS[0]).cast("long"), "c2": F.lit(LIMITS[1]).cast("long")})
    return coupling.binding_threshold(cleared, ["year"], 0, 3000, 25, "c1", "c2", WHEEL)
