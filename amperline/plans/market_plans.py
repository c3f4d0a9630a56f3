"""Windows, scores, stacks, joins, networks and scenarios over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.functions.numeric import half_up
from amperline.operators import graph, joins, scenario, stack, valuation
from amperline.operators import windows as win
from amperline.plans.common import EVENTS, dsum, intervals, mean, r, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _hours(spark, d):
    """Every hour from the first to the last of the table for each grid with the sum of its values."""
    e = intervals(spark, d)
    own = e.groupBy("grid", F.unix_seconds(F.col("hour_ts").cast("timestamp")).alias("epoch")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    grids = e.select("grid").distinct()
    span = own.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi")).where("lo IS NOT NULL")
    slots = grids.join(F.broadcast(span), how="cross").select("grid", F.explode(F.sequence("lo", "hi", F.lit(3600).cast("long"))).alias("epoch"))  # one row of limits
    return slots.join(own, ["grid", "epoch"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


_HOURS = f"""{EVENTS}, own AS (SELECT grid, CAST(epoch(hour_ts) AS BIGINT) AS epoch, {dsum('value')} AS value FROM e GROUP BY ALL),
    h AS (SELECT g.grid, s.epoch, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT grid FROM e) g CROSS JOIN (SELECT unnest(range(1704067200, 1704067200 + 30 * 86400, 3600)) AS epoch) s LEFT JOIN own USING (grid, epoch))"""


@query(
    "q_rolling_72h",
    f"""WITH {_HOURS}, w AS (SELECT grid, epoch, {r('CAST(sum(CAST(value AS DECIMAL(18,4))) OVER x AS DOUBLE) / CAST(count(*) OVER x AS DOUBLE)')} AS m, count(*) OVER x AS n FROM h
    WINDOW x AS (PARTITION BY grid ORDER BY epoch RANGE BETWEEN 259199 PRECEDING AND CURRENT ROW))
    SELECT grid, count(*) AS windows, count(*) FILTER (WHERE m > 80) AS breaches, max(m) AS max_mean, arg_min(epoch, (-m, epoch)) AS max_at FROM w WHERE n = 72 GROUP BY grid""",
)
def rolling_72h(spark, d):
    return win.rolling_trigger(_hours(spark, d), ["grid"], "epoch", "value", 72 * 3600, 72, 80.0)


_WINDOWS = f"""{EVENTS}, k AS (SELECT equipment, ts, event_id, CASE grid WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 END AS k FROM e WHERE grid IN ('error', 'purchase')),
    t AS (SELECT *, lag(k) OVER (PARTITION BY equipment ORDER BY ts, event_id) AS b FROM k), u AS (SELECT *, lead(ts) OVER (PARTITION BY equipment ORDER BY ts, event_id) AS until FROM t WHERE b IS NULL OR b <> k),
    w AS (SELECT equipment, ts AS "start", coalesce(until, ts + INTERVAL 1 HOUR) AS "end", until IS NULL AS "open" FROM u WHERE k = 1)"""


@query("q_gaps_islands_windows", f'WITH {_WINDOWS} SELECT equipment, "start", "end", "open" FROM w')
def gaps_islands_windows(spark, d):
    e = intervals(spark, d)
    return win.outage_windows(e, ["equipment"], "ts", ["ts", "event_id"], F.col("grid") == "error", F.col("grid") == "purchase")


@query(
    "q_window_hours",
    f"""WITH {_WINDOWS}, x AS (SELECT equipment, "start", "end", unnest(generate_series(date_trunc('hour', "start"), date_trunc('hour', "end"), INTERVAL 1 HOUR)) AS hour FROM w),
    s AS (SELECT equipment, hour, sum(greatest(0, CAST(floor(epoch(least("end", hour + INTERVAL 1 HOUR))) AS BIGINT) - CAST(floor(epoch(greatest("start", hour))) AS BIGINT))) AS s FROM x GROUP BY ALL)
    SELECT equipment, hour, {r('greatest(0.0, 1 - least(1.0, CAST(s AS DOUBLE) / 3600.0))', 3)} AS unblocked FROM s WHERE s > 0""",
)
def window_hours(spark, d):
    return win.window_hours(gaps_islands_windows(spark, d), ["equipment"])


@query(
    "q_max_rise",
    f"""WITH {_HOURS}, s AS (SELECT grid, epoch, CAST(CAST(value AS DECIMAL(18,4)) - lag(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY grid ORDER BY epoch) AS DOUBLE) AS rise FROM h)
    SELECT grid, rise, epoch AS "at" FROM s WHERE rise IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grid ORDER BY rise DESC, epoch) = 1""",
)
def max_rise(spark, d):
    return win.largest_rise(_hours(spark, d), ["grid"], "epoch", "value")


@query("q_duration_curve", f"WITH {EVENTS} SELECT grid, event_id, value, {r('100.0 * (row_number() OVER (PARTITION BY grid ORDER BY value DESC, event_id) - 1) / CAST(count(*) OVER (PARTITION BY grid) - 1 AS DOUBLE)')} AS percent FROM e")
def duration_curve(spark, d):
    return win.duration_curve(intervals(spark, d), ["grid"], "value", "event_id")


@query("q_hour_band", f"WITH {EVENTS} SELECT grid, {r('quantile_cont(value, 0.1)')} AS p10, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.9)')} AS p90 FROM e GROUP BY grid")
def hour_band(spark, d):
    return win.hour_band(intervals(spark, d), ["grid"], "value")


@query(
    "q_percentile_kinds",
    f"""WITH {EVENTS}, a AS (SELECT grid, list_sort(list(value)) AS s, CAST(count(*) AS INTEGER) AS n, quantile_cont(value, 0.9) AS lin, median(value) AS med FROM e GROUP BY grid)
    SELECT grid, s[CAST(floor(0.9 * (n - 1)) AS INTEGER) + 1] AS p_low, s[least(n - 1, CAST(floor(0.9 * n) AS INTEGER)) + 1] AS p_clipped, s[CAST(floor(0.9 * (n - 1) + 0.5) AS INTEGER) + 1] AS p_near,
    {r('lin')} AS p_linear, s[CAST(floor(n / 2.0) AS INTEGER) + 1] AS median_upper, {r('med')} AS median FROM a""",
)
def percentile_kinds(spark, d):
    return win.percentile_kinds(intervals(spark, d), ["grid"], "value", 0.9)


def _moments(x: str, y: str) -> str:
    x, y = f"CAST({x} AS DECIMAL(16,4))", f"CAST({y} AS DECIMAL(16,4))"
    return ", ".join(["CAST(count(*) AS BIGINT) AS n", *(f"CAST(sum({e}) AS DOUBLE) AS {k}" for k, e in (("sx", x), ("sy", y), ("sxx", f"{x} * {x}"), ("syy", f"{y} * {y}"), ("sxy", f"{x} * {y}")))])


_VX, _VY = "(n * sxx - sx * sx)", "(n * syy - sy * sy)"
_CORR = f"CASE WHEN n >= 3 AND {_VX} > 0 AND {_VY} > 0 THEN {r(f'(n * sxy - sx * sy) / sqrt({_VX}) / sqrt({_VY})')} END"


@query(
    "q_affine_fit",
    f"""WITH m AS (SELECT l_returnflag, {_moments('l_quantity', 'l_extendedprice / 100')} FROM lineitem GROUP BY 1)
    SELECT l_returnflag, n, {_CORR} AS corr, {r(f'(n * sxy - sx * sy) / {_VX}')} AS slope, {r(f'(sy - (n * sxy - sx * sy) / {_VX} * sx) / n')} AS intercept FROM m""",
)
def affine_fit(spark, d):
    return win.correlation(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice") / 100)


@query("q_affine_fit_all")
def affine_fit_all(spark, d):
    """q_affine_fit over all lines."""
    return win.correlation(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice") / 100)


@query(
    "q_spearman",
    f"""WITH k AS (SELECT s_nationkey % 5 AS g, rank() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey % 5, s_acctbal) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey % 7) + (count(*) OVER (PARTITION BY s_nationkey % 5, s_suppkey % 7) - 1) / 2.0 AS ry FROM supplier), m AS (SELECT g, {_moments('rx', 'ry')} FROM k GROUP BY g)
    SELECT g, n, {_CORR} AS spearman FROM m""",
)
def spearman(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("g"), "s_acctbal", (F.col("s_suppkey") % 7).alias("y"))
    return win.spearman(rows, ["g"], "s_acctbal", "y")


_PAIRS = "p AS (SELECT l_returnflag AS g, l_orderkey % 50 AS day, l_quantity AS obs, l_quantity + (l_partkey % 11) - 5 AS mod FROM lineitem)"


def _pairs(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") % 50).alias("day"), F.col("l_quantity").alias("obs"), (F.col("l_quantity") + F.col("l_partkey") % 11 - 5).alias("mod"))


_DIFF = "CAST(mod AS DECIMAL(18,4)) - CAST(obs AS DECIMAL(18,4))"


@query(
    "q_score_pairs",
    f"""WITH {_PAIRS}, c AS (SELECT g, list_sort(list(obs)) AS so, list_sort(list(mod)) AS sm, count(*) AS k FROM p GROUP BY g),
    t AS (SELECT g, so[CAST(floor(0.9 * (k - 1)) AS INTEGER) + 1] AS t_o, sm[CAST(floor(0.9 * (k - 1)) AS INTEGER) + 1] AS t_m, sm[CAST(floor(0.5 * (k - 1)) AS INTEGER) + 1] AS m_m FROM c),
    m AS (SELECT g, {_moments('obs', 'mod')} FROM p GROUP BY g),
    a AS (SELECT g, {r(mean('obs'))} AS mean_observed, {r(mean('mod'))} AS mean_modeled, {r(f'CAST(sum(abs({_DIFF})) AS DOUBLE) / count(*)')} AS mae, {r(f'CAST(sum({_DIFF}) AS DOUBLE) / count(*)')} AS bias,
    CASE WHEN any_value(t_m) > any_value(m_m) THEN {r('100 * (CAST(count(*) FILTER (WHERE obs >= t_o AND mod >= t_m) AS DOUBLE) / CAST(count(*) FILTER (WHERE obs >= t_o) AS DOUBLE))')} END AS high_hit FROM p JOIN t USING (g) GROUP BY g)
    SELECT g, n, {_CORR} AS corr, mean_observed, mean_modeled, mae, bias, high_hit FROM m JOIN a USING (g)""",
)
def score_pairs(spark, d):
    return win.score_pairs(_pairs(spark, d), ["g"], "obs", "mod")


@query(
    "q_smape",
    f"""WITH {_PAIRS}, t AS (SELECT g, CASE WHEN abs(mod) + abs(obs) > 1e-9 THEN CAST(2 * abs(mod - obs) / (abs(mod) + abs(obs)) AS DECIMAL(28,12)) END AS t FROM p)
    SELECT g, count(t) AS n, {r('100 * (CAST(sum(t) AS DOUBLE) / count(t))')} AS smape FROM t GROUP BY g""",
)
def smape(spark, d):
    return win.smape(_pairs(spark, d), ["g"], "obs", "mod")


@query(
    "q_within_day_corr",
    f"""WITH {_PAIRS}, m AS (SELECT g, day, {_moments('obs', 'mod')} FROM p GROUP BY ALL), c AS (SELECT g, {_CORR} AS corr FROM m WHERE n >= 24), l AS (SELECT g, list_sort(list(corr)) AS s, count(*) AS days FROM c WHERE corr IS NOT NULL GROUP BY g)
    SELECT g, CAST(days AS INTEGER) AS days, s[CAST(floor(0.5 * (days - 1)) AS INTEGER) + 1] AS median_corr FROM l""",
)
def within_day_corr(spark, d):
    return win.within_group_correlation(_pairs(spark, d), ["g"], "day", "obs", "mod", 24)


@query(
    "q_dedupe_close",
    f"""WITH RECURSIVE {EVENTS}, t AS (SELECT DISTINCT equipment, grid, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM e), j AS (SELECT a.equipment, a.grid, a.t, min(b.t) AS n FROM t a JOIN t b ON a.equipment = b.equipment AND a.grid = b.grid AND a.t + 21600 < b.t GROUP BY ALL),
    k AS (SELECT equipment, grid, min(t) AS t FROM t GROUP BY ALL UNION ALL SELECT k.equipment, k.grid, j.n FROM k JOIN j ON k.equipment = j.equipment AND k.grid = j.grid AND k.t = j.t) SELECT equipment, grid, t AS kept_at FROM k""",
)
def dedupe_close(spark, d):
    return win.dedupe_close(intervals(spark, d), ["equipment", "grid"], "ts", 6 * 3600)


@query("q_exposure_curve", f"WITH {EVENTS} SELECT grid, event_id, value, row_number() OVER (PARTITION BY grid ORDER BY value DESC, event_id) AS rank, greatest(0.0, CAST(equipment % 40 AS DOUBLE) - 15.0) AS exposed FROM e")
def exposure_curve(spark, d):
    e = intervals(spark, d).withColumns({"gen": (F.col("equipment") % 40).cast("double"), "contract": F.lit(15.0)})
    return win.exposure_curve(e, ["grid"], "value", "gen", "contract", "event_id")


_GP = "CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice AS DECIMAL(18,4))"


@query(
    "q_capture_price",
    f"""WITH a AS (SELECT l_returnflag, CAST(sum({_GP}) AS DOUBLE) / {dsum('l_quantity')} AS c, {mean('l_extendedprice')} AS m FROM lineitem GROUP BY 1)
    SELECT l_returnflag, {r('c')} AS capture, {r('m')} AS mean_price, {r('100 * (c / m)')} AS capture_rate FROM a""",
)
def capture_price(spark, d):
    return valuation.capture_price(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


_SET = "(CAST(1500.0 AS DECIMAL(18,4)) - CAST(l_extendedprice / 50 AS DECIMAL(18,4))) * least(CAST(l_quantity AS DECIMAL(18,4)), CAST(25.0 AS DECIMAL(18,4)))"
_REV = "CAST(l_extendedprice / 50 AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4))"


@query("q_portfolio_cfd", f"SELECT l_returnflag, {r(f'CAST(sum({_REV}) AS DOUBLE)', 2)} AS spot_revenue, {r(f'CAST(sum({_SET}) AS DOUBLE)', 2)} AS settlement, {r(f'CAST(sum({_REV}) + sum({_SET}) AS DOUBLE)', 2)} AS total FROM lineitem GROUP BY 1")
def portfolio_cfd(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"spot": F.col("l_extendedprice") / 50, "contract": F.lit(25.0)})
    return valuation.contract_value(rows, ["l_returnflag"], "spot", "l_quantity", "contract", 1500.0)


@query("q_bill", f"SELECT l_returnflag, {r(dsum('l_quantity'))} AS energy, {r(dsum('l_quantity') + ' * 7.5')} AS generation, {r(dsum('l_quantity') + ' * 1.25')} AS transmission FROM lineitem GROUP BY 1")
def bill(spark, d):
    return valuation.bill(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", {"generation": 7.5, "transmission": 1.25})


@query(
    "q_segments_unpivot",
    """WITH l AS (SELECT p_partkey, unnest([1, 2, 3, 4]) AS i, unnest([p_retailprice, p_retailprice + 10, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice + 20 END, p_retailprice + 30]) AS price,
    unnest([CAST(p_size AS DOUBLE), CAST(p_size AS DOUBLE) + p_partkey % 3, CAST(p_size AS DOUBLE) - 1, CAST(p_size AS DOUBLE) + 9]) AS q FROM part),
    s AS (SELECT *, min(CASE WHEN price IS NULL OR q IS NULL THEN i END) OVER (PARTITION BY p_partkey) AS stop FROM l),
    w AS (SELECT p_partkey, i AS segment, price, q - greatest(0.0, coalesce(max(q) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS width FROM s WHERE stop IS NULL OR i < stop)
    SELECT p_partkey, segment, price, width FROM w WHERE width > 1e-9""",
)
def segments_unpivot(spark, d):
    q, p = F.col("p_size").cast("double"), F.col("p_retailprice")
    wide = table(spark, d, "part").select(
        "p_partkey", p.alias("P1"), (p + 10).alias("P2"), F.when(F.col("p_size") % 5 != 0, p + 20).alias("P3"), (p + 30).alias("P4"), q.alias("Q1"), (q + F.col("p_partkey") % 3).alias("Q2"), (q - 1).alias("Q3"), (q + 9).alias("Q4")
    )
    return stack.segments(wide, ["p_partkey"], ["P1", "P2", "P3", "P4"], ["Q1", "Q2", "Q3", "Q4"])


_STACK = """b AS (SELECT l_suppkey AS grid, CAST(round(l_discount * 100) AS INTEGER) AS cost, CAST(l_quantity AS BIGINT) AS mw, l_returnflag AS fuel, l_orderkey, l_linenumber, l_partkey FROM lineitem),
    s AS (SELECT *, CAST(sum(mw) OVER (PARTITION BY grid ORDER BY cost, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM b)"""
_TIES = ["l_orderkey", "l_linenumber", "l_partkey"]


def _stacked(spark, d):
    return stack.running_stack(_blocks(spark, d), ["grid"], "cost", "mw", _TIES)


def _blocks(spark, d):
    """Order lines as blocks of each supplier's book: discount as cost, quantity as MW."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grid"), F.round(F.col("l_discount") * 100).cast("int").alias("cost"), F.col("l_quantity").cast("long").alias("mw"), F.col("l_returnflag").alias("fuel"), *_TIES)


@query("q_merit_stack", f"WITH {_STACK} SELECT grid, cost, mw, cum, l_orderkey, l_linenumber, l_partkey FROM s")
def merit_stack(spark, d):
    return _stacked(spark, d).drop("fuel")


@query(
    "q_merit_clear",
    f"""WITH {_STACK}, d AS (SELECT *, 6000 + 100 * (grid % 100) AS demand FROM s)
    SELECT grid, CAST(max(demand) AS BIGINT) AS demand, CAST(sum(mw) AS BIGINT) AS available, CAST(least(max(demand), sum(mw)) AS BIGINT) AS served, CAST(greatest(0, max(demand) - sum(mw)) AS BIGINT) AS shortfall, CAST(coalesce(min(cost) FILTER (WHERE cum >= demand), 32) AS DOUBLE) AS price FROM d GROUP BY grid""",
)
def merit_clear(spark, d):
    demand = (6000 + 100 * (F.col("grid") % 100)).cast("long")
    out = stack.clear(_stacked(spark, d), ["grid"], "cost", "mw", demand, _TIES)
    return out.withColumn("price", F.col("price").cast("double"))


@query("q_fuel_split", f"WITH {_STACK}, f AS (SELECT grid, fuel, greatest(0, least(mw, 6000 - (cum - mw))) AS own FROM s) SELECT grid, fuel, CAST(sum(own) AS BIGINT) AS mw FROM f GROUP BY ALL HAVING sum(own) > 0")
def fuel_split(spark, d):
    return stack.fuel_split(_stacked(spark, d), ["grid"], "fuel", "mw", F.lit(6000).cast("long"))


@query("q_book_sample_curve", f"WITH {_STACK}, k AS (SELECT unnest(range(1, 2000)) * 100 AS mw_point) SELECT grid, CAST(mw_point AS BIGINT) AS mw_point, cost AS price FROM s JOIN k ON cum - mw < mw_point AND mw_point <= cum")
def book_sample_curve(spark, d):
    return stack.sample_curve(_stacked(spark, d), ["grid"], "cost", "mw", 100)


@query(
    "q_loo_median",
    """WITH p AS (SELECT o_orderpriority AS k, o_custkey % 40 AS day, max(o_totalprice) AS v FROM orders GROUP BY ALL), j AS (SELECT a.k, a.day, list_sort(list(b.v)) AS s FROM p a JOIN p b ON a.k = b.k AND a.day <> b.day GROUP BY ALL)
    SELECT k, day, s[CAST(floor(len(s) / 2.0) AS INTEGER) + 1] AS median FROM j""",
)
def loo_median(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 40).alias("day")).agg(F.max("o_totalprice").alias("v"))
    return stack.leave_one_out_median(p, ["k"], "day", "v")


_CUT = """c AS (SELECT l_suppkey AS grid, CASE WHEN l_linestatus = 'F' THEN 'DP' ELSE 'ND' END AS side, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 10 + CAST(l_quantity AS BIGINT) % 10 AS seq, l_partkey % 200 AS resource, CAST(l_quantity AS BIGINT) AS mw FROM lineitem),
    u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY grid, seq ORDER BY mw) = 1), q AS (SELECT *, CAST(sum(mw) OVER (PARTITION BY grid, side ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM u)"""


@query(
    "q_dispatch_cut",
    f"""WITH {_CUT}, a AS (SELECT grid, arg_max(run, seq) FILTER (WHERE side = 'DP') AS dispatched, arg_min(run, seq) FILTER (WHERE side = 'ND') AS headroom, arg_max(resource, seq) FILTER (WHERE side = 'ND') AS next_up FROM q GROUP BY grid),
    m AS (SELECT grid, count(*) AS marginal FROM (SELECT grid, resource FROM u GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY grid)
    SELECT grid, dispatched, headroom, next_up, CAST(coalesce(marginal, 0) AS INTEGER) AS marginal FROM a LEFT JOIN m USING (grid)""",
)
def dispatch_cut(spark, d):
    q = F.col("l_quantity").cast("long")
    seq = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 10 + q % 10
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grid"), F.when(F.col("l_linestatus") == "F", "DP").otherwise("ND").alias("side"), seq.alias("seq"), (F.col("l_partkey") % 200).alias("resource"), q.alias("mw"))
    first = c.groupBy("grid", "seq").agg(F.min(F.struct("mw", "side", "resource")).alias("x")).select("grid", "seq", "x.*")
    return stack.dispatch_cut(first, ["grid"], "side", "seq", "resource", "mw")


@query(
    "q_cut_summary",
    f"""WITH {_CUT}, a AS (SELECT grid, sum(mw) FILTER (WHERE side = 'DP') AS dispatched, arg_min(mw, seq) FILTER (WHERE side = 'ND') AS headroom, sum(mw) AS mw FROM u GROUP BY grid), m AS (SELECT grid, count(*) AS marginal FROM (SELECT grid, resource FROM u GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY grid)
    SELECT grid % 3 AS region, count(*) AS cuts, {r(mean('headroom'), 1)} AS mean_headroom, min(headroom) AS min_headroom, max(headroom) AS max_headroom, {r('100.0 * count(*) FILTER (WHERE coalesce(marginal, 0) > 0) / count(*)', 1)} AS marginal_share, {r(mean('CAST(dispatched AS DOUBLE) / mw'), 3)} AS ratio FROM a LEFT JOIN m USING (grid) GROUP BY 1""",
)
def cut_summary(spark, d):
    """Headroom, how often a resource stands on both sides, and dispatched against observed MW of a region's cuts."""
    observed = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("long")
    seq = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 10 + q % 10
    once = observed.groupBy(F.col("l_suppkey").alias("grid"), seq.alias("seq")).agg(F.min(q).alias("mw"))
    return stack.cut_summary(dispatch_cut(spark, d).withColumn("region", F.col("grid") % 3), ["region"], "grid", once.groupBy("grid").agg(F.sum("mw").alias("observed")))


_ZONES = """z AS (SELECT l_linenumber AS hour, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS zone, CAST(round(l_discount * 100) AS BIGINT) AS price, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS mw FROM lineitem GROUP BY ALL),
    dm AS (SELECT hour, zone, CAST(floor(sum(mw) * (CASE zone WHEN 1 THEN 4 WHEN 2 THEN 9 ELSE 6 END) / 10.0) AS BIGINT) AS d FROM z GROUP BY hour, zone),
    cu AS (SELECT hour, zone, price, mw, CAST(sum(mw) OVER (PARTITION BY hour, zone ORDER BY price) AS BIGINT) AS cum FROM z), st AS (SELECT hour, zone, cum FROM cu UNION SELECT hour, zone, 0 FROM cu),
    fa AS (SELECT hour, cum - d AS f1 FROM st JOIN dm USING (hour, zone) WHERE zone = 1 UNION SELECT hour, f FROM (SELECT DISTINCT hour FROM z), (VALUES (0), (2500), (-2500)) v(f)),
    fb AS (SELECT hour, d - cum AS f2 FROM st JOIN dm USING (hour, zone) WHERE zone = 3 UNION SELECT hour, f FROM (SELECT DISTINCT hour FROM z), (VALUES (0), (4500), (-4500)) v(f)),
    fd AS (SELECT hour, cum - d AS w FROM st JOIN dm USING (hour, zone) WHERE zone = 2),
    f AS (SELECT hour, f1, f2 FROM fa JOIN fb USING (hour) UNION SELECT hour, f1, f1 + w FROM fa JOIN fd USING (hour) UNION SELECT hour, f2 - w, f2 FROM fb JOIN fd USING (hour)),
    g AS (SELECT f.hour, f1, f2, zone, d + CASE zone WHEN 1 THEN f1 WHEN 2 THEN f2 - f1 ELSE -f2 END AS need FROM f JOIN dm USING (hour) WHERE abs(f1) <= 2500 AND abs(f2) <= 4500),
    k AS (SELECT g.hour, f1, f2, zone, any_value(need) AS need, sum(greatest(0, least(mw, need - (cum - mw))) * price) + greatest(0, any_value(need) - sum(mw)) * 3200 AS cost FROM g JOIN cu USING (hour, zone) GROUP BY g.hour, f1, f2, zone),
    t AS (SELECT hour, f1, f2, sum(cost) + 2 * (abs(any_value(f1)) + abs(any_value(f2))) AS cost FROM k GROUP BY hour, f1, f2 HAVING min(need) >= 0)"""


@query("q_coupled_clear", f"WITH {_ZONES} SELECT hour, CAST(cost AS BIGINT) AS cost, CAST(f1 AS BIGINT) AS f1, CAST(f2 AS BIGINT) AS f2 FROM t QUALIFY row_number() OVER (PARTITION BY hour ORDER BY cost, abs(f1) + abs(f2), f1, f2) = 1")
def coupled_clear(spark, d):
    zone = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    z = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("hour"), zone.alias("zone"), F.round(F.col("l_discount") * 100).cast("long").alias("price")).agg(F.sum(F.col("l_quantity").cast("long")).alias("mw"))
    share = F.when(F.col("zone") == 1, 4).when(F.col("zone") == 2, 9).otherwise(6)
    per = z.groupBy("hour", "zone").agg(F.sort_array(F.collect_list(F.struct("price", "mw"))).alias("s"), F.sum("mw").alias("all")).withColumn("d", F.floor(F.col("all") * share / 10.0).cast("long"))
    one = per.groupBy("hour").agg(*(F.max(F.when(F.col("zone") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2, 3) for c in ("d", "s")))
    return stack.coupled_clear(one, ["hour"], 2500, 4500, 2)


@query(
    "q_n1",
    f"""WITH {_STACK}, u AS (SELECT grid, l_partkey % 5 AS unit, mw, cost, l_orderkey, l_linenumber, l_partkey FROM b), o AS (SELECT DISTINCT grid, unit AS lost FROM u),
    k AS (SELECT o.grid, o.lost, u.cost, u.mw, sum(u.mw) OVER (PARTITION BY o.grid, o.lost ORDER BY u.cost, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS cum FROM o JOIN u ON o.grid = u.grid AND o.lost <> u.unit)
    SELECT grid, lost, CAST(sum(mw) AS BIGINT) AS available, CAST(greatest(0, 9000 - sum(mw)) AS BIGINT) AS shortfall, CAST(coalesce(min(cost) FILTER (WHERE cum >= 9000), 32) AS DOUBLE) AS price FROM k GROUP BY ALL""",
)
def n1(spark, d):
    return _n1(_blocks(spark, d))


def _n1(blocks):
    return scenario.each_unit_out(blocks.withColumn("unit", F.col("l_partkey") % 5), "grid", "unit", "cost", "mw", 9000)


@query("q_n1_all")
def n1_all(spark, d):
    """q_n1 over all suppliers' books."""
    return _n1(_blocks(spark, d))


@query(
    "q_n1_ranked",
    f"""WITH {_STACK}, u AS (SELECT grid, l_partkey % 5 AS unit, cost, sum(mw) AS mw FROM b GROUP BY ALL), g AS (SELECT grid, coalesce(min(cost) FILTER (WHERE cum >= 9000), 32) AS base FROM s GROUP BY grid), o AS (SELECT grid, unit AS lost, sum(mw) AS capacity FROM u GROUP BY ALL),
    k AS (SELECT o.grid, o.lost, capacity, u.cost, u.mw, sum(u.mw) OVER (PARTITION BY o.grid, o.lost ORDER BY u.cost) AS cum FROM o JOIN u ON o.grid = u.grid AND o.lost <> u.unit),
    n AS (SELECT grid, lost, CAST(any_value(capacity) AS BIGINT) AS capacity, CAST(sum(mw) AS BIGINT) AS available, CAST(greatest(0, 9000 - sum(mw)) AS BIGINT) AS shortfall, CAST(coalesce(min(cost) FILTER (WHERE cum >= 9000), 32) AS DOUBLE) AS price FROM k GROUP BY ALL)
    SELECT grid, lost, available, shortfall, price, capacity, price - base AS change, CAST(row_number() OVER (PARTITION BY grid ORDER BY shortfall DESC, price - base DESC, capacity DESC, lost) AS INTEGER) AS rank FROM n JOIN g USING (grid)""",
)
def n1_ranked(spark, d):
    """Lost units of each grid, the gravest first."""
    return scenario.ranked_outages(n1(spark, d), stack.running_stack(_blocks(spark, d), ["grid"], "cost", "mw", _TIES), "grid", "cost", "mw", 9000)


@query(
    "q_load_sweep",
    f"""WITH {_STACK}, p AS (SELECT unnest(range(0, 3001, 25)) AS add), c AS (SELECT grid, add, coalesce(min(cost) FILTER (WHERE cum >= 8000 + add), 32) AS price FROM s CROSS JOIN p GROUP BY ALL)
    SELECT grid, CAST(coalesce(min(add) FILTER (WHERE price > 7), -1) AS INTEGER) AS first_over, CAST(coalesce(min(add) FILTER (WHERE price = 32), -1) AS INTEGER) AS first_short FROM c GROUP BY grid""",
)
def load_sweep(spark, d):
    return scenario.load_sweep(_stacked(spark, d), "grid", "cost", 8000, 0, 3000, 25, 7)


@query("q_load_sweep_all")
def load_sweep_all(spark, d):
    """q_load_sweep over all suppliers' books."""
    return scenario.load_sweep(_stacked(spark, d), "grid", "cost", 8000, 0, 3000, 25, 7)


@query(
    "q_tornado",
    f"""WITH {_STACK}, v(lever, add, fuel, scale) AS (VALUES ('base', 0, '', 1), ('load +5%', 400, '', 1), ('load -5%', -400, '', 1), ('A costs double', 0, 'A', 2), ('N costs double', 0, 'N', 2)),
    x AS (SELECT lever, add, b.grid, CASE WHEN b.fuel = v.fuel THEN cost * scale ELSE cost END AS c, mw, l_orderkey, l_linenumber, l_partkey FROM b CROSS JOIN v),
    y AS (SELECT *, sum(mw) OVER (PARTITION BY lever, grid ORDER BY c, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS cum FROM x), p AS (SELECT lever, grid, coalesce(min(c) FILTER (WHERE cum >= 8000 + add), 32) AS price FROM y GROUP BY ALL)
    SELECT a.lever, CAST(sum(a.price - b.price) AS BIGINT) AS delta FROM p a JOIN p b ON a.grid = b.grid AND b.lever = 'base' WHERE a.lever <> 'base' GROUP BY a.lever""",
)
def tornado(spark, d):
    return _tornado(spark, _blocks(spark, d))


@query("q_tornado_all")
def tornado_all(spark, d):
    """q_tornado over all suppliers' books."""
    return _tornado(spark, _blocks(spark, d))


def _tornado(spark, blocks):
    levers = spark.createDataFrame([("base", 0, "", 1), ("load +5%", 400, "", 1), ("load -5%", -400, "", 1), ("A costs double", 0, "A", 2), ("N costs double", 0, "N", 2)], "lever string, add int, lever_fuel string, scale int")
    return scenario.tornado(blocks, "grid", "fuel", "cost", "mw", 8000, levers)


@query(
    "q_monte_carlo",
    """WITH u AS (SELECT s_suppkey AS unit, CAST(floor(abs(s_acctbal)) AS BIGINT) AS mw, 5 + s_suppkey % 10 AS pct FROM supplier), d AS (SELECT unnest(range(2000)) AS draw),
    h AS (SELECT draw, unit, mw, pct, (((draw * 7919 + unit * 104729 + 42) * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648 AS x FROM u CROSS JOIN d),
    a AS (SELECT draw, sum(CASE WHEN (x // 65536) % 100 >= pct THEN mw ELSE 0 END) AS up FROM h GROUP BY draw), t AS (SELECT CAST(floor(sum(mw) * 0.9) AS BIGINT) AS load FROM u), s AS (SELECT greatest(0, load - up) AS short FROM a, t)
    SELECT count(*) AS draws, count(*) FILTER (WHERE short > 0) AS short_draws, CAST(sum(short) AS BIGINT) AS short_mw, CAST(max(short) AS BIGINT) AS worst FROM s""",
)
def monte_carlo(spark, d):
    return _monte_carlo(table(spark, d, "supplier"))


@query("q_monte_carlo_all")
def monte_carlo_all(spark, d):
    """q_monte_carlo over all suppliers."""
    return _monte_carlo(table(spark, d, "supplier"))


def _monte_carlo(suppliers):
    units = suppliers.select(F.col("s_suppkey").alias("unit"), F.floor(F.abs("s_acctbal")).cast("long").alias("mw"), (5 + F.col("s_suppkey") % 10).alias("pct"))
    return scenario.forced_outages(units, "unit", "mw", "pct", 2000, 42, 0.9)


@query(
    "q_haversine_nn",
    f"""WITH p AS (SELECT p_partkey AS point, CAST(p_partkey * 37 % 1000 AS DOUBLE) / 200 + 120 AS lon, CAST(p_partkey * 91 % 1000 AS DOUBLE) / 200 + 10 AS lat FROM part),
    s AS (SELECT s_suppkey AS station, CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 200 + 120 AS lon, CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 200 + 10 AS lat FROM supplier),
    k AS (SELECT point, station, {r("2 * 6371.0 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))", 6)} AS km FROM p CROSS JOIN s)
    SELECT point, station, {r('km', 3)} AS km FROM k WHERE km <= 20 QUALIFY row_number() OVER (PARTITION BY point ORDER BY km, station) = 1""",
)
def haversine_nn(spark, d):
    def geo(k, a, b):
        return [(F.col(k) * a % 1000).cast("double").alias("x"), (F.col(k) * b % 1000).cast("double").alias("y")]

    def place(t, k, name, a, b):
        return table(spark, d, t).select(F.col(k).alias(name), *geo(k, a, b)).select(name, (F.col("x") / 200 + 120).alias("lon"), (F.col("y") / 200 + 10).alias("lat"))

    return joins.nearest(place("part", "p_partkey", "point", 37, 91), "point", place("supplier", "s_suppkey", "station", 53, 71), "station", 20.0)


_EDGES = "g AS (SELECT CAST(n_nationkey AS BIGINT) AS u, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS v, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS w FROM nation), ed AS (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g)"


def _edges(spark, d):
    n = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(n.alias("u"), ((n * 7 + 3) % 25).alias("v"), (n % 5 + 1).cast("double").alias("w"))


@query("q_components", f"WITH RECURSIVE {_EDGES}, rch AS (SELECT u AS node, u AS other FROM ed UNION SELECT rch.node, ed.v FROM rch JOIN ed ON rch.other = ed.u) SELECT node, min(other) AS component FROM rch GROUP BY node")
def components(spark, d):
    return graph.components(_edges(spark, d).select("u", "v"))


@query("q_shortest_path", f"WITH RECURSIVE {_EDGES}, rch AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS dist UNION SELECT ed.v, rch.dist + ed.w FROM rch JOIN ed ON rch.node = ed.u WHERE rch.dist + ed.w <= 80) SELECT node, min(dist) AS dist FROM rch GROUP BY node")
def shortest_path(spark, d):
    return graph.shortest_paths(_edges(spark, d), 0)


@query("q_parallel_circuits", f"SELECT s_nationkey, count(*) AS circuits, {r('1.0 / sum(1.0 / (1 + s_suppkey % 5))')} AS x, CAST(sum(1 + s_suppkey % 9) AS BIGINT) AS rating FROM supplier GROUP BY 1")
def parallel_circuits(spark, d):
    b = table(spark, d, "supplier").select("s_nationkey", (1 + F.col("s_suppkey") % 5).cast("double").alias("x"), (1 + F.col("s_suppkey") % 9).alias("rating"))
    out = graph.parallel_circuits(b, ["s_nationkey"])
    return out.withColumn("x", half_up(F.col("x")))


@query(
    "q_prorata_injection",
    f"""WITH l AS (SELECT s_nationkey % 5 AS grid, s_nationkey AS bus, CAST(1 + s_suppkey % 13 AS DOUBLE) AS mw, s_suppkey % 4 = 0 AS lost FROM supplier), o AS (SELECT grid, bus, sum(mw) AS mw FROM l WHERE NOT lost GROUP BY ALL), t AS (SELECT grid, sum(mw) AS rest FROM l WHERE lost GROUP BY grid)
    SELECT grid, bus, {r('mw + coalesce(rest, 0.0) * (mw / sum(mw) OVER (PARTITION BY grid))')} AS mw FROM o LEFT JOIN t USING (grid)""",
)
def prorata_injection(spark, d):
    l = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("grid"), F.col("s_nationkey").alias("bus"), (1 + F.col("s_suppkey") % 13).cast("double").alias("mw"), (F.col("s_suppkey") % 4 == 0).alias("lost"))
    return graph.injections(l.where("NOT lost"), l.where("lost"), "grid", "bus", "mw").withColumn("mw", half_up(F.col("mw")))


@query("q_override_coalesce", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice, CASE WHEN p_partkey % 15 = 0 THEN 99.0 ELSE CAST(p_size AS DOUBLE) END AS p_size FROM part")
def override_coalesce(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    a = part.where("p_partkey % 10 = 0").select("p_partkey", F.lit("p_retailprice").alias("property"), (F.col("p_retailprice") * 2).alias("value"))
    b = part.where("p_partkey % 15 = 0").select("p_partkey", F.lit("p_size").alias("property"), F.lit(99.0).alias("value"))
    return joins.apply_overrides(part, "p_partkey", a.unionByName(b), ["p_retailprice", "p_size"])


@query(
    "q_csv_import_melt",
    """WITH w AS (SELECT p_partkey * 2 AS k, CAST(p_size AS VARCHAR) AS a, CASE WHEN p_size % 7 = 0 THEN 'n/a' WHEN p_size % 5 = 0 THEN ' ' ELSE CAST(p_size * 3 AS VARCHAR) END AS b FROM part), m AS (SELECT k, 'size' AS property, a AS raw FROM w UNION ALL SELECT k, 'mw', b FROM w),
    o AS (SELECT m.k, property, raw, CASE WHEN p.p_partkey IS NULL THEN 'skipped' WHEN TRY_CAST(trim(raw) AS DOUBLE) IS NULL THEN 'warning' ELSE 'used' END AS outcome FROM m LEFT JOIN part p ON p.p_partkey = m.k WHERE trim(raw) <> '')
    SELECT k, property, CASE WHEN outcome = 'used' THEN TRY_CAST(trim(raw) AS DOUBLE) END AS value, outcome FROM o""",
)
def csv_import_melt(spark, d):
    part = table(spark, d, "part")
    s = F.col("p_size")
    wide = part.select((F.col("p_partkey") * 2).alias("k"), s.cast("string").alias("A"), F.when(s % 7 == 0, "n/a").when(s % 5 == 0, " ").otherwise((s * 3).cast("string")).alias("B"))
    return joins.import_wide(wide, "k", {"A": "size", "B": "mw"}, part.select(F.col("p_partkey").alias("k")))


@query(
    "q_entity_ladder",
    """WITH a(code, fuel) AS (VALUES ('small ring', 'coal'), ('red widget', 'gas')), b(word, fuel) AS (VALUES ('red', 'hydro'), ('blue', 'wind'), ('ring', 'oil')),
    one AS (SELECT p_partkey, count(DISTINCT fuel) AS n, min(fuel) AS fuel FROM part JOIN a ON p_name = code GROUP BY 1), two AS (SELECT p_partkey, count(DISTINCT fuel) AS n, min(fuel) AS fuel FROM part JOIN b ON contains(p_name, word) GROUP BY 1)
    SELECT p.p_partkey, CASE WHEN one.n = 1 THEN 'alias' WHEN two.n = 1 THEN 'word' END AS source, CASE WHEN one.n = 1 THEN one.fuel WHEN two.n = 1 THEN two.fuel END AS fuel FROM part p LEFT JOIN one USING (p_partkey) LEFT JOIN two USING (p_partkey)""",
)
def entity_ladder(spark, d):
    alias = spark.createDataFrame([("small ring", "coal"), ("red widget", "gas")], "code string, fuel string")
    word = spark.createDataFrame([("red", "hydro"), ("blue", "wind"), ("ring", "oil")], "word string, fuel string")
    return joins.ladder(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", [("alias", alias, F.col("p_name") == F.col("code")), ("word", word, F.contains(F.col("p_name"), F.col("word")))], "fuel")


@query("q_shared_setters", f"WITH {EVENTS}, a AS (SELECT DISTINCT hour_ts, equipment FROM e WHERE grid = 'error'), b AS (SELECT DISTINCT hour_ts, equipment FROM e WHERE grid = 'purchase') SELECT a.hour_ts, count(*) AS named, count(b.equipment) AS agree FROM a LEFT JOIN b ON a.hour_ts = b.hour_ts AND a.equipment = b.equipment GROUP BY a.hour_ts")
def shared_setters(spark, d):
    e = intervals(spark, d)
    return joins.shared_setters(e.where("grid = 'error'"), e.where("grid = 'purchase'"), ["hour_ts"], "equipment")


@query("q_not_yet_archived", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def not_yet_archived(spark, d):
    done = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.not_yet(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("q_complete_sets", "SELECT l_suppkey, count(DISTINCT l_discount) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_discount) = 11")
def complete_sets(spark, d):
    return joins.complete_sets(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", 11)


@query("q_complete_sets_all")
def complete_sets_all(spark, d):
    """q_complete_sets over all lines."""
    return joins.complete_sets(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", 11)


@query("q_compact_book")
def compact_book(spark, d):
    return stack.compact_book(_blocks(spark, d), ["grid"], "cost", "mw", 6)
