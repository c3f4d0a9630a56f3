"""What the corridors between three zones in a row (1 - 2 - 3) do to prices: scenarios, rents, spreads, the load that makes a corridor bind.

A scenario is a value of a key, so one clear covers all of them. Intervals without blocks or
demand in all three zones are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import half_up, ratio
from amperline.operators.stack import corridor_report, coupled_clear

#: A limit beyond any flow, and the price of what is not served.
OPEN, SHORT = 1_000_000, 3200


def outage(blocks: DataFrame, keys: list[str], price: str, mw: str, hit: Column, lost: int) -> DataFrame:
    """The blocks after `lost` MW of those that `hit` names are gone in each key, the dearest first; empty blocks go."""
    dearest = Window.partitionBy(*keys, hit).orderBy(F.desc(price)).rowsBetween(Window.unboundedPreceding, 0)
    left = F.when(hit, F.greatest(F.lit(0), F.least(F.col(mw), F.sum(mw).over(dearest) - lost))).otherwise(F.col(mw))
    return blocks.withColumn(mw, left.cast("long")).where(F.col(mw) > 0)


def zones(blocks: DataFrame, keys: list[str], zone: str, price: str, mw: str, demand: DataFrame) -> DataFrame:
    """keys, d1..d3, s1..s3 for the coupled clear from blocks (one row a price) and demand (keys, zone, d)."""
    per = blocks.groupBy(*keys, zone).agg(F.sort_array(F.collect_list(F.struct(F.col(price).alias("price"), F.col(mw).alias("mw")))).alias("s")).join(demand, [*keys, zone])
    one = per.groupBy(*keys).agg(*(F.max(F.when(F.col(zone) == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2, 3) for c in ("d", "s")))
    return one.dropna(subset=["d1", "d2", "d3", "s1", "s2", "s3"])


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Few bytes a row but thousands of crossings to price: spread over the cores by key, which the clear's grouping then keeps."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _price(blocks: str, need: Column) -> Column:
    """Price of the block that serves the last MW of `need`."""
    at = F.aggregate(
        blocks, F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("p")),
        lambda a, b: F.struct((a["cum"] + b["mw"]).alias("cum"), F.coalesce(a["p"], F.when(a["cum"] + b["mw"] >= need, b["price"].cast("long"))).alias("p")),
    )
    return F.coalesce(at["p"], F.lit(SHORT).cast("long"))


def priced(cleared: DataFrame, keys: list[str], cap1: str, cap2: str, wheel: int) -> DataFrame:
    """keys, limits, f1, f2, p1..p3 and each corridor's saturated1/2 and rent1/2; `cleared` holds `zones` and the limits."""
    cleared = _spread(cleared, keys)
    flows = coupled_clear(cleared, keys, F.col(cap1), F.col(cap2), wheel)
    both = cleared.join(flows, keys)
    need = {1: F.col("d1") + F.col("f1"), 2: F.col("d2") + F.col("f2") - F.col("f1"), 3: F.col("d3") - F.col("f2")}
    out = both.select(*keys, cap1, cap2, "f1", "f2", *(_price(f"s{i}", need[i]).alias(f"p{i}") for i in need))
    for i, cap in ((1, cap1), (2, cap2)):
        out = corridor_report(out, f"f{i}", F.col(cap), f"p{i}", f"p{i + 1}").withColumnsRenamed({"saturated": f"saturated{i}", "rent": f"rent{i}"})
    return out


def rents(report: DataFrame, by: list[str], limits: tuple[int, int], cap1: str, cap2: str) -> DataFrame:
    """One row per `by` and corridor: n, intervals whose limit is under the fixed one, saturated_pct, mean rent where saturated (0 if never), mean and largest flow of either sign, mean limit."""
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("corridor"), F.lit(limits[i - 1]).alias("fixed"), F.col(c).alias("cap"), F.abs(f"f{i}").alias("flow"), F.col(f"saturated{i}").alias("full"), F.col(f"rent{i}").cast("long").alias("rent")) for i, c in ((1, cap1), (2, cap2)))))
    rows = report.select(*by, one.alias("x")).select(*by, "x.*")
    n = F.count("*")
    return rows.groupBy(*by, "corridor").agg(
        n.alias("n"), F.count_if(F.col("cap") < F.col("fixed")).alias("capped"), half_up(ratio(100 * F.count_if("full"), n), 1).alias("saturated_pct"),
        F.coalesce(half_up(ratio(F.sum("rent"), F.count_if("full")), 3), F.lit(0.0)).alias("mean_rent"),
        half_up(ratio(F.sum("flow"), n), 1).alias("mean_flow"), F.max("flow").alias("peak_flow"), half_up(ratio(F.sum("cap"), n), 1).alias("mean_cap"),
    )


def spreads(report: DataFrame, keys: list[str], by: list[str], observed: DataFrame) -> DataFrame:
    """One row per `by` and zone: n, mean observed and modelled price, mean absolute error, and zone less zone 1 as observed, as modelled and the share explained.

    `observed`: the keys that are not scenarios and o1..o3; intervals without all three don't count.
    """
    seen = observed.dropna(subset=["o1", "o2", "o3"])
    rows = report.join(seen, [k for k in seen.columns if k in keys])
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("zone"), F.col(f"o{i}").alias("o"), F.col(f"p{i}").alias("p"), (F.col(f"o{i}") - F.col("o1")).alias("so"), (F.col(f"p{i}") - F.col("p1")).alias("sp")) for i in (1, 2, 3))))
    n = F.count("*")
    sums = rows.select(*by, one.alias("x")).select(*by, "x.*").groupBy(*by, "zone").agg(
        n.alias("n"), *(half_up(ratio(F.sum(c), n), 3).alias(name) for c, name in (("o", "observed"), ("p", "modelled"), ("so", "observed_spread"), ("sp", "modelled_spread"))), half_up(ratio(F.sum(F.abs(F.col("p") - F.col("o"))), n), 3).alias("mae"),
    )
    return sums.withColumn("explained", half_up(ratio(F.col("modelled_spread"), F.col("observed_spread")), 3))


def binding_threshold(cleared: DataFrame, keys: list[str], start: int, stop: int, step: int, cap1: str, cap2: str, wheel: int) -> DataFrame:
    """(keys, base, binds_at): the first load added to zone 2 that saturates corridor 1, null where none does.

    Whether it saturates need not rise with the load (it may be full the other way at first), so
    every step is cleared; steps are rows and spread over the cores.
    """
    steps = _spread(cleared.withColumn("add", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop).cast("long"), F.lit(step).cast("long")))), [*keys, "add"])
    flows = coupled_clear(steps.withColumn("d2", F.col("d2") + F.col("add")), [*keys, "add"], F.col(cap1), F.col(cap2), wheel)
    full = flows.join(cleared.select(*keys, F.col("d2").alias("base"), cap1), keys)
    saturated = (F.col(cap1) > 0.5) & (F.abs("f1") >= F.col(cap1) - 0.5)
    return full.groupBy(*keys).agg(F.first("base").alias("base"), F.min(F.when(saturated, F.col("add"))).alias("binds_at"))
