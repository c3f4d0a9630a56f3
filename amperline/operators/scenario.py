"""Scenarios as rows: outages one by one, sweeps, levers, Monte Carlo, grouped dispatch."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import half_up, index_low
from amperline.operators.ranked import at_places
from amperline.operators.stack import CAP, clear, replay, running_stack
from amperline.sources.tables import written


def each_unit_out(blocks: DataFrame, grid: str, unit: str, cost: str, mw: str, demand: int) -> DataFrame:
    """Each unit lost in turn: (grid, lost, available, shortfall, price), one scenario per unit that leaves others.

    A unit takes its own MW out of the grid's cumulative curve. From one of its costs to the next
    that is a constant, so there the price is where the whole curve reaches the demand and that
    constant: one lookup for each of a unit's costs, all of them in one pass over the curve.
    """
    levels = blocks.groupBy(grid, unit, cost).agg(F.sum(mw).alias(mw))
    curve = running_stack(levels.groupBy(grid, cost).agg(F.sum(mw).alias(mw)), [grid], cost, mw, [])
    w = Window.partitionBy(grid, unit).orderBy(cost)
    own = running_stack(levels, [grid, unit], cost, mw, [])
    steps = own.select(grid, unit, F.col(cost).cast("double").alias("_from"), F.lead(cost).over(w).cast("double").alias("_to"), F.col("cum").alias("_out"))
    first = own.groupBy(grid, unit).agg(F.lit(None).cast("double").alias("_from"), F.min(cost).cast("double").alias("_to"), F.lit(0).alias("_out"))
    asked = steps.unionByName(first).select(grid, F.struct(unit, "_from", "_to").alias("_part"), (F.lit(demand) + F.col("_out")).alias("_d"))
    found = replay(curve, asked, [grid], cost, "_part", "_d").where("NOT short").select(grid, F.col(f"_part.{unit}").alias("lost"), F.greatest("price", "_part._from").alias("_p"), F.col("_part._to").alias("_to"))
    prices = found.where("_to IS NULL OR _p < _to").groupBy(grid, "lost").agg(F.min("_p").alias("price"))
    all_mw = levels.groupBy(grid).agg(F.sum(mw).alias("_all"), F.count_distinct(unit).alias("_units"))
    left = levels.groupBy(grid, F.col(unit).alias("lost")).agg(F.sum(mw).alias("_own")).join(all_mw, grid).where("_units > 1").select(grid, "lost", (F.col("_all") - F.col("_own")).alias("available"))
    short = F.greatest(F.lit(0), F.lit(demand) - F.col("available"))
    return left.join(prices, [grid, "lost"], "left").select(grid, "lost", "available", short.alias("shortfall"), F.coalesce("price", F.lit(CAP)).alias("price"))


def ranked_outages(out: DataFrame, stacked: DataFrame, grid: str, cost: str, mw: str, demand: int) -> DataFrame:
    """The rows of `each_unit_out` with the capacity lost, the change of the price and the rank in the grid: by shortfall, change of price and capacity, largest first, then by name."""
    base = clear(stacked, [grid], cost, mw, F.lit(demand).cast("long"), []).select(grid, F.col("price").cast("double").alias("_base"), F.col("available").alias("_all"))
    both = out.join(base, grid).withColumns({"capacity": F.col("_all") - F.col("available"), "change": F.col("price") - F.col("_base")})
    order = Window.partitionBy(grid).orderBy(F.desc("shortfall"), F.desc("change"), F.desc("capacity"), "lost")
    return both.withColumn("rank", F.row_number().over(order)).drop("_base", "_all")


def load_sweep(stacked: DataFrame, grid: str, cost: str, base: int, start: int, stop: int, step: int, over: float) -> DataFrame:
    """First added load whose price passes `over`, and the first that can't be served; -1 where none does.

    In merit order the price reaches a cost where the stack's cheaper blocks end, so one pass over
    the blocks gives both thresholds; no step is cleared by itself.
    """
    ends = stacked.groupBy(grid).agg(F.coalesce(F.max(F.when(F.col(cost) <= over, F.col("cum"))), F.lit(0)).alias("cheap"), F.max("cum").alias("all"))

    def first(limit):
        at = F.greatest(F.lit(start), F.lit(start) + F.floor((F.col(limit) - base - start) / step + 1) * step)
        return F.when(at <= stop, at).otherwise(-1).cast("int")

    return ends.select(grid, first("cheap").alias("first_over"), first("all").alias("first_short"))


def tornado(blocks: DataFrame, grid: str, fuel: str, cost: str, mw: str, demand: int, levers: DataFrame) -> DataFrame:
    """Change of the summed price by each lever (lever, add, lever_fuel, scale) against 'base'.

    Blocks of one cost reach the demand at one price, so a book is its MW at each cost (none under 0), and levers only meet those sums.
    """
    levels = blocks.groupBy(grid, fuel, cost).agg(F.sum(mw).alias(mw))
    rows = levels.join(F.broadcast(levers), how="cross").withColumn(cost, F.when(F.col(fuel) == F.col("lever_fuel"), F.col(cost) * F.col("scale")).otherwise(F.col(cost)))  # a handful of levers
    book = rows.groupBy("lever", "add", grid, cost).agg(F.sum(mw).alias(mw))
    out = clear(running_stack(book, ["lever", grid], cost, mw, []), ["lever", grid], cost, mw, F.lit(demand).cast("long") + F.col("add"), [])
    prices = out.groupBy(grid, "lever").agg(F.max("price").cast("long").alias("price"))
    base = prices.where("lever = 'base'").select(grid, F.col("price").alias("base"))
    return prices.where("lever <> 'base'").join(base, grid).groupBy("lever").agg(F.sum(F.col("price") - F.col("base")).alias("delta"))


def forced_outages(units: DataFrame, unit: str, mw: str, percent_out: str, draws: int, seed: int, load_share: float) -> DataFrame:
    """Monte Carlo of units on or off by a portable integer generator: draws, draws short of load, MW short, worst draw."""
    # units stay where they are and each makes its draws; a task sums over its units before anything is shuffled
    up = _available(units, [], unit, mw, percent_out, draws, seed)
    load = units.agg(F.floor(F.sum(mw) * load_share).cast("long").alias("load"))
    short = up.join(F.broadcast(load), how="cross").select(F.greatest(F.lit(0), F.col("load") - F.col("up")).alias("short"))
    return short.agg(F.count("*").alias("draws"), F.count_if(F.col("short") > 0).alias("short_draws"), F.sum("short").alias("short_mw"), F.max("short").alias("worst"))


def noisy_outages(units: DataFrame, grid: str, unit: str, mw: str, percent_out: str, loads: DataFrame, draws: int, seed: int) -> DataFrame:
    """Monte Carlo of units on or off against a normal load: (grid, draws, short_draws, expected, p50, p90, p99, worst) MW short.

    `loads`: (grid, mean, sd). Each draw's load is mean + sd * z to whole MW, z by Box-Muller from two
    numbers of the same counter-based generator as the outages. Units make their draws where they
    are and a task sums over its units before anything is shuffled; quantiles are taken at the low
    places over ranges.
    """
    short = written(shortfalls(units, grid, unit, mw, percent_out, loads, draws, seed), "shortfalls")
    places = {f"p{q}": (lambda n, q=q: index_low(n, q / 100)) for q in (50, 90, 99)}
    sums = short.groupBy(grid).agg(F.count("*").alias("draws"), F.count_if(F.col("short") > 0).alias("short_draws"), half_up(F.sum("short") / F.count("*"), 3).alias("expected"), F.max("short").alias("worst"))
    return sums.join(at_places(short, [grid], "short", places).drop("n"), grid)


def shortfalls(units: DataFrame, grid: str, unit: str, mw: str, percent_out: str, loads: DataFrame, draws: int, seed: int) -> DataFrame:
    """(grid, draw, short) of the draws of `noisy_outages`."""
    up = _available(units, [grid], unit, mw, percent_out, draws, seed)
    u1, u2 = ((_number(F.col("draw") * 15485863 + seed * 31 + k) + 1) / 32769.0 for k in (1, 2))
    z = F.sqrt(-2 * F.log(u1)) * F.cos(u2 * (2 * math.pi))
    load = F.floor(F.col("mean") + F.col("sd") * z + 0.5).cast("long")
    return up.join(loads, grid).select(grid, "draw", F.greatest(F.lit(0).cast("long"), load - F.col("up")).alias("short"))


def _step(x):
    return (x * 1103515245 + 12345) % 2147483648


def _number(x):
    """A number of 15 bits for a counter."""
    return F.floor(_step(_step(x % 2147483648)) / 65536) % 32768


def _available(units: DataFrame, keys: list[str], unit: str, mw: str, percent_out: str, draws: int, seed: int) -> DataFrame:
    """(keys, draw, up): the MW of the units that are on in each draw."""
    rows = units.repartition(F.col(unit)).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    u = _step(_step(F.col("draw") * 7919 + F.col(unit) * 104729 + seed))
    return rows.groupBy(*keys, "draw").agg(F.sum(F.when(F.floor(u / 65536) % 100 >= F.col(percent_out), F.col(mw)).otherwise(0)).alias("up"))


def buy_back(short: DataFrame, keys: list[str], short_mw: str, storage_mw: int, draws: str) -> DataFrame:
    """(keys, lolp_without, lolp_with, bought_back): the share of draws that are short without and with so much storage, in percent, and the MW that it covers on average."""
    mw = F.col(short_mw)
    n = F.count(draws)
    return short.groupBy(*keys).agg(
        half_up(100.0 * F.count_if(mw > 0) / n).alias("lolp_without"), half_up(100.0 * F.count_if(mw > storage_mw) / n).alias("lolp_with"), half_up(F.sum(F.least(mw, F.lit(storage_mw))) / n).alias("bought_back")
    )
