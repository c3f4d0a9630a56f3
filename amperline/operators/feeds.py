"""Joins and summaries of market feeds: replay pairs, reserves, outages, flows, energy, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, money, ratio


def price_with_generation(price: DataFrame, generation: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Prices of an interval beside its generation; with `left` an interval without one keeps a null."""
    return generation.join(price, keys, how)


def nonzero_share(rows: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Share of rows that are not 0, in percent, and the largest size."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), half_up(100 * ratio(F.count_if(F.abs(x) > 1e-9), F.count("*"))).alias("nonzero_share"), F.max(F.abs(x)).alias("max_abs"))


def roster(rows: DataFrame, keys: list[str], mw: str) -> DataFrame:
    """How often a resource is called, with the mean and largest MW."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), half_up(exact_mean(money(mw))).alias("mean"), F.max(mw).alias("max"))


def registered_offered(registered: DataFrame, offered: DataFrame, out: DataFrame, day: str, key: str, mw: str) -> DataFrame:
    """Per day registered and offered MW, what is scheduled out (0 without a schedule) and the gap that neither explains."""
    def sums(df, name):
        return df.groupBy(day).agg(F.sum(money(mw)).alias(name))

    both = sums(registered, "registered").join(sums(offered, "offered"), day).join(sums(out, "out"), day, "left").withColumn("out", F.coalesce("out", F.lit(0)))
    gap = F.greatest(F.lit(0), F.col("registered") - F.col("offered") - F.col("out"))
    return both.select(day, *(F.col(c).cast("double").alias(c) for c in ("registered", "offered", "out")), gap.cast("double").alias("unexplained"))


def native_load(rows: DataFrame, keys: list[str], gen: str, imports: str, exports: str, curtailed: str) -> DataFrame:
    """Native load = generation + imports - exports + curtailment above 0, and the net import."""
    def total(c):
        return F.sum(money(c))

    load = total(gen) + total(imports) - total(exports) + F.sum(F.greatest(F.lit(0).cast("decimal(18,4)"), money(curtailed)))
    return rows.groupBy(*keys).agg(load.cast("double").alias("load"), (total(imports) - total(exports)).cast("double").alias("net_import"))


def weekly_numbers(rows: DataFrame, week: Column, value: str, resource: str) -> DataFrame:
    """Rows, distinct resources and the largest value of each week."""
    return rows.groupBy(week.alias("week")).agg(F.count("*").alias("n"), F.count_distinct(resource).alias("resources"), F.max(value).alias("max"))


def newest_outages(rows: DataFrame, resource: str, file: list[str], grid: str, mw: str) -> DataFrame:
    """MW out per grid, each resource counted once by its newest row."""
    last = rows.groupBy(resource).agg(F.max(F.struct(*file, F.col(grid).alias("g"), F.col(mw).alias("v"))).alias("r")).select(F.col("r.g").alias(grid), F.col("r.v").alias("v"))
    return last.groupBy(grid).agg(F.count("*").alias("resources"), F.sum(money("v")).cast("double").alias("mw"))


def corridor_flow(rows: DataFrame, keys: list[str], flow: str, binding: Column) -> DataFrame:
    """Mean flow, binding intervals and all intervals of each hour."""
    return rows.groupBy(*keys).agg(half_up(exact_mean(money(flow))).alias("flow"), F.count_if(binding).alias("binding"), F.count("*").alias("n"))


def flagged_fraction(rows: DataFrame, keys: list[str], flag: Column, x: Column) -> DataFrame:
    """Mean of x, held between 0 and 1, over flagged rows only; null without one."""
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return rows.groupBy(*keys).agg(half_up(exact_mean(money(F.when(flag, held)))).alias("fraction"), F.count_if(flag).alias("flagged"))


def energy_reconciliation(parts: DataFrame, whole: DataFrame, keys: list[str], part: str, total: str) -> DataFrame:
    """Sum of the parts beside the reported total and the difference in percent of it."""
    own = parts.groupBy(*keys).agg(F.sum(money(half_up(F.col(part)))).alias("p")).join(whole.groupBy(*keys).agg(F.sum(money(total)).alias("t")), keys)
    return own.select(*keys, F.col("p").cast("double").alias("parts"), F.col("t").cast("double").alias("total"), half_up(100 * ratio(F.col("p") - F.col("t"), F.col("t"))).alias("off_percent"))


def reserve_layer(rows: DataFrame, keys: list[str], price: str, cap: float) -> DataFrame:
    """Mean, least and largest price and the share of intervals at the cap."""
    hit = F.count_if(F.col(price) >= cap)
    return rows.groupBy(*keys).agg(half_up(exact_mean(money(price))).alias("mean"), F.min(price).alias("min"), F.max(price).alias("max"), half_up(100 * ratio(hit, F.count("*"))).alias("cap_percent"))


def flow_score(pairs: DataFrame, keys: list[str], obs: Column, mod: Column, least: float) -> DataFrame:
    """Mean absolute error, and the share of equal directions among flows that are larger than `least`."""
    moved = F.abs(obs) > least
    same = F.count_if(moved & (F.signum(obs) == F.signum(mod)))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), half_up(exact_mean(F.abs(money(mod) - money(obs)))).alias("mae"), half_up(100 * ratio(same, F.count_if(moved))).alias("direction"))


def pool_validation(pairs: DataFrame, keys: list[str], obs: Column, mod: Column, exact: float, scarce: Column) -> DataFrame:
    """Share of hours within `exact`, scarce hours, and the error over the others."""
    gap = F.abs(money(mod) - money(obs))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("hours"), half_up(100 * ratio(F.count_if(gap <= exact), F.count("*"))).alias("exact_percent"), F.count_if(scarce).alias("scarce_hours"), half_up(exact_mean(F.when(~scarce, gap))).alias("mae")
    )


def ranges(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least and largest value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), half_up(exact_mean(money(value))).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def marginal_frequency(setters: DataFrame, keys: list[str], block: str) -> DataFrame:
    """How often each block sets the price, with its share of all."""
    n = setters.groupBy(*keys, block).agg(F.count("*").alias("n"))
    return n.join(setters.groupBy(*keys).agg(F.count("*").alias("all")), keys).select(*keys, block, "n", half_up(100 * ratio(F.col("n"), F.col("all"))).alias("share"))


def decomposition(rows: DataFrame, keys: list[str], observed: str, cost: str, premium: str) -> DataFrame:
    """Observed price = cost + premium + residual, as means; and the largest of the three by size."""
    mean = rows.groupBy(*keys).agg(*(exact_mean(money(c)).alias(n) for c, n in ((observed, "o"), (cost, "c"), (premium, "p"))))
    parts = mean.select(*keys, half_up(F.col("o")).alias("observed"), half_up(F.col("c")).alias("cost"), half_up(F.col("p")).alias("premium"), half_up(F.col("o") - F.col("c") - F.col("p")).alias("residual"))
    most = F.greatest(F.abs("cost"), F.abs("premium"), F.abs("residual"))
    return parts.withColumn("dominant", F.when(F.abs("cost") == most, "cost").when(F.abs("premium") == most, "premium").otherwise("residual"))


def additions(rows: DataFrame, keys: list[str], year: str, mw: str, horizon: int) -> DataFrame:
    """MW that comes by the horizon, later, and without a year."""
    y = F.col(year)
    when = F.when(y.isNull(), "no year").when(y <= horizon, "by horizon").otherwise("later")
    return rows.groupBy(*keys, when.alias("when")).agg(F.count("*").alias("n"), F.sum(money(mw)).cast("double").alias("mw"))


def observed_limit(rows: DataFrame, key: str, limit: str) -> DataFrame:
    """The largest limit above 0 that was seen of each equipment."""
    return rows.where(F.col(limit) > 0).groupBy(key).agg(F.max(limit).alias("limit"), F.count("*").alias("n"))


def mean_over_minutes(rows: DataFrame, keys: list[str], minute: Column, mw: str) -> DataFrame:
    """Sum inside a minute, then the mean over the minutes that occur."""
    per = rows.groupBy(*keys, minute.alias("_minute")).agg(F.sum(money(mw)).alias("s"))
    return per.groupBy(*keys).agg(F.count("*").alias("minutes"), half_up(exact_mean(F.col("s"))).alias("mw"))


def shares(rows: DataFrame, keys: list[str], part: str, mw: str) -> DataFrame:
    """Each part's MW and percent of its key's whole."""
    own = rows.groupBy(*keys, part).agg(F.sum(money(mw)).alias("v"))
    return own.join(rows.groupBy(*keys).agg(F.sum(money(mw)).alias("all")), keys).select(*keys, part, F.col("v").cast("double").alias("mw"), half_up(100 * ratio(F.col("v"), F.col("all"))).alias("percent"))


def load_pool(rows: DataFrame, keys: list[str], load: str) -> DataFrame:
    """Mean and population deviation from exact sums."""
    x = F.col(load).cast("decimal(18,4)")
    m = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).cast("double").alias("s"), F.sum((x * x).cast("decimal(38,8)")).cast("double").alias("q"))
    mean = F.col("s") / F.col("n")
    return m.select(*keys, "n", half_up(mean, 2).alias("mean"), half_up(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)), 2).alias("std"))


def growth_rate(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Compound growth a year, in percent, from the first to the last year; null over one year."""
    ends = rows.groupBy(*keys, year).agg(F.sum(money(value)).cast("double").alias("v")).groupBy(*keys).agg(F.min(F.struct(year, "v")).alias("a"), F.max(F.struct(year, "v")).alias("z"))
    years = F.col(f"z.{year}") - F.col(f"a.{year}")
    return ends.select(*keys, years.alias("years"), half_up(F.when(years > 0, 100 * (F.pow(F.col("z.v") / F.col("a.v"), F.lit(1.0) / years) - 1)), 3).alias("cagr"))


def consecutive_windows(days: DataFrame, day: str, length: int) -> DataFrame:
    """First days of windows of `length` observed days without a gap."""
    w = Window.partitionBy(F.lit(1)).orderBy(day)  # one row a day
    last = F.lead(day, length - 1).over(w)
    return days.select(day).distinct().select(F.col(day).alias("first_day"), last.alias("last_day")).where(F.datediff("last_day", "first_day") == length - 1)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def with_price_takers(offers: DataFrame, scheduled: DataFrame, floor: float, price: str) -> DataFrame:
    """Offers and, at the floor price, what is scheduled without one."""
    return offers.unionByName(scheduled.withColumn(price, F.lit(floor)))


def seeded_sample(rows: DataFrame, keys: list[str], name: Column, seed: int, k: int) -> DataFrame:
    """k rows of each key without replacement, by a hash of seed and name."""
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), name))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ticket))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def stack_invariants(stacked: DataFrame, keys: list[str], order: list[str], mw: str) -> DataFrame:
    """Whether the running total of each stack starts with its first block and never falls."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0))
    return stacked.withColumn("_ok", F.abs(step - F.col(mw)) < 1e-6).groupBy(*keys).agg(F.count("*").alias("blocks"), F.bool_and("_ok").alias("sound"))


def ramp_capability(rows: DataFrame, keys: list[str], unit: str, up_per_minute: Column, room: Column, minutes: int) -> DataFrame:
    """MW that a fleet can rise within `minutes`: each unit by its ramp or its room; and the share of units that its room, not the ramp, holds."""
    per = rows.groupBy(*keys, unit).agg(F.max(up_per_minute).alias("r"), F.max(room).alias("room"))
    inert = F.col("r") * minutes >= F.col("room")
    return per.groupBy(*keys).agg(F.sum(F.least(F.col("r") * minutes, F.col("room")).cast("decimal(18,4)")).cast("double").alias("mw"), half_up(100 * ratio(F.count_if(inert), F.count("*"))).alias("inert_percent"))


def firm_margin(supply: DataFrame, load: DataFrame, keys: list[str], mw: str, extra: float) -> DataFrame:
    """Firm margin over the peak in percent, as it is and with `extra` MW of load."""
    both = supply.groupBy(*keys).agg(F.sum(money(mw)).cast("double").alias("firm")).join(load.groupBy(*keys).agg(F.max("load").alias("peak")), keys)
    return both.select(*keys, "firm", "peak", *(half_up(100 * ratio(F.col("firm") - F.col("peak") - x, F.col("peak") + x)).alias(n) for x, n in ((0.0, "margin"), (extra, "margin_with_more"))))


def polyline_km(points: DataFrame, keys: list[str], order: str, lon: str, lat: str) -> DataFrame:
    """Length of a line through its points in order, by great circles."""
    w = Window.partitionBy(*keys).orderBy(order)
    rad = F.radians
    dlat, dlon = rad(F.col(lat) - F.col("_lat")), rad(F.col(lon) - F.col("_lon"))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(rad(F.col("_lat"))) * F.cos(rad(F.col(lat))) * F.pow(F.sin(dlon / 2), 2)
    km = 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    steps = points.withColumns({"_lat": F.lag(lat).over(w), "_lon": F.lag(lon).over(w)}).withColumn("_km", half_up(km, 3).cast("decimal(18,3)"))
    return steps.groupBy(*keys).agg(F.count("*").alias("points"), F.coalesce(F.sum("_km").cast("double"), F.lit(0.0)).alias("km"))
