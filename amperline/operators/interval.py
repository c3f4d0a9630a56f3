"""Aggregations of interval rows: leagues, means by hour, regimes, credits, pooled shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, money, ratio
from amperline.operators.ranked import at_places, between, interpolated


def hourly_mean(rows: DataFrame, keys: list[str], hour: Column, value: str) -> DataFrame:
    """(keys, hour, n, mean)."""
    return rows.groupBy(*keys, hour.alias("hour")).agg(F.count("*").alias("n"), half_up(exact_mean(money(value))).alias("mean"))


def day_slots(hourly: DataFrame, keys: list[str], value: str) -> DataFrame:
    """24 slots a key; a slot without an observation is null, not 0."""
    slots = hourly.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return slots.join(hourly.select(*keys, "hour", value), [*keys, "hour"], "left")


def congestion_league(rows: DataFrame, keys: list[str], source: str, day: str, overload: str, percent: str, base_case: Column) -> DataFrame:
    """One row per equipment: distinct days in all and by source, rows by source, maxima from 0, base-case rows."""
    def days(s):
        return F.count_distinct(F.when(F.col(source) == s, F.col(day)))

    return rows.groupBy(*keys).agg(
        F.count_distinct(day).alias("days"), days("RTD").alias("rtd_days"), days("DAP").alias("dap_days"),
        F.count_if(F.col(source) == "RTD").alias("rtd_intervals"), F.count_if(F.col(source) == "DAP").alias("dap_rows"),
        F.greatest(F.max(overload), F.lit(0.0)).alias("max_overload"), F.greatest(F.max(percent), F.lit(0.0)).alias("max_percent"),
        F.count_if(base_case).alias("base_case_rows"),
    )


def league_top(league: DataFrame, name: str, k: int = 30) -> DataFrame:
    """The first k by days, RTD days, DAP days, name."""
    return league.orderBy(F.desc("days"), F.desc("rtd_days"), F.desc("dap_days"), name).limit(k)


def corridor_receipts(rows: DataFrame, name: str, patterns: DataFrame, day: str) -> DataFrame:
    """Rows, days and distinct equipment of each corridor; a name belongs to a corridor if it starts with one of its patterns."""
    hit = rows.join(F.broadcast(patterns), F.col(name).startswith(F.col("pattern")))  # patterns: a constant dimension
    per_name = hit.groupBy("corridor", name, day).agg(F.count("*").alias("n"), F.count_distinct("pattern").alias("k"))
    return per_name.groupBy("corridor").agg(F.sum(F.col("n") / F.col("k")).cast("long").alias("intervals"), F.count_distinct(day).alias("days"), F.count_distinct(name).alias("equipment"))


def mode_by(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent value of each key; of equal counts the least value."""
    counted = rows.groupBy(*keys, value).count()
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("count", F.lit(0))).alias("_"), F.min(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias(out))


def equipment_collapse(league: DataFrame, key: str, days: str, intervals: str, voltage: str) -> DataFrame:
    """Per equipment the largest day count, all intervals and the usual voltage."""
    sums = league.groupBy(key).agg(F.max(days).alias("days"), F.sum(intervals).alias("intervals"))
    return sums.join(mode_by(league, [key], voltage, "voltage"), key)


def reliability_daily(rows: DataFrame, day: str, grid: str, bid: str, curtailed: str, slack: str) -> DataFrame:
    """Per day and grid: largest bid, curtailed MWh of five-minute rows, least slack, rows short of it; absent pairs are 0."""
    own = rows.groupBy(day, grid).agg(F.max(money(bid)).alias("peak"), F.sum(money(curtailed)).alias("mw"), F.min(money(slack)).alias("least"), F.count_if(F.col(slack) < 0).alias("short"))
    dense = rows.select(day).distinct().join(rows.select(grid).distinct(), how="cross")
    zero = F.lit(0.0)
    return dense.join(own, [day, grid], "left").select(
        day, grid, F.coalesce(F.col("peak").cast("double"), zero).alias("peak"), half_up(F.coalesce(F.col("mw").cast("double"), zero) * 5 / 60).alias("curtailed_mwh"),
        F.coalesce(F.col("least").cast("double"), zero).alias("min_slack"), F.coalesce("short", F.lit(0)).alias("short_rows"),
    )


def reliability_totals(daily: DataFrame, day: str, grid: str) -> DataFrame:
    """Per grid: totals, median of the daily minima, day of the largest peak (the first of equals)."""
    return daily.groupBy(grid).agg(
        half_up(F.sum(money("curtailed_mwh")).cast("double")).alias("curtailed_mwh"), F.sum("short_rows").alias("short_rows"),
        half_up(F.median("min_slack")).alias("median_min_slack"),
        F.min(F.struct((-F.col("peak")).alias("p"), F.col(day).alias("d")))["d"].alias("peak_day"),
    )


def price_spread(rows: DataFrame, day: str, grid: str, price: str) -> DataFrame:
    """Per day the spread between the dearest and the cheapest grid's mean; null with fewer than two grids."""
    means = rows.groupBy(day, grid).agg(exact_mean(money(price)).alias("mean"))
    return means.groupBy(day).agg(F.count("mean").alias("grids"), half_up(F.when(F.count("mean") >= 2, F.max("mean") - F.min("mean"))).alias("spread"))


def regime_stats(rows: DataFrame, spread: DataFrame, day: str, grid: str, price: str, resumed: str, wide: float) -> DataFrame:
    """Per regime (market from `resumed` on): days, mean price, days with a spread over `wide`; regimes are never mixed."""
    regime = F.when(F.col(day) >= F.lit(resumed), "market").otherwise("administered").alias("regime")
    a = rows.groupBy(regime).agg(half_up(exact_mean(money(price))).alias("mean_price"), F.count("*").alias("rows"))
    b = spread.groupBy(regime).agg(F.count("*").alias("days"), F.count_if(F.col("spread") > wide).alias("wide_days"), F.max("spread").alias("max_spread"))
    return a.join(b, "regime")


def equal_width_bins(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """n, mean and median of y in bins of equal width over x; the top edge belongs to the last bin."""
    span = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).where((F.col("n") >= bins) & (F.col("hi") > F.col("lo")))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / width)).cast("int")
    one = rows.join(F.broadcast(span.select("lo", "hi")), how="cross").select(k.alias("bin"), F.col(y))  # one row of limits
    means = one.groupBy("bin").agg(F.count("*").alias("n"), half_up(exact_mean(money(y))).alias("mean"))
    middles = at_places(one, ["bin"], y, between(0.5, "med")).select(F.col("bin").alias("_bin"), half_up(interpolated(0.5, "med", F.col("n"))).alias("median"))
    return means.join(middles, F.col("bin").eqNullSafe(F.col("_bin"))).drop("_bin")


def widest_swing(rows: DataFrame, keys: list[str], day: str, value: str, at_least: int) -> DataFrame:
    """Per key the day with the widest swing among days with enough rows; the first of equals."""
    swings = rows.groupBy(*keys, day).agg(F.count("*").alias("n"), (F.max(money(value)) - F.min(money(value))).cast("double").alias("swing")).where(F.col("n") >= at_least)
    best = F.min(F.struct((-F.col("swing")).alias("s"), F.col(day).alias("d"), F.col("n").alias("n")))
    return swings.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.d").alias(day), (-F.col("b.s")).alias("swing"), F.col("b.n").alias("n"))


def mean_of_means(rows: DataFrame, keys: list[str], interval: str, value: str) -> DataFrame:
    """Mean over intervals of each interval's mean, so that ties in an interval count once."""
    inner = rows.groupBy(*keys, interval).agg(exact_mean(money(value)).alias("m"))
    return inner.groupBy(*keys).agg(F.count("*").alias("intervals"), half_up(exact_mean(F.col("m").cast("decimal(28,10)"))).alias("mean"))


def fractional_credit(rows: DataFrame, keys: list[str], interval: str, resource: str, price: str, k: int) -> DataFrame:
    """Credit of 1/k to each of k resources tied in an interval; share of intervals and row-weighted mean price; top k per key."""
    ties = rows.groupBy(*keys, interval).agg(F.count_distinct(resource).alias("k"))
    intervals = ties.groupBy(*keys).agg(F.count("*").alias("all"))
    per = rows.groupBy(*keys, interval, resource).agg(F.sum(money(price)).alias("p"), F.count("*").alias("n")).join(ties, [*keys, interval])
    sums = per.groupBy(*keys, resource).agg(F.sum((1.0 / F.col("k")).cast("decimal(20,12)")).alias("credit"), F.sum("p").alias("p"), F.sum("n").alias("n")).join(intervals, keys)
    out = sums.select(*keys, resource, half_up(F.col("credit").cast("double")).alias("credit"), half_up(100 * ratio(F.col("credit"), F.col("all"))).alias("share"), half_up(ratio(F.col("p"), F.col("n"))).alias("mean_price"))
    return top_k(out, keys, [F.desc("credit"), F.col(resource)], k)


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def dense_daily(rows: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """A row for each day and key seen anywhere; the daily mean is null where there is none."""
    own = rows.groupBy(day, *keys).agg(half_up(exact_mean(money(value))).alias("mean"))
    grid = rows.select(day).distinct().join(rows.select(*keys).distinct(), how="cross")
    return grid.join(own, [day, *keys], "left")


def full_days(rows: DataFrame, day: str, keys: list[str], slots: int) -> DataFrame:
    """Days that have all `slots` combinations of the keys."""
    return rows.groupBy(day).agg(F.count_distinct(*keys).alias("slots")).where(F.col("slots") == slots)


def pinned_windows(rows: DataFrame, key: list[str], side: str, value: str, position: str) -> DataFrame:
    """Per window the last value of each side (by position) and whether both sides are equal."""
    def last(s):
        return F.max(F.when(F.col(side) == s, F.struct(position, value)))[value]

    return rows.groupBy(*key).agg(last("MAX").alias("most"), last("MIN").alias("least")).withColumn("pinned", F.coalesce(F.col("most") == F.col("least"), F.lit(False)))


def latest_revision(rows: DataFrame, keys: list[str], revision: list[str]) -> DataFrame:
    """The row with the greatest revision of each key."""
    rest = [c for c in rows.columns if c not in keys and c not in revision]
    return rows.groupBy(*keys).agg(F.max(F.struct(*revision, *rest)).alias("r")).select(*keys, "r.*")


def deviation_from_mean(rows: DataFrame, day: str, keys: list[str], value: str, least: float) -> DataFrame:
    """Each day's value minus the mean over all days (absent: 0); small deviations are dropped."""
    own = rows.groupBy(day, *keys).agg(F.sum(money(value)).alias("v"))
    n = rows.agg(F.count_distinct(day).alias("n_days"))
    mean = own.groupBy(*keys).agg(F.sum("v").alias("all")).join(F.broadcast(n), how="cross")  # one row
    grid = mean.join(F.broadcast(rows.select(day).distinct()), how="cross")  # a calendar's days, so many rows at most
    dev = half_up(F.coalesce(F.col("v").cast("double"), F.lit(0.0)) - ratio(F.col("all"), F.col("n_days")))
    return grid.join(own, [day, *keys], "left").select(day, *keys, dev.alias("deviation")).where(F.abs("deviation") >= least)


def modal_then_mean(rows: DataFrame, keys: list[str], interval: str, value: str) -> DataFrame:
    """Mean over intervals of each interval's most frequent value (of equals the least)."""
    modal = mode_by(rows, [*keys, interval], value, "modal")
    return modal.groupBy(*keys).agg(F.count("*").alias("intervals"), half_up(exact_mean(money("modal"))).alias("mean"))


def weighted_price(rows: DataFrame, keys: list[str], price: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg(half_up(ratio(F.sum(money(price) * money(weight)), F.sum(money(weight)))).alias("price"), F.sum(money(weight)).cast("double").alias("weight"))


def pooled_percent(daily: DataFrame, keys: list[str], percent: str, n: str) -> DataFrame:
    """Percentages pooled over days by the number of observations."""
    return daily.groupBy(*keys).agg(half_up(ratio(F.sum(money(percent) * F.col(n)), F.sum(n))).alias("percent"), F.sum(n).alias("n"))


def concentration(sales: DataFrame, firm: str, value: str) -> DataFrame:
    """Herfindahl index, the two largest shares and the band of the market."""
    firms = sales.groupBy(firm).agg(F.sum(money(value)).alias("v"))
    total = firms.agg(F.sum("v").alias("t"))
    share = (F.col("v").cast("double") / F.col("t").cast("double")).cast("decimal(20,14)")
    shares = firms.join(F.broadcast(total), how="cross").select(share.alias("s"))  # one row
    top = shares.orderBy(F.desc("s")).limit(2).agg(F.sum("s").alias("top2"))
    hhi = shares.agg(F.sum((F.col("s").cast("double") * F.col("s").cast("double")).cast("decimal(30,20)")).alias("h"), F.count("*").alias("firms"))
    h = half_up(F.col("h").cast("double") * 10000)
    return hhi.join(F.broadcast(top), how="cross").select("firms", h.alias("hhi"), half_up(100 * F.col("top2").cast("double")).alias("top2_share"), F.when(h < 1500, "unconcentrated").when(h < 2500, "moderate").otherwise("high").alias("band"))


def binding_causes(hours: DataFrame, keys: list[str], cause: Column) -> DataFrame:
    """Tally of causes with their share of a key's hours."""
    n = hours.groupBy(*keys, cause.alias("cause")).agg(F.count("*").alias("n"))
    return n.withColumn("share", half_up(100 * ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*keys)))))


def emissions(rows: DataFrame, fuel: str, mwh: str, factors: DataFrame) -> DataFrame:
    """Tonnes per fuel by the factor table."""
    sums = rows.groupBy(fuel).agg(F.sum(money(mwh)).alias("mwh"))
    return sums.join(F.broadcast(factors), fuel).select(fuel, F.col("mwh").cast("double").alias("mwh"), half_up((F.col("mwh") * F.col("factor")).cast("double")).alias("tonnes"))


def clean_days(flags: DataFrame, day: str, flag: str, n: str, share: float) -> DataFrame:
    """Days on which at least `share` of the rows are flagged OK."""
    ok = F.sum(F.when(F.col(flag) == "OK", F.col(n)).otherwise(0))
    return flags.groupBy(day).agg(half_up(ratio(ok, F.sum(n))).alias("ok_share")).where(F.col("ok_share") >= share)


def present_nodes(rows: DataFrame, node: str, day: str, share: float) -> DataFrame:
    """Nodes seen on at least max(1, floor(share * days)) days."""
    n = rows.agg(F.count_distinct(day).alias("all"))
    seen = rows.groupBy(node).agg(F.count_distinct(day).alias("days"))
    return seen.join(F.broadcast(n), how="cross").where(F.col("days") >= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("all")))).drop("all")


def thin(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k evenly spaced rows of each key: rows floor(i * n / k); all rows where there are at most k."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    ranked = rows.withColumns({"_i": i, "_n": n})
    # row j is taken if some i in 0..k-1 has floor(i * n / k) = j
    first = F.ceil(F.col("_i") * k / F.col("_n"))
    return ranked.where((F.col("_n") <= k) | ((F.floor(first * F.col("_n") / k) == F.col("_i")) & (first < k))).drop("_i", "_n")
