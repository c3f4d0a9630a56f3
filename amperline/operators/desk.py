"""Reports of a trading desk: matched equipment, adequacy, intervals of correlation, instructions, nodes, reserve, storage, levers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, money, ratio
from amperline.operators.geometry import best_pairs
from amperline.operators.ranked import at_places, between, interpolated, placed

#: Fixed forms of equipment codes: a transformer of a station, a circuit between two.
TRANSFORMER, CIRCUIT = r"^\d{0,2}([A-Z]+?)\d*_TR\d*$", r"^\d{0,2}([A-Z]+?)\d*_\d{0,2}([A-Z]+?)(\d+)?$"


def match_report(equipment: DataFrame, code: str, volts: str, candidates: DataFrame, paths: DataFrame, places: DataFrame) -> DataFrame:
    """(code, kind, a, b, metres, why): what each code stands for on the map, or why it stands for nothing.

    candidates: (token, station, voltage) of station tokens; paths: (a, b, metres); places:
    (station, lon, lat). A transformer needs one candidate, after those whose voltage tag carries the
    code's level if there are any; a circuit needs a best pair of candidates.
    """
    trafo, first, second = F.regexp_extract(code, TRANSFORMER, 1), F.regexp_extract(code, CIRCUIT, 1), F.regexp_extract(code, CIRCUIT, 2)
    kind = F.when(trafo != "", "station").when(first != "", "line").otherwise("unparsed")
    own = equipment.select(code, volts, kind.alias("kind"), F.when(trafo != "", trafo).otherwise(first).alias("_a"), second.alias("_b"))
    near = own.where("kind = 'station'").join(candidates, F.col("_a") == F.col("token"))
    fits = F.contains(F.coalesce("voltage", F.lit("")), F.concat(volts, F.lit("000")))
    level = near.withColumn("_fit", F.coalesce(fits, F.lit(False))).withColumn("_any", F.max("_fit").over(Window.partitionBy(code)))
    stations = level.where("_fit OR NOT _any").groupBy(code).agg(F.count("*").alias("n"), F.min("station").alias("station"))
    lines = own.where("kind = 'line'")
    sides = {s: lines.join(candidates, F.col(f"_{s}") == F.col("token")).select(code, F.col("station").alias(s)) for s in "ab"}
    has = sides["a"].select(code).distinct().join(sides["b"].select(code).distinct(), code).withColumn("_has", F.lit(True))
    best = best_pairs(lines.select(code), code, sides["a"], sides["b"], paths, places)
    out = own.join(stations, code, "left").join(has, code, "left").join(best, code, "left")
    why = (
        F.when(F.col("kind") == "unparsed", "unparsed code")
        .when(F.col("kind") == "station", F.when(F.col("n").isNull(), "station token unresolved").when(F.col("n") > 1, "station token ambiguous"))
        .when(F.col("_has").isNull(), "station token unresolved")
        .when(F.col("a").isNull(), "no plausible path in the graph")
    )
    return out.select(code, "kind", F.when(F.col("kind") == "station", F.when(F.col("n") == 1, F.col("station"))).otherwise(F.col("a")).alias("a"), "b", "metres", why.alias("why"))


def adequacy(available: DataFrame, demand: DataFrame, outages: DataFrame | None, grid: str, fuel: str, hour: str, added: float = 0.0) -> DataFrame:
    """(grid, firm, peak, margin, tight_hour, tight_mw): margin of the peak hour's available MW over the peak demand in percent, and the hour with the least MW to spare, the first of equals.

    available: (grid, fuel, hour, mw); demand: (grid, hour, mw); outages (grid, fuel, mw) come off
    their fuel in every hour, to no less than 0; `added` MW of load stand in every hour.
    """
    fuels = available.groupBy(grid, fuel, hour).agg(F.sum(money("mw")).alias("mw"))
    if outages is not None:
        out = outages.groupBy(grid, fuel).agg(F.sum(money("mw")).alias("_out"))
        fuels = fuels.join(out, [grid, fuel], "left").withColumn("mw", F.greatest(F.lit(0).cast("decimal(28,4)"), F.col("mw") - F.coalesce("_out", F.lit(0).cast("decimal(28,4)"))))
    have = fuels.groupBy(grid, hour).agg(F.sum("mw").cast("double").alias("have"))
    need = demand.groupBy(grid, hour).agg((F.sum(money("mw")).cast("double") + added).alias("need"))
    both = have.join(need, [grid, hour]).withColumn("spare", half_up(F.col("have") - F.col("need"), 1))
    at = both.groupBy(grid).agg(F.max(F.struct("need", (-F.col(hour)).alias("h"), "have")).alias("top"), F.min(F.struct("spare", hour)).alias("low"))
    return at.select(grid, half_up(F.col("top.have"), 1).alias("firm"), half_up(F.col("top.need"), 1).alias("peak"), half_up(100 * ratio(F.col("top.have") - F.col("top.need"), F.col("top.need")), 1).alias("margin"), F.col(f"low.{hour}").alias("tight_hour"), F.col("low.spare").alias("tight_mw"))


def fisher_interval(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The confidence interval of a correlation of n pairs; null for 3 pairs or fewer, or where |r| is 1."""
    fine = (n > 3) & (F.abs(r) < 1)
    half = z / F.sqrt(F.when(fine, n - 3).cast("double"))
    return half_up(F.tanh(F.when(fine, F.atanh(r)) - half), 3), half_up(F.tanh(F.when(fine, F.atanh(r)) + half), 3)


def instruction_weeks(rows: DataFrame, week: str, resource: str, mw: str) -> DataFrame:
    """(week, n_rows, n_resources, median, most, large): instructions of each week; large: of 100 MW and more."""
    values = at_places(rows, [week], mw, between(0.5, "m"))
    sums = rows.groupBy(week).agg(F.count("*").alias("n_rows"), F.count_distinct(resource).alias("n_resources"), F.max(mw).alias("most"), F.count_if(F.col(mw) >= 100).alias("large"))
    return sums.join(values, week).select(week, "n_rows", "n_resources", half_up(interpolated(0.5, "m", F.col("n")), 1).alias("median"), half_up(F.col("most"), 1).alias("most"), "large")


def peak_then_median(rows: DataFrame, region: str, keys: list[str], mw: str) -> DataFrame:
    """(region, hours, median): the median over a region's hours of each hour's largest instruction."""
    peaks = rows.groupBy(region, *keys).agg(F.max(mw).alias("_p"))
    out = at_places(peaks, [region], "_p", between(0.5, "m"))
    return out.select(region, F.col("n").alias("hours"), half_up(interpolated(0.5, "m", F.col("n")), 1).alias("median"))


def node_observation(rows: DataFrame, day: str, grid: str, node: str, hour: str, value: str, mw: str, k: int) -> DataFrame:
    """(grid, node, days, mean, evening, noon, mw, side): nodes by their mean over days of daily means, the k lowest and highest of each grid.

    evening and noon: the mean over days of hour 19 and 12 alone; mw: of the absolute MW. A node
    among both ends is the lowest.
    """
    def at(h):
        return exact_mean(F.when(F.col(hour) == h, money(value))).cast("decimal(18,4)")

    daily = rows.groupBy(day, grid, node).agg(exact_mean(money(value)).cast("decimal(18,4)").alias("v"), at(19).alias("e"), at(12).alias("n"), exact_mean(F.abs(money(mw))).cast("decimal(18,4)").alias("m"))
    mean = lambda c: half_up(exact_mean(F.col(c)))
    nodes = daily.groupBy(grid, node).agg(F.count("*").alias("days"), mean("v").alias("mean"), mean("e").alias("evening"), mean("n").alias("noon"), mean("m").alias("mw"))
    i, n = F.col("_place"), F.col("_n")
    side = F.when(i < k, "low").when(i >= n - k, "high")
    return placed(nodes, [grid], [F.asc("mean"), F.asc(node)]).withColumn("side", side).where("side IS NOT NULL").drop("_place", "_n")


def system_reserve(rows: DataFrame, interval: str, key: str, mw: str, price: str, cap: float) -> DataFrame:
    """(key, n, mean, least, most, cap_share, system_mean, top_decile): prices of each key, how often they are at the cap, and the mean MW of its intervals, of all and of the tenth with the most."""
    own = rows.groupBy(key).agg(F.count("*").alias("n"), half_up(exact_mean(money(price))).alias("mean"), F.min(price).alias("least"), F.max(price).alias("most"), half_up(100.0 * F.count_if(F.col(price) >= cap - 1e-9) / F.count("*"), 1).alias("cap_share"))
    sums = rows.groupBy(key, interval).agg(F.sum(money(mw)).alias("_mw"))
    ordered = placed(sums, [key], [F.desc("_mw"), F.asc(interval)])
    top = F.col("_place") < F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / 10))
    deciles = ordered.groupBy(key).agg(half_up(exact_mean(F.col("_mw").cast("decimal(28,4)")), 1).alias("system_mean"), half_up(exact_mean(F.when(top, F.col("_mw").cast("decimal(28,4)"))), 1).alias("top_decile"))
    return own.join(deciles, key)


def storage_schedule(hours: DataFrame, keys: list[str], hour: str, price: str, demand: str, power: int, energy: int, efficiency: float) -> DataFrame:
    """(keys, hour, charge, discharge, held) of a store over each key's hours: it buys in the cheapest hours and sells in the dearest, in tenths of MW.

    Hours are ranked by (price, demand, hour). As many cheapest ones as fill the store charge, and as
    many dearest ones of the others as empty it discharge; the state of charge then goes down the day.
    """
    buy = -(-energy * 1000 // int(power * efficiency * 1000))
    sell = -(-energy // power)
    w = Window.partitionBy(*keys)
    place, n = F.row_number().over(w.orderBy(price, demand, hour)), F.count("*").over(w)
    sells = F.least(F.lit(sell), F.greatest(F.lit(0).cast("long"), n - F.least(n, F.lit(buy))))
    ranked = hours.select(*keys, hour, F.when(place <= buy, 1).when(place > n - sells, -1).otherwise(0).alias("_role"))
    days = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(hour, "_role"))).alias("_h"))
    tenth = lambda c: F.floor(c * 10 + 1e-9) / 10
    start = F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("charge"), F.lit(0.0).alias("discharge"))

    def after(x, held):
        charge = F.when((x["_role"] == 1) & (held < energy - 1e-9), tenth(F.least(F.lit(float(power)), (energy - held) / efficiency))).otherwise(0.0)
        discharge = F.when((x["_role"] == -1) & (held > 1e-9), tenth(F.least(F.lit(float(power)), held))).otherwise(0.0)
        return F.struct((held + charge * efficiency - discharge).alias("held"), charge.alias("charge"), discharge.alias("discharge"))

    # a day has 24 hours or so: the state after each hour is folded from the day's first hours
    state = F.transform("_h", lambda x, i: F.struct(x[hour].alias(hour), F.aggregate(F.slice("_h", F.lit(1), i + 1), start, lambda acc, y: after(y, acc["held"])).alias("s")))
    out = days.select(*keys, F.inline(state))
    return out.select(*keys, hour, half_up(F.col("s.charge"), 1).alias("charge"), half_up(F.col("s.discharge"), 1).alias("discharge"), half_up(F.col("s.held"), 1).alias("held"))


def raised_share(raised: DataFrame, generated: DataFrame, grid: str, keys: list[str]) -> DataFrame:
    """(grid, hours, share): MW raised by the operator as a percentage of what was generated in the hours with a raise; hours without generation do not count."""
    both = raised.where("mw > 0").select(grid, *keys, F.col("mw").alias("_r")).join(generated.where("mw <> 0").select(grid, *keys, F.col("mw").alias("_g")), [grid, *keys])
    return both.groupBy(grid).agg(F.count("*").alias("hours"), half_up(100 * ratio(F.sum(money("_r")), F.sum(money("_g"))), 2).alias("share"))


def both_known(modeled: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, modeled, observed) where both sides have a value."""
    return modeled.select(*keys, "modeled").join(observed.select(*keys, "observed"), keys).where("modeled IS NOT NULL AND observed IS NOT NULL")


def commodity(c: Column) -> Column:
    """En for energy, Fr, Dr, Ru and Rd for reserves, in any case; null for others."""
    known = F.create_map(*(F.lit(x) for k in ("En", "Fr", "Dr", "Ru", "Rd") for x in (k.upper(), k)))
    return F.element_at(known, F.upper(F.trim(c)))


def first_interval(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The rows of the first stamp of each key."""
    first = F.min(stamp).over(Window.partitionBy(*keys))
    return rows.withColumn("_first", first).where(F.col(stamp) == F.col("_first")).drop("_first")


def apply_levers(blocks: DataFrame, fuel: str, cost: str, mw: str, carbon_price: float, tonnes: dict[str, float], scales: dict[str, float]) -> DataFrame:
    """Blocks with the price of their carbon on top of their cost, and with fuels' MW scaled; blocks without MW are left out."""
    def of(values: dict[str, float], default: float) -> Column:
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(fuel)), F.lit(default))

    return blocks.withColumns({cost: half_up(F.col(cost) + F.lit(carbon_price) * of(tonnes, 0.0)), mw: half_up(F.col(mw) * of(scales, 1.0))}).where(F.col(mw) > 0)


def sound_days(rows: DataFrame, day: str, hour: str, whole: Column, parts: list[Column], most: float, hours: int) -> DataFrame:
    """Rows of the days on which every price is the sum of its parts to within `most` and at least `hours` hours have rows."""
    residual = F.abs(money(whole) - sum((money(p) for p in parts), F.lit(0).cast("decimal(18,4)")))
    good = rows.groupBy(day).agg(F.max(residual).alias("_r"), F.count_distinct(hour).alias("_h")).where((F.col("_r") <= most) & (F.col("_h") >= hours)).select(day)
    return rows.join(good, day, "left_semi")


def nodal_hours(rows: DataFrame, keys: list[str], price: str, reference: str, congestion: str, mw: str) -> DataFrame:
    """Per key (day, grid, node, hour): rows, mean deviation from the reference price, mean MW, mean of the congestion parts that aren't 0 (null without any)."""
    part = F.when(F.col(congestion) != 0, money(congestion))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), half_up(exact_mean(money(F.col(price) - F.col(reference))), 3).alias("deviation"), half_up(exact_mean(money(mw)), 2).alias("mw"), half_up(exact_mean(part), 3).alias("congestion")
    )


def reference_hours(rows: DataFrame, keys: list[str], interval: str, reference: str) -> DataFrame:
    """Per key (day, grid, hour): mean over intervals of each interval's most frequent reference price to 2 digits (of equals the least), intervals, and those with more than one price."""
    counted = rows.groupBy(*keys, interval, half_up(F.col(reference), 2).alias("_v")).count()
    modal = counted.groupBy(*keys, interval).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("_v").alias("v"))).alias("m"), F.count("*").alias("_k"))
    return modal.groupBy(*keys).agg(F.count("*").alias("intervals"), F.count_if(F.col("_k") > 1).alias("multimodal"), half_up(exact_mean(money(F.col("m.v")))).alias("reference"))
