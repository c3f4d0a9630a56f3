"""Supply stacks and books: segments, merit order, clearing, dispatch cuts, the coupled clear."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, money

CAP = 32.0


def segments(offers: DataFrame, keys: list[str], prices: list[str], quantities: list[str]) -> DataFrame:
    """Widths of cumulative breakpoints: stops at the first blank, skips what does not rise over the largest quantity before it."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(p).try_cast("double").alias("price"), F.col(q).try_cast("double").alias("q")) for i, (p, q) in enumerate(zip(prices, quantities, strict=True), 1)))
    blank = F.filter(pairs, lambda x: x["price"].isNull() | x["q"].isNull())
    stop = F.coalesce(F.get(blank, F.lit(0))["i"], F.lit(len(prices) + 1))
    used = offers.select(*keys, F.filter(pairs, lambda x: x["i"] < stop).alias("s"))
    before = F.transform("s", lambda x, i: F.greatest(F.lit(0.0), F.array_max(F.transform(F.slice("s", 1, i), lambda y: y["q"]))))
    rows = used.withColumn("b", before).select(*keys, F.inline(F.arrays_zip("s", "b")))
    return rows.select(*keys, F.col("s.i").alias("segment"), F.col("s.price").alias("price"), half_up(F.col("s.q") - F.col("b")).alias("width")).where("width > 1e-9")


def build_stack(plants: DataFrame, keys: list[str], cost: str, mw: str, fuel: str, committed_share: float, committed_cost: float) -> DataFrame:
    """Blocks above 0 MW; coal is split into a committed part at its own cost and the rest."""
    coal = F.col(fuel) == "coal"
    parts = F.when(coal, F.array(F.struct((F.col(mw) * committed_share).alias("mw"), F.lit(committed_cost).alias("cost")), F.struct((F.col(mw) * (1 - committed_share)).alias("mw"), F.col(cost).alias("cost")))).otherwise(
        F.array(F.struct(F.col(mw).cast("double").alias("mw"), F.col(cost).alias("cost")))
    )
    return plants.select(*keys, F.col(fuel).alias("fuel"), F.inline(parts)).where("mw > 0")


def running_stack(blocks: DataFrame, keys: list[str], cost: str, mw: str, ties: list[str]) -> DataFrame:
    """Blocks with the MW up to and including each in merit order."""
    w = Window.partitionBy(*keys).orderBy(cost, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("cum", F.sum(mw).over(w))


def clear(stacked: DataFrame, keys: list[str], cost: str, mw: str, demand: Column, ties: list[str]) -> DataFrame:
    """Price of the block that reaches the demand, served and missing MW; short of supply the cap is the price."""
    order = F.struct(cost, *ties)
    cleared = stacked.withColumn("_d", demand).groupBy(*keys).agg(F.max("_d").alias("demand"), F.sum(mw).alias("available"), F.min(F.when(F.col("cum") >= F.col("_d"), order)).alias("_m"))
    return cleared.select(*keys, "demand", "available", F.least("demand", "available").alias("served"), F.greatest(F.lit(0), F.col("demand") - F.col("available")).alias("shortfall"), F.coalesce(F.col(f"_m.{cost}"), F.lit(CAP)).alias("price"))


def fuel_split(stacked: DataFrame, keys: list[str], fuel: str, mw: str, served: Column) -> DataFrame:
    """MW of each fuel below the served quantity."""
    own = F.greatest(F.lit(0), F.least(F.col(mw), served - (F.col("cum") - F.col(mw))))
    return stacked.select(*keys, fuel, own.alias("own")).groupBy(*keys, fuel).agg(F.sum("own").alias("mw")).where("mw > 0")


def sample_curve(stacked: DataFrame, keys: list[str], cost: str, mw: str, step: int) -> DataFrame:
    """The stack's price at step, 2 step, ... MW: each block gives the samples inside it."""
    first, last = F.floor((F.col("cum") - F.col(mw)) / step) + 1, F.floor(F.col("cum") / step)
    samples = F.when(last >= first, F.sequence(first.cast("int"), last.cast("int")))
    return stacked.select(*keys, F.explode(samples).alias("_k"), F.col(cost).alias("price")).select(*keys, (F.col("_k").cast("long") * step).alias("mw_point"), "price")


def leave_one_out_median(samples: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Upper median over the other days, for each day: from one sorted array per key, not a join of days with days."""
    a = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(value, day))).alias("s"))
    each = a.select(*keys, "s", F.posexplode("s").alias("i", "x")).withColumn("m", F.floor((F.size("s") - 1) / 2).cast("int"))
    # without row i the upper median of n - 1 values is row m, or m + 1 if i comes before or at it
    at = F.when(F.col("i") <= F.col("m"), F.col("m") + 1).otherwise(F.col("m"))
    return each.where(F.size("s") > 1).select(*keys, F.col(f"x.{day}").alias(day), F.get("s", at)[value].alias("median"))


def dispatch_cut(rows: DataFrame, keys: list[str], side: str, order: str, resource: str, mw: str) -> DataFrame:
    """Dispatched MW, headroom of the first undispatched block, resources on both sides of the cut, the last undispatched row."""
    on, off = F.col(side) == "DP", F.col(side) == "ND"
    cut = rows.groupBy(*keys).agg(
        F.sum(F.when(on, F.col(mw))).alias("dispatched"), F.min(F.when(off, F.struct(order, mw)))[mw].alias("headroom"), F.max(F.when(off, F.struct(order, resource)))[resource].alias("next_up"),
    )
    both = rows.groupBy(*keys, resource).agg((F.count_if(on) > 0).alias("_on"), (F.count_if(off) > 0).alias("_off"))
    marginal = both.groupBy(*keys).agg(F.count_if(F.col("_on") & F.col("_off") & F.col(resource).isNotNull()).cast("int").alias("marginal"))
    return cut.alias("c").join(marginal.alias("m"), reduce(lambda x, y: x & y, (F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys))).select("c.*", "m.marginal")


def cut_summary(cuts: DataFrame, keys: list[str], cut: str, observed: DataFrame) -> DataFrame:
    """(keys, cuts, mean, least and largest headroom, share of cuts with a marginal resource in percent, mean of dispatched / observed MW) of cuts; `observed`: (cut, observed), values of at most 1 MW do not count."""
    both = cuts.join(observed, cut, "left")
    share = F.when(F.col("observed") > 1, F.col("dispatched").cast("double") / F.col("observed"))
    return both.groupBy(*keys).agg(
        F.count("*").alias("cuts"), half_up(exact_mean(money("headroom")), 1).alias("mean_headroom"), F.min("headroom").alias("min_headroom"), F.max("headroom").alias("max_headroom"),
        half_up(100.0 * F.count_if(F.col("marginal") > 0) / F.count("*"), 1).alias("marginal_share"), half_up(exact_mean(money(share)), 3).alias("ratio"),
    )


def _zone_cost(stacks: Column, need: Column) -> Column:
    """Cost of `need` on one zone's sorted blocks; what is missing costs the cap (all numbers are integers)."""
    used = F.aggregate(
        stacks, F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("cum")),
        lambda a, b: F.struct((a["cost"] + F.greatest(F.lit(0), F.least(b["mw"], need - a["cum"])) * b["price"]).alias("cost"), (a["cum"] + b["mw"]).alias("cum")),
    )
    return used["cost"] + F.greatest(F.lit(0), need - used["cum"]) * F.lit(3200)


def coupled_clear(zones: DataFrame, keys: list[str], cap1: int | Column, cap2: int | Column, wheel: int) -> DataFrame:
    """The cheapest flows of three zones in a row (1 - 2 - 3), all quantities integers.

    `zones`: keys, d1..d3 (demand), s1..s3 (blocks price and mw, by price); limits may be columns of it. Cost is convex and
    piecewise linear in the flows, so some cheapest pair lies where two break lines cross: a flow
    that ends a block of zone 1 or 3, is 0 or a limit, or a difference that ends a block of zone 2.
    """
    def ends(s: str) -> Column:
        zero = F.array(F.struct(F.lit(0).cast("long").alias("c")))
        cum = F.aggregate(s, zero, lambda a, b: F.concat(a, F.array(F.struct((F.element_at(a, -1)["c"] + b["mw"]).alias("c")))))
        return F.transform(cum, lambda x: x["c"])

    limits = F.lit(cap1).cast("long").alias("_c1"), F.lit(cap2).cast("long").alias("_c2")
    lines = zones.select(*keys, "d1", "d2", "d3", "s1", "s2", "s3", *limits).select(
        "*",
        F.array_distinct(F.concat(F.transform(ends("s1"), lambda c: c - F.col("d1")), F.array(F.lit(0).cast("long"), F.col("_c1"), -F.col("_c1")))).alias("a"),
        F.array_distinct(F.concat(F.transform(ends("s3"), lambda c: F.col("d3") - c), F.array(F.lit(0).cast("long"), F.col("_c2"), -F.col("_c2")))).alias("b"),
        F.array_distinct(F.transform(ends("s2"), lambda c: c - F.col("d2"))).alias("d"),
    )
    # zone 2 produces d2 + f2 - f1, so its breaks are f2 - f1 = d
    ab = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.struct(x.alias("f1"), y.alias("f2")))))
    ad = F.flatten(F.transform("a", lambda x: F.transform("d", lambda z: F.struct(x.alias("f1"), (x + z).alias("f2")))))
    bd = F.flatten(F.transform("b", lambda y: F.transform("d", lambda z: F.struct((y - z).alias("f1"), y.alias("f2")))))
    f = lines.select(*keys, "d1", "d2", "d3", "s1", "s2", "s3", "_c1", "_c2", F.explode(F.concat(ab, ad, bd)).alias("f")).select("*", "f.f1", "f.f2").drop("f")
    g1, g2, g3 = F.col("d1") + F.col("f1"), F.col("d2") + F.col("f2") - F.col("f1"), F.col("d3") - F.col("f2")
    inside = f.where((F.abs("f1") <= F.col("_c1")) & (F.abs("f2") <= F.col("_c2")) & (g1 >= 0) & (g2 >= 0) & (g3 >= 0))
    size = F.abs("f1") + F.abs("f2")
    cost = _zone_cost(F.col("s1"), g1) + _zone_cost(F.col("s2"), g2) + _zone_cost(F.col("s3"), g3) + wheel * size
    best = inside.groupBy(*keys).agg(F.min(F.struct(cost.alias("cost"), size.alias("size"), "f1", "f2")).alias("m"))
    return best.select(*keys, F.col("m.cost").alias("cost"), F.col("m.f1").alias("f1"), F.col("m.f2").alias("f2"))


def corridor_report(flows: DataFrame, flow: str, cap: float | Column, price_from: str, price_to: str) -> DataFrame:
    """Saturation of a corridor and the rent across it; a closed corridor never saturates."""
    full = (F.lit(cap) > 0.5) & (F.abs(flow) >= cap - 0.5)
    gap = F.when(F.col(flow) > 0, F.col(price_to) - F.col(price_from)).otherwise(F.col(price_from) - F.col(price_to))
    return flows.withColumns({"saturated": full, "rent": F.when(full, gap).otherwise(F.lit(0.0))})


def price_label(unserved: Column, own: Column, price: Column, storage: Column, hydro: Column, own_fuel: Column) -> Column:
    """Who sets a price, in this order: shortage, own fuel, storage, hydro, export or import."""
    return (
        F.when(unserved, "shortage").when(F.abs(own - price) <= 0.025, own_fuel).when(storage, "storage").when(hydro, "hydro").when(price > own, "export").otherwise("import")
    )


def compact_book(book: DataFrame, keys: list[str], price: str, mw: str, most: int) -> DataFrame:
    """Each book's price levels, the two closest joined (MW-weighted price) until `most` are left.

    Levels are summed before they meet, so an array holds a book's distinct prices. Fixed values:
    prices to 3 digits, MW to 1, levels of at most 0.05 MW dropped.
    """
    cost = F.round(F.col(price).cast("double"), 3)
    levels = book.groupBy(*keys, cost.alias("p")).agg(F.sum(F.col(mw).cast("double")).alias("q"))
    books = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("a"))

    def join_closest(a, _):
        gaps = F.transform(F.slice(a, 2, F.size(a) - 1), lambda x, i: F.struct((x["p"] - F.get(a, i)["p"]).alias("gap"), i.alias("i")))
        at = F.array_min(gaps)["i"]
        x, y = F.get(a, at), F.get(a, at + 1)
        both = x["q"] + y["q"]
        one = F.struct(F.coalesce(F.round(F.try_divide(x["p"] * x["q"] + y["p"] * y["q"], both), 3), x["p"]).alias("p"), both.alias("q"))
        return F.concat(F.slice(a, F.lit(1), at), F.array(one), F.slice(a, at + 3, F.size(a)))

    surplus = F.greatest(F.lit(0), F.size("a") - most)
    steps = F.when(surplus > 0, F.sequence(F.lit(1), surplus)).otherwise(F.array().cast("array<int>"))
    done = books.select(*keys, F.inline(F.aggregate(steps, F.col("a"), join_closest)))
    return done.select(*keys, F.col("p").alias(price), F.round("q", 1).alias(mw)).where(F.col(mw) > 0.05)


def replay(stacked: DataFrame, demands: DataFrame, keys: list[str], cost: str, label: str, demand: str) -> DataFrame:
    """(keys, label, demand, price, short) of many demands against each book, linear in both.

    A book's blocks stand at their running totals, demands at their MW; in that order a demand's
    price is that of the next block. Beyond the book the price is the cap and `short` is set (with
    1e-9 to spare); a demand of 0 or less, or without a book, has no price.
    """
    blocks = stacked.select(*keys, F.col("cum").cast("double").alias("_x"), F.lit(1).alias("_kind"), F.col(cost).cast("double").alias("_p"), F.lit(None).cast(demands.schema[label].dataType).alias(label), F.lit(None).cast("double").alias("_d"))
    asked = demands.select(*keys, (F.col(demand).cast("double") - 1e-9).alias("_x"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_p"), label, F.col(demand).cast("double").alias("_d"))
    w = Window.partitionBy(*keys)
    ahead = w.orderBy("_x", "_kind", F.desc("_p")).rowsBetween(0, Window.unboundedFollowing)
    both = blocks.unionByName(asked).withColumns({"_next": F.first("_p", ignorenulls=True).over(ahead), "_has": F.max("_kind").over(w) == 1})
    real = F.col("_has") & (F.col("_d") > 0)
    out = both.where("_kind = 0").select(*keys, label, F.col("_d").alias(demand), F.when(real, F.coalesce("_next", F.lit(CAP))).alias("price"), (real & F.col("_next").isNull()).alias("short"))
    return out


def availability(plants: DataFrame, fuel: str, mw: str, derates: dict[str, float], shaped: str, profile: list[float]) -> DataFrame:
    """A row for each plant and hour: installed MW times the fuel's derate (1 where there is none), and for the fuel `shaped` times the hour's share of `profile`."""
    share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in derates.items() for x in kv)), F.col(fuel)), F.lit(1.0))
    hours = F.posexplode(F.array(*map(F.lit, profile)))
    rows = plants.select("*", hours.alias("hour", "_shape"))
    return rows.withColumn("available", F.col(mw) * share * F.when(F.col(fuel) == shaped, F.col("_shape")).otherwise(1.0)).drop("_shape")
