"""Daily layers of a market: load profiles, outages, capacity that is not offered, reserve pools, advisories, drivers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, money, ratio
from amperline.operators.ranked import at_places
from amperline.operators.stack import replay, running_stack


def load_profiles(rows: DataFrame, day: str, grid: str, hour: str, grids: int) -> DataFrame:
    """(day, grid, hour, demand, net_import) of the days that have 24 hours of demand on each of `grids` grids.

    Demand is generation and net imports and what was curtailed, over rows that generate; both are
    means of an hour's rows. `rows`: gen, imp, exp, cur.
    """
    net = money("imp") - money("exp")
    own = rows.where("gen > 0").groupBy(day, grid, hour).agg(half_up(exact_mean(money("gen") + net + F.greatest(money("cur"), F.lit(0).cast("decimal(18,4)"))), 1).alias("demand"), half_up(exact_mean(net), 1).alias("net_import"))
    whole = own.groupBy(day).agg(F.count("*").alias("slots")).where(F.col("slots") == 24 * grids)
    return own.join(whole.select(day), day, "left_semi")


def chain_flows(profiles: DataFrame, day: str, grid: str, hour: str, first: object, last: object) -> DataFrame:
    """(day, hour, out_of_first, into_last): the flows of three grids in a row from their ends' net imports, with the middle's as a check: what all three import should be 0."""
    net = lambda g: F.max(F.when(F.col(grid) == g, F.col("net_import")))
    return profiles.groupBy(day, hour).agg((-net(first)).alias("out_of_first"), net(last).alias("into_last"), half_up(F.sum(money("net_import")).cast("double"), 1).alias("imbalance"))


def not_offered(registered: DataFrame, books: DataFrame, out: DataFrame | None, day: str, keys: list[str], hour: str) -> DataFrame:
    """(day, keys, registered, book_max, out, not_offered): registered MW less the fullest hour of the book and what is out, at least 0.

    Inner on day and key between registered (mw) and the book (mw of an hour's blocks); `out` (mw) may be absent.
    """
    on = [day, *keys]
    reg = registered.groupBy(*on).agg(F.sum(money("mw")).alias("registered"))
    full = books.groupBy(*on, hour).agg(F.sum(money("mw")).alias("mw")).groupBy(*on).agg(F.max("mw").alias("book_max"))
    rows = reg.join(full, on)
    rows = rows.join(out.groupBy(*on).agg(F.sum(money("mw")).alias("out")), on, "left") if out is not None else rows.withColumn("out", F.lit(None).cast("decimal(18,4)"))
    gone = F.coalesce("out", F.lit(0).cast("decimal(18,4)"))
    left = F.greatest(F.col("registered") - F.col("book_max") - gone, F.lit(0).cast("decimal(18,4)"))
    return rows.select(*on, *(half_up(c.cast("double"), 1).alias(n) for n, c in (("registered", F.col("registered")), ("book_max", F.col("book_max")), ("out", gone), ("not_offered", left))))


def not_offered_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, days, median_upper, most, share): the upper median of what is not offered, and its percentage of the mean registered MW."""
    middle = at_places(rows, keys, "not_offered", {"median_upper": lambda n: F.floor(n / 2)})
    means = rows.groupBy(*keys).agg(F.max("not_offered").alias("most"), exact_mean(money("registered")).alias("_mean"))
    return middle.join(means, keys).select(*keys, F.col("n").alias("days"), "median_upper", "most", half_up(ratio(100 * F.col("median_upper"), F.col("_mean")), 1).alias("share"))


def outages_by_day(rows: DataFrame, day: str, resource: str, match: str, grid: str, fuel: str, plant: str, mw: str) -> tuple[DataFrame, DataFrame]:
    """Scheduled outages: MW (day, grid, fuel, mw) of verified resources and counts (day, n_out, n_unmatched).

    A resource counts once a day. Two codes of one plant with the same unit (what follows the last
    underscore) are one unit: the first by name counts.
    """
    once = rows.dropDuplicates([day, resource])
    counts = once.groupBy(day).agg(F.count("*").alias("n_out"), F.count_if(F.col(match) == "unmatched").alias("n_unmatched"))
    unit = F.element_at(F.split(resource, "_"), -1)
    first = F.row_number().over(Window.partitionBy(day, plant, "_unit").orderBy(resource))
    sized = once.where((F.col(match) == "verified") & F.col(grid).isNotNull()).withColumn("_unit", unit).withColumn("_first", first).where("_first = 1")
    return sized.groupBy(day, grid, fuel).agg(half_up(F.sum(money(mw)).cast("double"), 1).alias("mw")), counts


def reserve_pairs(books: DataFrame, schedules: DataFrame, prices: DataFrame, keys: list[str], cost: str, mw: str) -> DataFrame:
    """(keys, scheduled, modeled, observed, short, scarce): each book cleared at the scheduled MW, beside the official price of the same key.

    Keys name the opening interval of an hour: prices at other times do not pair. Schedules (mw,
    required) of 0 or less, without a book or a price, are left out. scarce: more than 0.1 MW below what is required.
    """
    asked = schedules.where(F.col("mw") > 0).select(*keys, F.lit(0).alias("_label"), F.col("mw").alias("_mw"))
    cleared = replay(running_stack(books, keys, cost, mw, []), asked, keys, cost, "_label", "_mw").where("price IS NOT NULL")
    both = cleared.join(schedules, keys).join(prices.select(*keys, F.col("price").alias("observed")), keys)
    return both.select(*keys, F.col("_mw").alias("scheduled"), F.col("price").alias("modeled"), "observed", "short", F.coalesce(F.col("mw") < F.col("required") - 0.1, F.lit(False)).alias("scarce"))


def pool_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, observed, modeled, mae, bias, calm, calm_mae, over, short): pairs of a pool, those that are not scarce, and how often the book clears above the official price."""
    d = money("modeled") - money("observed")
    calm = F.when(~F.col("scarce"), F.abs(d))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), half_up(exact_mean(money("observed")), 3).alias("observed"), half_up(exact_mean(money("modeled")), 3).alias("modeled"), half_up(exact_mean(F.abs(d)), 3).alias("mae"), half_up(exact_mean(d), 3).alias("bias"),
        F.count(calm).alias("calm"), half_up(exact_mean(calm), 3).alias("calm_mae"), F.count_if(d > 0).alias("over"), F.count_if("short").alias("short"),
    )


def reserve_aware(pools: DataFrame, grid: str, energy: DataFrame) -> DataFrame:
    """(grid, energy, reserve_clear, wedge, reserve_total, total): the energy price and the mean of the pools' reserve prices, split into what the books clear and what is observed above it."""
    means = pools.groupBy(grid).agg(half_up(exact_mean(money("observed")), 3).alias("reserve_total"), half_up(exact_mean(money("modeled")), 3).alias("reserve_clear"))
    own = means.join(energy.select(grid, F.col("price").alias("energy")), grid, "left")
    return own.select(grid, "energy", "reserve_clear", half_up(F.col("reserve_total") - F.col("reserve_clear"), 3).alias("wedge"), "reserve_total", half_up(F.col("energy") + F.col("reserve_total"), 3).alias("total"))


def advisories(rows: DataFrame, day: str, place: str, text: str, first: int) -> tuple[DataFrame, DataFrame]:
    """Advisory counts (day, n, n_hvdc, n_alert) of rows with a text, and the first events of each kind (kind, day, place, level), `first` of each."""
    message = F.trim(text)
    own = rows.select(day, place, message.alias("m")).where("m <> ''").withColumns({"hvdc": F.col("m").rlike("(?i)hvdc|de-?block|blocked"), "level": F.regexp_extract("m", r"(?i)\b(yellow|red|blue)\s+alert", 1)})
    counts = own.groupBy(day).agg(F.count("*").alias("n"), F.count_if("hvdc").alias("n_hvdc"), F.count_if(F.col("level") != "").alias("n_alert"))
    kinds = F.array_compact(F.array(F.when(F.col("hvdc"), F.lit("hvdc")), F.when(F.col("level") != "", F.lit("alert"))))
    events = own.select(F.explode(kinds).alias("kind"), day, place, F.lower("level").alias("level"))
    place_of = F.row_number().over(Window.partitionBy("kind").orderBy(day, place))
    return counts, events.withColumn("_i", place_of).where(F.col("_i") <= first).select("kind", day, place, F.when(F.col("kind") == "alert", F.col("level")).alias("level"))


def binding_by_day(rows: DataFrame, day: str, equipment: str, k: int = 3) -> DataFrame:
    """(day, binding_rows, top): rows of each day, and the names of the k equipments with the most, joined by commas; of equals the least name first."""
    own = rows.groupBy(day, equipment).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.desc("n"), equipment))
    placed = own.withColumn("_i", place)
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_i") <= k, F.struct("_i", F.col(equipment).cast("string").alias("e"))))), lambda x: x["e"]), ",")
    return placed.groupBy(day).agg(F.sum("n").alias("binding_rows"), top.alias("top"))


def drivers(prices: DataFrame, day: str, layers: list[DataFrame]) -> DataFrame:
    """A row for each day of `prices` with the columns of all layers; what a layer does not have is null."""
    return reduce(lambda a, b: a.join(b, day, "left"), layers, prices)


def manifest(files: DataFrame) -> DataFrame:
    """(key, files, bytes, oldest, newest) of files (key, name, bytes): the window is that of all the dates in their names, so that a range counts to its end."""
    dates = F.regexp_extract_all("name", F.lit(r"(20\d{6})"))
    return files.groupBy("key").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min(F.array_min(dates)).alias("oldest"), F.max(F.array_max(dates)).alias("newest"))


def staleness(keys: DataFrame, found: DataFrame, today: Column, default_days: int) -> DataFrame:
    """(key, age, budget, status) of data sets (key, budget): stale if the newest file is older than the budget, missing if there is none. A null budget is the default, one below 0 exempts its data set."""
    age = F.datediff(today, F.to_date("newest", "yyyyMMdd"))
    budget = F.coalesce("budget", F.lit(default_days))
    own = keys.join(found.select("key", "newest"), "key", "left").where(budget >= 0)
    status = F.when(F.col("newest").isNull(), "missing").when(age > budget, "stale").otherwise("ok")
    return own.select("key", age.alias("age"), budget.alias("budget"), status.alias("status"))


def wanted_files(listing: DataFrame, on_disk: DataFrame, kinds: DataFrame, sample_days: int, today: Column, recent_days: int = 2) -> DataFrame:
    """(key, name) of listed files that are to be fetched; files (key, name, bytes) on disk with bytes are not fetched again.

    By the kind of the key (kinds: key, kind): `sample`: the last `sample_days` days before the newest date listed;
    `revision`: all; others: dates after the newest on disk, or the last `recent_days` days where
    there is none. A date is the first YYYYMMDD of a name.
    """
    stamp = lambda c: F.nullif(F.regexp_extract(c, r"(\d{8})", 1), F.lit(""))
    date = lambda c: F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")
    newest_disk = on_disk.groupBy("key").agg(F.max(stamp("name")).alias("disk"))
    newest_list = listing.groupBy("key").agg(F.max(stamp("name")).alias("top"))
    own = listing.select("key", "name").distinct().join(kinds, "key", "left").join(newest_disk, "key", "left").join(newest_list, "key", "left").withColumn("at", stamp("name"))
    sample = (F.col("kind") == "sample") & (F.datediff(date(F.col("top")), date(F.col("at"))) < sample_days)
    newer = F.when(F.col("disk").isNotNull(), F.col("at") > F.col("disk")).otherwise(F.datediff(today, date(F.col("at"))).between(0, recent_days - 1))
    want = F.when(F.col("kind") == "sample", sample).when(F.col("kind") == "revision", F.lit(True)).otherwise(newer)
    valid = on_disk.where("bytes > 0").select("key", "name")
    return own.where(F.coalesce(want, F.lit(False))).join(valid, ["key", "name"], "left_anti").select("key", "name")


def against_model(observed: DataFrame, day: str, keys: list[str], mw: str, modeled: DataFrame) -> DataFrame:
    """(keys, days, observed, modeled, ratio): mean daily energy beside the model's (keys, mwh); the ratio is null where the model has none."""
    daily = observed.groupBy(day, *keys).agg(F.sum(money(mw)).alias("mwh")).groupBy(*keys).agg(F.count("*").alias("days"), half_up(exact_mean(F.col("mwh")), 1).alias("observed"))
    both = daily.join(modeled.select(*keys, F.col("mwh").alias("modeled")), keys, "left")
    return both.select(*keys, "days", "observed", "modeled", half_up(ratio(F.col("observed"), F.col("modeled")), 3).alias("ratio"))
