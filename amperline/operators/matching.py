"""Names that contain one another, ladders of sources, and what random names would score.

Candidates for a name inside a name come from an index of its runs of letters, not from comparing
all with all: the contained name looks itself up by the rarest of its runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.operators.joins import haversine_km

GRAM = 4


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n letters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def _inside(outer: DataFrame, o: str, o_text: str, inner: DataFrame, i: str, i_text: str) -> DataFrame:
    """(o, i): the inner text stands in the outer one."""
    own = inner.select(F.col(i).alias("_i"), F.col(i_text).alias("_it")).where(F.length("_it") > 0)
    own = own.withColumn("_gs", F.when(F.length("_it") < GRAM, F.array("_it")).otherwise(_grams(F.col("_it"), GRAM)))
    looked = own.select("_i", "_it", F.size("_gs").alias("_n"), F.explode("_gs").alias("_g"))
    rows = outer.select(F.col(o).alias("_o"), F.col(o_text).alias("_ot"))
    every = reduce(DataFrame.unionByName, [rows.select("_o", "_ot", F.explode(_grams(F.col("_ot"), n)).alias("_g")) for n in range(1, GRAM + 1)])
    index = every.join(looked.select("_g").distinct(), "_g", "left_semi")
    often = index.groupBy("_g").agg(F.count("*").alias("_often"))
    # a text that has a run which no outer text has stands in none of them
    rarest = looked.join(often, "_g").groupBy("_i", "_it", "_n").agg(F.count("*").alias("_found"), F.min(F.struct("_often", "_g"))["_g"].alias("_g")).where("_found >= _n").select("_i", "_it", "_g")
    return index.join(rarest, "_g").where(F.contains("_ot", F.col("_it"))).select(F.col("_o").alias(o), F.col("_i").alias(i))


def one_in_the_other(left: DataFrame, l: str, l_text: str, right: DataFrame, r: str, r_text: str) -> DataFrame:  # noqa: E741
    """(l, r) of all pairs of which one text stands in the other; empty texts match nothing."""
    return _inside(left, l, l_text, right, r, r_text).unionByName(_inside(right, r, r_text, left, l, l_text).select(l, r)).distinct()


def classify(resources: DataFrame, res: str, core: str, grid: str, plants: DataFrame, aliases: dict[str, tuple[str, str]], extras: dict[str, str], excluded: set[str], hints: list[str], least: int = 4) -> DataFrame:
    """(res, outcome, plant) of resources by the first rung that speaks of them.

    Rungs: excluded (its core is, or it is a battery); alias and extra (their grid must be the
    resource's, else unclassified); matched (one of plants (plant, name, grid) of its grid whose
    name contains the core, or is contained in it, the least name first; cores of at least `least` letters); suspect
    (the core holds a hint); unclassified.
    """
    def known(pairs: dict, value) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for k, v in pairs.items() for x in (k, value(v)))), F.col(core)) if pairs else F.lit(None).cast("string")

    own = resources.select(res, core, grid, F.regexp_replace(F.upper(core), "[^A-Z0-9]", "").alias("_n"))
    cores = own.select("_n").where(F.length("_n") >= least).distinct().withColumn("_c", F.col("_n"))
    named = plants.select("plant", F.col("grid").alias("_pg"), F.regexp_replace(F.upper("name"), "[^A-Z0-9]", "").alias("_pn"))
    # plants of one name in one grid match alike: the least of them stands for all, and each name is looked up once
    firsts = named.groupBy("_pn", "_pg").agg(F.min("plant").alias("plant"))
    names = named.select("_pn").distinct().withColumn("_name", F.col("_pn"))
    hits = one_in_the_other(cores, "_c", "_n", names, "_name", "_pn").join(firsts, F.col("_name") == F.col("_pn")).groupBy("_c", "_pg").agg(F.min(F.struct("_pn", "plant"))["plant"].alias("_hit"))
    found = own.join(hits, (F.col("_n") == F.col("_c")) & (F.col(grid) == F.col("_pg")), "left")
    alias, alias_grid, extra = known(aliases, lambda v: v[0]), known(aliases, lambda v: v[1]), known(extras, lambda v: v)
    hint = reduce(lambda a, b: a | b, (F.contains(core, F.lit(h)) for h in hints), F.lit(False))
    none = F.lit(None).cast("string")

    def says(outcome: str, plant: Column = none) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), plant.alias("plant"))

    rungs = (
        F.when(F.endswith(res, F.lit("_BAT")) | F.col(core).isin(*excluded), says("excluded"))
        .when(alias.isNotNull() & (F.col(grid) == alias_grid), says("alias", alias))
        .when(extra.isNotNull() & (F.col(grid) == extra), says("extra", F.col(core)))
        .when(alias.isNull() & extra.isNull() & F.col("_hit").isNotNull(), says("matched", F.col("_hit").cast("string")))
        .when(hint, says("suspect"))
        .otherwise(says("unclassified"))
    )
    return found.select(res, rungs.alias("x")).select(res, "x.outcome", "x.plant")


def located(resources: DataFrame, res: str, grid: str, rungs: list[tuple[str, DataFrame]], apart_km: float = 25.0) -> DataFrame:
    """(res, source, site, lon, lat): the place of each resource from the first source that is sure of it; null where none is.

    A rung is a name and its candidates (res, site, lon, lat, grid). A source is sure if it has
    candidates in the resource's grid and all lie within `apart_km` of the least of them.
    """
    found = []
    for i, (name, candidates) in enumerate(rungs):
        c = candidates.select(F.col(res), F.col("grid").alias("_g"), F.struct("site", "lon", "lat").alias("s")).join(resources.select(res, F.col(grid).alias("_own")), res).where("_g = _own")
        firsts = c.groupBy(res).agg(F.min("s").alias("first"))
        far = haversine_km(F.col("first.lon"), F.col("first.lat"), F.col("s.lon"), F.col("s.lat")) > apart_km
        sure = c.join(firsts, res).groupBy(res, "first").agg(F.max(far).alias("far")).where("NOT far")
        found.append(sure.select(res, F.struct(F.lit(i).alias("rung"), F.lit(name).alias("source"), "first.site", "first.lon", "first.lat").alias("b")))
    best = reduce(DataFrame.unionByName, found).groupBy(res).agg(F.min("b").alias("b"))
    return resources.select(res).join(best, res, "left").select(res, "b.source", "b.site", "b.lon", "b.lat")


def overlap_null_model(pools: DataFrame, named: DataFrame, marginal: DataFrame, key: str, resource: str, draws: int, seed: int, in_row: int = 2000) -> DataFrame:
    """How often named resources are marginal, against names drawn at random: (keys, agree, null_mean, as_high, p_value).

    For each key as many names as are named (at most all) are drawn without replacement from its
    pool, `draws` times: a draw takes the names with the least md5 of (seed, draw, key, name), so
    draws are dealt by key and draw and repeat anywhere. p_value: (1 + draws that agree as often or
    more) / (1 + draws). Keys without a pool, names or marginal resources are left out. A pool of at
    most `in_row` names is drawn from in its row; a larger one goes by a sort of its names for each draw.
    """
    parts = [df.select(key, resource, *(F.lit(int(i == j)).alias(c) for j, c in enumerate(("_pool", "_named", "_m")))) for i, df in enumerate((pools, named, marginal))]
    cells = reduce(DataFrame.unionByName, parts).where(F.col(key).isNotNull()).groupBy(key, resource).agg(F.max("_pool").alias("_pool"), F.max("_named").alias("_named"), F.max("_m").alias("_any"))
    cells = cells.withColumn("_m", F.when(F.col(resource).isNotNull(), F.col("_any")).otherwise(0))
    sums = cells.groupBy(key).agg(F.sum("_pool").alias("_n"), F.sum("_named").alias("_k"), F.max(F.col("_named") * F.col("_m")).alias("_hit"), F.max("_any").alias("_any"))
    usable = sums.where("_n > 0 AND _k > 0 AND _any = 1").select(key, "_n", F.col("_k").cast("int").alias("_k"), "_hit")
    rows = cells.where("_pool = 1").select(key, resource, "_m").join(usable, key)
    every = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")

    def lot(name: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(key).cast("string"), name.cast("string")))

    # draws multiply the rows after the shuffle, so small partitions must not be joined before them
    spread = int(pools.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.where(F.col("_n") <= in_row).repartition(spread, key).groupBy(key, "_k", "_hit").agg(F.collect_list(F.struct(F.col(resource).alias("r"), "_m")).alias("_p"))
    order = F.sort_array(F.transform("_p", lambda x: F.struct(lot(x["r"]).alias("h"), x["r"].alias("r"), x["_m"].alias("m"))))
    small = held.select(key, "_k", "_hit", "_p", every).select("draw", F.exists(F.slice(order, F.lit(1), F.col("_k")), lambda x: x["m"] == 1).cast("int").alias("_null"), "_hit")
    each = rows.where(F.col("_n") > in_row).select("*", every)
    place = F.row_number().over(Window.partitionBy(key, "draw").orderBy(lot(F.col(resource)), resource))
    large = each.withColumn("_place", place).where(F.col("_place") <= F.col("_k")).groupBy(key, "draw").agg(F.max("_m").alias("_null"), F.max("_hit").alias("_hit")).select("draw", "_null", "_hit")
    drawn = small.unionByName(large)
    totals = drawn.groupBy("draw").agg(F.count("*").alias("keys"), F.sum("_hit").alias("agree"), F.sum("_null").alias("null_agree"))
    n, high = F.count("*"), F.count_if(F.col("null_agree") >= F.col("agree"))
    return totals.agg(F.max("keys").alias("keys"), F.max("agree").alias("agree"), (F.sum("null_agree").cast("double") / n).alias("null_mean"), high.alias("as_high"), ((high + 1).cast("double") / (n + 1)).alias("p_value"))
