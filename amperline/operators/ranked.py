"""Places, ranks and quantiles inside a few large groups, without a task that holds a whole group.

Rows (or counts of distinct values) are dealt by ranges of (keys, order) and written once, so that
every later step sees the same ranges. A row's place is the number of rows of its key in earlier
ranges, one small table, plus its place in its own range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.sources.tables import written


def same(a: str, b: str, names: list[str]) -> Column:
    """Equal in all `names`; null equals null."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))


def _with_before(rows: DataFrame, keys: list[str], order: list[Column], weight: Column) -> DataFrame:
    """The rows with _part, _before (weight of the key's earlier ranges) and _n (weight of the key)."""
    dealt = rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    earlier = F.sum("_w").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_part", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_w").over(w).alias("_n"))
    both = dealt.alias("a").join(sums.alias("b"), same("a", "b", [*keys, "_part"]))
    return both.select("a.*", "b._before", "b._n")


def placed(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with _place (from 0, by `order`, columns by name) and _n (rows of the key); ties in `order` fall as they come."""
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    dealt = _with_before(rows, keys, order, F.lit(1).cast("long"))
    return dealt.withColumn("_place", F.col("_before") + within - 1).drop("_part", "_before")


def value_places(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, _c (rows that have it), _first (rows with less, nulls least) and _n (rows), each distinct value once."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(value))
    dealt = _with_before(counts, keys, [F.col(value)], F.col("_c"))
    return dealt.select(*keys, value, "_c", (F.col("_before") + upto - F.col("_c")).alias("_first"), "_n")


def at_places(rows: DataFrame, keys: list[str], value: str, places: dict[str, object]) -> DataFrame:
    """One row a key: n (values that are not null) and, by name, the value at the place that a function of n gives.

    Places count from 0 over the sorted values; a place out of range is null, and so are all of a
    key that has only nulls.
    """
    counts = value_places(rows.where(F.col(value).isNotNull()), keys, value)
    n, first = F.col("_n"), F.col("_first")
    here = [F.max(F.when((f(n) >= first) & (f(n) < first + F.col("_c")), F.col(value))).alias(name) for name, f in places.items()]
    found = counts.groupBy(*keys).agg(F.max("_n").cast("int").alias("n"), *here)
    groups = rows.select(*keys).distinct()
    out = groups.alias("g").join(found.alias("f"), same("g", "f", keys), "left")
    return out.select(*(f"g.{k}" for k in keys), F.coalesce("f.n", F.lit(0)).alias("n"), *(f"f.{name}" for name in places))


def between(q: float, name: str) -> dict[str, object]:
    """The two places that the interpolated quantile q lies between, for `at_places`."""
    return {f"{name}_lo": lambda n: F.floor(F.lit(q) * (n - 1)), f"{name}_hi": lambda n: F.ceil(F.lit(q) * (n - 1))}


def interpolated(q: float, name: str, n: Column) -> Column:
    """The quantile q from the values at the places of `between`."""
    at, lo, hi = F.lit(q) * (n - 1), F.col(f"{name}_lo"), F.col(f"{name}_hi")
    return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)
