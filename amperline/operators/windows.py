"""Ordered rows: rolling triggers, outage windows, rises, duration curves, bands, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, index_clipped, index_low, index_near, money, ratio
from amperline.operators.ranked import at_places, between, interpolated, placed, same, value_places
from amperline.sources.tables import written


def rolling_trigger(rows: DataFrame, keys: list[str], epoch: str, value: str, seconds: int, full: int, trigger: float) -> DataFrame:
    """Rolling means over (t - seconds, t] that hold exactly `full` rows: how many, how many over the trigger, the largest and the first time it stands."""
    # rows are dealt by key and day: a day's windows are made of it and of as many days before it as a window spans
    day = F.floor(F.col(epoch) / 86400)
    reach = -(-seconds // 86400)
    dealt = rows.select(*keys, epoch, value, F.explode(F.sequence(day, day + reach)).alias("_day"))
    w = Window.partitionBy(*keys, "_day").orderBy(epoch).rangeBetween(-(seconds - 1), 0)
    mean = half_up(ratio(F.sum(money(value)).over(w), F.count("*").over(w)))
    means = dealt.select(*keys, epoch, mean.alias("m"), F.count("*").over(w).alias("n"), (day == F.col("_day")).alias("own")).where((F.col("n") == full) & F.col("own"))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col(epoch).alias("at")))
    return means.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if(F.col("m") > trigger).alias("breaches"), best.alias("b")).select(*keys, "windows", "breaches", (-F.col("b.m")).alias("max_mean"), F.col("b.at").alias("max_at"))


def outage_windows(events: DataFrame, keys: list[str], ts: str, order: list[str], is_block: Column, is_clear: Column) -> DataFrame:
    """Windows from the first block of a streak to the next clear; an open tail lasts an hour."""
    kind = F.when(is_block, 1).when(is_clear, 0)
    marks = events.withColumn("_k", kind).where(F.col("_k").isNotNull())
    w = Window.partitionBy(*keys).orderBy(*order)
    turns = marks.withColumn("_before", F.lag("_k").over(w)).where((F.col("_before").isNull() | (F.col("_before") != F.col("_k"))))
    pairs = turns.withColumn("_until", F.lead(ts).over(w)).where("_k = 1")
    return pairs.select(*keys, F.col(ts).alias("start"), F.coalesce("_until", F.col(ts) + F.expr("INTERVAL 1 HOUR")).alias("end"), F.col("_until").isNull().alias("open"))


def window_hours(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Hours that windows touch, with the unblocked share to three digits."""
    hour = F.explode(F.sequence(F.date_trunc("hour", "start"), F.date_trunc("hour", "end"), F.expr("INTERVAL 1 HOUR")))
    split = windows.select(*keys, "start", "end", hour.alias("hour"))
    until = F.least("end", F.col("hour") + F.expr("INTERVAL 1 HOUR"))
    seconds = F.greatest(F.lit(0), F.unix_timestamp(until.cast("timestamp")) - F.unix_timestamp(F.greatest("start", "hour").cast("timestamp")))
    blocked = split.groupBy(*keys, F.col("hour").cast("timestamp_ntz").alias("hour")).agg(F.sum(seconds).alias("s")).where("s > 0")
    return blocked.select(*keys, "hour", half_up(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("s") / 3600.0)), 3).alias("unblocked"))


def largest_rise(hourly: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Largest step from one row to the next and where it ends (the first of equals)."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = hourly.select(*keys, order, (money(value) - F.lag(money(value)).over(w)).cast("double").alias("rise")).where("rise IS NOT NULL")
    return steps.groupBy(*keys).agg(F.min(F.struct((-F.col("rise")).alias("r"), F.col(order).alias("at"))).alias("b")).select(*keys, (-F.col("b.r")).alias("rise"), F.col("b.at").alias("at"))


def duration_curve(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Values from high to low with the percent of time they are reached: 100 i / (n - 1)."""
    i, n = F.col("_place"), F.col("_n")
    ordered = placed(rows.select(*keys, tie, value), keys, [F.desc(value), F.asc(tie)])
    return ordered.select(*keys, tie, value, half_up(F.try_divide(100.0 * i, (n - 1).cast("double"))).alias("percent"))


def hour_band(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated 10th, 50th and 90th percentiles."""
    bands = {f"p{q}": q / 100 for q in (10, 50, 90)}
    a = at_places(rows, keys, value, {k: f for name, q in bands.items() for k, f in between(q, name).items()})
    return a.select(*keys, *(half_up(interpolated(q, name, F.col("n"))).alias(name) for name, q in bands.items()))


def percentile_kinds(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """One percentile by each definition in use: low, clipped and near index, interpolated, upper median, plain median."""
    kinds = {"p_low": lambda n: index_low(n, q), "p_clipped": lambda n: index_clipped(n, q), "p_near": lambda n: index_near(n, q), "median_upper": lambda n: F.floor(n / 2)}
    a = at_places(rows, keys, value, {**kinds, **between(q, "lin"), **between(0.5, "med")})
    n = F.col("n")
    return a.select(*keys, "p_low", "p_clipped", "p_near", half_up(interpolated(q, "lin", n)).alias("p_linear"), "median_upper", half_up(interpolated(0.5, "med", n)).alias("median"))


def _moments(x: Column, y: Column) -> list[Column]:
    x, y = x.cast("decimal(16,4)"), y.cast("decimal(16,4)")
    return [F.count("*").alias("n"), *(F.sum(c).cast("double").alias(k) for k, c in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y)))]


def correlation(pairs: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Pearson correlation from exact sums; null with fewer than 3 pairs or without spread; also the line of best fit."""
    m = pairs.groupBy(*keys).agg(*_moments(x, y))
    n, vx, vy = F.col("n"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    ok = (n >= 3) & (vx > 0) & (vy > 0)
    slope = F.when(ok, cov / vx)
    return m.select(*keys, "n", half_up(F.when(ok, cov / F.sqrt(vx) / F.sqrt(vy))).alias("corr"), half_up(slope).alias("slope"), half_up((F.col("sy") - slope * F.col("sx")) / n).alias("intercept"))


def average_ranks(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1; ties get the mean of their ranks."""
    ranks = value_places(rows, keys, value).withColumn(out, F.col("_first") + 1 + (F.col("_c") - 1) / 2)
    return rows.alias("r").join(ranks.alias("v"), same("r", "v", [*keys, value])).select("r.*", f"v.{out}")


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, keys, x, "_rx"), keys, y, "_ry")
    return correlation(ranked, keys, F.col("_rx"), F.col("_ry")).select(*keys, "n", F.col("corr").alias("spearman"))


def score_pairs(pairs: DataFrame, keys: list[str], observed: str, modeled: str) -> DataFrame:
    """n, means, MAE, bias, correlation and the share of high hours that the model also ranks high.

    High: at least the low 90th percentile of what was observed; the share is null if the model's
    own 90th percentile is not above its median.
    """
    o, m = F.col(observed), F.col(modeled)
    high, middle = lambda n: index_low(n, 0.9), lambda n: index_low(n, 0.5)
    pairs = written(pairs, "pairs")  # four passes read it
    of_model = at_places(pairs, keys, modeled, {"tm": high, "mm": middle}).drop("n")
    cuts = at_places(pairs, keys, observed, {"to": high}).drop("n").join(of_model, keys)
    d = money(m) - money(o)
    both = pairs.join(cuts, keys)
    a = both.groupBy(*keys).agg(
        half_up(exact_mean(money(o))).alias("mean_observed"), half_up(exact_mean(money(m))).alias("mean_modeled"), half_up(exact_mean(F.abs(d))).alias("mae"), half_up(exact_mean(d)).alias("bias"),
        half_up(F.when(F.first("tm") > F.first("mm"), 100 * ratio(F.count_if((o >= F.col("to")) & (m >= F.col("tm"))), F.count_if(o >= F.col("to"))))).alias("high_hit"),
    )
    return correlation(pairs, keys, o, m).select(*keys, "n", "corr").join(a, keys)


def smape(pairs: DataFrame, keys: list[str], observed: str, modeled: str) -> DataFrame:
    """100 * mean of 2|m - o| / (|m| + |o|); pairs near 0 on both sides are left out."""
    o, m = F.col(observed), F.col(modeled)
    term = F.when(F.abs(m) + F.abs(o) > 1e-9, 2 * F.abs(m - o) / (F.abs(m) + F.abs(o))).cast("decimal(28,12)")
    return pairs.groupBy(*keys).agg(F.count(term).alias("n"), half_up(100 * exact_mean(term)).alias("smape"))


def within_group_correlation(pairs: DataFrame, keys: list[str], day: str, observed: str, modeled: str, least: int) -> DataFrame:
    """Low median of the correlations of days with at least `least` pairs."""
    daily = correlation(pairs, [*keys, day], F.col(observed), F.col(modeled)).where((F.col("n") >= least) & F.col("corr").isNotNull())
    s = daily.groupBy(*keys).agg(F.sort_array(F.collect_list("corr")).alias("s"), F.count("*").cast("int").alias("days"))
    return s.select(*keys, "days", F.get("s", index_low(F.col("days"), 0.5)).alias("median_corr"))


def dedupe_close(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Events more than `seconds` after the last kept one of their key.

    An event that long after the one before it is kept whatever came before, so times are folded
    from one such event to the next and no fold sees more than a run of close events.
    """
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    times = events.select(*keys, t.alias("t")).distinct()
    w = Window.partitionBy(*keys).orderBy("t")
    starts = F.coalesce(F.col("t") - F.lag("t").over(w) > seconds, F.lit(True)).cast("int")
    runs = times.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w))
    sorted_times = runs.groupBy(*keys, "_run").agg(F.sort_array(F.collect_list("t")).alias("t"))
    empty = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    kept = F.aggregate("t", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > seconds), F.array_append(acc, x)).otherwise(acc))
    return sorted_times.select(*keys, F.explode(kept).alias("kept_at"))


def exposure_curve(rows: DataFrame, keys: list[str], spot: str, generated: str, contracted: str, tie: str) -> DataFrame:
    """Uncovered generation by falling spot price."""
    ordered = placed(rows.select(*keys, tie, spot, generated, contracted), keys, [F.desc(spot), F.asc(tie)])
    return ordered.select(*keys, tie, spot, (F.col("_place") + 1).alias("rank"), F.greatest(F.lit(0.0), F.col(generated) - F.col(contracted)).alias("exposed"))
