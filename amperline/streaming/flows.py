"""Structured Streaming forms of the interval queries.

Each takes a stream of rows, a folder for its result and one for its checkpoint, runs over what
there is and returns; called again it goes on with what has come since.

Derived tables are kept up by partition: a batch's rows are landed under the batch's number (so a
batch that runs again replaces itself), and only the partitions that the batch touches are computed
again from what has landed and put in place of what was there. Late rows are rows like others:
their days are computed again, and `corrections` says which days and how late. No state grows with
the stream, and no batch writes the whole result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.functions.numeric import half_up, money

DAY_SECONDS = 86_400


def _drain(rows: DataFrame, mode: str, folder: str, checkpoint: str, each=None) -> None:
    write = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = write.foreachBatch(each).start() if each else write.format("parquet").option("path", folder).start()
    query.awaitTermination()


def keep_up(rows: DataFrame, part: Column, compute: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, reach: int = 0) -> DataFrame:
    """The result of `compute` over all rows that have come, kept up by the partition `part`.

    `part` is a whole number that a row of the result has from its rows. With `reach`, rows also
    take part in the results of the next `reach` partitions. `compute` gets rows with the column
    _part and gives rows with it; those of partitions that it was not asked for are not used.
    """
    spark = rows.sparkSession
    landed, result = f"{folder}/landed", f"{folder}/result"

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy("_part").parquet(f"{landed}/batch={n}")
        every = spark.read.option("basePath", landed).parquet(f"{landed}/batch=*").drop("batch")
        own = spark.read.option("basePath", landed).parquet(f"{landed}/batch={n}").select("_part").distinct()
        if own.isEmpty():
            return
        touched = own.select(F.explode(F.sequence(F.col("_part"), F.col("_part") + reach)).alias("_part")).distinct()
        read = touched.select(F.explode(F.sequence(F.col("_part") - reach, F.col("_part"))).alias("_part")).distinct()
        out = compute(every.join(read, "_part", "left_semi")).join(touched, "_part", "left_semi")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(result)

    dealt = rows.withColumn("_part", part.cast("int"))
    schema = compute(dealt).schema
    spark.createDataFrame([], schema).write.mode("append").partitionBy("_part").parquet(result)  # there is a result before there are rows
    _drain(dealt, "append", folder, checkpoint, each)
    return spark.read.schema(schema).parquet(result).drop("_part")


def day_number(stamp: str) -> Column:
    return F.floor(F.unix_seconds(F.col(stamp).cast("timestamp")) / DAY_SECONDS)


def hourly_means(rows: DataFrame, keys: list[str], hour: str, value: str, folder: str, checkpoint: str) -> DataFrame:
    """Rows and mean of each hour so far; a batch computes the days of its rows."""
    def means(df: DataFrame) -> DataFrame:
        return df.groupBy("_part", *keys, hour).agg(F.count("*").alias("n"), half_up(F.sum(money(value)).cast("double") / F.count(value)).alias("mean"))

    return keep_up(rows, day_number(hour), means, folder, checkpoint)


def rolling_full(rows: DataFrame, keys: list[str], stamp: str, value: str, span: int, step: int, folder: str, checkpoint: str) -> DataFrame:
    """Rows and mean of every sliding window of `span` seconds, one each `step` seconds, in which no slot of `step` seconds is empty.

    Slots are summed first, so a window reads span / step rows, and rows are dealt by key and day:
    a day's windows are made of that day and as many before it as a window spans.
    """
    reach = -(-span // DAY_SECONDS)
    slots = span // step

    def windows(df: DataFrame) -> DataFrame:
        slot = F.floor(F.unix_seconds(stamp) / step)
        sums = df.groupBy(*keys, slot.alias("slot")).agg(F.sum(money(value)).alias("v"), F.count("*").alias("n"), F.count(value).alias("k"))
        end_part = F.floor(F.col("slot") * step / DAY_SECONDS).cast("int")
        day = F.explode(F.sequence(end_part, end_part + reach)).alias("_part")
        w = Window.partitionBy(*keys, "_part").orderBy("slot").rangeBetween(-(slots - 1), 0)
        own = sums.select("*", day).withColumns({"own": F.floor(F.col("slot") * step / DAY_SECONDS) == F.col("_part"), "full": F.count("*").over(w) == slots, "_v": F.sum("v").over(w), "_n": F.sum("n").over(w), "_k": F.sum("k").over(w)})
        until = F.timestamp_seconds((F.col("slot") + 1) * step)
        return own.where("own AND full").select("_part", *keys, until.alias("until"), F.col("_n").alias("n"), half_up(F.col("_v").cast("double") / F.col("_k")).alias("mean"))

    return keep_up(rows, day_number(stamp), windows, folder, checkpoint, reach)


def latest_revisions(rows: DataFrame, keys: list[str], revision: list[str], folder: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """The newest row of each key so far; keys are kept up in `buckets` parts by their hash."""
    rest = [c for c in rows.columns if c not in keys]

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy("_part", *keys).agg(F.max(F.struct(*revision, *(c for c in rest if c not in revision))).alias("r")).select("_part", *keys, "r.*")

    return keep_up(rows, F.pmod(F.xxhash64(*keys), F.lit(buckets)), newest, folder, checkpoint)


def corrected_days(rows: DataFrame, keys: list[str], stamp: str, value: str, revision: str, budget_days: int, folder: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Daily rows and mean of the newest revision of each (keys, stamp), and the corrections.

    Late and revised rows change their day's result whenever they come. The corrections have a row
    for each day that a batch reached after a later day had come: the batch, how many days late, and
    whether that is over the data set's budget.
    """
    def daily(df: DataFrame) -> DataFrame:
        newest = df.groupBy("_part", *keys, stamp).agg(F.max(F.struct(revision, value)).alias("r"))
        return newest.groupBy("_part", *keys).agg(F.count("*").alias("n"), half_up(F.sum(money("r." + value)).cast("double") / F.count("r." + value)).alias("mean")).withColumn("day", F.date_from_unix_date("_part"))

    out = keep_up(rows, day_number(stamp), daily, folder, checkpoint)
    landed = rows.sparkSession.read.parquet(f"{folder}/landed").select("batch", "_part").distinct()
    tops = landed.groupBy("batch").agg(F.max("_part").alias("top"))
    before = landed.alias("a").join(tops.alias("t"), F.col("t.batch") < F.col("a.batch")).groupBy("a.batch", "a._part").agg(F.max("t.top").alias("top"))
    late = before.where("top > _part").withColumn("days_late", F.col("top") - F.col("_part"))
    return out, late.select("batch", F.date_from_unix_date("_part").alias("day"), "days_late", (F.col("days_late") > budget_days).alias("over_budget"))


def counted_once(rows: DataFrame, keys: list[str], stamp: str, late: str, folder: str, checkpoint: str) -> DataFrame:
    """Windows that several files repeat, once each; rows later than `late` behind the newest are not waited for."""
    _drain(rows.withWatermark(stamp, late).dropDuplicates(keys).select(*keys), "append", folder, checkpoint)
    return rows.sparkSession.read.parquet(folder)


def append_days(rows: DataFrame, day: str, complete: Column, folder: str, checkpoint: str) -> DataFrame:
    """Rows that pass the gate, appended exactly once: a batch's folder is its number, so a batch that runs again replaces itself."""
    _drain(rows.where(complete), "append", folder, checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}"))
    return rows.sparkSession.read.parquet(folder).drop("batch")


def derive_days(rows: DataFrame, day: str, gate: Callable[[DataFrame], DataFrame], derive: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, limit: int | None = None) -> DataFrame:
    """A derived day for each day that passes the gate, once: days that have been derived are skipped, later rows do not change them.

    `gate` gets rows and gives the `day`s that are complete; a day is looked at when rows of it
    come, over all its rows so far. `limit`: so many days a batch, the earliest first; the others are
    taken when the next batch comes.
    """
    spark = rows.sparkSession
    landed, derived, open_days = f"{folder}/landed", f"{folder}/derived", f"{folder}/open"

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{landed}/batch={n}")
        every = spark.read.parquet(landed)
        seen = every.where(F.col("batch") == n).select(day).distinct()
        if n > 0:
            seen = seen.unionByName(spark.read.schema(seen.schema).parquet(f"{open_days}/batch={n - 1}")).distinct()
            done = spark.read.parquet(derived).where(F.col("batch") < n).select(day)
            seen = seen.join(done, day, "left_anti")
        ready = gate(every.join(seen, day, "left_semi")).select(day).distinct()
        now = ready.orderBy(day).limit(limit) if limit is not None else ready
        derive(every.join(now, day, "left_semi").drop("batch")).write.mode("overwrite").parquet(f"{derived}/batch={n}")
        ready.join(now, day, "left_anti").write.mode("overwrite").parquet(f"{open_days}/batch={n}")

    _drain(rows, "append", folder, checkpoint, each)
    return spark.read.parquet(derived).drop("batch")


def streaks(rows: DataFrame, keys: list[str], stamp: str, late: str, folder: str, checkpoint: str) -> DataFrame:
    """(keys, first_day, last_day, days, n): runs of consecutive days with rows that the watermark has passed.

    A session of a key goes on as long as the next day has a row: days are counted from their start,
    24 hours apart, and a gap of 36 hours ends a session.
    """
    start = F.date_trunc("day", stamp)
    sessions = rows.withColumn(stamp, start).withWatermark(stamp, late).groupBy(*keys, F.session_window(stamp, "36 hours").alias("s"))
    out = sessions.agg(F.count("*").alias("n"), F.min(stamp).alias("first"), F.max(stamp).alias("last"))
    days = out.select(*keys, F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"), (F.datediff("last", "first") + 1).alias("days"), "n")
    _drain(days, "append", folder, checkpoint)
    return rows.sparkSession.read.parquet(folder)


def interval_join(left: DataFrame, right: DataFrame, key: str, stamp: str, within: str, late: str, folder: str, checkpoint: str, row: str = "event_id") -> DataFrame:
    """Pairs of two streams with one key, the right side's row at most `within` after the left's; state older than that goes."""
    a = left.withWatermark(stamp, late).select(F.col(key), F.col(stamp).alias("left_at"), F.col(row).alias("left_id"))
    b = right.withWatermark(stamp, late).select(F.col(key).alias("_key"), F.col(stamp).alias("right_at"), F.col(row).alias("right_id"))
    near = (F.col(key) == F.col("_key")) & (F.col("right_at") >= F.col("left_at")) & (F.col("right_at") <= F.col("left_at") + F.expr(f"INTERVAL {within}"))
    _drain(a.join(b, near).select(key, "left_id", "right_id"), "append", folder, checkpoint)
    return left.sparkSession.read.parquet(folder)
