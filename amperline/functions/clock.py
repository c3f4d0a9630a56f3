"""Market time: interval-ending stamps, their hours and days, the formats that files use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats seen in market files, first match wins.
FORMATS = ("M/d/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy")


def parse_stamp(c: Column) -> Column:
    """A timestamp from any of FORMATS, else null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")


def hour_of_stamp(ts: Column) -> Column:
    """Hour 0-23 of the five-minute interval that ends at `ts`; 00:00 belongs to hour 23."""
    return F.pmod(F.floor((F.hour(ts) * 60 + F.minute(ts) - 5) / 60), F.lit(24)).cast("int")


def hour_of_text(c: Column) -> Column:
    """The same from text; text without a clock time is the interval that ends at midnight."""
    ts = parse_stamp(c)
    return F.when(~F.contains(c, F.lit(":")) & ts.isNotNull(), F.lit(23)).otherwise(hour_of_stamp(ts)).cast("int")


def day_of_stamp(ts: Column) -> Column:
    """Day of the interval that ends at `ts`; midnight belongs to the day before."""
    return F.to_date(ts - F.expr("INTERVAL 5 MINUTES"))


def day_of_file(name: Column) -> Column:
    """The first YYYYMMDD in a file name as a date, else null."""
    d = F.regexp_extract(name, r"(\d{8})", 1)
    return F.try_to_timestamp(F.nullif(d, F.lit("")), F.lit("yyyyMMdd")).cast("date")


def advisory_minute(c: Column) -> Column:
    """Minutes of the day of a mark like `at 930H`, else null."""
    d = F.lpad(F.nullif(F.regexp_extract(c, r"at\s+(\d{3,4})H", 1), F.lit("")), 4, "0")
    return (F.substring(d, 1, 2).cast("int") * 60 + F.substring(d, 3, 2).cast("int")).cast("int")
