"""Market files: day files of CSV with a header, blank rows and an EOF mark, and the listing of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amperline.functions import clock
from amperline.sources.tables import written


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, day, bytes) of the files below a folder, hidden ones left out; the day is the first YYYYMMDD of the day file's name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = day_file(F.col("path"))
    return found.select(name.alias("file"), clock.day_of_file(name).alias("day"), F.col("length").alias("bytes"))


def day_file(path):
    """The folder `file=NAME` that stands for a day file, else the last part of the path."""
    own = F.regexp_extract(path, r"/file=([^/]+)/", 1)
    return F.when(own != "", own).otherwise(F.element_at(F.split(path, "/"), -1))


def csv_fields(line: Column, most: int) -> Column:
    """The fields of a CSV line; those that the line does not have are null."""
    names = [f"c{i}" for i in range(most)]
    row = F.from_csv(line, F.lit(", ".join(f"{n} string" for n in names)))
    return F.array(*(row[n] for n in names))


def read_day_files(spark: SparkSession, folder: str, needed: list[str]) -> DataFrame:
    """The needed columns as text, with the day of the file, each file by its own header.

    Rows whose fields are all blank, and rows that begin with the EOF mark, are dropped. A file that
    has rows but not all of the needed columns is refused; one without rows is not. Bytes that are
    no UTF-8 become replacement marks. A field does not go over a line's end. Headers are found
    where files begin and joined to the lines by file, so files and headers may be of any number.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(folder)
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = written(lines.where(F.trim("value") != "").withColumn("value", F.decode(F.encode("value", "UTF-8"), "UTF-8")), "day-lines")
    heads = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"), F.min("line").alias("first"))
    most = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    names = F.transform(csv_fields(F.col("head"), most), lambda x: F.btrim(x, F.lit(" \ufeff")))
    heads = heads.select(F.col("file").alias("of"), "first", *(F.array_position(names, n).cast("int").alias(f"at_{i}") for i, n in enumerate(needed)))
    given = F.filter(csv_fields(F.col("value"), most), lambda x: F.trim(x) != "")
    rows = lines.join(heads, (F.col("file") == F.col("of")) & (F.col("line") != F.col("first")))
    full = rows.where((F.size(given) > 0) & (F.upper(F.coalesce(F.trim(F.get(given, F.lit(0))), F.lit(""))) != "EOF"))
    missing = F.filter(F.array(*(F.when(F.coalesce(f"at_{i}", F.lit(0)) == 0, F.lit(n)) for i, n in enumerate(needed))), lambda n: n.isNotNull())
    lacking = full.withColumn("missing", missing).where(F.size("missing") > 0).groupBy("file").agg(F.first("missing").alias("missing"))
    if bad := lacking.orderBy("file").limit(5).collect():
        raise ValueError("columns missing: " + "; ".join(f"{r.file} lacks {', '.join(r.missing)}" for r in bad))
    fields = full.select("file", *(f"at_{i}" for i in range(len(needed))), csv_fields(F.col("value"), most).alias("fields"))
    values = [F.nullif(F.trim(F.get("fields", F.col(f"at_{i}") - 1)), F.lit("")).alias(n) for i, n in enumerate(needed)]
    return fields.select(*values, clock.day_of_file(day_file(F.col("file"))).alias("day"))


def write_day_files(rows: DataFrame, folder: str, file: str) -> None:
    """CSV with a header, one folder `file=NAME` for each day file."""
    rows.write.partitionBy(file).option("header", True).csv(folder)
