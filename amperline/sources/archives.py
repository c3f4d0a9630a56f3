"""Zipped market files and texts with sections or a preamble.

Archives come as rows (path, content), as Spark's `binaryFile` source gives them. One archive is
unzipped by one task, member after member, so a task holds one archive (at most 2 GB, the limit of
that source) and one batch of rows. Archives that are no zip files are left out.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amperline.sources.files import csv_fields

ROWS_A_BATCH = 10_000
#: Marks in a line that open the sections of a merit-order member.
SECTIONS = {"Offers Not Dispatched": "not dispatched", "Offers Dispatched": "dispatched"}


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the zip files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder)
    return found.select("path", "content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, io.TextIOWrapper]]:
    """(path, member, its text) of each member; bytes that are no UTF-8 become replacement marks."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            raw = content.as_py()
            if raw is None or not zipfile.is_zipfile(io.BytesIO(raw)):
                continue
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for name in z.namelist():
                    with z.open(name) as f:
                        yield path.as_py(), name, io.TextIOWrapper(f, "utf-8", errors="replace", newline="")


def _batched(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_A_BATCH:
            yield _batch(held, kinds, names)
            held = []
    if held:
        yield _batch(held, kinds, names)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def csv_members(files: DataFrame, needed: list[str]) -> DataFrame:
    """(path, member, needed columns as text) of every row of the CSV members, by each member's own header; a column that a member lacks is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, name, *(r.get(c) for c in needed)) for path, name, text in _opened(batches) for r in csv.DictReader(text))
        yield from _batched(rows, [pa.string()] * (2 + len(needed)), ["path", "member", *needed])

    return files.select("path", "content").mapInArrow(read, ", ".join(f"`{c}` string" for c in ["path", "member", *needed]))


def _sectioned(lines: Iterator[str]) -> Iterator[tuple[int, str, str, str | None, bool]]:
    """(number, line, first line, section, whether it opens that) of each line that is neither blank nor the EOF mark."""
    first = section = None
    for i, line in enumerate(lines):
        own = line.rstrip("\r\n")
        if own.strip() in ("", "EOF"):
            continue
        first = own if first is None else first
        opens = False
        for mark, side in SECTIONS.items():
            if mark in own:
                opens, section = True, side
                break
        yield i, own, first, section, opens


def line_members(files: DataFrame) -> DataFrame:
    """(path, member, line_no, line, first, section, opens) of every line of the members that is neither blank nor the EOF mark.

    `first` is the member's first such line, `section` the last of SECTIONS that a line up to this one opens: the task that reads a member knows them, so no line is sent to another for them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, name, *own) for path, name, text in _opened(batches) for own in _sectioned(text))
        yield from _batched(rows, [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()], ["path", "member", "line_no", "line", "first", "section", "opens"])

    return files.select("path", "content").mapInArrow(read, "path string, member string, line_no long, line string, first string, section string, opens boolean")


def merit_sections(lines: DataFrame) -> DataFrame:
    """(path, member, stamp, side, line_no, resource, mw, block, running_total) of merit-order members, from `line_members`.

    A member's first line is its stamp. A line that names a section opens it; rows before the first section,
    header rows and rows that are no four numbers-to-be are left out.
    """
    part = F.split("line", ",")
    seen = lines.where("NOT opens AND section IS NOT NULL").where(~F.startswith("line", F.lit("Resource ID"))).select(
        "path",
        "member",
        F.trim("first").alias("stamp"),
        F.col("section").alias("side"),
        "line_no",
        F.trim(F.get(part, F.lit(0))).alias("resource"),
        F.get(part, F.lit(1)).try_cast("double").alias("mw"),
        F.get(part, F.lit(2)).try_cast("int").alias("block"),
        F.get(part, F.lit(3)).try_cast("double").alias("running_total"),
    )
    return seen.where("mw IS NOT NULL AND block IS NOT NULL AND running_total IS NOT NULL")


def after_preamble(texts: DataFrame, mark: str, schema: str, key: str, keep: list[str]) -> DataFrame:
    """`keep` and the CSV rows of the column `value` after the header that starts with `mark`.

    `schema` names the columns wanted and their types; a text's own header, in any case and order,
    says where they stand, and a column that it lacks is null. Texts without the mark and rows with a blank `key` give
    nothing. A field does not go over a line's end.
    """
    wanted = [c.split() for c in schema.split(",")]
    at = F.instr("value", mark)
    rest = texts.where(at > 0).select(*keep, F.substring("value", at, F.length("value")).alias("_rest"))
    most = rest.agg(F.max(F.size(F.split(F.regexp_substr("_rest", F.lit("^[^\r\n]*")), ",")))).first()[0] or 1
    names = F.transform(csv_fields(F.regexp_substr("_rest", F.lit("^[^\r\n]*")), most), lambda x: F.lower(F.trim(x)))
    lines = rest.select(*keep, F.array(*(F.array_position(names, n.lower()).cast("int") for n, _ in wanted)).alias("_at"), F.posexplode(F.split("_rest", "\r?\n")).alias("place", "line"))
    rows = lines.where("place > 0 AND trim(line) <> ''").select(*keep, "_at", csv_fields(F.col("line"), most).alias("_f"))
    own = [F.when(F.col("_at")[i] > 0, F.get("_f", F.col("_at")[i] - 1)).try_cast(kind).alias(n) for i, (n, kind) in enumerate(wanted)]
    return rows.select(*keep, *own).where(F.trim(key) != "")


def running_total_faults(rows: DataFrame, member: list[str]) -> DataFrame:
    """Faults of each member against the cut between its sections, 0 where it is sound.

    Running totals grow away from the cut: they do not rise along the offers that are not dispatched
    nor fall along those that are (by 0.001), and the rows at the cut, the last and the first of the
    two, carry their own MW (to 0.01). Each row that breaks this is a fault.
    """
    w = Window.partitionBy(*member, "side").orderBy("line_no")
    total, before = F.col("running_total"), F.lag("running_total").over(w)
    off = F.col("side") == "not dispatched"
    turns = F.when(off, total > before + 1e-3).otherwise(total < before - 1e-3)
    at_cut = F.when(off, F.lead("line_no").over(w).isNull()).otherwise(before.isNull())
    own = F.abs(total - F.col("mw")) > 1e-2
    faults = F.coalesce(turns, F.lit(False)).cast("int") + (at_cut & own).cast("int")
    return rows.withColumn("_faults", faults).groupBy(*member).agg(F.sum("_faults").alias("faults"))
