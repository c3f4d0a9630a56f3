"""Line dedup with DataFrame operations only.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case. A key of
at least `min_chars` code points that at least `min_docs` documents hold keeps only its lines in
the largest doc_id among them.

1. Digests of long lines are counted with a partial aggregate before the shuffle; only those that
   occur `min_docs` times can matter, and their occurrences go on.
2. Occurrences are range-partitioned by digest, ROWS_A_TASK to a range, with a secondary sort by document (descending) and
   position. A digest with more than RANGE_ROWS occurrences is split into parts by a hash of the
   document, so no range grows with a hot line.
3. A range streams in that order: the first occurrence of each digest gives the winning document,
   and each change of document counts one more. A split digest's parts are then put together,
   one row a part. Lines of other documents go if enough documents hold the digest.
4. Per row of `docs` the result is a compressed keep bitmap: for each dropped line the number of
   kept lines since the last dropped one, 7 bits a byte. Texts are cut only where someone asks.

Defined cases: null or empty text is one empty line; rows of one doc_id count as one document
in the counts, and each row loses only its own lines; rows without a doc_id lose nothing and
count for nothing; a table without rows gives none; columns of `docs` other than `doc_id` and
`text` are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amperline.llm.store import save

RANGE_ROWS = 256
ROWS_A_TASK = 100_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, position, d1, d2) of each line whose key is long enough; d1, d2: 128 bits of digest."""
    long_lines = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("position"), F.btrim(x, F.lit(BLANKS)).alias("line"))),
        lambda x: F.char_length(x["line"]) >= min_chars,
    )
    key = F.translate("line", UPPER, LOWER)
    return (
        _lines(docs)
        .select("doc_id", "row", F.inline(long_lines))
        .select("doc_id", "row", "position", key.alias("key"))
        .select("doc_id", "row", "position", F.xxhash64("key").alias("d1"), F.xxhash64(F.lit(7), F.reverse("key")).alias("d2"))
    )


def streamed_lines(seen: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, row, position, d1, d2, parts, leads, winner, n_docs): occurrences in sorted ranges, each with its part's first document and number of documents."""
    counts = seen.groupBy("d1", "d2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    parts = F.ceil(F.col("n") / RANGE_ROWS).cast("int")
    counts = save(counts.select("d1", "d2", "n", parts.alias("parts")), "common-digests")
    n = -(-(counts.agg(F.sum("n")).first()[0] or 1) // ROWS_A_TASK)
    common = seen.join(counts.drop("n"), ["d1", "d2"])
    common = common.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    ranges = common.repartitionByRange(n, "d1", "d2", "part").sortWithinPartitions("d1", "d2", "part", F.desc("doc_id"), "position")
    digest = Window.partitionBy("d1", "d2", "part")
    stream = digest.orderBy(F.desc("doc_id"), "position")
    before = F.lag("doc_id").over(stream)
    ranges = ranges.withColumns({"leads": before.isNull(), "turns": (before.isNull() | (before != F.col("doc_id"))).cast("int"), "winner": F.first("doc_id").over(stream)})
    return ranges.withColumn("n_docs", F.sum("turns").over(digest)).drop("turns", "part")


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, position) of each line that goes."""
    seen = save(line_occurrences(docs, min_chars), "line-digests")
    stream = save(streamed_lines(seen, min_docs), "streamed-lines")
    whole = stream.where(F.col("parts") == 1)
    split = stream.where(F.col("parts") > 1)
    heads = split.where("leads").groupBy("d1", "d2").agg(F.max("winner").alias("winner"), F.sum("n_docs").alias("n_docs"))
    both = whole.unionByName(split.drop("winner", "n_docs").join(heads, ["d1", "d2"]))
    return both.where((F.col("n_docs") >= min_docs) & (F.col("doc_id") < F.col("winner"))).select("doc_id", "row", "position")


def _packed(gaps):
    """Numbers as bytes: 7 bits each, low bits first, the high bit set but in a number's last byte."""
    def digits(g):
        more = F.when(g < 1 << 7, 0).when(g < 1 << 14, 1).when(g < 1 << 21, 2).when(g < 1 << 28, 3).otherwise(4)
        steps = F.array(*(F.lit(128**i) for i in range(5)))
        return F.transform(F.slice(steps, F.lit(1), more + 1), lambda step, i: F.lpad(F.hex(F.floor(g / step) % 128 + F.when(i < more, 128).otherwise(0)), 2, "0"))

    return F.unhex(F.array_join(F.flatten(F.transform(gaps, digits)), ""))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, keep_runs) for each row that loses lines.

    keep_runs: packed numbers, for each dropped line that of kept lines between it and the one
    dropped before; lines after the last dropped one are kept.
    """
    at = F.col("at")
    runs = F.transform(at, lambda p, i: F.when(i == 0, p).otherwise(p - F.get(at, i - 1) - 1).cast("long"))
    return (
        dropped_lines(docs, min_chars, min_docs)
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set("position")).alias("at"))
        .select("doc_id", "row", _packed(runs).alias("keep_runs"))
    )


def _let(value, body):
    """`body` of a value that is computed once: what a lambda only mentions is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unpacked(bitmap):
    """The numbers that `_packed` wrote, in time that is linear in their bytes."""
    octets = F.transform(F.sequence(F.lit(1), F.length(bitmap)), lambda i: F.conv(F.hex(F.substring(bitmap, i, F.lit(1))), 16, 10).cast("long"))

    def number(o, first, last):
        digits = (F.when(first + j <= last, F.get(o, first + j) % 128 * 128**j).otherwise(0) for j in range(5))
        return functools.reduce(lambda x, y: x + y, digits).cast("long")

    def numbers(o):
        ends = F.filter(F.transform(o, lambda b, i: F.when(b < 128, i)), lambda i: i.isNotNull())
        return _let(ends, lambda e: F.transform(e, lambda last, k: number(o, F.coalesce(F.get(e, k - 1) + 1, F.lit(0)), last)))

    return F.when(F.length(bitmap) > 0, _let(octets, numbers))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with kept_text (null text: empty), n_lines and n_dropped."""
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    base = docs.select(*names, F.xxhash64("text").alias("_row"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    own = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_own"), "keep_runs")
    both = base.join(own.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("_row") == F.col("_own")), "left")  # bitmaps grow with docs: the same plan at every size
    runs = F.col("_runs")
    flags = F.flatten(F.transform(runs, lambda g: F.concat(F.array_repeat(F.lit(True), g.cast("int")), F.array(F.lit(False)))))
    # lines behind the last flag are kept; arguments of a function are computed once, what its lambda mentions for each line
    kept = F.filter(F.zip_with("_lines", "_flags", lambda x, flag: F.when(F.coalesce(flag, F.lit(True)), x)), lambda x: x.isNotNull())
    return (
        both.withColumns({"_lines": lines, "_runs": _unpacked(F.col("keep_runs"))})
        .withColumn("_flags", flags)
        .select(
            *names,
            F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size(runs), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(runs.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        )
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per row of `docs`."""
    docs = docs.select("doc_id", "text")
    bitmaps = save(keep_bitmaps(docs, min_chars, min_docs), "keep-bitmaps")
    return apply_bitmaps(docs, bitmaps).select("doc_id", "n_lines", "n_dropped", "kept_text")
