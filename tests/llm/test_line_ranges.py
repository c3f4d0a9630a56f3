"""op8 with split digests, packed bitmaps and rows that share a doc_id."""

from pyspark.sql import functions as F

from amperline.llm import linededup
from tests.llm import plain

SCHEMA = "doc_id long, text string"
LINE = "this line is long enough to be seen as one that repeats"


def got(spark, rows, **kw):
    df = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def test_split_digests(spark, monkeypatch):
    monkeypatch.setattr(linededup, "RANGE_ROWS", 7)
    rows = [(i, f"own {i}\n{LINE}\n" + f"{LINE} {i % 9}\n" * (i % 3) + LINE.upper()) for i in range(60)]
    assert got(spark, rows) == plain.cut_lines(rows)
    rows = rows[:4]
    assert got(spark, rows) == plain.cut_lines(rows)


def test_bitmaps_of_long_texts(spark):
    """Gaps over 127 and over 16383 lines take two and three bytes."""
    rows = [(i, "\n".join([LINE] + [f"{i} {k}" for k in range(200)] + [LINE] + [str(k) for k in range(17000)] + [LINE, "end"])) for i in range(6)]
    assert got(spark, rows) == plain.cut_lines(rows)
    maps = linededup.keep_bitmaps(spark.createDataFrame(rows, SCHEMA)).select(F.length("keep_runs").alias("n")).collect()
    assert [r.n for r in maps] == [1 + 2 + 3] * 5


def test_rows_with_one_id_and_other_texts(spark):
    rows = [(i, LINE) for i in range(5)] + [(2, f"unique first line here\n{LINE}"), (None, LINE), (4, "no such line")]
    found = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 9, r.kept_text) for r in found) == [(0, ""), (1, ""), (2, ""), (2, "unique first line here"), (3, ""), (4, "no such line"), (4, LINE), (9, LINE)]


def test_many_dropped_lines_in_one_text(spark):
    """Time is linear in a text's lines: this took minutes when numbers were appended one by one."""
    import time

    text = "\n".join(f"{LINE} {i}" for i in range(100_000))
    rows = [(i, text) for i in range(5)] + [(9, "short\n" + text + "\nlast")]
    start = time.time()
    got_rows = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(6)).select("doc_id", "n_lines", "n_dropped", F.length("kept_text").alias("n")).collect()
    assert sorted(map(tuple, got_rows)) == [(i, 100_000, 100_000, 0) for i in range(5)] + [(9, 100_002, 0, len("short\n" + text + "\nlast"))]
    assert time.time() - start < 180
