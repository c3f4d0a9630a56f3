"""Zipped and sectioned files on small odd inputs; the queries over whole tables are held to SQL in test_catalog."""

import io
import zipfile

import duckdb

from amperline.plans import archive_plans
from amperline.sources import archives


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def test_archives_from_a_folder(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(_zip({"x.csv": "A,B\n1,\"p,q\"\n", "y.csv": b"B\nz\xff\n", "empty.csv": ""}))
    (tmp_path / "bad.zip").write_bytes(b"no zip file")
    got = archives.csv_members(archives.archives(spark, str(tmp_path)), ["A", "B"]).select("member", "A", "B").collect()
    assert sorted(map(tuple, got), key=str) == [("x.csv", "1", "p,q"), ("y.csv", None, "z\ufffd")]


def test_sections_and_running_totals(spark):
    text = "2024-01-01 00:05:00\r\nlost,1,1,1\nOffers Not Dispatched\nResource ID,MW,Block,Total\nA,1,1,1\nA,x,2,2\nshort,1\n\nOffers Dispatched\n B ,5,1,5\nB,1,2,4\nEOF\n"
    files = spark.createDataFrame([("p", _zip({"m": text, "blank": "\nEOF\n"})), ("none", None)], "path string, content binary")
    rows = archives.merit_sections(archives.line_members(files))
    got = rows.orderBy("line_no").select("stamp", "side", "resource", "mw", "block", "running_total").collect()
    stamp = "2024-01-01 00:05:00"
    assert list(map(tuple, got)) == [(stamp, "not dispatched", "A", 1.0, 1, 1.0), (stamp, "dispatched", "B", 5.0, 1, 5.0), (stamp, "dispatched", "B", 1.0, 2, 4.0)]
    assert [r.faults for r in archives.running_total_faults(rows, ["path", "member"]).collect()] == [1]


def test_sections_move_no_line(spark):
    """A member's stamp and sections come from the task that reads it; sections open again, and marks and lines before them are no rows."""
    text = "\n stamp \nA,1,1,1\nx Offers Dispatched,1,1,1\nB,2,1,2\nOffers Not Dispatched\nC,3,1,3\nOffers Dispatched\nResource ID,4,1,4\nD,5,2,7\n"
    files = spark.createDataFrame([("p", _zip({"m": text, "n": "only\n"}))], "path string, content binary")
    rows = archives.merit_sections(archives.line_members(files))
    got = [(r.stamp, r.side, r.line_no, r.resource) for r in rows.collect()]
    assert got == [("stamp", "dispatched", 4, "B"), ("stamp", "not dispatched", 6, "C"), ("stamp", "dispatched", 9, "D")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def _faults(spark, *sections):
    rows = [("m", side, 10 * k + i, float(mw), float(total)) for k, (side, own) in enumerate(sections) for i, (mw, total) in enumerate(own)]
    return archives.running_total_faults(spark.createDataFrame(rows, "member string, side string, line_no long, mw double, running_total double"), ["member"]).first().faults


def test_totals_grow_away_from_the_cut(spark):
    off, on = "not dispatched", "dispatched"
    assert _faults(spark, (off, [(10, 30), (12, 20), (8, 8)]), (on, [(5, 5), (6, 11)])) == 0
    assert _faults(spark, (off, [(10, 10), (12, 22)])) == 2  # it rises, and the row at the cut is not its own MW
    assert _faults(spark, (on, [(5, 500), (6, 506)])) == 1
    assert _faults(spark, (on, [(5, 5), (6, 4.5), (1, 12)])) == 1
    assert _faults(spark, (off, [(5, 5.005)]), (on, [(5, 4.995)])) == 0


def test_preamble(spark):
    texts = spark.createDataFrame([(1, "title\nUNIT,N\nu,1\n ,2\n\n"), (2, "no header"), (3, None)], "id long, value string")
    got = archives.after_preamble(texts, "UNIT,", "unit string, n long", "unit", ["id"]).collect()
    assert list(map(tuple, got)) == [(1, "u", 1)]


def test_preamble_by_each_header(spark):
    texts = spark.createDataFrame([(1, "title\r\nUNIT,Other,N\r\nu,\"x,y\",1\r\n"), (2, "UNIT,n\nv,2"), (3, "UNIT,M\nw,9"), (4, "UNIT,N\nz,no")], "id long, value string")
    got = archives.after_preamble(texts, "UNIT,", "unit string, n long", "unit", ["id"]).collect()
    assert sorted(map(tuple, got)) == [(1, "u", 1), (2, "v", 2), (3, "w", None), (4, "z", None)]


def test_tied_offers_stand_as_they_were_added_up(spark, tmp_path):
    """Offers alike in block, unit and MW: on either side totals rise in the order of the lines, as in SQL, whose second sort leaves ties as the first one made them."""
    tied = [(1, 9, 2, 5.0, "N"), (1, 9, 2, 5.0, "N"), (1, 4, 3, 7.0, "N"), (2, 8, 1, 5.0, "A"), (2, 8, 1, 5.0, "R"), (4, 3, 4, 6.0, "N"), (4, 3, 4, 6.0, "N"), (4, 3, 4, 6.0, "N")]
    columns = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(tied, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: r.faults for r in archive_plans.running_totals(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == dict(con.execute(archive_plans.ORACLE["q_running_totals"]).fetchall()) == {1: 1, 2: 0, 4: 3}
