"""Text tables on small hand-made reports: wrapped rows, moved columns, sections that do not add up."""

from decimal import Decimal

from pyspark.sql import functions as F

from amperline.sources import reports

FUELS = {"COAL": "coal", "WIND": "wind"}

SHEET = """Existing plants
NAME                TYPE         INSTALLED   DEPENDABLE  UNITS
COAL   1,030.0   900.0
Alpha  12 Main St   Grid           1,000.5        880.0      2
                                                   9.5
Beta                Embedded
                                      20.0
Gamma Central                          9.5          9.0
                    Grid
PROJECT

     NAME                TYPE         INSTALLED   DEPENDABLE  UNITS
WIND   7.0   7.0
Delta                    Grid               7.0          7.0      1.5
TOTAL LUZON   1,037.0
Omega               Grid               3.0          3.0      1
"""


def test_column_sheet(spark):
    texts = spark.createDataFrame([(1, SHEET), (2, None), (3, "")], "report long, text string")
    rows = reports.plant_sheets(texts, "report", "text", FUELS)
    got = [tuple(r)[3:] for r in rows.where("kind = 'row'").orderBy("line").collect()]
    assert got == [
        ("coal", "Alpha", "grid", 1000.5, 880.0, 2),
        ("coal", "Beta", "embedded", 20.0, 9.5, 1),
        ("coal", "Gamma Central PROJECT", "grid", 9.5, 9.0, 1),
        ("wind", "Delta", "grid", 7.0, 7.0, 1),
    ]
    assert {(r.fuel, r.parsed, r.ok) for r in reports.sheet_reconciliation(rows, "report").collect()} == {("coal", 1030.0, True), ("wind", 7.0, True)}
    assert rows.where("kind = 'total'").first().installed == 1037.0 and rows.select("report").distinct().count() == 1


def test_sheet_that_does_not_add_up(spark):
    texts = spark.createDataFrame([(1, SHEET.replace("1,030.0", "1,036.0"))], "report long, text string")
    rows = reports.plant_sheets(texts, "report", "text", FUELS)
    assert {(r.fuel, r.ok) for r in reports.sheet_reconciliation(rows, "report").collect()} == {("coal", False), ("wind", True)}


def test_total_or_section_below_a_wrapped_row_is_no_name(spark):
    head = "NAME                TYPE         INSTALLED   DEPENDABLE  UNITS\n"
    row = "{}                                 9.5          9.0\n                    Grid\n"
    sheet = head + "COAL   9.5   9.0\n" + row.format("Alpha") + "WIND   9.5   9.0\n" + row.format("Gamma") + "TOTAL LUZON   19.0\n"
    rows = reports.plant_sheets(spark.createDataFrame([(1, sheet)], "report long, text string"), "report", "text", FUELS)
    assert [(r.fuel, r.name) for r in rows.where("kind = 'row'").orderBy("line").collect()] == [("coal", "Alpha"), ("wind", "Gamma")]


def test_project_list(spark):
    text = "5.00 TBD\nCOAL   10.50\n A 4.25 Mar-26 x 6.25 2027 Q3 2028\nWIND (NEW)  1.00\n B 1.00 2025\nWIND   3.00\n B 2.00 Completed\nCOAL  0.00"
    sections = reports.project_sections(spark.createDataFrame([(1, text), (2, None)], "report long, text string"), "report", "text", FUELS)
    judged, rows = reports.reconciled_projects(sections, "report")
    # a header that is no known section opens none: its rows stay with the section above
    assert [(r.section, r.fuel, r.n_rows, r.reconciled) for r in judged.orderBy("section").collect()] == [(1, "coal", 0, False), (2, "wind", 0, False), (3, "coal", 0, True)]
    judged, rows = reports.reconciled_projects(sections.where("mw IS NULL OR mw <> 1.00"), "report")
    assert [(r.section, r.mw, r.target, r.target_year) for r in rows.orderBy("mw").collect()] == [(1, Decimal("4.250"), "Mar-26", 2026), (1, Decimal("6.250"), "Q3 2028", 2028)]


def test_target_years(spark):
    dates = ["Mar-26", "March 2031", "Q1 2030", "2040", "TBD", "Completed", None]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i long, d string")
    assert [r.y for r in frame.orderBy("i").select(reports.target_year(F.col("d")).alias("y")).collect()] == [2026, 2031, 2030, 2040, None, None, None]


def test_demand_path(spark):
    good = "x\n 2021*  1,000  200 300 1,501\n2022 1 1 1 3\n2022 9 9 9 99\n2023 1 1 1 3 4\n"
    got = reports.demand_path(spark.createDataFrame([(1, good), (2, "2021 1 1 1 9\n2022 1 1 1 3"), (3, None)], "report long, text string"), "report", "text")
    assert sorted(map(tuple, got.collect())) == [(1, 2021, True, 1000, 200, 300, 1501), (1, 2022, False, 1, 1, 1, 3)]
