"""Reports made of the driver's suppliers and parts, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperline.plans.common import table
from amperline.sources import reports

QUERIES, ORACLE = {}, {}
FUELS = {"COAL": "coal", "NATURAL GAS": "gas", "HYDRO (LARGE)": "hydro"}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


_PLANTS = """p AS (SELECT CAST(s_suppkey // 40 AS BIGINT) AS report, s_suppkey AS k, CASE s_suppkey // 3 % 3 WHEN 0 THEN 'coal' WHEN 1 THEN 'gas' ELSE 'hydro' END AS fuel,
    'PLANT ' || s_suppkey || CASE WHEN s_suppkey % 6 = 5 THEN ' PHASE 2' ELSE '' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'grid' ELSE 'embedded' END AS connection,
    CAST(s_suppkey * 37 % 21000 + 5 AS DOUBLE) / 10 AS installed, CAST(s_suppkey * 37 % 21000 AS DOUBLE) / 10 AS dependable, CAST(1 + s_suppkey % 9 AS INTEGER) AS units FROM supplier)"""


def _sheets(spark, d):
    """Sheets of 40 suppliers: numbers beside the name, on the line below it, or with the connection on a line of its own; in some, a subtotal is off."""
    k = F.col("s_suppkey")
    tenths = k * 37 % 21000
    number = lambda t: F.format_number(t / 10, 1)
    left = F.concat(F.lit("PLANT "), k.cast("string"))
    conn = F.when(k % 2 == 0, "Grid").otherwise("Embedded")
    figures = F.concat(F.lpad(number(tenths + 5), 14, " "), F.lpad(number(tenths), 16, " "), F.lpad((1 + k % 9).cast("string"), 10, " "))
    beside = F.concat(F.rpad(left, 30, " "), F.rpad(conn, 14, " "), figures)
    below = F.concat(F.rpad(left, 30, " "), conn, F.lit("\n"), F.lpad(figures, 84, " "))
    wrapped = F.concat(F.rpad(left, 44, " "), figures, F.lit("\n"), F.lpad(F.rpad(conn, 14, " "), 44, " "), F.when(k % 6 == 5, "\nPHASE 2").otherwise(""))
    line = F.when(k % 3 == 0, beside).when(k % 3 == 1, below).otherwise(wrapped)
    names = F.when(F.floor(k / 3) % 3 == 0, "COAL").when(F.floor(k / 3) % 3 == 1, "NATURAL GAS").otherwise("HYDRO (LARGE)")
    rows = table(spark, d, "supplier").select(F.floor(k / 40).cast("long").alias("report"), names.alias("section"), k.alias("k"), line.alias("line"), (tenths + 5).alias("i"), tenths.alias("d"))
    own = rows.groupBy("report", "section").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("x"), F.sum("i").alias("i"), F.sum("d").alias("d"))
    extra = F.when((F.col("report") % 2 == 1) & (F.col("section") == "COAL"), 400).otherwise(0)
    header = F.concat(F.rpad(F.lit("FACILITY"), 30, " "), F.rpad(F.lit("TYPE"), 17, " "), F.lit("INSTALLED      DEPENDABLE     UNITS\n"))
    section = F.concat(header, F.col("section"), F.lit("   "), number(F.col("i") + extra), F.lit("   "), number(F.col("d")), F.lit("\n"), F.array_join(F.col("x")["line"], "\n"), F.lit("\n"))
    texts = own.groupBy("report").agg(F.sort_array(F.collect_list(section)).alias("s"), F.sum("i").alias("i"))
    return texts.select("report", F.concat(F.lit("Report\n"), F.array_join("s", "\n"), F.lit("TOTAL LUZON   "), number(F.col("i")), F.lit("\n")).alias("text"))


@query("q_plant_sheets", f"WITH {_PLANTS} SELECT report, fuel, name, connection, installed, dependable, units FROM p")
def plant_sheets(spark, d):
    return reports.plant_sheets(_sheets(spark, d), "report", "text", FUELS).where("kind = 'row'").drop("kind", "line")


@query("q_sheet_reconciliation", f"WITH {_PLANTS}, s AS (SELECT report, fuel, CAST(sum(CAST(installed AS DECIMAL(18,1))) AS DOUBLE) AS parsed FROM p GROUP BY ALL) SELECT report, fuel, parsed + CASE WHEN report % 2 = 1 AND fuel = 'coal' THEN 40 ELSE 0 END AS subtotal, parsed, CASE WHEN report % 2 = 1 AND fuel = 'coal' THEN 40 <= greatest(1.0, (parsed + 40) * 0.005) ELSE true END AS ok FROM s")
def sheet_reconciliation(spark, d):
    return reports.sheet_reconciliation(reports.plant_sheets(_sheets(spark, d), "report", "text", FUELS), "report")


_PROJECTS = """p AS (SELECT CAST(p_partkey // 100 AS BIGINT) AS report, p_partkey AS k, CASE p_partkey // 10 % 3 WHEN 0 THEN 'coal' WHEN 1 THEN 'gas' ELSE 'hydro' END AS fuel, p_partkey * 7 % 90000 + 1 AS cents, CAST(p_partkey * 7 % 90000 + 1 AS DOUBLE) / 100 AS mw,
    CASE p_partkey % 5 WHEN 0 THEN 'TBD' WHEN 1 THEN 'Mar-2' || p_partkey % 7 WHEN 2 THEN 'Q' || 1 + p_partkey % 4 || ' 2031' WHEN 3 THEN 'June 2029' ELSE '2033' END AS target FROM part)"""


def _lists(spark, d):
    """Project lists of 100 parts in three sections; in every third list the gas section's subtotal is off."""
    k = F.col("p_partkey")
    cents = k * 7 % 90_000 + 1
    date = F.when(k % 5 == 0, "TBD").when(k % 5 == 1, F.concat(F.lit("Mar-2"), (k % 7).cast("string"))).when(k % 5 == 2, F.concat(F.lit("Q"), (1 + k % 4).cast("string"), F.lit(" 2031"))).when(k % 5 == 3, "June 2029").otherwise("2033")
    number = lambda c: F.format_number(c / 100, 2)
    line = F.concat(F.lit("  Project "), k.cast("string"), F.lit("   Owner Inc.   "), number(cents), F.when(k % 2 == 0, "   2024   ").otherwise("   "), date)
    name = F.when(F.floor(k / 10) % 3 == 0, "COAL").when(F.floor(k / 10) % 3 == 1, "NATURAL GAS").otherwise("HYDRO (LARGE)")
    rows = table(spark, d, "part").select(F.floor(k / 100).cast("long").alias("report"), name.alias("name"), "p_partkey", line.alias("line"), cents.alias("cents"))
    own = rows.groupBy("report", "name").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "line"))).alias("x"), F.sum("cents").alias("cents"))
    off = F.when((F.col("report") % 3 == 1) & (F.col("name") == "NATURAL GAS"), 5).otherwise(0)
    text = F.concat(F.col("name"), F.lit("   "), number(F.col("cents") + off), F.lit("\n"), F.array_join(F.col("x")["line"], "\n"), F.lit("\n"))
    return own.groupBy("report").agg(F.concat(F.lit("List 2,000.00 Jan-20\n"), F.array_join(F.sort_array(F.collect_list(text)), "")).alias("text"))


_SECTION_NO = "CASE fuel WHEN 'coal' THEN 1 WHEN 'hydro' THEN 2 ELSE 3 END"


@query("q_project_sections", f"WITH {_PROJECTS}, s AS (SELECT report, fuel, sum(cents) AS cents, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, report % 3 = 1 AND fuel = 'gas' AS off FROM s) SELECT report, CAST({_SECTION_NO} AS BIGINT) AS section, fuel, CAST(cents + CASE WHEN off THEN 5 ELSE 0 END AS DOUBLE) / 100 AS subtotal, CASE WHEN off THEN 0 ELSE n END AS n_rows, NOT off AS reconciled FROM t")
def project_sections(spark, d):
    sections = reports.project_sections(_lists(spark, d), "report", "text", FUELS)
    return reports.reconciled_projects(sections, "report")[0].withColumn("subtotal", F.col("subtotal").cast("double"))


@query("q_project_rows", f"WITH {_PROJECTS} SELECT report, CAST({_SECTION_NO} AS BIGINT) AS section, fuel, mw, target, CAST(CASE k % 5 WHEN 1 THEN 2020 + k % 7 WHEN 2 THEN 2031 WHEN 3 THEN 2029 WHEN 4 THEN 2033 END AS INTEGER) AS target_year FROM p WHERE NOT (report % 3 = 1 AND fuel = 'gas')")
def project_rows(spark, d):
    sections = reports.project_sections(_lists(spark, d), "report", "text", FUELS)
    return reports.reconciled_projects(sections, "report")[1].withColumn("mw", F.col("mw").cast("double"))


@query(
    "q_demand_path",
    """WITH y AS (SELECT CAST(s_suppkey AS BIGINT) AS report, 2021 + i AS year, i, 9000 + s_suppkey % 90 + i * 310 AS luzon, 2000 + i * 70 AS visayas, 1800 + i * 55 + s_suppkey % 7 AS mindanao FROM supplier, (SELECT unnest(range(30)) AS i))
    SELECT report, CAST(year AS INTEGER) AS year, i < 2 AS actual, luzon, visayas, mindanao, luzon + visayas + mindanao + report % 3 - 1 AS national FROM y WHERE report % 11 <> 0""",
)
def demand_path(spark, d):
    """Plans with a table of 30 years; every eleventh has a year that does not add up."""
    k = F.col("s_suppkey").cast("long")
    rows = table(spark, d, "supplier").select(k.alias("report"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
    r = F.col("report")
    grids = [9000 + r % 90 + F.col("i") * 310, 2000 + F.col("i") * 70, 1800 + F.col("i") * 55 + r % 7]
    national = grids[0] + grids[1] + grids[2] + r % 3 - 1 + F.when((r % 11 == 0) & (F.col("i") == 7), 5).otherwise(0)
    text = F.concat_ws("   ", F.concat((2021 + F.col("i")).cast("string"), F.when(F.col("i") < 2, "*").otherwise("")), *(F.format_number(g, 0) for g in (*grids, national)))
    texts = rows.select("report", "i", F.concat(F.lit("  "), text).alias("line")).groupBy("report").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "line")))["line"], "\n").alias("t"))
    whole = F.concat(F.lit("Table 28. Peak demand\nYear Luzon Visayas Mindanao Total\n"), "t", F.lit("\n2024 1 2 3 4 extra\nSee also\n2025   1   1   1   3\n"))
    return reports.demand_path(texts.select("report", whole.alias("text")), "report", "text")
