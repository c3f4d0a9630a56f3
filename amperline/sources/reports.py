"""Tables in the text of reports: column sheets, sections with subtotals, rows of numbers by pattern.

Reports come as rows (a key, the text), one document a row. Sheets need a state that goes down the
page, so a table function reads one document at a time; the other two are lines and patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed shapes of a sheet: the columns by the words of their headers, and how far right of a header's end its numbers may end.
SHEET_COLUMNS = ("installed", "dependable", "units")
EDGE, REACH, WITHOUT_NEIGHBOUR = 3, 7, 4
_NUMBER = re.compile(r"[\d,]+\.\d+|\b\d{1,3}\b")
_SHEET_SECTION = re.compile(r"\s*([A-Z][A-Z ()\-/]*[A-Z)])\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)\s*")
_SHEET_TOTAL = re.compile(r"\s*TOTAL\s+[A-Z]+\s+([\d,]+\.\d+)")
_CONNECTION = re.compile(r"\b(Grid|Embedded)\b")


def _number(text: str) -> float:
    return float(text.replace(",", ""))


class PlantSheet:
    """A table function: the rows, subtotals and totals of one sheet.

    Headers give the columns' places and may move from page to page; a number belongs to the column
    whose header ends nearest to its own end. A record is a line that begins with a name and tells the
    connection; its numbers may stand on lines above or below. A wrapped record has numbers beside
    its name, the connection alone on one of the two next lines, and perhaps the rest of the name below that.
    """

    def eval(self, text: str, fuels: dict) -> Iterator[tuple]:
        edges: dict[str, int] = {}
        fuel, lines = None, (text or "").splitlines()
        cells: list[dict[str, float]] = [{} for _ in lines]
        records: list[tuple[int, str, str, str]] = []  # line, name, connection, fuel
        for at, line in enumerate(lines):
            if "INSTALLED" in line and "DEPENDABLE" in line:
                edges = {c: line.index(c.upper()) + len(c) + EDGE for c in SHEET_COLUMNS if c.upper() in line}
            elif total := _SHEET_TOTAL.match(line):
                fuel = None
                yield ("total", at, None, None, None, _number(total[1]), None, None)
            elif (section := _SHEET_SECTION.fullmatch(line)) and section[1].strip() in fuels:
                fuel = fuels[section[1].strip()]
                yield ("subtotal", at, fuel, None, None, _number(section[2]), _number(section[3]), None)
            elif fuel and edges:
                cells[at] = self._cells(line, edges)
                if record := self._record(lines, at, cells[at], edges, fuels):
                    records.append((at, *record, fuel))
        for (at, name, connection, of), own in zip(records, self._claims(records, cells), strict=True):
            if "installed" in own:
                yield ("row", at, of, name, connection, own["installed"], own.get("dependable", 0.0), int(own.get("units", 1)))

    @staticmethod
    def _cells(line: str, edges: dict[str, int]) -> dict[str, float]:
        """The first number under each column."""
        out: dict[str, float] = {}
        for m in _NUMBER.finditer(line):
            column, far = min(((c, abs(m.end() - edge)) for c, edge in edges.items()), key=lambda x: x[1])
            value = _number(m[0])
            # unit counts are small whole numbers; a street number is none
            if far <= REACH and (column != "units" or (value.is_integer() and 1 <= value <= 99)):
                out.setdefault(column, value)
        return out

    def _record(self, lines: list[str], at: int, own: dict[str, float], edges: dict[str, int], fuels: dict) -> tuple[str, str] | None:
        name = self._name(lines[at])
        if not name or name in fuels:
            return None
        if here := _CONNECTION.search(lines[at]):
            return name, here[1].lower()
        if not own.keys() & {"installed", "dependable"}:
            return None
        for below in range(at + 1, min(at + 3, len(lines))):
            alone = _CONNECTION.search(lines[below])
            if alone and not self._name(lines[below]):
                rest = lines[below + 1] if below + 1 < len(lines) else ""
                more = self._name(rest)
                ends_name = more and not self._own_kind(rest, fuels) and not _CONNECTION.search(rest) and not self._cells(rest, edges)
                return (f"{name} {more}" if ends_name else name), alone[1].lower()
        return None

    @staticmethod
    def _own_kind(line: str, fuels: dict) -> bool:
        """Whether a line is a header, a total or a section, which are never part of a name."""
        section = _SHEET_SECTION.fullmatch(line)
        return ("INSTALLED" in line and "DEPENDABLE" in line) or bool(_SHEET_TOTAL.match(line)) or bool(section and section[1].strip() in fuels)

    @staticmethod
    def _name(line: str) -> str:
        """The first cell of a line that does not begin with a blank."""
        return re.split(r"\s{2,}", line.strip())[0] if line[:1].strip() else ""

    @staticmethod
    def _claims(records: list[tuple], cells: list[dict[str, float]]) -> Iterator[dict[str, float]]:
        """Each record's numbers: those of its own line, then the nearest that no record has taken between its neighbours."""
        taken: set[tuple[int, str]] = set()
        for k, (at, *_) in enumerate(records):
            own = dict(cells[at])
            above = records[k - 1][0] if k else at - WITHOUT_NEIGHBOUR
            below = records[k + 1][0] if k + 1 < len(records) else at + WITHOUT_NEIGHBOUR
            near = sorted((j for j in range(max(0, above + 1), min(below, len(cells))) if j != at), key=lambda j, at=at: (abs(j - at), j))
            for column in SHEET_COLUMNS:
                if column not in own:
                    free = next((j for j in near if column in cells[j] and (j, column) not in taken), None)
                    if free is not None:
                        own[column] = cells[free][column]
                        taken.add((free, column))
            yield own


_SHEET_ROWS = "kind string, line int, fuel string, name string, connection string, installed double, dependable double, units int"


def plant_sheets(reports: DataFrame, key: str, text: str, fuels: dict[str, str]) -> DataFrame:
    """(key, kind, line, fuel, name, connection, installed, dependable, units) of column sheets; `fuels`: section names and their fuels. Null texts have no rows."""
    read = F.udtf(PlantSheet, returnType=_SHEET_ROWS)
    names = F.create_map(*(F.lit(x) for kv in fuels.items() for x in kv))
    return reports.lateralJoin(read(F.col(text).outer(), names)).select(key, *(c.split()[0] for c in _SHEET_ROWS.split(", ")))


def sheet_reconciliation(rows: DataFrame, key: str) -> DataFrame:
    """(key, fuel, subtotal, parsed, ok): whether a section's rows add up to its subtotal, to 1 MW or half a percent."""
    sums = rows.groupBy(key, "fuel").agg(F.max(F.when(F.col("kind") == "subtotal", F.col("installed"))).alias("subtotal"), F.coalesce(F.sum(F.when(F.col("kind") == "row", F.col("installed").cast("decimal(18,4)"))), F.lit(0)).cast("double").alias("parsed"))
    parsed = F.round("parsed", 1)
    return sums.where("subtotal IS NOT NULL").select(key, "fuel", "subtotal", parsed.alias("parsed"), (F.abs(parsed - F.col("subtotal")) <= F.greatest(F.lit(1.0), F.col("subtotal") * 0.005)).alias("ok"))


#: Fixed forms of a project list: a section with its subtotal, a row of MW and one or two dates.
_LIST_SECTION = r"^([A-Z][A-Z /()&-]*[A-Z)])\s+([\d,]+\.\d{2,3})\s*$"
_DATE = r"(?:TBD|Completed|[A-Z][a-z]{2}-\d{2}|[A-Z][a-z]+ \d{4}|Q[1-4]\s?\d{4}|\d{4})"
_LIST_ROW = rf"([\d,]+\.\d{{2,3}})\s+({_DATE})(?:\s+({_DATE}))?(?:\s|$)"


def _decimal(c: Column) -> Column:
    return F.translate(c, ",", "").try_cast("decimal(18,3)")


def target_year(date: Column) -> Column:
    """The year of a date like Mar-26, March 2026, Q1 2026 or 2026; null for others."""
    short = F.regexp_extract(date, r"^[A-Z][a-z]{2}-(\d{2})$", 1)
    return F.when(short != "", 2000 + short.try_cast("int")).otherwise(F.regexp_extract(date, r"(\d{4})", 1).try_cast("int"))


def project_sections(reports: DataFrame, key: str, text: str, fuels: dict[str, str]) -> DataFrame:
    """(key, section, fuel, line, subtotal, mw, target): each row of a project list with its section, numbered from 1; a section without rows has one with null mw. The last date of a row is its target."""
    names = F.create_map(*(F.lit(x) for kv in fuels.items() for x in kv))
    lines = reports.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    fuel = F.element_at(names, F.nullif(F.trim(F.regexp_extract("value", _LIST_SECTION, 1)), F.lit("")))
    marked = lines.withColumn("opens", F.when(fuel.isNotNull(), F.struct(fuel.alias("fuel"), _decimal(F.regexp_extract("value", _LIST_SECTION, 2)).alias("subtotal"))))
    down = Window.partitionBy(key).orderBy("line")
    held = marked.select(key, "line", "value", F.last("opens", ignorenulls=True).over(down).alias("s"), F.count("opens").over(down).alias("section"), F.col("opens").isNotNull().alias("head")).where("section > 0")
    groups = [F.regexp_extract_all("value", F.lit(_LIST_ROW), F.lit(i)) for i in (1, 2, 3)]
    rows = F.when(F.col("head"), F.array(F.struct(F.lit(None).cast("string").alias("mw"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))).otherwise(F.transform(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "xyz", strict=True))), lambda z: F.struct(z["x"].alias("mw"), z["y"].alias("a"), z["z"].alias("b"))))
    out = held.select(key, "section", "s.fuel", "line", "s.subtotal", F.inline(rows))
    return out.select(key, "section", "fuel", "line", "subtotal", _decimal(F.col("mw")).alias("mw"), F.coalesce(F.nullif("b", F.lit("")), F.nullif("a", F.lit(""))).alias("target"))


def reconciled_projects(sections: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The sections (key, section, fuel, subtotal, n_rows, reconciled) and the rows (key, section, fuel, mw, target, target_year) of those that add up to 0.01 MW; n_rows is 0 where they do not."""
    sums = sections.groupBy(key, "section", "fuel", "subtotal").agg(F.count("mw").alias("n"), F.coalesce(F.sum("mw"), F.lit(0)).alias("mw_sum"))
    judged = sums.withColumn("reconciled", F.abs(F.col("mw_sum") - F.col("subtotal")) < 0.01)
    good = judged.where("reconciled").select(F.col(key).alias("_k"), F.col("section").alias("_s"))
    rows = sections.where("mw IS NOT NULL").join(good, (F.col(key) == F.col("_k")) & (F.col("section") == F.col("_s")), "left_semi")
    return judged.select(key, "section", "fuel", "subtotal", F.when(F.col("reconciled"), F.col("n")).otherwise(0).alias("n_rows"), "reconciled"), rows.select(key, "section", "fuel", "mw", "target", target_year(F.col("target")).alias("target_year"))


_YEAR_ROW = r"(?m)^[ \t]*(20[2-5][0-9])(\*?)[ \t]+([\d,]+)[ \t]+([\d,]+)[ \t]+([\d,]+)[ \t]+([\d,]+)[ \t]*$"


def demand_path(reports: DataFrame, key: str, text: str, tolerance: int = 2) -> DataFrame:
    """(key, year, actual, luzon, visayas, mindanao, national): the year rows of a plan's text, the first of each year; a star marks what was measured.

    A document whose grids do not add up to the national figure in some year is refused: it has no rows.
    """
    fields = ("year", "star", "luzon", "visayas", "mindanao", "national")
    groups = [F.regexp_extract_all(text, F.lit(_YEAR_ROW), F.lit(i)).alias(n) for i, n in enumerate(fields, 1)]
    rows = reports.select(key, F.posexplode(F.arrays_zip(*groups)).alias("place", "r"))
    whole = {n: F.translate(F.col(f"r.{n}"), ",", "").try_cast("long").alias(n) for n in fields if n != "star"}
    typed = rows.select(key, "place", whole["year"], (F.col("r.star") == "*").alias("actual"), *(whole[n] for n in fields[2:]))
    once = typed.groupBy(key, "year").agg(F.min(F.struct("place", "actual", *fields[2:])).alias("r")).select(key, F.col("year").cast("int").alias("year"), "r.actual", *(f"r.{n}" for n in fields[2:]))
    off = F.abs(F.col("luzon") + F.col("visayas") + F.col("mindanao") - F.col("national")) > tolerance
    return once.withColumn("_bad", F.max(F.coalesce(off, F.lit(True))).over(Window.partitionBy(key))).where("NOT _bad").drop("_bad")
