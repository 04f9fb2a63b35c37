"""Levels of accuracy: classes of building elements and of the specification, its table as triples, overrides by a sheet, and reports."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The specification's class of a building element's, and the elements of a class of the specification.
CLASS_OF_ELEMENT = {
    "IfcFooting": "A_SUBSTRUCTURE", "IfcPile": "A_SUBSTRUCTURE", "IfcPlate": "A_SUBSTRUCTURE",
    "IfcWall": "B2010_EXTERIOR_WALLS", "IfcCurtainWall": "B2010_EXTERIOR_WALLS", "IfcWallStandardCase": "B2010_EXTERIOR_WALLS",
    "IfcBuildingElement": "B_SHELL", "IfcSite": "B_SHELL", "IfcBuilding": "B_SHELL",
    "IfcRoof": "B1020_ROOF_CONSTRUCTION", "IfcSlab": "B1010_FLOOR_CONSTRUCTION",
    "IfcBuildingStorey": "C_INTERIORS", "IfcSpace": "C_INTERIORS", "IfcSpatialZone": "C_INTERIORS",
    "IfcWindow": "B2020_EXTERIOR_WINDOWS", "IfcDoor": "B2020_EXTERIOR_WINDOWS",
    "IfcRailing": "B1080_STAIRS", "IfcStair": "B1080_STAIRS", "IfcStairFlight": "B1080_STAIRS",
    "IfcOpening": "B3060_HORIZONTAL_OPENINGS", "IfcCeiling": "C1070_SUSPENDED_CEILING_CONSTRUCTION",
}
OTHER_CLASS, OTHER_ELEMENT = "C_INTERIORS", "IfcBuildingElement"
FOUNDATION, OUTER, ROOM = "IfcFooting IfcPile IfcPlate", "IfcWall IfcCurtainWall IfcWallStandardCase", "IfcFurniture IfcCeiling IfcDoor IfcWindow IfcWall"
ELEMENTS_OF_CLASS = {
    "A_SUBSTRUCTURE": FOUNDATION, "A10_FOUNDATIONS": FOUNDATION, "A1010_STANDARD_FOUNDATIONS": FOUNDATION, "A1020_SPECIAL_FOUNDATIONS": FOUNDATION,
    "A20_SUBGRADE_ENCLOSURES": f"{FOUNDATION} IfcWall IfcCurtainWall", "A2010_WALLS_FOR_SUBGRADE_ENCLOSURES": f"{FOUNDATION} IfcWall IfcCurtainWall",
    "A40_SLABS_ON_GRADE": "IfcSlab", "A4010_STANDARD_SLABS_ON_GRADE": "IfcSlab", "A4020_STRUCTURAL_SLABS_ON_GRADE": "IfcSlab",
    "B_SHELL": "IfcBuildingElement IfcSite IfcRoof IfcBuildingStorey IfcSpace IfcBuilding IfcBuildingElementProxy IfcSpatialZone IfcExternalSpatialStructureElement",
    "B10_SUPERSTRUCTURE": "IfcBuildingElement IfcBuildingStorey IfcSpace IfcBuilding IfcBuildingElementProxy IfcSpatialZone",
    "B1010_FLOOR_CONSTRUCTION": "IfcSlab", "B1020_ROOF_CONSTRUCTION": "IfcRoof", "B1080_STAIRS": "IfcRailing IfcStair IfcStairFlight",
    "B20_EXTERIOR_VERTICAL_ENCLOSURES": "IfcWall IfcWindow IfcDoor IfcChimney IfcCurtainWall IfcWallStandardCase",
    "B2010_EXTERIOR_WALLS": OUTER, "B2080_EXTERIOR_WALLS_AND_APPURTENANCES": OUTER, "B2090_EXTERIOR_WALLS_SPECIALTIES": OUTER,
    "B2020_EXTERIOR_WINDOWS": "IfcWindow", "B2050_EXTERIOR_DOORS_AND_GRILLES": "IfcDoor", "B30_EXTERIOR_HORIZONTAL_ENCLOSURES": "IfcSlab IfcRoof",
    "B3010_ROOFING": "IfcRoof", "B3020_ROOF_APPERURTENANCES": "IfcRoof", "B3040_TRAFFIC_BEARING_HORIZONTAL_ENCLOSURES": "IfcSlab", "B3060_HORIZONTAL_OPENINGS": "IfcOpening", "B3080_OVERHEAD_EXTERIOR_ENCLOSURES": "IfcSlab IfcCeiling IfcCovering",
    "C_INTERIORS": ROOM, "C10_INTERIOR_CONSTRUCTION": ROOM, "C1010_INTERIOR_PARTITIONS": "IfcRoom IfcSpace", "C1020_INTERIOR_WINDOWS": "IfcWindow", "C1030_INTERIOR_DOORS": "IfcDoor",
    "C1040_INTERIOR_GRILLES_AND_GATES": "IfcFurniture", "C1060_RAISED_FLOOR_CONSTRUCTION": "IfcSlab", "C1070_SUSPENDED_CEILING_CONSTRUCTION": "IfcCeiling", "C1090_INTERIOR_SPECIALTIES": "IfcFurniture",
    "C20_INTERIOR_FINISHES": "IfcFurniture", "C2010_WALL_FINISHES": "IfcWall IfcCurtainWall", "C2020_INTERIOR_FABRICATIONS": "IfcFurniture", "C2030_FLOORING": "IfcSlab", "C2040_STAIR_FINISHES": "IfcRailing", "C2050_CEILING_FINISHES": "IfcCeiling",
}
#: Fixed value: what stands before a class's name in its URI.
SPACE = "https://"


def class_of_element(element: Column) -> Column:
    """The specification's class, as a URI, of a building element's class name."""
    table = F.create_map(*(F.lit(x) for pair in CLASS_OF_ELEMENT.items() for x in pair))
    return F.concat(F.lit(SPACE), F.coalesce(F.try_element_at(table, element), F.lit(OTHER_CLASS)))


def elements_of_class(name: Column) -> Column:
    """The class names of building elements that belong to a class of the specification (with or without its URI's beginning)."""
    table = F.create_map(*(F.lit(x) for pair in ELEMENTS_OF_CLASS.items() for x in pair))
    return F.split(F.coalesce(F.try_element_at(table, F.regexp_replace(name, f"^{SPACE}", "")), F.lit(OTHER_ELEMENT)), " ")


def read_specification(spark: SparkSession, path: str) -> DataFrame:
    """The specification's table: subject, CSI, LOAm, LOAr, validation."""
    return spark.read.csv(path, sep=";", header=True, schema="subject string, CSI string, LOAm int, LOAr int, validation string")


def specification_triples(table: DataFrame, space: str = "loa:") -> DataFrame:
    """The table as triples: its numbers, its validation and the elements of each class."""
    items = {"rdf:type": F.lit("LOA"), f"{space}CSI": F.col("CSI"), f"{space}LOAm": F.col("LOAm").cast("string"), f"{space}LOAr": F.col("LOAr").cast("string"), f"{space}validation": F.col("validation")}
    single = F.array(*(F.struct(F.lit(p).alias("predicate"), v.alias("object")) for p, v in items.items()))
    classes = F.transform(elements_of_class(F.col("subject")), lambda x: F.struct(F.lit("ifc:classes").alias("predicate"), x.alias("object")))
    rows = table.select(F.concat(F.lit(SPACE), F.col("subject")).alias("subject"), F.explode(F.concat(single, classes)).alias("t"))
    return rows.select("subject", "t.predicate", "t.object").where("object IS NOT NULL")


#: Columns of a filled-in sheet, from 0. The name stands in one of three, the last filled one; an accuracy is (n + 1) * 10 for the first filled of four.
NAMES, MEASURED, REPRESENTED, VALIDATION = (3, 2, 1), (5, 6, 7, 8), (13, 14, 15, 16), 10


def sheet_overrides(sheet: DataFrame) -> DataFrame:
    """What a filled-in sheet (row, cells array<string>) states: name, LOAm, LOAr, validation, a row for each of its rows that has a name."""
    cell = lambda k: F.nullif(F.trim(F.get(F.col("cells"), F.lit(k))), F.lit(""))
    level = lambda at: F.coalesce(*(F.when(cell(k).isNotNull(), (n + 1) * 10) for n, k in enumerate(at)))
    return sheet.select("row", F.coalesce(*map(cell, NAMES)).alias("name"), level(MEASURED).alias("LOAm"), level(REPRESENTED).alias("LOAr"), cell(VALIDATION).alias("validation")).where("name IS NOT NULL")


def overridden(table: DataFrame, overrides: DataFrame) -> DataFrame:
    """The specification's table with the values of overrides, for the subjects that have their name in them (in either case, spaces as underscores); the last row of a sheet wins."""
    names = overrides.withColumn("_n", F.lower(F.regexp_replace("name", r"\s+", "_")))
    # a specification has some dozens of rows, each of which looks through those of one sheet, in one array
    gathered = names.agg(F.array_sort(F.collect_list(F.struct("row", "_n", "LOAm", "LOAr", "validation"))).alias("_o"))
    rows = table.join(F.broadcast(gathered)).withColumn("_o", F.filter("_o", lambda o: F.contains(F.lower(F.col("subject")), o["_n"])))
    last = lambda c: F.element_at(F.filter(F.concat(F.array(F.lit(None).cast(dict(table.dtypes)[c])), F.transform("_o", lambda o: o[c])), lambda x: x.isNotNull()), -1)
    filled = lambda c: F.when(F.exists("_o", lambda o: o[c].isNotNull()), last(c)).otherwise(F.col(c))
    return rows.select("subject", "CSI", *(filled(c).alias(c) for c in ("LOAm", "LOAr", "validation")))


def report(levels: DataFrame, visibility: DataFrame | None = None) -> DataFrame:
    """A row for each element (name, loa, r10, r20, r30) of a report, with its visibility (name, visible) if that is given; the name 0 is no element."""
    rows = levels.where(F.col("name") != "0").select(F.col("name").alias("Name"), F.col("loa").alias("LOA"), F.col("r10").alias("LOA10"), F.col("r20").alias("LOA20"), F.col("r30").alias("LOA30"))
    if visibility is None:
        return rows
    return rows.join(visibility.select(F.col("name").alias("Name"), F.col("visible").alias("Theoretical visibility")), "Name", "left")


def write_csv_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


# workbooks: one sheet, in the plainest form of the format

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(rows: Sequence[Sequence]) -> bytes:
    """A workbook of one sheet."""

    def cell(k: int, n: int, v) -> str:
        at = f"{_letters(n)}{k + 1}"
        return "" if v is None else f'<c r="{at}"><v>{v!r}</v></c>' if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{k + 1}">' + "".join(cell(k, n, v) for n, v in enumerate(row)) + "</row>" for k, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def read_workbook(data: bytes) -> list[list[str]]:
    """The text of a workbook's first sheet by rows; empty cells are empty text."""
    strip = lambda x: re.sub(rb'\sxmlns(:\w+)?="[^"]*"', b"", x)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter("t")) for s in ET.fromstring(strip(z.read("xl/sharedStrings.xml"))).iter("si")] if "xl/sharedStrings.xml" in names else []
        sheet = ET.fromstring(re.sub(rb"<(/?)\w+:", rb"<\1", strip(z.read(min(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))))))
    out: list[list[str]] = []
    for row in sheet.iter("row"):
        at = int(row.get("r", len(out) + 1)) - 1
        out += [[] for _ in range(at + 1 - len(out))]
        for n, c in enumerate(row.findall("c")):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            col = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters[0]))) - 1 if letters else n
            text = "".join(t.text or "" for t in c.iter("t")) if c.get("t") == "inlineStr" else c.findtext("v") or ""
            out[at] += [""] * (col + 1 - len(out[at]))
            out[at][col] = shared[int(text)] if c.get("t") == "s" and text else text
    return out


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheets of workbooks: subject, row (from 0), cells."""
    from geoweft.sources.files import read_each

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = read_workbook(content)
        if rows:
            yield pd.DataFrame({"subject": path, "row": range(len(rows)), "cells": rows})

    return read_each(spark, path, parse, "subject string, row int, cells array<string>", ("xlsx",))


def workbook_report(rows: DataFrame) -> bytes:
    """A report as a workbook, one file of one table, gathered on the driver: for reports of elements, not for points."""
    return write_workbook([rows.columns, *(tuple(r) for r in rows.orderBy(rows.columns[0]).toLocalIterator())])
