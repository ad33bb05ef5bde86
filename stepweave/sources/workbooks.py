"""What a workbook says beside its values: styles, sizes, panes, filters, validations, conditional formats, sparklines, pivots and charts.

Each property is a row (sheet, part, at, key, value), so that checks compare and filter them like any other table."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Property = tuple[str, str, str, str | None]  # part, at, key, value


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [n for n in node.iter() if _local(n) == name]


def _first(node: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        node = next((n for n in (node if node is not None else []) if _local(n) == name), None)
    return node


def _text(node: ET.Element | None) -> str | None:
    return None if node is None else "".join(node.itertext())


def _value(node: ET.Element | None, key: str = "val", default: str | None = None) -> str | None:
    return default if node is None else node.get(key, default)


def _flag(node: ET.Element | None) -> str:
    return "false" if node is None or node.get("val", "1") in ("0", "false") else "true"


class _Book:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, part) of what a part refers to."""
        folder, base = posixpath.split(name)
        found = self.read(f"{folder}/_rels/{base}.rels")
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], place(r.get("Target"))) for r in (found if found is not None else [])}

    def sheets(self) -> Iterator[tuple[str, str]]:
        links = self.links("xl/workbook.xml")
        for sheet in _all(self.read("xl/workbook.xml"), "sheet"):
            key = next((v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id"), None)
            if key in links:
                yield sheet.get("name"), links[key][1]


def _styles(book: _Book) -> list[dict[str, str | None]]:
    """The properties of each cell format, by its number."""
    sheet = book.read("xl/styles.xml")
    formats = {n.get("numFmtId"): n.get("formatCode") for n in _all(_first(sheet, "numFmts"), "numFmt")}
    fonts, fills = list(_first(sheet, "fonts") or []), list(_first(sheet, "fills") or [])
    out = []
    for f in _first(sheet, "cellXfs") or []:
        font = fonts[int(f.get("fontId", 0))] if int(f.get("fontId", 0)) < len(fonts) else None
        fill = _first(fills[int(f.get("fillId", 0))], "patternFill") if int(f.get("fillId", 0)) < len(fills) else None
        align = _first(f, "alignment")
        out.append({
            "number_format": formats.get(f.get("numFmtId"), f.get("numFmtId")), "font_name": _value(_first(font, "name")), "font_size": _value(_first(font, "sz")), "font_color": _value(_first(font, "color"), "rgb"),
            "font_bold": _flag(_first(font, "b")), "font_italic": _flag(_first(font, "i")), "font_underline": _value(_first(font, "u"), "val", "single" if _first(font, "u") is not None else None),
            "fill_type": _value(fill, "patternType"), "fill_color": _value(_first(fill, "fgColor"), "rgb"), "h_align": _value(align, "horizontal"), "v_align": _value(align, "vertical"),
        })
    return out


def _sheet_parts(sheet: ET.Element, styles: list[dict]) -> Iterator[Property]:
    for view in _all(sheet, "sheetView"):
        yield "view", "", "zoom", view.get("zoomScale", "100")
    for pane in _all(sheet, "pane"):
        yield "view", "", "freeze", pane.get("topLeftCell")
    for column in _all(sheet, "col"):
        for i in range(int(column.get("min")), min(int(column.get("max")), int(column.get("min")) + 16383) + 1):
            for key in ("width", "hidden", "collapsed", "outlineLevel"):
                if column.get(key) is not None:
                    yield "column", str(i), key, column.get(key)
    for row in _all(sheet, "row"):
        for key, name in (("ht", "height"), ("hidden", "hidden"), ("collapsed", "collapsed"), ("outlineLevel", "outlineLevel")):
            if row.get(key) is not None:
                yield "row", row.get("r"), name, row.get(key)
    for cell in _all(sheet, "c"):
        style = int(cell.get("s", 0))
        for key, value in (styles[style] if style < len(styles) else {}).items():
            if value is not None:
                yield "cell", cell.get("r"), key, value
    for found in _all(sheet, "autoFilter"):
        yield "filter", found.get("ref"), "ref", found.get("ref")
        for column in _all(found, "filterColumn"):
            values = [f.get("val") for f in _all(column, "filter")] + [f"{c.get('operator', 'equal')} {c.get('val')}" for c in _all(column, "customFilter")]
            yield "filter", found.get("ref"), f"column {column.get('colId')}", ",".join(sorted(v or "" for v in values))
    for rule in _all(sheet, "dataValidation"):
        for key in ("type", "operator", "allowBlank", "errorStyle", "promptTitle", "errorTitle"):
            if rule.get(key) is not None:
                yield "validation", rule.get("sqref"), key, rule.get(key)
        for key in ("formula1", "formula2"):
            if (own := _first(rule, key)) is not None:
                yield "validation", rule.get("sqref"), key, _text(own)
    for block in _all(sheet, "conditionalFormatting"):
        if block.get("sqref"):
            for rule in _all(block, "cfRule"):
                yield "conditional", block.get("sqref"), f"{rule.get('type')} {rule.get('operator', '')}".strip(), ";".join(_text(f) or "" for f in _all(rule, "formula"))
    for line in _all(sheet, "sparkline"):
        yield "sparkline", _text(_first(line, "sqref")), "source", _text(_first(line, "f"))


_CHARTS = re.compile(r"(bar|line|pie|scatter|area|doughnut|radar|bubble|surface)(3D)?Chart$")


def _chart(book: _Book, name: str) -> Iterator[Property]:
    chart = book.read(name)
    series = [_text(f) for s in _all(chart, "ser") for kind in ("val", "yVal") for f in _all(_first(s, kind), "f")]
    at = ",".join(x or "" for x in series)
    for kind in (n for n in (chart.iter() if chart is not None else []) if _CHARTS.search(_local(n))):
        yield "chart", at, "type", _local(kind)
        if (direction := _first(kind, "barDir")) is not None:
            yield "chart", at, "direction", _value(direction)
    titles = {"title": _first(chart, "chart", "title")}
    for i, axis in enumerate(n for n in _first(chart, "chart", "plotArea") or [] if _local(n) in ("catAx", "dateAx", "valAx", "serAx")):
        titles["xyz"[min(i, 2)] + "title"] = _first(axis, "title")
    for key, title in titles.items():
        if title is not None:
            yield "chart", at, key, "".join(_text(t) or "" for t in _all(title, "t"))
    if (legend := _first(chart, "chart", "legend", "legendPos")) is not None:
        yield "chart", at, "legend", _value(legend)


def _pivot(book: _Book, name: str) -> Iterator[Property]:
    table = book.read(name)
    cache = next((book.read(part) for kind, part in book.links(name).values() if kind == "pivotCacheDefinition"), None)
    source = next(iter(_all(cache, "worksheetSource")), None)
    fields = [f.get("name") for f in _all(cache, "cacheField")]
    at = _value(_first(table, "location"), "ref", "")
    named = lambda i: fields[int(i)] if i is not None and 0 <= int(i) < len(fields) else str(i)
    yield "pivot", at, "name", table.get("name")
    yield "pivot", at, "source", None if source is None else f"{source.get('sheet')}!{source.get('ref')}"
    for key, group, item, place in (("filter", "pageFields", "pageField", "fld"), ("row", "rowFields", "field", "x"), ("column", "colFields", "field", "x")):
        yield "pivot", at, key, ",".join(named(f.get(place)) for f in _all(_first(table, group), item))
    yield "pivot", at, "value", ",".join(f"{f.get('subtotal', 'sum')}:{named(f.get('fld'))}" for f in _all(_first(table, "dataFields"), "dataField"))


def workbook_properties(content: bytes) -> list[tuple]:
    """(sheet, part, at, key, value) of an .xlsx workbook. Content that is no workbook gives none."""
    try:
        book = _Book(content)
        styles = _styles(book)
        out = []
        for title, name in book.sheets():
            sheet = book.read(name)
            if sheet is None:
                continue
            out += [(title, *p) for p in _sheet_parts(sheet, styles)]
            for kind, part in book.links(name).values():
                if kind == "pivotTable":
                    out += [(title, *p) for p in _pivot(book, part)]
                elif kind == "drawing":
                    out += [(title, *p) for inner, chart in book.links(part).values() if inner == "chart" for p in _chart(book, chart)]
        return out
    except (zipfile.BadZipFile, ET.ParseError):
        return []


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, part, at, key, value), a workbook a task at most."""

    def rows(batches):
        for pdf in batches:
            found = [(p, *row) for p, content in zip(pdf["path"], pdf["content"], strict=True) for row in workbook_properties(content)]
            yield pd.DataFrame(found, columns=["path", "sheet", "part", "at", "key", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, sheet string, part string, at string, key string, value string")
