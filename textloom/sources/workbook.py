"""Workbooks (xlsx) as tables, and tables as workbooks.

Files are read by Spark, from any file system it reaches, and opened in tasks: a file is one value there, its rows are
streamed out of the zip, and only its shared strings are held besides. Nothing passes the driver but the
columns' names and kinds of values."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.shared import written

# Texts that stand for a missing value, number formats that show a date, rows of a sheet.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
SHEET_ROWS = 1_048_576

#: Column types by the kinds of a column's values; any other mixture is text.
TYPES = {"i": "bigint", "n": "double", "in": "double", "b": "boolean", "d": "timestamp_ntz"}
CELLS = "path string, sheet string, row long, names array<string>, kinds array<string>, cells array<string>"
_ESCAPED, _CONTROL = re.compile(r"_x([0-9A-Fa-f]{4})_"), re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    """An attribute by its name without a namespace."""
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _said(element: ElementTree.Element) -> str:
    """Text of a string element with its runs, without phonetic hints."""
    parts = [e.text or "" for child in element if _tag(child) != "rPh" for e in child.iter() if _tag(e) == "t"]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _place(reference: str) -> int:
    """Column of a cell such as ``AB12``, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _elements(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag, one at a time: each is cleared with all before it once it is used."""
    with book.open(name) as f:
        above: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if _tag(element) == wanted:
                yield element
                if above:
                    above[-1].clear()


class Workbook:
    """One file: its sheets by name, and the values of their rows."""

    def __init__(self, content: bytes):
        self.book = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.book.namelist())
        tree = ElementTree.fromstring(self.book.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self.book.read("xl/_rels/workbook.xml.rels"))
        targets = {e.get("Id"): e.get("Target", "") for e in links}
        self.sheets = {}
        for e in tree.iter():
            if _tag(e) == "sheet":
                target = targets.get(_attribute(e, "id"), "")
                self.sheets[e.get("name", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        old = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in tree.iter())
        self.epoch = datetime(1904, 1, 1) if old else datetime(1899, 12, 30)
        self.strings = [_said(e) for e in _elements(self.book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _date_styles(self) -> set[int]:
        styles = ElementTree.fromstring(self.book.read("xl/styles.xml"))
        shown = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _tag(e) == "numFmt"}
        plain = {k: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", v) for k, v in shown.items()}
        dated = DATE_FORMATS | {k for k, v in plain.items() if re.search(r"[dmyhs]", v, re.IGNORECASE)}
        cells = next((e for e in styles if _tag(e) == "cellXfs"), [])
        return {k for k, e in enumerate(cells) if int(e.get("numFmtId", 0)) in dated}

    def _value(self, cell: ElementTree.Element) -> tuple[str, str] | None:
        """Kind (i integer, n number, b boolean, d time, s text) and text of a value; None for an error or nothing."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            inner = next((e for e in cell if _tag(e) == "is"), None)
            return None if inner is None else ("s", _said(inner))
        text = next((e.text for e in cell if _tag(e) == "v"), None)
        if text is None or kind == "e":
            return None
        if kind == "s":
            return "s", self.strings[int(text)]
        if kind == "str":
            return "s", _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
        if kind == "b":
            return "b", "true" if text.strip() == "1" else "false"
        if kind == "d":
            return "d", text.replace("T", " ").removesuffix("Z")
        whole = re.fullmatch(r"\s*-?\d+\s*", text)
        number = int(text) if whole else float(text)
        if int(cell.get("s", 0)) in self.dates:
            day = number + 1 if self.epoch.year == 1899 and 1 <= number < 60 else number
            if 0 <= day < 1 or not 0 <= day < 2_958_466:
                return ("s", str((datetime.min + timedelta(seconds=round(86_400 * day))).time())) if 0 <= day < 1 else ("n", repr(float(number)))
            return "d", str(self.epoch + timedelta(milliseconds=round(86_400_000 * day)))
        if number == number // 1 and abs(number) < 1 << 63:
            return "i", str(int(number))
        return "n", repr(float(number))

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
        """Number (from 1) and values by place of a sheet's rows, in their order."""
        at = 0
        for row in _elements(self.book, self.sheets[sheet], "row"):
            at, place, found = int(row.get("r", at + 1)), -1, {}
            for cell in row:
                place = _place(cell.get("r")) if cell.get("r") else place + 1
                value = self._value(cell)
                if value is not None:
                    found[place] = value
            yield at, found


def column_names(head: dict[int, tuple[str, str]], width: int) -> list[str]:
    """Names from the first row: a repeated one gets ``.1``, ``.2``, ..., an empty one its place."""
    names: list[str] = []
    for place in range(width):
        name = head.get(place, ("s", ""))[1] or f"Unnamed: {place}"
        k, free = 0, name
        while free in names:
            k += 1
            free = f"{name}.{k}"
        names.append(free)
    return names


def workbook_cells(files: DataFrame, sheet: int | str | None = 0, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """path, sheet, row, names, kinds, cells: the values of each row that has any, of files (path, content).

    ``sheet`` is a place, a name (files without it give nothing), or None for all. The first row with a value has the
    columns' names, and comes as row 0 with kind ``h`` and places as cells. Texts of ``missing`` and errors are
    no values. A value without a name above it is in column ``Unnamed: k``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.string())

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), lists, lists, lists]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "sheet", "row", "names", "kinds", "cells"])

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                book = Workbook(content.as_py())
                named = list(book.sheets)
                for name in named if sheet is None else named[sheet : sheet + 1] if isinstance(sheet, int) else [n for n in named if n == sheet]:
                    names, held = None, []
                    for at, found in book.rows(name):
                        if names is None:
                            if found:
                                names = column_names(found, max(found) + 1)
                                held.append((path.as_py(), name, 0, names, ["h"] * len(names), [str(k) for k in range(len(names))]))
                            continue
                        kept = {k: v for k, v in found.items() if v[0] != "s" or v[1] not in missing}
                        if kept:
                            own = [names[k] if k < len(names) else f"Unnamed: {k}" for k in kept]
                            held.append((path.as_py(), name, at, own, [v[0] for v in kept.values()], [v[1] for v in kept.values()]))
                        if len(held) >= 1024:
                            yield table(held)
                            held = []
                    yield table(held)

    return files.select("path", "content").mapInArrow(read, CELLS)


def workbook_table(files: DataFrame, sheet: int | str | None = 0, schema: T.StructType | None = None, missing: tuple[str, ...] = MISSING, origin: str | None = None) -> DataFrame:
    """The rows of workbooks, files (path, content), as one table; columns of different files meet by name.

    Without ``schema`` columns come in the order of their places, as bigint, double, boolean, timestamp_ntz, or else
    as text, by all their values; a column without values is text. A ``schema`` takes its columns; what does not
    fit its type is null. ``origin`` names a column for path, sheet and row. Rows without a value are left out; no
    files give a table without columns."""
    cells = workbook_cells(files, sheet, missing)
    if schema is None:
        cells = written(cells, "workbook")
        each = cells.select(F.explode(F.arrays_zip("names", "kinds", "cells")).alias("c")).select("c.*")
        place = F.min(F.when(F.col("kinds") == "h", F.col("cells").cast("int")))
        found = each.groupBy("names").agg(F.coalesce(place, F.lit(1 << 20)).alias("place"), F.array_sort(F.collect_set(F.when(F.col("kinds") != "h", F.col("kinds")))).alias("kinds"))
        columns = [(r.names, TYPES.get("".join(r.kinds), "string")) for r in found.orderBy("place", "names").collect()]
    else:
        columns = [(f.name, f.dataType) for f in schema.fields]
    rows = cells.where("row > 0").select(F.struct("path", "sheet", "row").alias("o"), F.map_from_arrays("names", "cells").alias("m"))
    made = [F.try_element_at("m", F.lit(c)).try_cast(kind).alias(c) for c, kind in columns]
    return rows.select(*([F.col("o").alias(origin)] if origin else []), *made)


def read_workbooks(spark: SparkSession, path: str, sheet: int | str | None = 0, schema: T.StructType | None = None, missing: tuple[str, ...] = MISSING, origin: str | None = None) -> DataFrame:
    """``workbook_table`` of a file, or of all xlsx files in a folder; each file has at most 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").option("recursiveFileLookup", "true").load(path)
    return workbook_table(files, sheet, schema, missing, origin)


def _letters(place: int) -> str:
    out = ""
    place += 1
    while place:
        place, k = divmod(place - 1, 26)
        out = chr(65 + k) + out
    return out


def _cell(place: int, row: int, value: object) -> str:
    at = f'<c r="{_letters(place)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) <= 1 << 53 or isinstance(value, float) and abs(value) < float("inf"):
        return f"{at}><v>{value!r}</v></c>"
    text = escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value)))
    return f'{at} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def workbook_bytes(columns: list[str], rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook with one sheet: names, then rows."""
    main, relations = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kinds = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{relations}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{relations}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for at, row in enumerate([columns, *rows], 1):
                f.write(f'<row r="{at}">{"".join(_cell(k, at, v) for k, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbook_files(df: DataFrame, rows_per_file: int = 50_000) -> DataFrame:
    """path (a name), content: the table's rows as workbooks of at most ``rows_per_file`` rows, made in tasks. Whole
    numbers beyond 2^53 and all that is no number or boolean are text; texts are kept whole, also where a
    spreadsheet program shows 32,767 characters. An empty table gives no workbook."""
    if not 0 < rows_per_file < SHEET_ROWS:
        raise ValueError(f"a sheet has at most {SHEET_ROWS - 1} rows below the names")
    plain = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    # the task sees places, as names may have dots
    placed = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    cells = placed.select(*[F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string") for f in placed.schema.fields])
    columns = df.columns

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{made:05d}.xlsx"]), pa.array([workbook_bytes(columns, held)], pa.binary())], ["path", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == rows_per_file:
                    yield file()
                    made, held = made + 1, []
        if held:
            yield file()

    return cells.mapInArrow(render, "path string, content binary")
