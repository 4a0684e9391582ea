"""Workbooks as tables: types, names, dates, several files and sheets, and a round trip."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import types as T

from textloom.sources.corpus import assemble_documents, read_table
from textloom.sources.workbook import MISSING, Workbook, read_workbooks, workbook_bytes, workbook_files, workbook_table

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def made(sheets, strings=(), formats=(), epoch=""):
    """A workbook as spreadsheet programs write them: shared strings, styles, absolute and relative targets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook {MAIN}>{epoch}<sheets>{listed}</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        codes = "".join(f'<numFmt numFmtId="{164 + k}" formatCode="{c}"/>' for k, c in enumerate(formats))
        book.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts>{codes}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>{"".join(f"""<xf numFmtId="{164 + k}"/>""" for k in range(len(formats)))}</cellXfs></styleSheet>')
        for k, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_values_of_a_sheet():
    strings = ["<t>plain</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh>", "<t>_x005F_x0041_ _x000D_</t>"]
    rows = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c t="s"><v>2</v></c><c r="AB2" t="e"><v>#N/A</v></c></row><row r="4"/>'
        '<row><c><v>3.0</v></c><c><v>2.5</v></c><c t="b"><v>1</v></c><c t="str"><v>x</v></c><c t="inlineStr"><is><t>in</t></is></c></row>'
        '<row r="9"><c s="1"><v>45292</v></c><c s="2"><v>45292.75</v></c><c s="3"><v>7</v></c><c s="1"><v>0.5</v></c><c s="1"><v>59</v></c><c s="1"><v>61</v></c><c t="d"><v>2024-02-29T01:02:03</v></c></row>'
    )
    got = dict(Workbook(made({"S": rows}, strings, ["dd/mm/yyyy\\ hh:mm", "&quot;days&quot; 0"])).rows("S"))
    assert got[2] == {0: ("s", "plain"), 2: ("s", "two runs"), 3: ("s", "_x0041_ \r")} and got[4] == {}
    assert got[5] == {0: ("i", "3"), 1: ("n", "2.5"), 2: ("b", "true"), 3: ("s", "x"), 4: ("s", "in")}
    assert got[9] == {0: ("d", "2024-01-01 00:00:00"), 1: ("d", "2024-01-01 18:00:00"), 2: ("i", "7"), 3: ("s", "12:00:00"), 4: ("d", "1900-02-28 00:00:00"), 5: ("d", "1900-03-01 00:00:00"), 6: ("d", "2024-02-29 01:02:03")}
    later = Workbook(made({"S": '<row><c s="1"><v>43830</v></c></row>'}, epoch='<workbookPr date1904="1"/>'))
    assert dict(later.rows("S"))[1] == {0: ("d", "2024-01-01 00:00:00")}


def test_files_meet_by_name(spark, tmp_path):
    text = lambda *xs: "<row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else "<c/>" if x is None else f"<c><v>{x}</v></c>" for x in xs) + "</row>"
    first = text("id", "age", "age", None, "q1_response") + text(1, 30, "x", 4, "A first answer.") + text(2, "N/A", "None", None, "") + text(None, None)
    second = text("id", "city", "q1_response") + text(3, "Rome", "Another.") + text(4.5, "7", "More.", "beyond")
    (tmp_path / "a.xlsx").write_bytes(made({"one": first, "two": text("z") + text("other sheet")}))
    (tmp_path / "b.XLSX").write_bytes(made({"one": second}))
    (tmp_path / "empty.xlsx").write_bytes(made({"one": ""}))
    (tmp_path / "notes.txt").write_text("no workbook")
    df = read_workbooks(spark, str(tmp_path), origin="at")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields][1:] == [("id", "double"), ("age", "bigint"), ("city", "string"), ("age.1", "string"), ("q1_response", "string"), ("Unnamed: 3", "string")]
    rows = {r.id: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 3, 4.5] and rows[1]["Unnamed: 3"] == "4" and rows[4.5]["Unnamed: 3"] == "beyond" and rows[4.5].city == "7"
    assert (rows[2].age, rows[2]["age.1"], rows[2].q1_response) == (None, None, None) and (rows[2].at.sheet, rows[2].at.row) == ("one", 3)
    kept = read_workbooks(spark, str(tmp_path / "a.xlsx"), missing=())
    assert {r.age for r in kept.collect()} == {"30", "N/A"} and "None" in {r["age.1"] for r in kept.collect()}
    assert {r.z for r in read_workbooks(spark, str(tmp_path), "two").collect()} == {"other sheet"} == {r.z for r in read_workbooks(spark, str(tmp_path), 1).collect()}
    assert read_workbooks(spark, str(tmp_path), None).where("z is not null or id is not null").count() == 5
    typed = read_table(spark, str(tmp_path / "a.xlsx"), T.StructType.fromDDL("q1_response string, id string, age double, gone int"))
    assert sorted(map(tuple, typed.collect()), key=str) == sorted([("A first answer.", "1", 30.0, None), (None, "2", None, None)], key=str)
    docs = assemble_documents(read_table(spark, str(tmp_path / "a.xlsx")).drop("age"), "id")
    assert {r.id: (r.text, r.metadata) for r in docs.collect()}["1"] == ("A first answer.", {"id": "1", "age.1": "x", "Unnamed: 3": "4", "q1_response": "A first answer."})
    assert read_workbooks(spark, str(tmp_path / "empty.xlsx")).columns == []


def test_round_trip(spark):
    texts = ["plain", " é 日本 🙂 ", "a\r\nb\tc\x0b_x0041_", "<&>\"'", "x" * 100_000, "007", "1e5", None, *MISSING]
    rows = [(k, k / 3, k % 2 == 0, t, (1 << 60) + k, datetime.datetime(2024, 1, 1, 0, 0, k), None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, `x.y` double, b boolean, t string, large long, at timestamp, none string").repartition(3)
    files = workbook_files(df, 4).cache()
    assert files.count() >= 7
    got = workbook_table(files, missing=("",))
    assert [t for _, t in got.dtypes] == ["bigint", "double", "boolean", "string", "string", "string", "string"]
    wanted = {r[0]: (r[1], r[2], r[3] or None, str(r[4]), f"2024-01-01 00:00:{r[0]:02d}", None) for r in rows}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == wanted
    assert workbook_files(df.where("k < 0")).isEmpty() and workbook_table(workbook_files(df.where("false"))).columns == []
    with pytest.raises(ValueError):
        workbook_files(df, 1 << 21)


def test_a_sheet_is_read_as_a_stream():
    import tracemalloc

    data = workbook_bytes(["k", "t"], ([k, "word " * 20] for k in range(30_000)))
    tracemalloc.start()
    assert sum(1 for _ in Workbook(data).rows("Sheet1")) == 30_001
    assert tracemalloc.get_traced_memory()[1] < 3_000_000 + len(data)
    tracemalloc.stop()
