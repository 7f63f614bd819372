import datetime as dt
import json
import zipfile

import pytest

from tallyframe import sql
from tallyframe.operators import templates, workbooks
from tallyframe.sources import readers, sinks


def test_csv_types_and_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,s,b\n1,1.5,NA,true\n2,,"a,b",false\n')
    df = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "s": "string", "b": "boolean"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 1.5, None, True), (2, None, "a,b", False)]
    r = readers.load_report(df, 1)
    assert r["rows"] == 2 and r["null_counts"] == {"id": 0, "x": 1, "s": 1, "b": 0} and len(r["preview"]) == 1
    with pytest.raises(Exception, match="(?i)path"):
        readers.read_table(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("doc,n", [([{"a": 1}, {"a": 2}], 2), ({"a": [1, 2], "b": ["x", "y"]}, 2), ({"a": 1, "b": "x"}, 1)])
def test_json_shapes(spark, tmp_path, doc, n):
    (tmp_path / "a.json").write_text(json.dumps(doc))
    df = readers.read_json(spark, str(tmp_path / "a.json"))
    assert df.count() == n and "a" in df.columns


def test_commented_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿# IFRS chart\n\nAccount_ID,Name\n1,Café\n2,#x\n".encode())
    (tmp_path / "b.csv").write_bytes("Account_ID\tOther\n3\tCaf\xe9\n".encode("latin-1"))
    got = sorted(tuple(r) for r in readers.read_commented_csv(spark, str(tmp_path / "*.csv"), ("#",), True).select("file", "row_index", "Account_ID", "Name", "Other").collect())
    assert got == [("a.csv", 0, "1", "Café", None), ("a.csv", 1, "2", "#x", None), ("b.csv", 0, "3", None, "Café")]
    lines = readers.numbered_lines(spark, str(tmp_path / "b.csv"))
    assert [(r.row_index, r.line) for r in lines.orderBy("row_index").collect()] == [(0, "Account_ID\tOther"), (1, "3\tCafé")]


@pytest.mark.parametrize("text,want", [
    ("a\tb\n1\t2\n3\t4", {(1, "a", "1"), (1, "b", "2"), (2, "a", "3"), (2, "b", "4")}), ("a|b\n1|2|3", {(1, "a", "1"), (1, "b", "2"), (1, "col_3", "3")}), ("x  y z\n1  2 3", {(1, "x", "1"), (1, "y z", "2 3")}),
    ("only one line", {(0, "col_1", "only"), (0, "col_2", "one"), (0, "col_3", "line")}), ("", set()), (None, set()), (" \n\n", set()),
])
def test_tables_in_texts(spark, text, want):
    df = spark.createDataFrame([(7, text)], "i long, t string")
    assert {(r.row_no, r.column_name, r.value) for r in readers.parse_tables(df, "i", "t").collect()} == want


def test_files_and_guards(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("x.csv", "y.csv", "z.txt"):
        (tmp_path / "d" / n).write_text("1")
    assert readers.find_files(spark, [str(tmp_path)], "*.csv", "Y").count() == 1 and readers.find_files(spark, [str(tmp_path)], "*.csv").count() == 2
    one = readers.stage_file(str(tmp_path / "d" / "x.csv"), str(tmp_path / "s"))
    two = readers.stage_file(str(tmp_path / "d" / "x.csv"), str(tmp_path / "s"))
    assert one != two and len(list((tmp_path / "s").iterdir())) == 2
    with pytest.raises(ValueError, match="only SELECT"):
        readers.query_database(spark, "jdbc:x", "DELETE FROM t")
    assert readers.page_numbers("all") is None and readers.page_numbers("1,3-4") == {1, 3, 4}


def test_sql_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n3,4\n")
    assert sql.register(spark, str(tmp_path / "a.csv"), "t_a")["rows"] == 2
    r = sql.query_report(spark, "SELECT k, v * 2 AS w FROM t_a ORDER BY k", preview=1)
    assert r["preview"] == [{"k": 1, "w": 4}] and r["truncated"]
    assert {"t_a"} <= {x["name"] for x in sql.list_tables(spark)}
    for what in ("WITH q AS (SELECT * FROM t_a) SELECT * FROM q", "t_a"):
        out = sql.export_parquet(spark, what, str(tmp_path / "out"))
        assert out["rows"] == 2 and out["bytes"] > 0
    sinks.write_csv(spark.table("t_a"), str(tmp_path / "c"), single=True)
    assert readers.read_csv(spark, str(tmp_path / "c")).count() == 2
    for _ in range(2):
        sinks.append_json(spark.table("t_a"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def book(path, sheets, names=0, macro=False):
    """A minimal workbook: sheets as name -> rows of values; '=...' is a formula."""
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        tags = "".join(f'<sheet name="{n.replace("&", "&amp;")}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{tags}</sheets><definedNames>{'<definedName name=\"x\">A1</definedName>' * names}</definedNames></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        if macro:
            z.writestr("xl/vbaProject.bin", b"x")
        for i, rows in enumerate(sheets.values(), 1):
            cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}"><f>{v[1:]}</f><v>0</v></c>' if str(v).startswith("=") else f'<c r="{chr(65 + c)}{r}" t="s"><v>0</v></c>' if v == "shared" else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    book(tmp_path / "data.xlsx", {"S1": [["a", "b", "shared"], ["1", "2", "3"], ["4", "5", "6"]]})
    book(tmp_path / "calc.xlsx", {"P&L": [["x", "=SUMIF(A1:A2,1)", "=SUM(A1)"]], "Empty": []}, names=2, macro=True)
    book(tmp_path / "sales_export.xlsx", {"P&L": [["h"]], "Export": [[str(i)] for i in range(99)]})
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    f = workbooks.classify(workbooks.scan_directory(spark, str(tmp_path))).cache()
    got = {r.file_name: r for r in f.collect()}
    assert got["data.xlsx"].total_row_count == 3 and got["data.xlsx"].sheets[0].anchor_row == 1 and got["data.xlsx"].scan_status == "ok"
    c = got["calc.xlsx"]
    assert (c.formula_count, c.has_sumif_pattern, c.has_macros, c.named_range_count, c.sheets[1].is_empty) == (2, True, True, 2, True)
    assert got["old.xls"].scan_status == "skipped" and got["broken.xlsx"].scan_status == "error" and got["broken.xlsx"].archetype == "Unknown"
    s = workbooks.triage_summary(f).first()
    assert (s.total_files, s.scanned, s.errors, s.skipped) == (5, 3, 1, 1)
    t = workbooks.read_sheet(spark, str(tmp_path / "data.xlsx"))
    assert t.columns == ["a", "b", "shared"] and sorted(tuple(r) for r in t.collect()) == [("1", "2", "3"), ("4", "5", "6")]
    assert readers.read_table(spark, str(tmp_path / "data.xlsx")).count() == 2


BASE = {"file_path": "x", "file_size_bytes": 1, "file_extension": ".xlsx", "scan_status": "ok", "error_message": "", "sheet_count": 1, "sheet_names": ["S"], "sheets": [], "total_row_count": 0, "formula_count": 0, "named_range_count": 0, "has_macros": False, "has_pivot_tables": False, "has_sumif_pattern": False, "has_vlookup_pattern": False, "has_if_chain": False, "dominant_formula_functions": []}


@pytest.mark.parametrize("name,facts,archetype,confidence", [
    ("budget_2025.xlsx", {"formula_count": 50, "has_sumif_pattern": True, "sheet_count": 2, "sheet_names": ["P&L", "Balance Sheet"], "total_row_count": 100}, "Financial Report", 0.75),
    ("sales_export.xlsx", {"total_row_count": 5000}, "Data Extract", 0.40),
    ("homework_chapter3.xlsx", {"sheet_count": 4, "sheet_names": ["#1", "#2", "#3", "#4"], "total_row_count": 20, "formula_count": 3}, "Academic/Exercise", None),
    ("x.xlsx", {"scan_status": "error"}, "Unknown", 0.0),
])
def test_archetypes(spark, name, facts, archetype, confidence):
    df = spark.createDataFrame([{**BASE, "file_name": name, **facts}], workbooks.SCHEMA)
    r = workbooks.classify(df).first()
    assert r.archetype == archetype and (confidence is None or r.archetype_confidence == pytest.approx(confidence))
    assert workbooks.archetype_counts(workbooks.classify(df)).first().n_files == 1


def test_templates(spark, tmp_path, rows):
    ix = spark.createDataFrame([("a", "A", "income_statement", "manufacturing", 12), ("b", "B", "balance_sheet", "general", 3), ("c", "C", None, None, None)], "id string, name string, category string, industry string, hierarchy_count int")
    assert rows(templates.recommend(ix, "Manufacturing", "PL"), "id", "score", "industry_match") == [("a", 100, True), ("b", 60, False)]
    assert templates.recommend(ix).count() == 1 and templates.recommend(ix.limit(0), "x").count() == 0
    c = templates.Catalogue(str(tmp_path), "templates")
    c.save("My Template!", {"industry": "oil_gas", "at": dt.datetime(2024, 1, 1)})
    assert c.get("my template")["industry"] == "oil_gas" and c.get("nope") is None
    assert c.update("My Template!", note="x")["note"] == "x" and len(c.list(industry="oil_gas")) == 1 and len(c.by_industry("oil")) == 1
    assert c.delete("My Template!") and not c.delete("My Template!") and c.list() == []
    with pytest.raises(ValueError, match="needs an id"):
        c.save("!", {})
