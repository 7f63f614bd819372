import datetime as dt
import json

from pyspark.sql import functions as F

from tallyframe.operators import feed_drift

SCHEMA = "feed_id string, file_name string, file_no int, delivered_at timestamp_ntz, line_no int, raw_line string, column_name string, value string"


def feed(spark, files):
    """files: (feed, number, day, lines)."""
    data = [(f, f"{f}_{n}", n, dt.datetime(2024, 1, day), i, line, "own", "own") for f, n, day, lines in files for i, line in enumerate(lines, 1)]
    cells = feed_drift.cells(spark.createDataFrame(data, SCHEMA)).cache()
    return cells, feed_drift.file_columns(cells)


def test_changes_between_files(spark, rows):
    one = ["﻿Account-Id,Balance,Is Active,Cost Center,Note", 'A-1,"1,000.50",yes,77,x', "A-2,(20.00),no,78,y", "A-3,3.25-,yes,79,", "", "A-4,4.5,no,80,-"]
    two = ["# extract", "account_id\tbalance\tis_active\tkostenstelle\tposted_on", "A-1\t1000.50\ttrue\t77\t2024-01-31", "A-2\t-20\tfalse\t78\t2024/02/01", "A-3\t-3.25\ttrue\t79\tn/a", "A-4\t4.5\tfalse\t80\t"]
    three = [json.dumps({"accountId": f"A-{i}", "BALANCE": i * 1.5, "isActive": str(i % 2), "kostenstelle": 76 + i, "postedOn": None}) for i in range(1, 5)]
    four = [json.dumps({"accountId": "A-1", "balance": None, "isActive": 1, "kostenstelle": "CO-77", "postedOn": "31.01.2024"})]
    cells, cols = feed(spark, [("f", 1, 5, one), ("f", 2, 1, two), ("f", 3, 7, three), ("f", 3, 8, three), ("f", 4, 9, four), ("g", 9, 1, one)])
    assert rows(feed_drift.drift(cells, cols)) == [
        ("f", 2, "added", "postedon", ""), ("f", 2, "removed", "note", ""), ("f", 2, "renamed", "kostenstelle", "costcenter"),
        ("f", 3, "type_changed", "isactive", ""), ("f", 4, "type_changed", "kostenstelle", ""),
    ]
    wide = feed_drift.read_feed(cells, cols, "f").where("file_no = 1 and key = 'a-2'").first()
    assert wide["balance"] == -20.0 and wide["isactive"] == "no" and wide["costcenter"] == 78
    assert feed_drift.consistent_table(cells, cols).where("feed_id = 'f' and file_no = 3").count() == 4


def test_types_of_values(spark):
    texts = {"1": "int", "1,234": "int", "(5)": "int", "5-": "int", "+7": "int", "1.5": "decimal", "1.234,56": "decimal", ".5": "decimal", "1e5": "decimal", "2024-01-02": "date", "2.1.2024": "date", "1/2/2024": "date", "Y": "boolean", "TRUE": "boolean", "week 3": "text", "A-1": "text", "12,34": "text", "--": "text"}
    df = spark.createDataFrame([(k,) for k in texts], "v string").select("v", feed_drift.type_of(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == texts


def test_empty_odd_and_broken_lines(spark, rows):
    cells, cols = feed(spark, [])
    assert rows(feed_drift.drift(cells, cols)) == [] and rows(feed_drift.consistent_table(cells, cols)) == []
    long = "x" * 200_000
    cells, cols = feed(spark, [("f", 1, 1, ["id;account_no;id;v", f"1;A-1;;{long}", "2;A-2", '3;"A-3;broken', None, "4;A-4;9;z;extra"]), ("f", 2, 1, ["{broken", '{"account_no": "A-1", "n": {"x": 1}}', "[1]"]), (None, 3, 1, ["a,b"])])
    assert {(r.column_name, r.type) for r in cols.where("file_no = 1").collect()} >= {("id", "int"), ("v", "text")}
    assert {r.column_name for r in cols.where("file_no = 2").collect()} == {"accountno", "n"}
