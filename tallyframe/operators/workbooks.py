"""Workbook triage: reading the structure of .xlsx files and telling what kind
of workbook each one is.

Files are read as binary rows and opened inside ``mapInPandas``, one file at a
time, with the standard library; a broken file gives an error row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of a sheet that are looked at cell by cell, and of those the ones for the anchor.
SHEET_ROWS, SHEET_COLS, ANCHOR = 200, 50, 20

SCHEMA = """file_path string, file_name string, file_size_bytes long, file_extension string, scan_status string, error_message string, sheet_count int, sheet_names array<string>,
sheets array<struct<name:string,row_count:int,col_count:int,formula_count:int,anchor_row:int,anchor_col:int,has_pivot_table:boolean,is_empty:boolean>>,
total_row_count long, formula_count long, named_range_count int, has_macros boolean, has_pivot_tables boolean, has_sumif_pattern boolean, has_vlookup_pattern boolean, has_if_chain boolean, dominant_formula_functions array<string>"""
CELLS = "file_path string, sheet string, row_no int, col_no int, value string, formula string"

_NS = re.compile(r"^\{[^}]*\}")
_FUNCTION = re.compile(r"([A-Z][A-Z0-9.]+)\(")


def _tag(e: ElementTree.Element) -> str:
    return _NS.sub("", e.tag)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


class Book:
    """The parts of an .xlsx file that are needed."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {}
        if "xl/_rels/workbook.xml.rels" in self.names:
            rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets: list[tuple[str, str]] = []
        self.defined = 0
        for e in book.iter():
            if _tag(e) == "sheet":
                target = rels.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), ""), "").lstrip("/")
                path = target if target.startswith("xl/") else f"xl/{target}"
                self.sheets.append((e.get("name", ""), path if path in self.names else f"xl/worksheets/sheet{len(self.sheets) + 1}.xml"))
            elif _tag(e) == "definedName":
                self.defined += 1
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.names:
            self.shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")) if _tag(s) == "si"]

    def cells(self, path: str) -> Iterator[tuple[int, int, str | None, str | None]]:
        """(row, column, value, formula); shared formulas without a text give an empty one."""
        row = col = 0
        for _, e in ElementTree.iterparse(self.zip.open(path), events=("end",)):
            if _tag(e) != "c":
                continue
            ref = e.get("r")
            if ref:
                row, col = int(re.sub(r"\D", "", ref) or 1), _column(ref)
            else:
                col += 1
            value = formula = None
            for x in e:
                if _tag(x) == "f":
                    formula = x.text or ""
                elif _tag(x) == "v":
                    value = x.text
                elif _tag(x) == "is":
                    value = "".join(t.text or "" for t in x.iter() if _tag(t) == "t")
            if e.get("t") == "s" and value is not None:
                value = self.shared[int(value)]
            e.clear()
            yield row, col, value, formula

    def pivots(self, path: str) -> bool:
        rel = path.replace("worksheets/", "worksheets/_rels/") + ".rels"
        return rel in self.names and b"pivotTable" in self.zip.read(rel)


def scan_file(path: str, content: bytes) -> dict:
    name = path.rstrip("/").rpartition("/")[2]
    ext = name.rpartition(".")[2].lower()
    out = {"file_path": path, "file_name": name, "file_size_bytes": len(content), "file_extension": f".{ext}", "scan_status": "ok", "error_message": "", "sheet_count": 0, "sheet_names": [], "sheets": [], "total_row_count": 0, "formula_count": 0, "named_range_count": 0, "has_macros": False, "has_pivot_tables": False, "has_sumif_pattern": False, "has_vlookup_pattern": False, "has_if_chain": False, "dominant_formula_functions": []}
    if ext in ("xls", "xlsb"):
        return out | {"scan_status": "skipped", "error_message": f"format .{ext} is not read"}
    if ext not in ("xlsx", "xlsm"):
        return out | {"scan_status": "error", "error_message": f"no workbook: .{ext}"}
    try:
        book = Book(content)
        functions: Counter[str] = Counter()
        for sheet, sheet_path in book.sheets:
            rows = cols = formulas = 0
            filled: dict[int, set[int]] = {}
            top = 0
            for r, c, value, formula in book.cells(sheet_path):
                rows, cols = max(rows, r), max(cols, c)
                if r <= SHEET_ROWS and c <= SHEET_COLS:
                    top = max(top, r)
                    if formula is not None:
                        formulas += 1
                        up = formula.upper()
                        functions.update(_FUNCTION.findall(up))
                        out["has_sumif_pattern"] |= "SUMIF" in up
                        out["has_vlookup_pattern"] |= "VLOOKUP" in up
                        out["has_if_chain"] |= bool(re.search(r"\bIF\(.*\bIF\(", up))
                    if r <= ANCHOR and c <= ANCHOR and (value not in (None, "") or formula is not None):
                        filled.setdefault(r, set()).add(c)
            if rows > SHEET_ROWS and top:  # the part seen stands for the rest
                formulas = round(formulas * rows / SHEET_ROWS)
            width = min(cols, ANCHOR)
            anchor = next((r for r in sorted(filled) if width and len(filled[r]) > width / 2), None)
            pivot = book.pivots(sheet_path)
            out["sheets"].append({"name": sheet, "row_count": rows, "col_count": cols, "formula_count": formulas, "anchor_row": anchor, "anchor_col": min(filled[anchor]) if anchor else None, "has_pivot_table": pivot, "is_empty": rows == 0})
            out["total_row_count"] += rows
            out["formula_count"] += formulas
            out["has_pivot_tables"] |= pivot
        out |= {"sheet_count": len(book.sheets), "sheet_names": [s for s, _ in book.sheets], "named_range_count": book.defined, "has_macros": any(n.endswith("vbaProject.bin") for n in book.names), "dominant_formula_functions": [f for f, _ in functions.most_common(5)]}
    except Exception as e:  # noqa: BLE001 - any broken file is a row
        return out | {"scan_status": "error", "error_message": f"{type(e).__name__}: {e}"[:500]}
    return out


def _files(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xlsx,xlsm,xls,xlsb}").load(directory).select("path", "content")


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """One row per workbook under a directory (see ``SCHEMA``); broken files have
    scan_status ``error``, old binary formats ``skipped``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([scan_file(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)])

    return _files(spark, directory).mapInPandas(run, SCHEMA)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks under a path, in long form; broken files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    book = Book(bytes(c))
                    rows = [(p, s, r, k, v, f) for s, at in book.sheets for r, k, v, f in book.cells(at)]
                except Exception:  # noqa: BLE001
                    rows = []
                yield pd.DataFrame(rows, columns=["file_path", "sheet", "row_no", "col_no", "value", "formula"])

    return _files(spark, path).mapInPandas(run, CELLS)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet (the first by default) of one workbook as a table of texts under its first row."""
    cells = read_cells(spark, path)
    if sheet is None:
        sheet = spark.read.format("binaryFile").load(path).select("content").limit(1).rdd.map(lambda r: Book(bytes(r[0])).sheets[0][0]).first()
    one = cells.where(F.col("sheet") == sheet)
    header = {r.col_no: r.value or f"col_{r.col_no}" for r in one.where("row_no = 1").collect()}
    body = one.where("row_no > 1").groupBy("row_no").agg(*[F.max(F.when(F.col("col_no") == c, F.col("value"))).alias(n) for c, n in sorted(header.items())])
    return body.orderBy("row_no").drop("row_no")


#: Words in file names, functions, and sheet names that tell of an archetype.
FILE_WORDS = {
    "Model/Template": ((r"\b(template|blank|form)\b", 0.2), (r"\b(model|simulat\w+|monte.?carlo|probabilit\w+|sampling|experiment|decision.?tree|portfolio|optimi\w+|solver|allocation|scenario)\b", 0.2)),
    "Academic/Exercise": ((r"\b(exam|homework|practice|exercise|quiz|test|assignment|class|chapter|edition|textbook|midterm|final\b.*\bsolution|survey|poll|question|session|work\d|topic\d|case[\s_]|solutions?\.xlsx|tutorial|reading|mgmt\s*\d|emba|capm|student|scorecard)\b", 0.25),),
    "Financial Report": ((r"\b(p&l|p\.l|revenue|balance|financial|budget\w*|valuation|income|forecast|cashflow|cash.?flow|profit|margin|cost|checking|retirement|mortgage|loan|investment\w*|rate|price.?structure|salary|calculat\w*|cal\s*sheet|personal\s*budget)", 0.15),),
    "Data Extract": ((r"\b(data|extract|export|dump|download|database|report(?:ing)?)\b", 0.15),),
    "Consolidation": ((r"\b(consolidat\w*|consol\w*|combined|merged|interco\w*)\b", 0.2),),
    "Reference Data": ((r"\b(reference|lookup|master|mapping|codes|chart.of.accounts|coa|schedule|roster|contact|list|rank|directory|hours|timesheet|status.?report|timeline|timing|inspection|estimate|spr\b)\b", 0.2),),
}
FINANCIAL_FUNCTIONS = "pv npv irr xirr xnpv pmt fv rate yield price duration effect nominal".split()
STATISTICAL_FUNCTIONS = "average stdev sqrt intercept slope correl normsdist norminv ln exp sumproduct".split()
MODEL_SHEETS = ("model", "assumptions", "inputs", "parameters", "dashboard")
REPORT_SHEETS = ("p&l", "balance sheet", "income", "bs", "pl", "is", "cf", "revenue", "expenses", "budget", "forecast")
ARCHETYPES = ("Financial Report", "Data Extract", "Model/Template", "Reference Data", "Academic/Exercise", "Consolidation")


def _signals() -> dict[str, list[tuple[Column, float]]]:
    """What speaks for each archetype, and how much."""
    fc, nr, rc, sc = (F.col(c) for c in ("formula_count", "named_range_count", "total_row_count", "sheet_count"))
    used = F.transform(F.coalesce("dominant_formula_functions", F.array()), F.lower)
    among = lambda names: F.size(F.array_intersect(used, F.array(*map(F.lit, names))))
    dense = fc / F.nullif(rc, F.lit(0))
    stats = F.size(F.filter(used, lambda x: x.isin(*STATISTICAL_FUNCTIONS)))
    filled = F.transform(F.filter("sheets", lambda s: ~s["is_empty"] & (s["row_count"] > 0)), lambda s: s["row_count"].cast("double"))
    mean = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x) / F.size(filled)
    spread = F.sqrt(F.aggregate(filled, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(filled)) / mean
    sparse = F.size(F.filter("sheets", lambda s: s["is_empty"] | ((s["row_count"] <= 5) & (s["formula_count"] <= 2))))
    names = F.transform("sheet_names", lambda s: F.lower(F.trim(s)))
    named = lambda these: F.exists(names, lambda s: s.isin(*these))
    out = {
        "Financial Report": [
            ((fc > 20) & (F.col("has_sumif_pattern") | (nr > 5)), 0.4), (F.col("has_vlookup_pattern") & (fc > 10), 0.3), ((nr > 10) & (fc > 50), 0.2), (among(FINANCIAL_FUNCTIONS) > 0, 0.25),
            ((sc == 1) & (fc > 100) & (dense > 2.0), 0.2), (named(REPORT_SHEETS), 0.2),
        ],
        "Data Extract": [
            ((fc < 5) & (rc > 500), 0.4), ((rc > 500) & (fc > 0) & (fc < rc) & (stats > 0) & (stats >= F.size(used) * 0.5), 0.2), ((rc > 1000) & (sc >= 2) & (fc < rc), 0.15),
            ((sc >= 5) & (rc > 1000) & (fc < rc), 0.25), (F.array_contains(names, "data") & (sc >= 2), 0.15),
        ],
        "Model/Template": [
            ((sc >= 2) & (fc > 50) & (dense > 2.0), 0.3), ((sc == 1) & (fc > 10) & (rc < 100) & (fc > rc * 0.5), 0.15), ((sc == 1) & (fc > 50) & (rc > 50) & (dense > 0.5) & (dense < 2.0), 0.15),
            ((sc >= 2) & (fc > 100) & (dense > 1.5), 0.2), ((sc >= 2) & (sparse >= sc * 0.5), 0.3), (named(MODEL_SHEETS), 0.15),
        ],
        "Reference Data": [((fc == 0) & (rc > 10) & (rc <= 500) & (sc <= 3), 0.3), ((sc >= 2) & (fc == 0) & (rc > 10), 0.2)],
        "Academic/Exercise": [((fc < 5) & (rc < 50) & (sc <= 2), 0.3), ((sc == 1) & (fc > 5) & (fc <= 200) & (rc > 10) & (rc <= 200) & (stats > 0), 0.2), (F.size(F.filter(names, lambda s: s.rlike(r"^#\d+$"))) >= 3, 0.3)],
        "Consolidation": [((sc >= 3) & (F.size(filled) >= 3) & (spread < 0.5), 0.35)],
    }
    for a, patterns in FILE_WORDS.items():
        out[a] += [(F.col("file_name").rlike(f"(?i){p}"), w) for p, w in patterns]
    return out


def classify(files: DataFrame) -> DataFrame:
    """Adds archetype and archetype_confidence (1 at most) to scanned files; the
    strongest archetype (ties: the order of ``ARCHETYPES``), Unknown below 0.15
    and for files that were not read."""
    signals = _signals()
    score = {a: sum((F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0)) for c, w in signals[a]), F.lit(0.0)) for a in ARCHETYPES}
    best = F.array_max(F.array(*[F.struct(F.round(s, 6).alias("s"), F.lit(-i).alias("o"), F.lit(a).alias("a")) for i, (a, s) in enumerate(score.items())]))
    ok = F.col("scan_status") == "ok"
    return files.withColumn("__b", best).withColumn("archetype", F.when(ok & (F.col("__b.s") >= 0.15), F.col("__b.a")).otherwise("Unknown")).withColumn("archetype_confidence", F.when(ok, F.least(F.col("__b.s"), F.lit(1.0))).otherwise(0.0)).drop("__b")


def triage_summary(files: DataFrame) -> DataFrame:
    """One row: files by status, sheets, formulas, rows, macros, pivots, sizes."""
    n = lambda c: F.count_if(c)
    s = F.col("scan_status")
    return files.agg(
        F.count("*").alias("total_files"), n(s == "ok").alias("scanned"), n(s == "error").alias("errors"), n(s == "skipped").alias("skipped"), F.coalesce(F.sum("sheet_count"), F.lit(0)).alias("total_sheets"),
        F.coalesce(F.sum("formula_count"), F.lit(0)).alias("total_formulas"), F.coalesce(F.sum("total_row_count"), F.lit(0)).alias("total_rows"), n(F.col("has_macros")).alias("files_with_macros"), n(F.col("has_pivot_tables")).alias("files_with_pivots"),
        F.min("file_size_bytes").alias("min_file_size"), F.max("file_size_bytes").alias("max_file_size"), F.avg("file_size_bytes").alias("avg_file_size"), F.median("file_size_bytes").alias("median_file_size"),
    )


def archetype_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("archetype").agg(F.count("*").alias("n_files"))
