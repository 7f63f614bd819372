"""Reading files of many kinds into frames."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.cleaning import na_to_null

#: Marks of comment lines at the head of exported files.
COMMENT_MARKS = ("#", "*", "--", "//")


#: Bytes up to which a text file is read by one task.
WHOLE_FILE = 64 << 20


def read_csv(spark: SparkSession, path: str, infer: bool = True, sep: str = ",") -> DataFrame:
    """A delimited file with a header; missing-value texts are null.  Types are
    inferred after that, by one more pass, unless ``infer`` is false."""
    df = na_to_null(spark.read.csv(path, header=True, sep=sep, multiLine=False, inferSchema=False, enforceSchema=False))
    if not infer:
        return df
    kinds = df.agg(*[e for i, c in enumerate(df.columns) for x in [F.trim(F.col(f"`{c}`"))] for e in (F.bool_and(x.rlike(r"^[-+]?\d{1,18}$")).alias(f"i{i}"), F.bool_and(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")).alias(f"d{i}"), F.bool_and(x.rlike("(?i)^(true|false)$")).alias(f"b{i}"))]).first()
    cast = lambda i: "long" if kinds[f"i{i}"] else "double" if kinds[f"d{i}"] else "boolean" if kinds[f"b{i}"] else "string"
    return df.select(*[(F.trim(F.col(f"`{c}`")).cast(cast(i)) if cast(i) != "string" else F.col(f"`{c}`")).alias(c) for i, c in enumerate(df.columns)])


def numbered_lines(spark: SparkSession, path: str, whole_up_to: int = WHOLE_FILE, keep_path: bool = False) -> DataFrame:
    """(file, row_index, line) of text files, numbered within each file from 0;
    with ``keep_path`` also the path.

    Files of up to ``whole_up_to`` bytes are read whole by one task each, and
    encodings are tried in turn (UTF-8 with or without mark, Latin-1).  Larger
    ones are read in splits, as UTF-8: lines are numbered within their split,
    and a split's first number is what the splits before it hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text = bytes(c).decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = bytes(c).decode("latin-1")
                lines = text.splitlines()
                yield pd.DataFrame({"path": [p] * len(lines), "row_index": range(len(lines)), "line": lines})

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole_up_to).select("path", "content").mapInPandas(run, "path string, row_index long, line string")
    large = [r.path for r in files.where(F.col("length") > whole_up_to).select("path").collect()]
    out = small
    if large:
        raw = spark.read.text(large).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
        inside = raw.withColumn("n", F.row_number().over(Window.partitionBy("path", "at").orderBy("id")) - 1)
        earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        before = raw.groupBy("path", "at").agg(F.count("*").alias("c")).select("path", "at", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
        out = small.unionByName(inside.join(before, ["path", "at"]).select("path", (F.col("before") + F.col("n")).alias("row_index"), F.regexp_replace("line", "^\\uFEFF", "").alias("line")))
    return out.select(*(["path"] if keep_path else []), F.regexp_extract("path", "[^/]*$", 0).alias("file"), "row_index", "line")


def read_commented_csv(spark: SparkSession, path: str, marks: tuple[str, ...] = COMMENT_MARKS, blanks: bool = False, sep: str | None = None) -> DataFrame:
    """Delimited files whose header follows comment lines: file, row_index (from
    0), comments (their text) and a text column for each name in any header.
    Only leading comments (with ``blanks`` also blank lines) are skipped.  Without
    ``sep`` it is a tab if the header has one, else a comma."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text = bytes(c).decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = bytes(c).decode("latin-1")
                lines = text.splitlines()
                at = 0
                while at < len(lines) and (lines[at].startswith(marks) or (blanks and not lines[at].strip())):
                    at += 1
                head = "\n".join(lines[:at])
                d = sep or ("\t" if at < len(lines) and "\t" in lines[at] else ",")
                rows = list(csv.reader(lines[at:], delimiter=d))
                names = [n.strip() for n in rows[0]] if rows else []
                body = [r for r in rows[1:] if r]
                yield pd.DataFrame({"file": [p.rpartition("/")[2]] * len(body), "row_index": range(len(body)), "comments": [head] * len(body), "v": [{n: v for n, v in zip(names, r, strict=False)} for r in body]})

    long = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row_index long, comments string, v map<string,string>")
    names = sorted(r[0] for r in long.select(F.explode(F.map_keys("v"))).distinct().collect())
    return long.select("file", "row_index", "comments", *[F.try_element_at("v", F.lit(n)).alias(n) for n in names])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, one object of equally long lists, or one object."""
    df = spark.read.json(path, multiLine=True)
    if "_corrupt_record" in df.columns and len(df.columns) == 1:
        raise ValueError(f"no JSON table: {path}")
    if df.columns and all(t.startswith("array") for _, t in df.dtypes):
        return df.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])))
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A file by its ending: parquet, json, xlsx, tsv, else csv."""
    ext = path.lower().rstrip("/").rpartition(".")[2]
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext in ("json", "jsonl"):
        return read_json(spark, path) if ext == "json" else spark.read.json(path)
    if ext in ("xlsx", "xlsm"):
        from tallyframe.operators.workbooks import read_sheet

        return read_sheet(spark, path)
    return read_csv(spark, path, sep="\t" if ext == "tsv" else ",")


def load_report(df: DataFrame, preview: int = 5) -> dict:
    """Rows, columns, types, null counts (one aggregation) and a short preview."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {"rows": one["n"], "columns": df.columns, "dtypes": dict(df.dtypes), "null_counts": {c: one[f"c{i}"] for i, c in enumerate(df.columns)}, "preview": [r.asDict(True) for r in df.limit(preview).collect()]}


def query_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A SELECT run by a database over JDBC; other statements are refused."""
    first = query.strip().split(None, 1)[0].lower() if query.strip() else ""
    if first not in ("select", "with"):
        raise ValueError("only SELECT queries are run")
    return spark.read.format("jdbc").option("url", url).option("query", query.strip().rstrip(";")).options(**options).load()


def parse_tables(texts: DataFrame, id_column: str, text_column: str, delimiter: str = "auto") -> DataFrame:
    """Tables within texts, a row per cell: id, row_no (from 1), column_name,
    value.  The first line that is not blank is the header; cells beyond it are
    named col_i.  ``auto`` takes tabs, bars, runs of blanks, then single blanks.
    A text of a single line gives its cells under row 0, named col_i."""
    t = F.col(f"`{text_column}`")
    lines = F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != "")
    auto = F.when(t.contains("\t"), "\t").when(t.contains("|"), r"\|").when(t.rlike(r"\S {2,}\S"), " {2,}").otherwise(r"\s+")
    sep = auto if delimiter == "auto" else F.lit({"tab": "\t", "pipe": r"\|", "|": r"\|", "comma": ","}.get(delimiter, delimiter))
    base = texts.select(F.col(f"`{id_column}`").alias("id"), lines.alias("lines"), sep.alias("sep")).where(F.size("lines") > 0)
    cut_ = lambda line, s: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), s), F.trim)
    rows = base.select("id", "sep", F.posexplode("lines").alias("row_no", "line"), F.size("lines").alias("n"), cut_(F.col("lines")[0], F.col("sep")).alias("header"))
    cells = rows.where("row_no > 0 or n = 1").select("id", "row_no", "n", "header", F.posexplode(cut_(F.col("line"), F.col("sep"))).alias("i", "value"))
    name = F.coalesce(F.when(F.col("n") > 1, F.nullif(F.try_element_at("header", F.col("i") + 1), F.lit(""))), F.concat(F.lit("col_"), F.col("i") + 1))
    return cells.select("id", "row_no", name.alias("column_name"), "value")


def file_heads(lines: DataFrame, most: int = 50) -> DataFrame:
    """The first lines of each file with what they tell: file, lines, delimiter
    (of the first ten lines without comments: present in all with counts at most
    two apart, tab before comma, semicolon and bar; else comma), header names
    and data cells of the next lines.  ``lines``: file, row_index, line."""
    g = lines.where(F.col("row_index") < most).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]).alias("lines"))
    body = F.filter("lines", lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(#|\*|--|//)"))
    ten = F.slice(body, 1, 10)

    def fits(d: str):
        n = F.transform(ten, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
        return (F.size(ten) > 0) & (F.array_min(n) > 0) & (F.array_max(n) - F.array_min(n) <= 2)

    delim = F.when(fits("\t"), "\t").when(fits(","), ",").when(fits(";"), ";").when(fits("|"), "|").otherwise(",")
    wordy = F.filter(F.transform(body, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.length(F.regexp_replace(s["x"], r"[^\p{L}]", "")) / F.greatest(F.length(s["x"]), F.lit(1)) > 0.3)
    h = g.withColumn("body", body).withColumn("delimiter", delim).withColumn("h", wordy[0])
    split = lambda x: F.transform(F.split(x, F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))), lambda c: F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""))
    h = h.withColumn("header", F.coalesce(split(F.col("h.x")), F.array().cast("array<string>"))).withColumn("data", F.transform(F.slice("body", F.coalesce(F.col("h.i"), F.lit(0)) + 2, 19), split))
    return h.select("file", "lines", "delimiter", "header", "data")


def extract_pdf(spark: SparkSession, path: str, pages: str = "all", most_chars: int = 2000) -> DataFrame:
    """file, page, text of PDF files, with an optional library on the workers."""
    wanted = page_numbers(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf on the workers") from e
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                texts = [(i, x.extract_text() or "") for i, x in enumerate(PdfReader(io.BytesIO(bytes(c))).pages, 1) if wanted is None or i in wanted]
                yield pd.DataFrame({"file": [p] * len(texts), "page": [i for i, _ in texts], "text": [t[:most_chars] for _, t in texts]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, page int, text string")


def page_numbers(spec: str) -> set[int] | None:
    """``all``, ``3``, ``1-5`` or ``1,2,7-9`` as a set; None for all."""
    if spec.strip().lower() == "all":
        return None
    out: set[int] = set()
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        out |= set(range(int(a), int(b or a) + 1))
    return out


def ocr_images(spark: SparkSession, path: str, language: str = "eng", most_chars: int = 5000) -> DataFrame:
    """file, language, text, character_count of images, with an optional library on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            import pytesseract
            from PIL import Image
        except ImportError as e:
            raise RuntimeError("reading images needs the packages pytesseract and Pillow on the workers") from e
        for pdf in batches:
            texts = [pytesseract.image_to_string(Image.open(io.BytesIO(bytes(c))), lang=language) for c in pdf["content"]]
            yield pd.DataFrame({"file": pdf["path"], "language": language, "text": [t[:most_chars] for t in texts], "character_count": [len(t) for t in texts]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, language string, text string, character_count int")


def find_files(spark: SparkSession, directories: list[str], pattern: str = "*.csv", name: str = "", most: int = 20) -> DataFrame:
    """path, size, modified of files under the directories, newest first."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directories)
    hit = df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return hit.where(F.lower(F.regexp_extract("path", "[^/]*$", 0)).contains(name.lower())).orderBy(F.desc("modified"), "path").limit(most)


def stage_file(path: str, directory: str, new_name: str = "") -> str:
    """Copies a local file into a directory; a name that is taken gets a time stamp."""
    os.makedirs(directory, exist_ok=True)
    name = new_name or os.path.basename(path)
    to = os.path.join(directory, name)
    if os.path.exists(to):
        stem, ext = os.path.splitext(name)
        to = os.path.join(directory, f"{stem}_{time.strftime('%Y%m%d_%H%M%S')}{ext}")
    shutil.copy2(path, to)
    return to
