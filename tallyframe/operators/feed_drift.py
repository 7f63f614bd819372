"""Schemas that drift between the files of a feed.

Lines stay rows throughout: a file's header is found by an aggregation, its
lines are cut into cells under that header, and all that is known of a column
of a file is an aggregate over its cells.  So neither a large file nor a large
feed is ever gathered in one task; what windows run over is one row per file
and column.
"""

from __future__ import annotations

import csv
import functools
import json
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallyframe.functions.text import trimmed
from tallyframe.session import cut

#: Texts that are no values, header names of the key column, comment marks.
NO_VALUE = ("n/a", "na", "null", "none", "-")
KEY_NAMES = ("accountid", "accountno", "glaccount", "account", "accountnumber")
COMMENT = r"^\s*(#|//|--|\*)"
#: Delimiters in the order in which they are tried.
DELIMITERS = ("\t", "|", ";", ",")
#: The promotion lattice: two types meet in their least common type.
_NUMBER = r"(\d{1,3}(,\d{3})+|\d+)"
INTEGER, DECIMAL = rf"^{_NUMBER}$", rf"^({_NUMBER}?\.\d+|{_NUMBER}\.|\d{{1,3}}(\.\d{{3}})+,\d+|\d+(\.\d+)?[eE][+-]?\d+)$"
TRUTHS = ("true", "false", "yes", "no", "y", "n")
DATES = (r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?Z?$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$")
#: A column is the old one renamed if this share of the accounts with both values agree.
SAME_SHARE = 0.8

_FILE = ["feed_id", "file_no"]


def column_form(c: Column) -> Column:
    """Header names in lower-case letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def value_of(c: Column) -> Column:
    """A cell without blanks and quotes; null for no value."""
    c = trimmed(c)
    quoted = c.startswith('"') & c.endswith('"') & (F.length(c) > 1)
    c = F.when(quoted, trimmed(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    return F.when((c != "") & ~F.lower(c).isin(*NO_VALUE), c)


def unsigned(v: Column) -> Column:
    """A number's text without sign and brackets."""
    return F.regexp_replace(v, r"^\(\s*(.*?)\s*\)$|^[+-]\s*(.*)$|^(.*?)\s*-$", "$1$2$3")


def type_of(v: Column) -> Column:
    """The narrowest type of one value: int, decimal, date, boolean or text.
    A value that begins with a letter is put to no number pattern."""
    u = unsigned(v)
    figures = F.when(u.rlike(INTEGER), "int").when(u.rlike(DECIMAL), "decimal").when(v.rlike("|".join(DATES)), "date").otherwise("text")
    first = F.ascii(F.substring(v, 1, 1))
    return F.when(v.isNull(), None).when(F.lower(v).isin(*TRUTHS), "boolean").when(first < 64, figures).otherwise("text")


def number_of(v: Column) -> Column:
    """The value of a number."""
    u = unsigned(v)
    plain = F.when(u.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), F.translate(u, ",.", ".")).otherwise(F.replace(u, F.lit(","), F.lit("")))
    n = plain.try_cast("double")
    return F.when(v.startswith("(") | v.startswith("-") | v.endswith("-"), -n).otherwise(n)


def date_of(v: Column) -> Column:
    """A date's ISO text.  Slashed dates with the year last are day first."""
    parts = F.split(F.regexp_replace(v, "[T ].*$|Z$", ""), "[-/.]")
    at = lambda i: F.lpad(F.try_element_at(parts, F.lit(i)), 2, "0")
    year_first = F.length(F.try_element_at(parts, F.lit(1))) == 4
    return F.when(year_first, F.concat_ws("-", parts[0], at(2), at(3))).otherwise(F.concat_ws("-", F.try_element_at(parts, F.lit(3)), at(2), at(1)))


def truth_of(v: Column) -> Column:
    return F.lower(v).isin("true", "yes", "y")


def canonical(v: Column, type_: Column) -> Column:
    """One notation per value, whatever its type's notation in the file."""
    number = (number_of(v) + F.lit(0.0)).cast("string")
    return F.when(type_.isin("int", "decimal"), number).when(type_ == "date", date_of(v)).when(type_ == "boolean", truth_of(v).cast("string")).otherwise(v)


_CELLS = StructType([StructField("k", ArrayType(StringType())), StructField("v", ArrayType(StringType()))])


def _text(x: object) -> str | None:
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, bool):
        return str(x).lower()
    return json.dumps(x, ensure_ascii=False, sort_keys=True) if isinstance(x, (dict, list)) else str(x)


@functools.lru_cache(maxsize=10_000)
def _name(key: str) -> str:
    """``column_form`` of a JSON key; keys recur from line to line."""
    return "".join(c for c in key.lower() if unicodedata.category(c)[0] in "LN")


def _cut_line(line: str | None, sep: str | None) -> tuple[list[str] | None, list[str | None] | None]:
    if line is None or sep is None:
        return None, None
    if sep == "json":
        try:
            row = json.loads(line, parse_float=str, parse_int=str)
        except ValueError:
            return None, None
        return ([_name(k) for k in row], [_text(x) for x in row.values()]) if isinstance(row, dict) else (None, None)
    try:
        return None, next(csv.reader([line], delimiter=sep, strict=False), [])
    except csv.Error:
        return None, line.split(sep)


@F.pandas_udf(_CELLS)
def _cells(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(2**31 - 1)
    for lines, seps in batches:
        rows = [_cut_line(a, b) for a, b in zip(lines, seps, strict=True)]
        yield pd.DataFrame({"k": [r[0] for r in rows], "v": [r[1] for r in rows]})


def delivered_lines(lines: DataFrame) -> DataFrame:
    """The lines of each file as last delivered, each line once: feed_id,
    file_no, line_no, line (without byte-order mark), sep (``json`` or the
    delimiter) and, for delimited files, header.  Comments, blank lines and the
    header itself are left out."""
    raw = lines.select(
        F.trim("feed_id").alias("feed_id"), "file_no", "delivered_at", "line_no",
        F.regexp_replace("raw_line", "^[﻿￾]+|[\r\n]+$", "").alias("line"),
    ).where(F.col("feed_id").isNotNull() & F.col("file_no").isNotNull() & ~F.col("line").rlike(COMMENT) & (F.trim("line") != ""))
    heads = raw.groupBy(*_FILE).agg(F.max("delivered_at").alias("last"), F.min_by("line", F.struct(-F.coalesce(F.unix_micros(F.col("delivered_at").cast("timestamp")), F.lit(0)), "line_no")).alias("head"))
    sep = F.when(F.ltrim("head").startswith("{"), "json")
    for d in DELIMITERS:
        sep = sep.when(F.contains(F.col("head"), F.lit(d)), d)
    heads = heads.withColumn("sep", sep.otherwise(DELIMITERS[-1]))
    heads = heads.withColumn("header", F.transform(_cells("head", F.when(F.col("sep") != "json", F.col("sep")))["v"], column_form))
    joined = raw.join(heads, _FILE).where(F.col("delivered_at").eqNullSafe(F.col("last")) & ((F.col("sep") == "json") | (F.col("line") != F.col("head"))))
    return joined.select(*_FILE, "line_no", "line", "sep", "header").dropDuplicates([*_FILE, "line_no"])


def cells(lines: DataFrame, key_names: Sequence[str] = KEY_NAMES) -> DataFrame:
    """feed_id, file_no, line_no, key, column_name, value, type for every cell of
    the files as last delivered; value and type null for no value.  A delimited file's cells
    follow its header: cells beyond it are dropped, missing ones have no value;
    of columns with one name the first with a value counts.  The key is the
    line's value in the first column named as one of ``key_names``."""
    d = delivered_lines(lines).withColumn("c", _cells("line", "sep"))
    names = F.coalesce(F.col("c.k"), F.col("header"))
    pairs = F.arrays_zip(names.alias("n"), F.coalesce(F.col("c.v"), F.array().cast("array<string>")).alias("v"))
    pairs = F.filter(pairs, lambda p: p["n"].isNotNull() & (p["n"] != ""))
    wide = d.where("c.v is not null").select(*_FILE, "line_no", pairs.alias("p"))
    named = F.filter("p", lambda p: p["n"].isin(*key_names))
    value_in = lambda k: F.try_element_at(F.filter(F.transform(F.filter("keys", lambda p: p["n"] == k), lambda p: value_of(p["v"])), lambda v: v.isNotNull()), F.lit(1))
    keyed = wide.withColumn("keys", named).select(*_FILE, "line_no", F.lower(F.coalesce(*[value_in(k) for k in key_names])).alias("key"), F.inline("p"))
    # values and types are worked out once, outside the arrays, in generated code
    valued = keyed.select(*_FILE, "line_no", "key", F.col("n").alias("column_name"), value_of(F.col("v")).alias("value"))
    return valued.withColumn("type", type_of(F.col("value")))


def file_columns(cell_rows: DataFrame) -> DataFrame:
    """One row per file and column: its type by the lattice, null without values."""
    has = lambda x: F.max(F.coalesce(F.col("type") == x, F.lit(False)))
    g = cell_rows.groupBy(*_FILE, "column_name").agg(F.count("value").alias("n_values"), has("int").alias("i"), has("decimal").alias("n"), has("date").alias("d"), has("boolean").alias("b"), has("text").alias("s"))
    return g.select(*_FILE, "column_name", "n_values", promoted("i", "n", "d", "b", "s").alias("type"))


def promoted(i: str, n: str, d: str, b: str, s: str) -> Column:
    """The least type above all types seen (boolean columns telling which)."""
    number, others = F.col(i) | F.col(n), F.col(d).cast("int") + F.col(b).cast("int")
    return (
        F.when(F.col(s) | ((number.cast("int") + others) > 1), "text").when(F.col(n), "decimal").when(F.col(i), "int").when(F.col(d), "date").when(F.col(b), "boolean")
    )


def drift(cell_rows: DataFrame, columns: DataFrame, same_share: float = SAME_SHARE) -> DataFrame:
    """feed_id, file_no, change, column_name, old_name (empty but for renamed
    columns): each file against the one of the next lower number.

    ``type_changed`` compares with the type the column last had, so one without
    values keeps it.  ``renamed``: among columns gone and columns new in one
    file, those with the same values for the same accounts (dates, numbers and
    truth values compared as such), the best match first on both sides; ties go
    by name.  The first file has no changes; a feed of one file, or none, gives
    no rows."""
    files = columns.select(*_FILE).distinct()
    files = files.withColumn("prev", F.lag("file_no").over(Window.partitionBy("feed_id").orderBy("file_no"))).withColumn("next", F.lead("file_no").over(Window.partitionBy("feed_id").orderBy("file_no")))
    by_col = Window.partitionBy("feed_id", "column_name").orderBy("file_no")
    known = columns.join(files, _FILE).select(
        "*", F.last("type", True).over(by_col.rowsBetween(Window.unboundedPreceding, -1)).alias("old_type"),
        F.lag("file_no").over(by_col).alias("seen"), F.lead("file_no").over(by_col).alias("again"),
    )
    known = cut(known)
    typed = known.where("prev is not null and seen = prev and type != old_type").select(*_FILE, F.lit("type_changed").alias("change"), "column_name", F.lit("").alias("old_name"))
    new = known.where("prev is not null and (seen is null or seen != prev)").select(*_FILE, "prev", "column_name")
    gone = known.where("next is not null and (again is null or again != next)").select("feed_id", F.col("next").alias("file_no"), F.col("file_no").alias("prev"), "column_name")
    # only columns that vanish from or appear in a file with both kinds of columns meet, account by account
    change = ["feed_id", "file_no"]
    pairs_of = new.select(*change).distinct().join(gone.select(*change).distinct(), change)
    asked = cut(
        new.join(pairs_of, change, "left_semi").select("feed_id", F.col("file_no").alias("at"), "file_no", "column_name", F.lit(True).alias("is_new"))
        .unionByName(gone.join(pairs_of, change, "left_semi").select("feed_id", F.col("prev").alias("at"), "file_no", "column_name", F.lit(False).alias("is_new")))
    )
    of_asked = cell_rows.where("key is not null and value is not null").withColumnRenamed("file_no", "at").join(asked, ["feed_id", "at", "column_name"])
    value = of_asked.groupBy(*change, "is_new", "key", "column_name").agg(F.min(canonical(F.col("value"), F.col("type"))).alias("x"))
    value = cut(value)
    after = value.where("is_new").select(*change, "key", F.col("column_name").alias("new_name"), "x")
    before = value.where("not is_new").select(*change, "key", F.col("column_name").alias("old_name"), F.col("x").alias("y"))
    scored = after.join(before, [*change, "key"]).groupBy(*change, "new_name", "old_name").agg(F.count("*").alias("n"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("same"), F.count_distinct("x").alias("kinds"))
    scored = scored.where((F.col("same") >= same_share * F.col("n")) & (F.col("n") > 0))
    rank = lambda by, other: F.row_number().over(Window.partitionBy(*change, by).orderBy(F.desc(F.col("same") / F.col("n")), F.desc("kinds"), F.desc("n"), other))
    renamed = cut(scored.select("*", rank("new_name", "old_name").alias("r1"), rank("old_name", "new_name").alias("r2")).where("r1 = 1 and r2 = 1").select(*change, "new_name", "old_name"))
    added = new.join(renamed.select(*change, F.col("new_name").alias("column_name")), [*change, "column_name"], "left_anti").select(*change, F.lit("added").alias("change"), "column_name", F.lit("").alias("old_name"))
    removed = gone.join(renamed.select(*change, F.col("old_name").alias("column_name")), [*change, "column_name"], "left_anti").select(*change, F.lit("removed").alias("change"), "column_name", F.lit("").alias("old_name"))
    return typed.unionByName(added).unionByName(removed).unionByName(renamed.select(*change, F.lit("renamed").alias("change"), F.col("new_name").alias("column_name"), "old_name"))


def feed_schema(columns: DataFrame) -> DataFrame:
    """The union schema: one row per feed and column with its type over all files."""
    has = lambda x: F.max(F.coalesce(F.col("type") == x, F.lit(False)))
    g = columns.groupBy("feed_id", "column_name").agg(has("int").alias("i"), has("decimal").alias("n"), has("date").alias("d"), has("boolean").alias("b"), has("text").alias("s"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"))
    return g.select("feed_id", "column_name", F.coalesce(promoted("i", "n", "d", "b", "s"), F.lit("text")).alias("type"), "first_file", "last_file")


def consistent_table(cell_rows: DataFrame, columns: DataFrame) -> DataFrame:
    """All feeds as one table: a row per feed, file and line with the values cast
    to the union schema, as maps by type (numbers, dates, truths, texts)."""
    typed = cell_rows.drop("type").join(feed_schema(columns).select("feed_id", "column_name", "type"), ["feed_id", "column_name"]).where("value is not null")
    v = F.col("value")
    pick = lambda cond, x: F.map_from_entries(F.array_sort(F.collect_set(F.when(cond, F.struct("column_name", x.alias("v"))))))
    dedup = typed.groupBy(*_FILE, "line_no", "key", "column_name", "type").agg(F.min("value").alias("value"))
    return dedup.groupBy(*_FILE, "line_no", "key").agg(
        pick(F.col("type").isin("int", "decimal"), number_of(v)).alias("numbers"), pick(F.col("type") == "date", date_of(v).try_cast("date")).alias("dates"),
        pick(F.col("type") == "boolean", truth_of(v)).alias("truths"), pick(F.col("type") == "text", v).alias("texts"),
    )


def read_feed(cell_rows: DataFrame, columns: DataFrame, feed_id: str) -> DataFrame:
    """One feed as a wide table under its union schema."""
    one = cell_rows.where(F.col("feed_id") == feed_id)
    schema = {r.column_name: r.type for r in feed_schema(columns.where(F.col("feed_id") == feed_id)).collect()}
    v = F.col("value")
    cast = {"int": number_of(v).cast("long"), "decimal": number_of(v), "date": date_of(v).try_cast("date"), "boolean": truth_of(v), "text": v}
    return one.groupBy(*_FILE, "line_no", "key").agg(*[F.min(F.when(F.col("column_name") == c, cast[t])).alias(c) for c, t in sorted(schema.items())])

