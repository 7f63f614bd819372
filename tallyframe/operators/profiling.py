"""Profiles, schema drift, expectation suites and their validation.

Figures of all columns come from one scan, in long form: a row per column.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import cut

#: Names of types in reports, and conversions that lose nothing.
TYPE_NAMES = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32", "string": "object", "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]"}
SAFE_CONVERSIONS = {("int64", "float64"), ("int32", "int64"), ("float32", "float64"), ("int64", "object"), ("float64", "object"), ("bool", "object")}
#: Words in a column name that tell of dates.
DATE_WORDS = ("date", "time", "period", "month", "year", "day", "_ts", "_at")


def type_name(spark_type: str) -> str:
    return TYPE_NAMES.get(spark_type, spark_type)


def _c(name: str):
    return F.col(f"`{name}`")


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column_name, data_type, n_rows, n_null, null_pct, n_distinct (nulls not
    counted), cardinality (n_distinct / n_rows; null for no rows), potential_key
    (> 0.99), high_cardinality (> 0.9), low_cardinality (< 0.1).

    ``approximate`` counts distinct values by sketches: one pass with constant
    memory for each column instead of a shuffle of the distinct values."""
    kinds = df.sparkSession.createDataFrame([(i, c, type_name(t)) for i, (c, t) in enumerate(df.dtypes)], "__i int, column_name string, data_type string")
    if approximate:
        one = df.agg(F.count("*").alias("__n"), *[x for i, c in enumerate(df.columns) for x in (F.count(_c(c)).alias(f"v{i}"), F.approx_count_distinct(_c(c)).alias(f"d{i}"))])
        per = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), F.col("__n").alias("n_rows"), (F.col("__n") - F.col(f"v{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct")) for i in range(len(df.columns))])))
    else:
        # (column, value) pairs, counted before they are shuffled: a column of few values moves as few rows
        text = lambda c, t: (_c(c) + F.lit(0.0) if t in ("double", "float") else _c(c)).cast("string")
        long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), text(c, t).alias("v")) for i, (c, t) in enumerate(df.dtypes)])))
        values = long.groupBy("__i", "v").agg(F.count("*").alias("n"))
        per = values.groupBy("__i").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("v").alias("n_distinct"))
    long = kinds.join(per, "__i", "left").select("column_name", "data_type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_null", "n_distinct")])
    card = F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows"))
    return long.select("*", F.when(F.col("n_rows") > 0, F.round(F.col("n_null") * 100.0 / F.col("n_rows"), 2)).alias("null_pct"), card.alias("cardinality"), F.coalesce(card > 0.99, F.lit(False)).alias("potential_key"), F.coalesce(card > 0.9, F.lit(False)).alias("high_cardinality"), F.coalesce(card < 0.1, F.lit(False)).alias("low_cardinality"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, n_duplicates (rows beyond the first of each content, nulls equal)
    and duplicate_pct (null for no rows)."""
    g = df.groupBy(*[_c(c) for c in df.columns]).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count("*").alias("k"))
    return g.select("n_rows", (F.col("n_rows") - F.col("k")).alias("n_duplicates"), F.when(F.col("n_rows") > 0, F.round((F.col("n_rows") - F.col("k")) * 100.0 / F.col("n_rows"), 2)).alias("duplicate_pct"))


def describe_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, least, quartiles
    (interpolated, NaN left out) and greatest of number columns."""
    names = list(columns) if columns else [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    x = lambda c: _c(c).cast("double")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), x(c).alias("v")) for c in names]))).where("v is not null")
    stats = cut(long.groupBy("column_name").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(~F.isnan("v")).alias("n_ranked"), F.min(F.when(~F.isnan("v"), F.col("v"))).alias("lo"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("hi")))
    quartiles = _quantiles(long.where(~F.isnan("v")), stats, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    base = df.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    return base.join(stats, "column_name", "left").join(quartiles, "column_name", "left").select("column_name", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "q25", "q50", "q75", "max")


def _quantiles(long: DataFrame, stats: DataFrame, wanted: dict[str, float], buckets: int = 1000) -> DataFrame:
    """Exact interpolated quantiles of (column_name, v).  Values are counted,
    the counts summed by bucket of the value range, and only the few buckets in
    which a wanted rank falls are put in order, each in a task of its own."""
    counts = long.groupBy("column_name", "v").agg(F.count("*").alias("c")).join(F.broadcast(stats.select("column_name", "lo", "hi")), "column_name")
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    b = counts.select("column_name", "v", "c", F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), buckets).otherwise(F.coalesce(F.floor(share * buckets), F.lit(0))).cast("int").alias("bucket"))
    b = cut(b)
    w = Window.partitionBy("column_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("column_name", "bucket").agg(F.sum("c").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
    at = lambda q: F.lit(q) * (F.col("n_ranked") - 1)
    ranks = stats.where("n_ranked > 0").select("column_name", F.inline(F.array(*[F.struct(F.lit(f"{k}{e}").alias("name"), f(at(q)).cast("long").alias("rank")) for k, q in wanted.items() for e, f in (("_lo", F.floor), ("_hi", F.ceil))])))
    falls = ranks.join(sums, "column_name").where("rank >= before and rank < before + t").select("column_name", "bucket", "name", "rank", "before")
    inside = Window.partitionBy("column_name", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = b.join(F.broadcast(falls.select("column_name", "bucket").distinct()), ["column_name", "bucket"], "left_semi").withColumn("upto", F.sum("c").over(inside))
    hit = ordered.join(F.broadcast(falls), ["column_name", "bucket"]).where((F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("c")))
    picked = hit.groupBy("column_name").agg(*[F.max(F.when(F.col("name") == f"{k}{e}", F.col("v"))).alias(f"{k}{e}") for k in wanted for e in ("_lo", "_hi")])
    part = lambda q: at(q) - F.floor(at(q))
    value = lambda k, q: F.when(F.col(f"{k}_lo") == F.col(f"{k}_hi"), F.col(f"{k}_lo")).otherwise(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * part(q))
    return picked.join(stats.select("column_name", "n_ranked"), "column_name").select("column_name", *[value(k, q).alias(k) for k, q in wanted.items()])


def describe_texts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """n, n_unique, top value and its frequency of text columns (ties: the least value)."""
    names = list(columns) if columns else [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n long, n_unique long, top string, freq long")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _c(c).cast("string").alias("v")) for c in names])).alias("x")).select("x.*")
    counts = long.groupBy("column_name", "v").count()
    top = counts.where("v is not null").groupBy("column_name").agg(F.sum("count").alias("n"), F.count("*").alias("n_unique"), F.max("count").alias("freq"))
    first = counts.where("v is not null").join(top.select("column_name", F.col("freq").alias("count")), ["column_name", "count"]).groupBy("column_name").agg(F.min("v").alias("top"))
    base = df.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    return base.join(top, "column_name", "left").join(first, "column_name", "left").select("column_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "top", F.coalesce("freq", F.lit(0)).alias("freq"))


def structure_type(df: DataFrame) -> str:
    """``Fact/Transaction`` for more than 1,000 rows and a date-like column, else ``Dimension/Reference``."""
    dated = any(w in c.lower() for c in df.columns for w in DATE_WORDS)
    return "Fact/Transaction" if dated and df.limit(1001).count() > 1000 else "Dimension/Reference"


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """column_name, change (added, removed, type_changed or same), old_type,
    new_type, similarity of the type names, safe and warning.  Schemas only."""
    old, new = {c: type_name(t) for c, t in a.dtypes}, {c: type_name(t) for c, t in b.dtypes}
    rows = []
    for c in [*old, *[c for c in new if c not in old]]:
        x, y = old.get(c), new.get(c)
        change = "added" if x is None else "removed" if y is None else "same" if x == y else "type_changed"
        sim = round(difflib.SequenceMatcher(None, x, y).ratio(), 4) if change == "type_changed" else None
        safe = (x, y) in SAFE_CONVERSIONS if change == "type_changed" else None
        warn = None if change != "type_changed" or safe else f"{c}: {x} to {y} may lose data"
        rows.append((c, change, x, y, sim, safe, warn))
    return a.sparkSession.createDataFrame(rows, "column_name string, change string, old_type string, new_type string, similarity double, safe boolean, warning string")


SUITE = "expectation string, column_name string, least double, most double, value string"


def suite(df: DataFrame, null_threshold: float = 5.0, uniqueness: float = 0.99, approximate: bool = False) -> DataFrame:
    """Expectations that the table itself suggests: its columns, a row count of
    half to one and a half times its own, columns without many nulls, unique
    columns, and types.  For no rows: columns and types."""
    p = column_profile(df, approximate)
    each = F.array_compact(F.array(
        F.when(F.col("null_pct") <= null_threshold, F.struct(F.lit("not_null").alias("expectation"), F.lit(None).cast("string").alias("value"))),
        F.when(F.col("cardinality") >= uniqueness, F.struct(F.lit("unique").alias("expectation"), F.lit(None).cast("string").alias("value"))),
        F.struct(F.lit("type").alias("expectation"), F.col("data_type").alias("value")),
    ))
    nul = F.lit(None).cast("double")
    cols = p.select("column_name", F.inline(each)).select("expectation", "column_name", nul.alias("least"), nul.alias("most"), "value")
    n = F.max("n_rows").alias("n")
    count = p.agg(n).select(F.lit("row_count").alias("expectation"), F.lit(None).cast("string").alias("column_name"), F.greatest(F.lit(1.0), F.floor(F.col("n") * 0.5).cast("double")).alias("least"), F.floor(F.col("n") * 1.5).cast("double").alias("most"), F.lit(None).cast("string").alias("value")).where("most >= 1")
    names = df.sparkSession.createDataFrame([("columns_exist", None, None, None, ",".join(df.columns))], SUITE)
    return names.unionByName(count).unionByName(cols)


def validate(df: DataFrame, expectations: DataFrame, approximate: bool = False) -> DataFrame:
    """``expectations`` with passed and observed.  Uniqueness counts a null as a
    value; a column that is gone fails; unknown expectations are left out."""
    p = column_profile(df, approximate).withColumn("n_repeats", F.col("n_rows") - F.col("n_distinct") - F.least(F.col("n_null"), F.lit(1)))
    # expectations of the whole table meet the row named ""
    whole = p.agg(F.max("n_rows").alias("n_rows")).select(F.lit("").alias("column_name"), "n_rows")
    m = p.unionByName(whole, allowMissingColumns=True).withColumnRenamed("column_name", "__c")
    known = expectations.where(F.col("expectation").isin("columns_exist", "row_count", "not_null", "unique", "type"))
    j = known.join(F.broadcast(m), F.coalesce("column_name", F.lit("")) == F.col("__c"), "left")
    have = F.array(*[F.lit(c) for c in df.columns])
    missing = F.array_except(F.split("value", ","), have)
    e = F.col("expectation")
    passed = (
        F.when(e == "columns_exist", F.size(missing) == 0).when(e == "row_count", F.col("n_rows").between(F.col("least"), F.col("most")))
        .when(e == "not_null", F.col("n_null") == 0).when(e == "unique", F.col("n_repeats") == 0).when(e == "type", F.col("data_type") == F.col("value"))
    )
    seen = (
        F.when(e == "columns_exist", F.array_join(missing, ",")).when(e == "row_count", F.col("n_rows").cast("string")).when(e == "not_null", F.col("n_null").cast("string"))
        .when(e == "unique", F.col("n_repeats").cast("string")).when(e == "type", F.col("data_type"))
    )
    return j.select("expectation", "column_name", "least", "most", "value", F.coalesce(passed, F.lit(False)).alias("passed"), seen.alias("observed"))


def validation_summary(validated: DataFrame) -> DataFrame:
    """total, n_passed, n_failed, success_pct (one decimal; null for none)."""
    g = validated.agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"))
    return g.select("total", "n_passed", (F.col("total") - F.col("n_passed")).alias("n_failed"), F.when(F.col("total") > 0, F.round(F.col("n_passed") * 100.0 / F.col("total"), 1)).alias("success_pct"))


def keep_suite(expectations: DataFrame, path: str, name: str, source: str = "") -> None:
    """Writes a suite under its name, which replaces one of that name."""
    out = expectations.withColumns({"suite": F.lit(name), "source_file": F.lit(source)})
    out.repartition(1).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("suite").json(path)


def list_suites(spark: SparkSession, path: str) -> DataFrame:
    """name, source_file and expectations_count of the suites kept in a folder."""
    rows = spark.read.schema(f"{SUITE}, source_file string, suite string").json(path)
    return rows.groupBy(F.col("suite").alias("name")).agg(F.max("source_file").alias("source_file"), F.count("*").alias("expectations_count"))


def read_suite(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One suite of the folder."""
    return spark.read.schema(f"{SUITE}, source_file string, suite string").json(path).where(F.col("suite") == name).drop("suite", "source_file")
