"""Writing frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import _filesystem


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Delimited text with a header; ``single`` makes one part, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def append_json(df: DataFrame, path: str) -> None:
    """Adds rows to a dataset of JSON lines (feedback, results, counterexamples)."""
    df.write.mode("append").json(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def export_parquet(spark: SparkSession, sql_or_table: str, path: str) -> dict:
    """Writes a query or a table as parquet; rows are counted by the write itself."""
    text = sql_or_table.strip().rstrip(";")
    df = spark.sql(text) if text.split(None, 1)[0].lower() in ("select", "with", "values", "from", "(") or "\n" in text else spark.table(text)
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    fs, p = _filesystem(spark, path)
    size = fs.getContentSummary(p).getLength()
    return {"path": path, "rows": seen.get["n"], "bytes": size, "mb": round(size / 1e6, 2)}
