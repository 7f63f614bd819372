"""SQL over files: views, queries, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.sources.readers import read_table
from tallyframe.sources.sinks import export_parquet

__all__ = ["export_parquet", "list_tables", "query", "query_report", "register"]


def register(spark: SparkSession, path: str, name: str) -> dict:
    """A file as a view; its row count and schema."""
    df = read_table(spark, path)
    df.createOrReplaceTempView(name)
    return {"table": name, "rows": df.count(), "schema": dict(df.dtypes)}


def query(spark: SparkSession, sql: str, files: dict[str, str] | None = None) -> DataFrame:
    """Any Spark SQL over registered views and the files named here."""
    for name, path in (files or {}).items():
        read_table(spark, path).createOrReplaceTempView(name)
    return spark.sql(sql)


def query_report(spark: SparkSession, sql: str, files: dict[str, str] | None = None, preview: int = 10) -> dict:
    df = query(spark, sql, files)
    rows = df.limit(preview + 1).collect()
    return {"sql": sql, "columns": df.columns, "dtypes": dict(df.dtypes), "preview": [r.asDict(True) for r in rows[:preview]], "truncated": len(rows) > preview}


def list_tables(spark: SparkSession) -> list[dict]:
    """Views and tables but for temporary ones of ours; -1 rows where counting fails."""
    out = []
    for t in spark.catalog.listTables():
        if t.name.startswith("_tmp_"):
            continue
        try:
            n = spark.table(t.name).count()
        except Exception:  # noqa: BLE001
            n = -1
        out.append({"name": t.name, "type": t.tableType, "rows": n})
    return out
