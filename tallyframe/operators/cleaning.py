"""Cleaning text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value in delimited files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

OPERATIONS = {
    "upper": F.upper,
    "lower": F.lower,
    "strip": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""),
    "trim_spaces": lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", ""),
    "remove_special": lambda c: F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s]", ""),
}
OPERATIONS["trim"] = OPERATIONS["trim_spaces"]


def cleaned(c: Column, operation: str) -> Column:
    """The column after one operation; null stays null."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}; one of {', '.join(sorted(OPERATIONS))}")
    return OPERATIONS[operation](c)


def clean(df: DataFrame, column: str, operation: str) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"column not found: {column}")
    return df.withColumn(column, cleaned(F.col(f"`{column}`").cast("string"), operation))


def clean_preview(df: DataFrame, column: str, operation: str, n: int = 5) -> DataFrame:
    """``before`` and ``after`` of a few rows."""
    c = F.col(f"`{column}`").cast("string")
    if column not in df.columns:
        raise ValueError(f"column not found: {column}")
    return df.limit(n).select(c.alias("before"), cleaned(c, operation).alias("after"))


def na_to_null(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Missing-value texts of all text columns as null."""
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
