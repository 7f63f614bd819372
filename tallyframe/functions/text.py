"""Text normalisation shared by the operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Blanks at either end, Unicode white space, no-break and zero-width blanks and byte-order marks included.
OUTER_BLANKS = r"(?U)^[\s ​﻿]+|[\s ​﻿]+$"


#: The same characters, one by one.
BLANKS = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


def trimmed(c: Column) -> Column:
    """Without outer blanks, as ``strip`` but without a regular expression."""
    return F.btrim(c, F.lit(BLANKS))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_BLANKS, "")


def blank_to_null(c: Column) -> Column:
    """Without outer blanks; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def id_form(c: Column) -> Column:
    """The form in which ids compare: no outer blanks, lower case, blank as null."""
    return F.lower(blank_to_null(c))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Composes text columns.  Only text with other than ASCII characters goes to
    Python; the rest stays in the JVM."""
    for c in columns:
        x = F.col(c)
        other = F.octet_length(x) != F.length(x)
        df = df.withColumn(c, F.coalesce(_nfc(F.when(other, x)), x))
    return df
