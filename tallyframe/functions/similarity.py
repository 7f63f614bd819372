"""Similarities and differences of texts.

Ratcliff-Obershelp results (ratio, blocks, opcodes, text diffs) come from the
standard library inside Arrow-batched functions; the Indel ratio from a
bit-parallel longest common subsequence; bounds and Jaccard are built-ins.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

BLOCKS = ArrayType(StructType([StructField("a_start", LongType()), StructField("b_start", LongType()), StructField("size", LongType()), StructField("content", StringType())]))
OPCODES = ArrayType(StructType([StructField("operation", StringType()), StructField("a_start", LongType()), StructField("a_end", LongType()), StructField("b_start", LongType()), StructField("b_end", LongType()), StructField("a_content", StringType()), StructField("b_content", StringType())]))


def indel_ratio(a: str, b: str) -> float:
    """200 LCS / (|a| + |b|); 100 for two empty texts.  One bit per character of ``a``."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def _pairs(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio, 0 to 100; null if either is null."""
    return _pairs(indel_ratio, a, b).astype(float)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, 0 to 1; equal texts 1, one empty text 0; the order of arguments matters."""
    return _pairs(lambda x, y: 1.0 if x == y else 0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio(), a, b).astype(float)


@F.pandas_udf(DoubleType())
def quick_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Upper bound of ``similarity`` from letter counts."""
    return _pairs(lambda x, y: difflib.SequenceMatcher(None, x, y).quick_ratio(), a, b).astype(float)


def real_quick_ratio(a: Column, b: Column) -> Column:
    """Upper bound of ``similarity`` from lengths alone."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)


@F.pandas_udf(BLOCKS)
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(lambda x, y: [(m.a, m.b, m.size, x[m.a : m.a + m.size]) for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks() if m.size], a, b)


@F.pandas_udf(OPCODES)
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(lambda x, y: [(op, i, j, k, m, x[i:j], y[k:m]) for op, i, j, k, m in difflib.SequenceMatcher(None, x, y).get_opcodes()], a, b)


def _line_diff(make, a: Column, b: Column, from_label: str, to_label: str, context: int) -> Column:
    @F.pandas_udf(StringType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _pairs(lambda p, q: "\n".join(make(p.splitlines(), q.splitlines(), from_label, to_label, n=context, lineterm="")), x, y)

    return run(a, b)


def unified_diff(a: Column, b: Column, from_label: str = "a", to_label: str = "b", context: int = 3) -> Column:
    """Changed lines with ``context`` lines around them; empty for equal texts, null if either is null."""
    return _line_diff(difflib.unified_diff, a, b, from_label, to_label, context)


def context_diff(a: Column, b: Column, from_label: str = "a", to_label: str = "b", context: int = 3) -> Column:
    """Changed stretches before and after, with ``context`` lines around them."""
    return _line_diff(difflib.context_diff, a, b, from_label, to_label, context)


@F.pandas_udf(StringType())
def ndiff(a: pd.Series, b: pd.Series) -> pd.Series:
    """By character if both texts are single lines, else by line."""
    parts = lambda x, y: (list(x), list(y)) if "\n" not in x + y else (x.splitlines(), y.splitlines())
    return _pairs(lambda x, y: "\n".join(difflib.ndiff(*parts(x, y))), a, b)


def explanation(a: Column, b: Column) -> Column:
    """What differs, in words: a line for the similarity and one for each change."""
    # fixed values: the wording of the lines
    said = F.transform(
        F.filter(opcodes(a, b), lambda o: o["operation"] != "equal"),
        lambda o: F.when(o["operation"] == "insert", F.format_string("  Added: '%s'", o["b_content"])).when(o["operation"] == "delete", F.format_string("  Removed: '%s'", o["a_content"])).otherwise(F.format_string("  Changed: '%s' -> '%s'", o["a_content"], o["b_content"])),
    )
    quoted = lambda word, c: F.concat(F.lit(f"{word}: '"), c, F.lit("'"))
    return (
        F.when(a == b, F.lit("Identical - no changes")).when(F.length(a) == 0, quoted("Added", b)).when(F.length(b) == 0, quoted("Removed", a))
        .otherwise(F.array_join(F.concat(F.array(F.format_string("Similarity: %.1f%%", similarity(a, b) * 100)), said), "\n"))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays' distinct elements; 1 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def list_difference(a: Column, b: Column) -> Column:
    """Struct of added, removed and common elements (order and repeats kept) and Jaccard similarity."""
    return F.struct(
        F.filter(b, lambda x: ~F.array_contains(a, x)).alias("added"), F.filter(a, lambda x: ~F.array_contains(b, x)).alias("removed"),
        F.filter(a, lambda x: F.array_contains(b, x)).alias("common"), jaccard(a, b).alias("jaccard"),
    )


def map_difference(a: Column, b: Column) -> Column:
    """Struct of added, removed, changed and unchanged keys, each sorted."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = lambda k: F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))
    return F.struct(
        F.array_sort(F.array_except(F.map_keys(b), F.map_keys(a))).alias("added"), F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b))).alias("removed"),
        F.array_sort(F.filter(common, lambda k: ~same(k))).alias("changed"), F.array_sort(F.filter(common, same)).alias("unchanged"),
    )


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lists, element by element as text; 1 for
    two empty lists, null if either is null."""
    text = lambda xs: ["" if x is None else str(x) for x in xs]
    return _pairs(lambda x, y: difflib.SequenceMatcher(None, text(x), text(y)).ratio(), a, b).astype(float)


def paired_differences(df: DataFrame, before: str, after: str) -> DataFrame:
    """A row for each place that two array columns both have: the other columns,
    index (from 0), before, after (null reads as empty), similarity, opcodes and
    explanation."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (before, after)]
    pairs = F.arrays_zip(F.col(f"`{before}`").cast("array<string>").alias("x"), F.col(f"`{after}`").cast("array<string>").alias("y"))
    both = F.slice(pairs, 1, F.least(F.size(f"`{before}`"), F.size(f"`{after}`")))
    rows = df.where(F.col(f"`{before}`").isNotNull() & F.col(f"`{after}`").isNotNull()).select(*keep, F.posexplode(both).alias("index", "__p"))
    x, y = F.coalesce("__p.x", F.lit("")), F.coalesce("__p.y", F.lit(""))
    return rows.select(*keep, "index", x.alias("before"), y.alias("after"), similarity(x, y).alias("similarity"), opcodes(x, y).alias("opcodes"), explanation(x, y).alias("explanation"))
