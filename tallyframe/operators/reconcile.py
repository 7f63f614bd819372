"""Reconciling two tables on keys: orphans, conflicts, matches, merges.

Keys compare with null equal to null.  Of rows with equal keys the last one, by
the order columns given, stands for the key; equal order falls back on content.
Everything is one full outer join on typed columns and what follows from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _need(df: DataFrame, cols: Sequence[str], which: str) -> None:
    gone = [c for c in cols if c not in df.columns]
    if gone:
        raise ValueError(f"columns not found in source {which}: {', '.join(gone)}")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, the last by ``order``; an aggregation, so no sort by key."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    body = [*lead, *[c for c in rest if c not in lead]]
    if not body:
        return df.select(*keys).distinct()
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in body])).alias("__r"))
    return best.select(*[F.col(f"`{k}`") for k in keys], *[F.col("__r")[c].alias(c) for c in rest])


def compared_columns(a: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    """Columns to compare: those given, else all of ``a`` that are no keys."""
    return list(columns) if columns else [c for c in a.columns if c not in keys]


def row_hash(columns: Sequence[str]) -> Column:
    """First 16 hex digits of SHA-256 over the columns' texts.  Nulls read
    ``nan``; a separator within a value is escaped, so values cannot run together."""
    text = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")), r"([|\\])", r"\\$1") for c in columns]
    return F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 16)


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The keys of both tables, each once, with ``__a`` and ``__b``: the compared
    columns as structs, null where the key is missing."""
    cols = compared_columns(a, keys, columns)
    _need(a, [*keys, *cols], "a")
    _need(b, [*keys, *cols], "b")
    sides = []
    for df, tag in ((a, "a"), (b, "b")):
        one = last_per_key(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *cols, *[o for o in order if o in df.columns]])]), keys, [o for o in order if o in df.columns])
        sides.append(one.select(*[F.col(f"`{k}`").alias(f"__{tag}_{i}") for i, k in enumerate(keys)], F.struct(*([F.col(f"`{c}`") for c in cols] or [F.lit(1).alias("one")])).alias(f"__{tag}")))
    on = [F.col(f"__a_{i}").eqNullSafe(F.col(f"__b_{i}")) for i in range(len(keys))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    j = sides[0].join(sides[1], cond, "full_outer")
    return j.select(*[F.when(F.col("__a").isNotNull(), F.col(f"__a_{i}")).otherwise(F.col(f"__b_{i}")).alias(k) for i, k in enumerate(keys)], "__a", "__b")


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row: orphans on either side, conflicts, exact matches, match_rate (in
    percent of the common keys; null without any) and coverage (common keys in
    percent of all keys)."""
    cols = compared_columns(a, keys, columns)
    p = paired(a, b, keys, columns, order)
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    same = F.lit(True)
    for c in cols:
        same = same & F.col("__a")[c].eqNullSafe(F.col("__b")[c])
    n = lambda cond: F.count_if(cond)
    g = p.agg(n(F.col("__b").isNull()).alias("orphans_a"), n(F.col("__a").isNull()).alias("orphans_b"), n(both & ~same).alias("conflicts"), n(both & same).alias("exact_matches"))
    common = F.col("conflicts") + F.col("exact_matches")
    return g.select(
        "orphans_a", "orphans_b", (F.col("orphans_a") + F.col("orphans_b")).alias("total_orphans"), "conflicts", "exact_matches",
        F.when(common > 0, F.round(F.col("exact_matches") * 100.0 / common, 2)).alias("match_rate"),
        F.when(common + F.col("orphans_a") + F.col("orphans_b") > 0, F.round(common * 100.0 / (common + F.col("orphans_a") + F.col("orphans_b")), 2)).alias("coverage"),
    )


def orphans(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``a`` whose key ``b`` has not; nulls equal."""
    _need(a, keys, "a")
    _need(b, keys, "b")
    other = b.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & a[f"`{k}`"].eqNullSafe(other[f"__k{i}"])
    return a.join(other, cond, "left_anti")


def orphan_details(a: DataFrame, b: DataFrame, keys: Sequence[str], source: str = "both", limit: int | None = 10, order: Sequence[str] = ()) -> DataFrame:
    """Orphans of source ``a``, ``b`` or ``both``: source, total (of that source)
    and the row as JSON; the first ``limit`` of each source by ``order`` and the
    keys, all for None."""
    if source not in ("a", "b", "both"):
        raise ValueError(f"unknown source: {source}")
    out = None
    for tag, x, y in (("a", a, b), ("b", b, a)):
        if source not in (tag, "both"):
            continue
        found = orphans(x, y, keys)
        by = [F.col(f"`{c}`") for c in dict.fromkeys([*order, *keys])]
        total = found.agg(F.count("*").alias("total"))
        shown = found if limit is None else found.orderBy(*by).limit(limit)
        one = shown.select(F.lit(tag).alias("source"), *[c.alias(f"__o{i}") for i, c in enumerate(by)], F.to_json(F.struct(*[F.col(f"`{c}`") for c in x.columns])).alias("row"))
        one = one.crossJoin(F.broadcast(total)).select("source", "total", "row")
        out = one if out is None else out.unionByName(one)
    return out


def conflicts(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Keys, column_name, value_a, value_b of every differing field of common keys."""
    cols = compared_columns(a, keys, columns)
    p = paired(a, b, keys, columns, order).where("__a is not null and __b is not null")
    one = lambda c: F.when(~F.col("__a")[c].eqNullSafe(F.col("__b")[c]), F.struct(F.lit(c).alias("column_name"), F.col("__a")[c].cast("string").alias("value_a"), F.col("__b")[c].cast("string").alias("value_b")))
    return p.select(*keys, F.inline(F.array_compact(F.array(*[one(c) for c in cols])))) if cols else p.select(*keys, F.lit("").alias("column_name"), F.lit("").alias("value_a"), F.lit("").alias("value_b")).limit(0)


def merge(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Join on keys, which appear once; other columns of both get suffixes; null
    keys meet.  ``how``: inner, left, right or outer."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown merge type: {how}")
    _need(a, keys, "a")
    _need(b, keys, "b")
    shared = {c for c in a.columns if c in b.columns and c not in keys}
    x = a.select(*[F.col(f"`{c}`").alias(f"__l{keys.index(c)}" if c in keys else c + suffixes[0] if c in shared else c) for c in a.columns])
    y = b.select(*[F.col(f"`{c}`").alias(f"__r{keys.index(c)}" if c in keys else c + suffixes[1] if c in shared else c) for c in b.columns])
    cond = F.lit(True)
    for i in range(len(keys)):
        cond = cond & F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}"))
    j = x.join(y, cond, "full_outer" if how == "outer" else how)
    key = lambda i: F.col(f"__l{i}") if how in ("inner", "left") else F.col(f"__r{i}") if how == "right" else F.coalesce(f"__l{i}", f"__r{i}")
    return j.select(*[key(i).alias(k) for i, k in enumerate(keys)], *[c for c in x.columns if not c.startswith("__l")], *[c for c in y.columns if not c.startswith("__r")])
