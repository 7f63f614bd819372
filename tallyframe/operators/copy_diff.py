"""Differences between two copies of a dataset.

Each copy is reduced to one 64-bit key hash and one 64-bit row hash per key.
Every (key hash, row hash) pair is an element of a set; both sets are summed
into invertible Bloom lookup tables, one table per hash bucket, with opposite
signs, so equal rows cancel and a table has the size of the difference, not of
the data.  Peeling a bucket's table yields the keys whose rows differ; only
these are fetched and compared by field.  Where a key may have several rows in
a copy, its last one must be found first, which shuffles the copies once by key;
with ``unique`` keys that step is left out and only sums of cells move.

The number of cells comes from a strata estimate of the difference (Eppstein
et al. 2011), a table of fixed size.  A bucket that does not peel completely
is not dropped: all its keys are fetched and compared exactly.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import blank_to_null, nfc
from tallyframe.session import cut

_MASK = (1 << 64) - 1
#: Cells of one bucket's table, in three equal parts, and elements meant for it.
CELLS, LOAD = 192, 96
#: Strata of the estimator and cells of each.
STRATA, STRATUM_CELLS = 40, 96


@dataclass(frozen=True)
class Compared:
    """A compared field: ``kind`` is ``text``, ``folded`` (case ignored) or ``number``."""

    name: str
    kind: str = "text"
    tolerance: float = 0.0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _xx(value: int, seed: int) -> int:
    """Spark's xxhash64 of one BIGINT under a seed, as unsigned."""
    import xxhash

    return xxhash.xxh64_intdigest(struct.pack("<Q", value & _MASK), seed & _MASK)


def element_hash(key_hash: int, row_hash: int) -> int:
    """Spark's ``xxhash64(key_hash, row_hash)``."""
    return _signed(_xx(row_hash, _xx(key_hash, 42)))


def cell_positions(element: int, cells: int) -> list[int]:
    part = cells // 3
    return [j * part + _signed(_xx(j, _xx(element, 42))) % part for j in range(3)]


def _cell_column(element: Column, cells: int) -> Column:
    part = cells // 3
    return F.array(*[
        (F.lit(j * part) + F.pmod(F.xxhash64(element, F.lit(j).cast("long")), F.lit(part))).cast("int")
        for j in range(3)
    ])


def peel(cells: dict[int, list[int]], size: int) -> tuple[list[tuple[int, int]], bool]:
    """Elements of a table ``{cell: [count, key, row, element]}`` as (key hash,
    sign), and whether the table came out empty.  Changes ``cells``."""
    out: list[tuple[int, int]] = []
    todo = [c for c, v in cells.items() if v[0] in (1, -1)]
    while todo:
        v = cells.get(todo.pop())
        if v is None or v[0] not in (1, -1) or element_hash(v[1], v[2]) != v[3]:
            continue
        sign, key, row, element = v
        out.append((key, sign))
        for c in cell_positions(element, size):
            w = cells.setdefault(c, [0, 0, 0, 0])
            w[0] -= sign
            w[1] ^= key
            w[2] ^= row
            w[3] ^= element
            if w[0] in (1, -1):
                todo.append(c)
    return out, not any(any(v) for v in cells.values())


def _table(elements: DataFrame, group: Column, cells: int) -> DataFrame:
    """(grp, cell, n, k, r, e) of all elements, cells that cancel left out."""
    return (
        elements.select(group.alias("grp"), F.explode(_cell_column(F.col("e"), cells)).alias("cell"), "sign", "kh", "rh", "e")
        .groupBy("grp", "cell")
        .agg(F.sum("sign").alias("n"), F.bit_xor("kh").alias("k"), F.bit_xor("rh").alias("r"), F.bit_xor("e").alias("e"))
        .where("n != 0 or k != 0 or r != 0 or e != 0")
    )


def estimate_difference(elements: DataFrame) -> int:
    """Estimated number of elements in one copy only.  Collects at most
    ``STRATA * STRATUM_CELLS`` cells, whatever the size of the data."""
    # An element falls into stratum i with probability 2^-(i+1).
    h = F.xxhash64(F.col("e"), F.lit("stratum")).bitwiseAND(F.lit((1 << 62) - 1))
    stratum = F.least(F.bit_count(h.bitwiseXOR(h - F.lit(1))) - F.lit(1), F.lit(STRATA - 1))
    by: dict[int, dict[int, list[int]]] = {}
    for r in _table(elements, stratum, STRATUM_CELLS).collect():
        by.setdefault(r.grp, {})[r.cell] = [r.n, r.k, r.r, r.e]
    found = 0
    for i in range(STRATA - 1, -1, -1):
        out, clean = peel(by.get(i, {}), STRATUM_CELLS)
        if not clean:
            return max(1, found) * 2 ** (i + 1)
        found += len(out)
    return found


def _canonical(df: DataFrame, fields: Sequence[Compared]) -> DataFrame:
    texts = [f for f in fields if f.kind != "number"]
    if texts:
        df = nfc(df, [f.name for f in texts])
    for f in fields:
        c = F.col(f.name)
        if f.kind == "number":
            c = c.cast("double")
            c = F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c)
        else:
            c = blank_to_null(c)
            if f.kind == "folded":
                c = F.lower(c)
        df = df.withColumn(f.name, c)
    return df


def _digest(f: Compared) -> Column:
    """What enters the row hash.  A number is rounded to half its tolerance, so
    numbers that differ by the tolerance always differ here as well; numbers
    closer than that may, and the comparison by field settles them."""
    c = F.col(f.name)
    if f.kind == "number":
        if f.tolerance:
            c = F.round(c / F.lit(f.tolerance / 2))
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    return F.when(c.isNull(), F.lit("\u0000")).otherwise(c.cast("string"))


def _differs(f: Compared, a: Column, b: Column) -> Column:
    if f.kind == "number":
        nan = F.isnan(a) != F.isnan(b)
        far = F.abs(a - b) >= f.tolerance - f.tolerance * 1e-6 if f.tolerance else a != b
        number = nan | (~F.isnan(a) & ~F.isnan(b) & (a != b) & far)
        return F.coalesce(F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).otherwise(number), F.lit(False))
    return ~a.eqNullSafe(b)


def _state(df: DataFrame, keys: Sequence[str], fields: Sequence[Compared], latest_by: Sequence[str], unique: bool = False) -> DataFrame:
    """One row per key: the one that is last by ``latest_by`` (ties by content)."""
    rest = [f.name for f in fields]
    if unique:
        return df.select(*keys, *rest)
    return df.groupBy(*keys).agg(F.max(F.struct(*latest_by, *rest)).alias("__s")).select(*keys, *[F.col("__s")[c].alias(c) for c in rest])


def _prepare(df: DataFrame, keys: Sequence[str], fields: Sequence[Compared], latest_by: Sequence[str]) -> DataFrame:
    cols = list(dict.fromkeys([*keys, *latest_by, *[f.name for f in fields]]))
    out = df.select(*[F.col(f"`{c}`") for c in cols]).dropna(subset=list(keys))
    return out.withColumn("__kh", F.xxhash64(*keys))


def diff_copies(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    fields: Sequence[Compared],
    latest_by: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Rows missing on either side and fields that differ.

    Returns the keys, ``kind`` (``only_in_a``, ``only_in_b`` or the name of a
    differing field) and ``value_a``, ``value_b`` as text (null for missing rows).

    The state of a key in a copy is its row with the greatest ``latest_by``
    (nulls first; ties and repeated rows: the greatest remaining content), so
    ``latest_by`` may be empty for keys that are unique.  Rows with a null in a
    key column do not count.  Text compares in Unicode composition NFC without
    outer blanks, blank equals null; NaN equals NaN; null differs from a number.
    Columns not named play no part, whatever they are called.  Empty copies give
    only missing rows, or none.  ``unique`` says that no key has two rows in one
    copy; a key that has, then counts with each of them.

    Two rows of one key go unnoticed only if their 64-bit row hashes collide.
    """
    pa, pb = _prepare(a, keys, fields, latest_by), _prepare(b, keys, fields, latest_by)

    def elements(p: DataFrame, sign: int) -> DataFrame:
        s = _canonical(_state(p, [*keys, "__kh"], fields, latest_by, unique), fields)
        s = s.select(F.col("__kh").alias("kh"), F.xxhash64(*keys, *[_digest(f) for f in fields]).alias("rh"), F.lit(sign).cast("long").alias("sign"))
        return s.withColumn("e", F.xxhash64("kh", "rh"))

    all_elements = cut(elements(pa, 1).unionByName(elements(pb, -1)))
    expected = estimate_difference(all_elements)
    buckets = max(1, math.ceil(1.3 * expected / LOAD))
    bucket = F.pmod(F.xxhash64("kh", F.lit("bucket")), F.lit(buckets))

    def peel_bucket(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {c: [n, k, r, e] for c, n, k, r, e in zip(*(pdf[x].tolist() for x in ("cell", "n", "k", "r", "e")), strict=True)}
        out, clean = peel(cells, CELLS)
        keys_ = [k for k, _ in out] if clean else []
        return pd.DataFrame({"grp": [key[0]] * (len(keys_) or 1), "kh": pd.array(keys_ or [None], dtype="Int64"), "open": [not clean] * (len(keys_) or 1)})

    # A bucket's table has at most CELLS rows.
    peeled = cut(_table(all_elements, bucket, CELLS).groupBy("grp").applyInPandas(peel_bucket, "grp long, kh long, open boolean"))
    open_buckets = peeled.where("open").select("grp").distinct()
    wanted = (
        peeled.where("kh is not null").select("kh")
        .unionByName(all_elements.withColumn("grp", bucket).join(open_buckets, "grp", "left_semi").select("kh"))
        .distinct()
        .withColumnRenamed("kh", "__kh")
    )
    sa = _canonical(_state(pa.join(wanted, "__kh", "left_semi"), [*keys, "__kh"], fields, latest_by), fields)
    sb = _canonical(_state(pb.join(wanted, "__kh", "left_semi"), [*keys, "__kh"], fields, latest_by), fields)
    pack = lambda s, side: s.select(*keys, F.struct(*[f.name for f in fields]).alias(side))
    both = pack(sa, "__a").join(pack(sb, "__b"), list(keys), "full_outer")
    text = lambda c: F.col(c).cast("string")
    null = F.lit(None).cast("string")
    row = lambda kind, va, vb: F.struct(F.lit(kind).alias("kind"), va.alias("value_a"), vb.alias("value_b"))
    cases = F.array(
        F.when(F.col("__b").isNull(), row("only_in_a", null, null)),
        F.when(F.col("__a").isNull(), row("only_in_b", null, null)),
        *[
            F.when(
                F.col("__a").isNotNull() & F.col("__b").isNotNull() & _differs(f, F.col("__a")[f.name], F.col("__b")[f.name]),
                row(f.name, text(f"__a.{f.name}"), text(f"__b.{f.name}")),
            )
            for f in fields
        ],
    )
    return both.select(*keys, F.explode(F.array_compact(cases)).alias("__c")).select(*keys, "__c.*")
