"""References to records that do not exist.

Parents and children are put into one long form of (target table, target key)
rows; one aggregation per key tells whether the key has a parent, whether the
parent was deleted last and when it first came.  Only the keys with a case go
on, to be met again by the references.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import id_form

#: Texts that stand for "no reference".
PLACEHOLDERS = ("-", "--", "n/a", "na", "null", "none", "nil", "unknown", "tbd", "?", ".")


def reference_id(c: Column, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """The id referred to, trimmed and in lower case; null for no reference."""
    c = id_form(c)
    return F.when(~c.isin(*placeholders), c)


def references(df: DataFrame, table: str, record: str, target_table: str, target: str, loaded: str, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """References in long form.  ``target`` is a text column or an array of texts."""
    refs = df.select(F.col(f"`{record}`").alias("r"), F.col(f"`{target}`").alias("t"), F.col(f"`{loaded}`").alias("l"))
    if dict(refs.dtypes)["t"].startswith("array"):
        # outer: a record's earliest row counts even where it refers to nothing
        refs = refs.select("r", F.explode_outer("t").alias("t"), "l")
    return refs.select(
        F.lit(table).alias("ref_table"), id_form(F.col("r")).alias("record_id"), F.lit(target_table).alias("target_table"),
        reference_id(F.col("t"), placeholders).alias("target_id"), F.col("l").alias("loaded_at"),
    )


def targets(df: DataFrame, table: str, key: str, loaded: str, deleted: Column) -> DataFrame:
    """Parent rows in long form; ``deleted`` tells whether a row is a deletion."""
    return df.select(F.lit(table).alias("target_table"), id_form(F.col(f"`{key}`")).alias("target_id"), F.col(f"`{loaded}`").alias("loaded_at"), F.coalesce(deleted, F.lit(False)).alias("deleted")).where("target_id is not null")


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_table, record_id, target_table, target_id, state, period) of every
    reference whose target is ``missing``, ``deleted`` or ``late``, once each.

    ``deleted``: the target's row loaded last is a deletion (equal times: the
    deletion counts).  ``late``: the target's earliest load is after the
    record's.  ``period``: month of the record's earliest load, null if it has
    none; a null time is never early or late.  Null, blank or placeholder
    targets are no references.  Records without an id share the null id.
    Repeated rows and array elements count once; empty inputs give no rows.

    Rows of a hot key are summed before the shuffle and never gathered; the join
    back holds only keys with a case on its other side, and adaptive execution
    splits the references of a hot one.
    """
    each = refs.groupBy("ref_table", "record_id", "target_table", "target_id").agg(F.min("loaded_at").alias("loaded_at"))
    first = each.groupBy("ref_table", "record_id").agg(F.min("loaded_at").alias("record_loaded"))
    each = each.where("target_id is not null").drop("loaded_at")
    children = each.join(first.withColumnsRenamed({"ref_table": "__t", "record_id": "__r"}), (F.col("ref_table") == F.col("__t")) & F.col("record_id").eqNullSafe(F.col("__r"))).drop("__t", "__r")
    long = parents.select("target_table", "target_id", F.col("loaded_at").alias("parent_loaded"), "deleted", F.lit(True).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("child_loaded")).unionByName(
        children.select("target_table", "target_id", F.lit(None).cast("timestamp_ntz").alias("parent_loaded"), F.lit(None).cast("boolean").alias("deleted"), F.lit(False).alias("is_parent"), F.col("record_loaded").alias("child_loaded"))
    )
    # The order of (time, deleted) packs into a comparable number, so the aggregation hashes instead of sorting.
    stamp = F.coalesce(F.unix_micros(F.col("parent_loaded").cast("timestamp")), F.lit(-(1 << 60))) * F.lit(2) + F.col("deleted").cast("int")
    keys = long.groupBy("target_table", "target_id").agg(
        F.max("is_parent").alias("has_parent"),
        F.max(F.when(F.col("is_parent"), stamp)).alias("last"),
        F.min("parent_loaded").alias("parent_first"),
        F.count(F.when(~F.col("is_parent"), 1)).alias("n_refs"),
        F.min("child_loaded").alias("child_first"),
    )
    gone = F.col("last") % 2 != 0
    bad = keys.where((F.col("n_refs") > 0) & (~F.col("has_parent") | gone | (F.col("parent_first") > F.col("child_first"))))
    state = F.when(~F.col("has_parent"), "missing").when(gone, "deleted").when(F.col("parent_first") > F.col("record_loaded"), "late")
    return (
        children.join(bad, ["target_table", "target_id"])
        .select("ref_table", "record_id", "target_table", "target_id", state.alias("state"), F.date_format("record_loaded", "yyyy-MM").alias("period"))
        .where("state is not null")
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references by table, target table, state and month."""
    return orphans.groupBy("ref_table", "target_table", "state", "period").agg(F.count("*").alias("n_refs"), F.count_distinct("target_id").alias("n_targets"))
