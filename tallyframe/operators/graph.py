"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut, release


def star_components(edges: DataFrame) -> DataFrame:
    """(vertex, label) of the vertices of ``edges`` (u, v); the label is the
    smallest vertex of the component.  Neighbourhoods are only ever reduced to a
    minimum, so a hub is never gathered; rounds grow with the logarithm of the
    vertices.  Nulls and self-links play no part."""
    stars = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null and u != v").distinct())
    seen = None
    while True:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        old, stars = stars, cut(large.join(down, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct())
        release(old)
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            member = stars.select(F.col("v").alias("vertex"), F.col("u").alias("label"))
            return member.unionByName(stars.select(F.col("u").alias("vertex"), F.col("u").alias("label")).distinct())
        seen = now
