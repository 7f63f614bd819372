"""Queries of the language-model operators, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import components, entity_match, eval_leaks, languages, name_variants, source_mix


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vendors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    erp = name_variants.records(_t(spark, d, "new_erp_vendors"), "erp", "erp_id", name="legal_name", street="address_line", zip="zip_code", town="city_name", phone="contact_phone", web="contact_email")
    return erp, name_variants.records(_t(spark, d, "legacy_vendors"), "legacy", "vendor_id", name="vendor_name", street="street", zip="postcode", town="town", phone="phone", web="website")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match(*_vendors(spark, d)).withColumnsRenamed({"key_left": "erp_id", "key_right": "vendor_id"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("erp_id", "vendor_id")


def p4_functions(spark: SparkSession, d: str) -> DataFrame:
    erp, legacy = _vendors(spark, d)
    return entity_match.functions_learned(erp.unionByName(legacy))


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    erp, legacy = _vendors(spark, d)
    return entity_match.variants(erp.unionByName(legacy))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_variants(spark, d).select("key_a", "key_b")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.mention_groups(_t(spark, d, "entity_links"), _t(spark, d, "entity_conflicts"))


def p6_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("group_id").agg((F.count("*") + 1).alias("n_mentions"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks_by_item(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.leaks_by_item(p8_leaks(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.shares(*source_mix.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets")))


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, languages.Model]:
    docs = _t(spark, d, "documents")
    return docs, languages.train(docs)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_labels(languages.document_languages(*_languages(spark, d)))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(*_languages(spark, d))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(*_languages(spark, d))


_P6 = r"""
WITH RECURSIVE raw AS (
  SELECT lower(trim(mention_a_id)) AS a, lower(trim(mention_b_id)) AS b FROM entity_links WHERE composite_score >= 0.5
  UNION ALL SELECT lower(trim(m)), '~' || lower(trim(cluster_id)) FROM (SELECT cluster_id, unnest(mention_ids) AS m FROM entity_conflicts) WHERE trim(cluster_id) <> '' AND trim(m) <> ''),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM raw UNION ALL SELECT b, a FROM raw) WHERE a <> b AND a <> '' AND b <> ''),
reach(x, y) USING KEY (x) AS (
  SELECT a, least(a, min(b)) FROM e GROUP BY a
  UNION
  SELECT e.a, min(r.y) FROM reach r JOIN e ON r.x = e.b JOIN recurring.reach c ON c.x = e.a WHERE r.y < c.y GROUP BY e.a)
SELECT y AS group_id, x AS mention_id FROM reach WHERE x NOT LIKE '~%' AND x <> y
"""

QUERIES = {
    "p4_found": p4_found, "p4_matches": p4_matches, "p4_functions": p4_functions, "p5_found": p5_found, "p5_variants": p5_variants,
    "p6_found": p6_found, "p6_group_sizes": p6_group_sizes,
    "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_leaks_by_item": p8_leaks_by_item,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_documents": p10_documents, "p10_segments": p10_segments,
}

SQL = {
    "p6_found": _P6,
    "p6_group_sizes": f"SELECT group_id, count(*) + 1 AS n_mentions FROM ({_P6}) GROUP BY 1",
}
