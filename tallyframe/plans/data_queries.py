"""Queries of the general training-data operators, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import copy_diff, feed_drift, hierarchy, orphan_refs
from tallyframe.operators.copy_diff import Compared
from tallyframe.session import cut

CUSTOMER_FIELDS = (Compared("name"), Compared("email", "folded"), Compared("city"), Compared("balance", "number", 0.005))


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_field_values(spark: SparkSession, d: str) -> DataFrame:
    return copy_diff.diff_copies(_t(spark, d, "customers_a"), _t(spark, d, "customers_b"), ["id"], CUSTOMER_FIELDS, ["updated_at", "loaded_at"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_field_values(spark, d).select("id", "kind")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphan_refs.references(_t(spark, d, "feedback_records"), "feedback_records", "feedback_id", "grounded_findings", "finding_id", "loaded_at").unionByName(
        orphan_refs.references(_t(spark, d, "detection_rules"), "detection_rules", "rule_id", "kb_nodes", "evidence_nodes", "loaded_at")
    )
    findings, nodes = _t(spark, d, "grounded_findings"), _t(spark, d, "kb_nodes")
    parents = orphan_refs.targets(findings, "grounded_findings", "finding_id", "loaded_at", F.lower(F.trim("op")) == "delete").unionByName(
        orphan_refs.targets(nodes, "kb_nodes", "node_id", "loaded_at", F.col("deleted_at").isNotNull())
    )
    return orphan_refs.find_orphans(refs, parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "record_id", "target_id", "state", "period")


def p2_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphan_refs.orphan_counts(_orphans(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.links(_t(spark, d, "template_hierarchy"), "template_id", "hierarchy_id", "parent_id", "loaded_at", "level")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return hierarchy.faults(nodes, hierarchy.resolve(nodes)).select(F.col("tree_id").alias("template_id"), F.col("node_id").alias("hierarchy_id"), "kind")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return hierarchy.paths(nodes, hierarchy.resolve(nodes))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.full_hierarchy(_paths(spark, d)).withColumnsRenamed({"tree_id": "template_id", "node_id": "hierarchy_id"})


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_paths(spark, d)).withColumnsRenamed({"tree_id": "template_id"})


def _feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = cut(feed_drift.cells(_t(spark, d, "raw_feed_lines")))
    return cells, cut(feed_drift.file_columns(cells))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return feed_drift.drift(*_feed(spark, d))


def p7_schema(spark: SparkSession, d: str) -> DataFrame:
    return feed_drift.feed_schema(_feed(spark, d)[1])


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    return feed_drift.consistent_table(*_feed(spark, d))


_P1_STATES = r"""
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM customers_a WHERE id IS NOT NULL) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM customers_b WHERE id IS NOT NULL) WHERE rn = 1),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS ia, b.id AS ib,
  nullif(trim(nfc_normalize(a.name)), '') AS na, nullif(trim(nfc_normalize(b.name)), '') AS nb,
  nullif(lower(trim(nfc_normalize(a.email))), '') AS ea, nullif(lower(trim(nfc_normalize(b.email))), '') AS eb,
  nullif(trim(nfc_normalize(a.city)), '') AS ca, nullif(trim(nfc_normalize(b.city)), '') AS cb, a.balance AS ba, b.balance AS bb
  FROM a FULL OUTER JOIN b ON a.id = b.id)
"""
_P1 = _P1_STATES + r"""SELECT id, 'only_in_a' AS kind FROM j WHERE ib IS NULL
UNION ALL SELECT id, 'only_in_b' FROM j WHERE ia IS NULL
UNION ALL SELECT id, 'name' FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND na IS DISTINCT FROM nb
UNION ALL SELECT id, 'email' FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND ea IS DISTINCT FROM eb
UNION ALL SELECT id, 'city' FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND ca IS DISTINCT FROM cb
UNION ALL SELECT id, 'balance' FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND ((ba IS NULL) <> (bb IS NULL) OR abs(ba - bb) >= 0.00499999)
"""

_P1_VALUES = _P1_STATES + """SELECT id, 'only_in_a' AS kind, NULL::VARCHAR AS value_a, NULL::VARCHAR AS value_b FROM j WHERE ib IS NULL
UNION ALL SELECT id, 'only_in_b', NULL, NULL FROM j WHERE ia IS NULL
UNION ALL SELECT id, 'name', na, nb FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND na IS DISTINCT FROM nb
UNION ALL SELECT id, 'email', ea, eb FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND ea IS DISTINCT FROM eb
UNION ALL SELECT id, 'city', ca, cb FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND ca IS DISTINCT FROM cb
UNION ALL SELECT id, 'balance', ba::VARCHAR, bb::VARCHAR FROM j WHERE ia IS NOT NULL AND ib IS NOT NULL AND ((ba IS NULL) <> (bb IS NULL) OR abs(ba - bb) >= 0.00499999)
"""

_P2 = r"""
WITH r AS (
  SELECT 'feedback_records' AS ref_table, 'grounded_findings' AS target_table, lower(trim(feedback_id)) AS record_id, lower(trim(finding_id)) AS target_id, loaded_at FROM feedback_records
  UNION ALL
  SELECT 'detection_rules', 'kb_nodes', lower(trim(rule_id)), lower(trim(n)), loaded_at FROM (SELECT rule_id, loaded_at, unnest(CASE WHEN len(evidence_nodes) > 0 THEN evidence_nodes ELSE [NULL] END) AS n FROM detection_rules)
), f AS (SELECT ref_table, target_table, record_id, target_id, min(loaded_at) OVER (PARTITION BY ref_table, record_id) AS first FROM r),
c AS (SELECT DISTINCT * FROM f WHERE target_id IS NOT NULL AND target_id NOT IN ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nil', 'unknown', 'tbd', '?', '.')),
p AS (
  SELECT 'grounded_findings' AS target_table, lower(trim(finding_id)) AS target_id, loaded_at, op = 'delete' AS deleted FROM grounded_findings
  UNION ALL SELECT 'kb_nodes', lower(trim(node_id)), loaded_at, deleted_at IS NOT NULL FROM kb_nodes
), t AS (SELECT target_table, target_id, min(loaded_at) AS came, arg_max(deleted, (epoch_us(loaded_at) * 2 + coalesce(deleted, false)::INT)) AS deleted FROM p GROUP BY 1, 2)
SELECT c.ref_table, c.record_id, c.target_id, CASE WHEN t.target_id IS NULL THEN 'missing' WHEN t.deleted THEN 'deleted' ELSE 'late' END AS state, strftime(c.first, '%Y-%m') AS period, c.target_table
FROM c LEFT JOIN t ON c.target_table = t.target_table AND c.target_id = t.target_id
WHERE t.target_id IS NULL OR t.deleted OR t.came > c.first
"""

_P3 = r"""
WITH RECURSIVE n AS MATERIALIZED (
  SELECT lower(trim(template_id)) AS t, lower(trim(hierarchy_id)) AS h, arg_max(trim(template_id), loaded_at) AS template_id, arg_max(trim(hierarchy_id), loaded_at) AS hierarchy_id,
    arg_max({'p': CASE WHEN parent_id IS NULL OR trim(parent_id) IN ('', '-') THEN NULL ELSE lower(trim(parent_id)) END}, loaded_at).p AS p, arg_max({'l': level}, loaded_at).l AS level
  FROM template_hierarchy WHERE hierarchy_id IS NOT NULL GROUP BY 1, 2),
down AS (
  SELECT t, h, template_id, hierarchy_id, level, 1 AS depth, hierarchy_id AS path, hierarchy_id AS root, [hierarchy_id] AS ids FROM n WHERE p IS NULL
  UNION ALL SELECT n.t, n.h, n.template_id, n.hierarchy_id, n.level, d.depth + 1, d.path || ' > ' || n.hierarchy_id, d.root, list_append(d.ids, n.hierarchy_id) FROM n JOIN down d ON n.t = d.t AND n.p = d.h)
"""
_P3_FAULTS = _P3 + r""", up AS (
  SELECT t, h, h AS at, p, 0 AS hops FROM n
  UNION ALL SELECT u.t, u.h, n.h, n.p, u.hops + 1 FROM up u JOIN n ON u.t = n.t AND u.p = n.h WHERE u.hops <= (SELECT max(c) FROM (SELECT count(*) AS c FROM n GROUP BY t)) ),
miss AS (SELECT n.t, n.h FROM n LEFT JOIN n q ON n.t = q.t AND n.p = q.h WHERE n.p IS NOT NULL AND q.h IS NULL),
s AS (SELECT n.template_id, n.hierarchy_id, n.t, n.h, n.level, d.depth,
  EXISTS (SELECT 1 FROM miss m WHERE m.t = n.t AND m.h = n.h) AS own_missing,
  EXISTS (SELECT 1 FROM up u JOIN miss m ON u.t = m.t AND u.at = m.h WHERE u.t = n.t AND u.h = n.h) AS any_missing,
  EXISTS (SELECT 1 FROM up u WHERE u.t = n.t AND u.h = n.h AND u.p = n.h) AS loop
  FROM n LEFT JOIN down d ON n.t = d.t AND n.h = d.h)
SELECT template_id, hierarchy_id, CASE WHEN depth IS NOT NULL THEN 'wrong_level' WHEN own_missing THEN 'missing_parent' WHEN any_missing THEN 'below_missing' WHEN loop THEN 'cycle' ELSE 'below_cycle' END AS kind
FROM s WHERE depth IS NULL OR (level IS NOT NULL AND level <> depth)
"""

QUERIES = {
    "p1_found": p1_found, "p1_field_values": p1_field_values,
    "p2_found": p2_found, "p2_orphans_by_period": p2_orphans_by_period,
    "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants,
    "p7_found": p7_found, "p7_schema": p7_schema, "p7_table": p7_table,
}

SQL = {
    "p1_found": _P1,
    "p1_field_values": _P1_VALUES,
    "p2_found": f"SELECT ref_table, record_id, target_id, state, period FROM ({_P2})",
    "p2_orphans_by_period": f"SELECT ref_table, target_table, state, period, count(*) AS n_refs, count(DISTINCT target_id) AS n_targets FROM ({_P2}) GROUP BY 1, 2, 3, 4",
    "p3_found": _P3_FAULTS,
    "p3_hierarchy": _P3 + """, pairs AS (SELECT t, template_id, unnest(ids[:-2]) AS a FROM down), k AS (SELECT t, a, count(*) AS c FROM pairs GROUP BY 1, 2)
SELECT d.template_id, d.hierarchy_id, d.path, d.depth::INT AS depth, d.root, coalesce(k.c, 0)::BIGINT AS n_descendants FROM down d LEFT JOIN k ON d.t = k.t AND d.hierarchy_id = k.a""",
    "p3_descendants": _P3 + "SELECT template_id, ids[i] AS ancestor, hierarchy_id AS descendant, (len(ids) - i)::INT AS distance FROM (SELECT template_id, hierarchy_id, ids, unnest(range(1, len(ids))) AS i FROM down)",
}
