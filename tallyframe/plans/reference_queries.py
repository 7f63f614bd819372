"""Queries of the reconciliation, quality and detection operators, with SQL for
the same results.  All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import sql as tsql
from tallyframe.functions import similarity as sim
from tallyframe.operators import checks, cleaning, detection, fuzzy, graph, linking, profiling, reconcile, templates, workbooks
from tallyframe.session import cut
from tallyframe.sources import readers
from tallyframe.streaming import incremental

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "customers_a", "customers_b", "grounded_findings", "feedback_records", "template_hierarchy", "legacy_vendors", "new_erp_vendors", "entity_links", "detection_rules", "kb_nodes", "entity_conflicts", "raw_feed_lines")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _views(s: SparkSession, d: str, sql: str) -> DataFrame:
    """Runs SQL over the tables it names."""
    import re

    files = {}
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            files[t] = f"{d}/{t}.parquet"
    return tsql.query(s, sql, files)


def both(name: str, sql: str, duck: str | None = None) -> None:
    """A query given as SQL that both engines read."""
    QUERIES[name] = lambda s, d: _views(s, d, sql)
    SQL[name] = duck or sql


# ---- reconciliation -------------------------------------------------------

COLS = ["name", "email", "city", "balance"]
ORDER = ["updated_at", "loaded_at"]
_LAST = """WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, name DESC NULLS LAST, email DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) AS rn FROM customers_a) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, name DESC NULLS LAST, email DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) AS rn FROM customers_b) WHERE rn = 1),
j AS (SELECT a.rn AS ra, b.rn AS rb, coalesce(a.id, b.id) AS id, a.name AS na, b.name AS nb, a.email AS ea, b.email AS eb, a.city AS ca, b.city AS cb, a.balance AS ba, b.balance AS bb FROM a FULL OUTER JOIN b ON a.id IS NOT DISTINCT FROM b.id)
"""
_SAME = "na IS NOT DISTINCT FROM nb AND ea IS NOT DISTINCT FROM eb AND ca IS NOT DISTINCT FROM cb AND ba IS NOT DISTINCT FROM bb"


def _ab(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _t(s, d, "customers_a"), _t(s, d, "customers_b")


@query(_LAST + f""", c AS (SELECT count(*) FILTER (WHERE rb IS NULL) AS oa, count(*) FILTER (WHERE ra IS NULL) AS ob, count(*) FILTER (WHERE ra = 1 AND rb = 1 AND NOT ({_SAME})) AS x, count(*) FILTER (WHERE ra = 1 AND rb = 1 AND {_SAME}) AS m FROM j)
SELECT oa AS orphans_a, ob AS orphans_b, oa + ob AS total_orphans, x AS conflicts, m AS exact_matches, round(m * 100.0 / (x + m), 2) AS match_rate, round((x + m) * 100.0 / (x + m + oa + ob), 2) AS coverage FROM c""")
def recon_compare(s, d):
    return reconcile.compare(*_ab(s, d), ["id"], COLS, ORDER)


@query("SELECT * FROM customers_a a WHERE NOT EXISTS (SELECT 1 FROM customers_b b WHERE a.id IS NOT DISTINCT FROM b.id)")
def recon_orphans_a(s, d):
    return reconcile.orphans(*_ab(s, d), ["id"])


@query("SELECT * FROM customers_b b WHERE NOT EXISTS (SELECT 1 FROM customers_a a WHERE a.id IS NOT DISTINCT FROM b.id)")
def recon_orphans_b(s, d):
    a, b = _ab(s, d)
    return reconcile.orphans(b, a, ["id"])


@query(_LAST + """SELECT id, c AS column_name, x AS value_a, y AS value_b FROM (
SELECT id, 'name' AS c, na AS x, nb AS y FROM j WHERE ra = 1 AND rb = 1 AND na IS DISTINCT FROM nb UNION ALL SELECT id, 'email', ea, eb FROM j WHERE ra = 1 AND rb = 1 AND ea IS DISTINCT FROM eb
UNION ALL SELECT id, 'city', ca, cb FROM j WHERE ra = 1 AND rb = 1 AND ca IS DISTINCT FROM cb UNION ALL SELECT id, 'balance', ba::VARCHAR, bb::VARCHAR FROM j WHERE ra = 1 AND rb = 1 AND ba IS DISTINCT FROM bb)""")
def recon_conflicts(s, d):
    return reconcile.conflicts(*_ab(s, d), ["id"], COLS, ORDER)


@query("""WITH c AS (SELECT c_custkey, sha256(concat_ws('|', c_custkey::VARCHAR, regexp_replace(coalesce(c_name, 'nan'), '([|\\\\])', '\\\\\\1', 'g'), coalesce(c_mktsegment, 'nan'), coalesce(c_acctbal::DECIMAL(18,2)::VARCHAR, 'nan'))) AS h FROM customer) SELECT c_custkey, substr(h, 1, 16) AS row_hash FROM c""")
def recon_row_hash(s, d):
    c = _t(s, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return c.select("c_custkey", reconcile.row_hash(["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]).alias("row_hash"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_quantity DESC NULLS LAST) AS rn FROM lineitem) WHERE rn = 1""")
def recon_last_wins(s, d):
    return reconcile.last_per_key(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_quantity"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_quantity"])


for _how, _kind, _key in (("inner", "JOIN", "a.id"), ("left", "LEFT JOIN", "a.id"), ("right", "RIGHT JOIN", "b.id"), ("outer", "FULL OUTER JOIN", "coalesce(a.id, b.id)")):
    QUERIES[f"merge_{_how}"] = lambda s, d, how=_how: reconcile.merge(_t(s, d, "customers_a").select("id", "name", "balance"), _t(s, d, "customers_b").select("id", "name", "city"), ["id"], how)
    SQL[f"merge_{_how}"] = f"SELECT {_key} AS id, a.name AS name_a, a.balance, b.name AS name_b, b.city FROM customers_a a {_kind} customers_b b ON a.id IS NOT DISTINCT FROM b.id"

# ---- cleaning --------------------------------------------------------------

for _op, _sql in (
    ("upper", "upper(name)"), ("lower", "lower(name)"), ("strip", r"regexp_replace(name, '^\s+|\s+$', '', 'g')"),
    ("trim_spaces", r"regexp_replace(regexp_replace(name, '\s+', ' ', 'g'), '^ | $', '', 'g')"), ("remove_special", r"regexp_replace(name, '[^a-zA-Z0-9\s]', '', 'g')"),
):
    QUERIES[f"clean_{_op}"] = lambda s, d, op=_op: cleaning.clean(_t(s, d, "legacy_vendors").select("vendor_id", F.col("vendor_name").alias("name")), "name", op)
    SQL[f"clean_{_op}"] = f"SELECT vendor_id, {_sql} AS name FROM (SELECT vendor_id, vendor_name AS name FROM legacy_vendors)"

# ---- profile, drift, expectations -------------------------------------------

_LINE = {"l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int32", "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64", "l_returnflag": "object", "l_linestatus": "object", "l_shipdate": "datetime64[ns]"}
_ORD = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64", "o_orderdate": "datetime64[ns]", "o_orderpriority": "object"}
_CUST = {"id": "int64", "name": "object", "email": "object", "city": "object", "balance": "float64", "updated_at": "datetime64[ns]", "loaded_at": "datetime64[ns]"}


def _profile_sql(table: str, cols: dict[str, str]) -> str:
    one = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM {table}" for c, t in cols.items())
    return f"SELECT *, round(n_null * 100.0 / n_rows, 2) AS null_pct, n_distinct / n_rows AS cardinality, n_distinct / n_rows > 0.99 AS potential_key, n_distinct / n_rows > 0.9 AS high_cardinality, n_distinct / n_rows < 0.1 AS low_cardinality FROM ({one})"


@query(_profile_sql("lineitem", _LINE))
def profile_columns(s, d):
    return profiling.column_profile(_t(s, d, "lineitem").select(*_LINE))


@query(f"SELECT sum(c)::BIGINT AS n_rows, (sum(c) - count(*))::BIGINT AS n_duplicates, round((sum(c) - count(*)) * 100.0 / sum(c), 2)::DOUBLE AS duplicate_pct FROM (SELECT count(*) AS c FROM customers_a GROUP BY {', '.join(_CUST)})")
def profile_duplicates(s, d):
    return profiling.duplicate_rows(_t(s, d, "customers_a"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def profile_numbers(s, d):
    return profiling.describe_numbers(_t(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count({c}) FROM orders) AS n, (SELECT count(DISTINCT {c}) FROM orders) AS n_unique, v AS top, k AS freq FROM (SELECT {c} AS v, count(*) AS k FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 1)" for c in ("o_orderstatus", "o_orderpriority")))
def profile_texts(s, d):
    return profiling.describe_texts(_t(s, d, "orders"))


@query()
def drift_columns(s, d):
    return profiling.drift(_t(s, d, "customer").withColumnRenamed("c_name", "name"), _t(s, d, "customers_a"))


_SUITE = f"""WITH p AS ({_profile_sql('orders', _ORD)})
SELECT 'columns_exist' AS expectation, NULL AS column_name, NULL::DOUBLE AS least, NULL::DOUBLE AS most, '{','.join(_ORD)}' AS value
UNION ALL SELECT 'row_count', NULL, greatest(1, floor(max(n_rows) * 0.5))::DOUBLE, floor(max(n_rows) * 1.5)::DOUBLE, NULL FROM p
UNION ALL SELECT 'not_null', column_name, NULL, NULL, NULL FROM p WHERE null_pct <= 5 UNION ALL SELECT 'unique', column_name, NULL, NULL, NULL FROM p WHERE cardinality >= 0.99
UNION ALL SELECT 'type', column_name, NULL, NULL, data_type FROM p"""


@query(_SUITE)
def expectations_suite(s, d):
    return profiling.suite(_t(s, d, "orders").select(*_ORD))


_VALID = f"""WITH p AS ({_profile_sql('customers_a', _CUST)}), q AS ({_profile_sql('customers_b', _CUST)}), u AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, count(*) - (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) AS r FROM customers_b" for c in _CUST)}),
n AS (SELECT max(n_rows) AS b FROM q), m AS (SELECT max(n_rows) AS a FROM p)
SELECT 'columns_exist' AS expectation, NULL AS column_name, true AS passed, '' AS observed
UNION ALL SELECT 'row_count', NULL, b BETWEEN floor(a * 0.5) AND floor(a * 1.5), b::VARCHAR FROM n, m
UNION ALL SELECT 'not_null', q.column_name, q.n_null = 0, q.n_null::VARCHAR FROM p JOIN q ON p.column_name = q.column_name WHERE p.null_pct <= 5
UNION ALL SELECT 'unique', u.column_name, r = 0, r::VARCHAR FROM p JOIN u ON p.column_name = u.column_name WHERE p.cardinality >= 0.99
UNION ALL SELECT 'type', q.column_name, q.data_type = p.data_type, q.data_type FROM p JOIN q ON p.column_name = q.column_name"""


def _validated(s, d):
    a, b = _ab(s, d)
    return profiling.validate(b.select(*_CUST), profiling.suite(a.select(*_CUST)))


@query(_VALID)
def validate_expectations(s, d):
    return _validated(s, d).select("expectation", "column_name", "passed", "observed")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS n_passed, count(*) FILTER (WHERE NOT passed) AS n_failed, round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS success_pct FROM ({_VALID})")
def validate_summary(s, d):
    return profiling.validation_summary(_validated(s, d))


# ---- similarity --------------------------------------------------------------


@query()
def fuzzy_best_match(s, d):
    return fuzzy.fuzzy_match(_t(s, d, "new_erp_vendors"), "legal_name", _t(s, d, "legacy_vendors"), "vendor_name", 90)


@query()
def fuzzy_dedupe_groups(s, d):
    return fuzzy.fuzzy_dedupe(_t(s, d, "legacy_vendors"), "vendor_name", 90)


@query()
def fuzzy_close_matches(s, d):
    return fuzzy.close_matches(_t(s, d, "new_erp_vendors"), "legal_name", _t(s, d, "legacy_vendors"), "vendor_name", 3, 92)


@query("SELECT p_partkey, CASE WHEN length(p_name) + length(p_type) = 0 THEN 1.0 ELSE 2.0 * least(length(p_name), length(p_type)) / (length(p_name) + length(p_type)) END AS bound FROM part")
def fuzzy_length_bound(s, d):
    return _t(s, d, "part").select("p_partkey", sim.real_quick_ratio(F.col("p_name"), F.col("p_type")).alias("bound"))


@query("SELECT rule_id, loaded_at, len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) AS jaccard FROM (SELECT rule_id, loaded_at, string_split(lower(name), ' ') AS a, string_split(lower(description), ' ') AS b FROM detection_rules)")
def diff_jaccard(s, d):
    return _t(s, d, "detection_rules").select("rule_id", "loaded_at", sim.jaccard(F.split(F.lower("name"), " "), F.split(F.lower("description"), " ")).alias("jaccard"))


@query("SELECT rule_id, loaded_at, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n_added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_removed, len(list_filter(a, lambda x: list_contains(b, x))) AS n_common FROM (SELECT rule_id, loaded_at, string_split(lower(name), ' ') AS a, string_split(lower(description), ' ') AS b FROM detection_rules)")
def diff_lists(s, d):
    x = _t(s, d, "detection_rules").select("rule_id", "loaded_at", sim.list_difference(F.split(F.lower("name"), " "), F.split(F.lower("description"), " ")).alias("x"))
    return x.select("rule_id", "loaded_at", *[F.size(f"x.{c}").cast("long").alias(f"n_{c}") for c in ("added", "removed", "common")])


@query()
def diff_maps(s, d):
    want = F.create_map(F.lit("include_flag"), F.lit(True), F.lit("calculation_flag"), F.lit(False), F.lit("other"), F.lit(True))
    return _t(s, d, "template_hierarchy").where("flags is not null").select("template_id", "hierarchy_id", "loaded_at", sim.map_difference(F.col("flags"), want).alias("x")).select("template_id", "hierarchy_id", "loaded_at", "x.*")


@query()
def diff_opcodes(s, d):
    a, b = _ab(s, d)
    c = reconcile.conflicts(a, b, ["id"], ["name", "email", "city"], ORDER).where("value_a is not null and value_b is not null")
    return c.select("id", "column_name", sim.similarity("value_a", "value_b").alias("similarity"), sim.opcodes("value_a", "value_b").alias("opcodes"), sim.explanation(F.col("value_a"), F.col("value_b")).alias("explanation"))


# ---- financial checks ----------------------------------------------------------

_JOURNAL = """SELECT concat('file_', cast(l_suppkey % 9 AS varchar(10))) AS file, cast(l_orderkey AS varchar(20)) AS Journal_ID,
CASE l_linenumber WHEN 1 THEN '4000' WHEN 2 THEN '4010' WHEN 3 THEN '5000' WHEN 4 THEN '6800' WHEN 5 THEN '1800' WHEN 6 THEN '6000' ELSE '2800' END AS Account,
CASE WHEN l_discount > 0.05 THEN concat('(', cast(cast(l_extendedprice AS decimal(18,2)) AS varchar(30)), ')') WHEN l_tax > 0.06 THEN cast(cast(floor(l_extendedprice / 1000) * 1000 AS decimal(18,2)) AS varchar(30)) ELSE cast(cast(l_extendedprice AS decimal(18,2)) AS varchar(30)) END AS Amount,
substr(cast(l_shipdate AS varchar(30)), 1, 7) AS Period, CASE WHEN l_tax < 0.04 THEN 'Manual' ELSE 'System' END AS Source,
CASE l_partkey % 7 WHEN 0 THEN 'Reclassification of cost' WHEN 1 THEN 'Reserve release' WHEN 2 THEN 'Miscoded expense' ELSE 'Ordinary' END AS Description,
CASE l_suppkey % 5 WHEN 0 THEN 'Silk Horizon Consulting, LLC' WHEN 1 THEN 'Nordic Trade Ltd.' ELSE 'Miller and Sons' END AS Counterparty,
CASE l_partkey % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' ELSE '' END AS Prepared_By, CASE l_suppkey % 3 WHEN 0 THEN 'Ann ' WHEN 1 THEN 'CFO' ELSE '' END AS Approved_By, CASE WHEN l_quantity > 45 THEN 'Y' ELSE 'N' END AS Override,
concat(substr(cast(l_shipdate AS varchar(30)), 1, 10), 'T', lpad(cast(l_partkey % 24 AS varchar(10)), 2, '0'), ':00:00') AS Timestamp FROM lineitem"""
_J = f"""WITH j AS MATERIALIZED (SELECT *, CASE WHEN Amount LIKE '(%' THEN -CAST(trim(Amount, '()') AS DOUBLE) ELSE CAST(Amount AS DOUBLE) END AS amt, Counterparty LIKE 'Silk%' OR Counterparty LIKE 'Nordic%' AS shell, lower(Description) AS d FROM ({_JOURNAL}))
"""
_FRAUD = {
    "round_tripping": "SELECT file, 'ROUND_TRIPPING' AS type, 'CRITICAL' AS severity, Period AS subject, count(*) FILTER (WHERE Account LIKE '4%') AS n_rows, round(sum(amt) FILTER (WHERE Account LIKE '4%'), 2) AS total FROM j WHERE shell AND amt > 0 GROUP BY file, Period HAVING count(*) FILTER (WHERE Account LIKE '4%') > 0 AND count(*) FILTER (WHERE Account LIKE '5%' OR Account LIKE '6%') > 0",
    "channel_stuffing": "SELECT file, 'CHANNEL_STUFFING' AS type, 'HIGH' AS severity, Period AS subject, round(rev * 100 / av)::BIGINT AS n_rows, round(coalesce(nb, 0), 2) AS total FROM (SELECT *, avg(rev) OVER (PARTITION BY file) AS av, count(*) OVER (PARTITION BY file) AS n, lead(coalesce(back, 0)) OVER (PARTITION BY file ORDER BY Period) AS nb FROM (SELECT file, Period, sum(amt) FILTER (WHERE Account = '4000' AND amt > 0) AS rev, -sum(amt) FILTER (WHERE Account IN ('4010', '4100') AND amt < 0) AS back FROM j GROUP BY 1, 2) WHERE rev IS NOT NULL) WHERE n >= 4 AND substr(Period, 6) IN ('03', '06', '09', '12') AND rev / av > 1.5",
    "cookie_jar": "SELECT file, 'COOKIE_JAR_RESERVES' AS type, 'HIGH' AS severity, CASE WHEN bool_and(lower(Source) = 'manual') THEN 'all manual' ELSE '' END AS subject, count(*) FILTER (WHERE Account LIKE '6%' AND amt <> 0) AS n_rows, round(sum(amt) FILTER (WHERE Account LIKE '6%' AND amt > 0), 2) AS total FROM j WHERE Account IN ('2800', '6800') OR regexp_matches(d, 'reserve|provision|contingenc') GROUP BY file HAVING count(*) FILTER (WHERE Account LIKE '6%' AND amt > 0) > 0 AND count(*) FILTER (WHERE Account LIKE '6%' AND amt < 0) > 0",
    "capitalization": "SELECT file, 'CAPITALIZATION_ABUSE' AS type, 'CRITICAL' AS severity, '' AS subject, count(*) AS n_rows, round(sum(t), 2) AS total FROM (SELECT file, abs(amt) AS t FROM j WHERE regexp_matches(d, 'reclassif|capitaliz') AND Account IN ('1800', '1700', '1600') UNION ALL SELECT file, 0 FROM j WHERE Account LIKE '6%' AND amt < 0 AND d LIKE '%reclassif%') GROUP BY file",
    "related_party": "SELECT file, 'RELATED_PARTY' AS type, 'CRITICAL' AS severity, array_to_string(list_sort(list(DISTINCT Counterparty))[1:5], '; ') AS subject, count(*) AS n_rows, round(sum(amt), 2) AS total FROM j WHERE shell GROUP BY file",
}
_FLAGS = """SELECT file, Journal_ID AS journal_id, amt AS amount, list_filter([CASE WHEN amt = floor(amt) AND abs(amt) >= 1000 THEN 'ROUND_AMOUNT' END, CASE WHEN substr(Timestamp, 12, 2) < '07' OR substr(Timestamp, 12, 2) >= '21' THEN 'OFF_HOURS' END, CASE WHEN substr(Timestamp, 9, 2) >= '28' THEN 'PERIOD_END' END,
CASE WHEN Prepared_By <> '' AND Approved_By <> '' AND lower(trim(Prepared_By)) = lower(trim(Approved_By)) THEN 'SELF_APPROVED' END, CASE WHEN Override = 'Y' THEN 'CONTROL_OVERRIDE' END, CASE WHEN d LIKE '%miscoded%' THEN 'DESC_MISMATCH' END], lambda x: x IS NOT NULL) AS flags FROM j WHERE lower(Source) = 'manual'"""
_FRAUD["journal_entry"] = f"SELECT file, 'JOURNAL_ENTRY_FRAUD' AS type, CASE WHEN max(len(flags)) >= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, '' AS subject, count(*) AS n_rows, round(sum(amount), 2) AS total FROM ({_FLAGS}) WHERE len(flags) > 0 GROUP BY file"


def _journal(s: SparkSession, d: str) -> DataFrame:
    return _views(s, d, _JOURNAL)


for _name, _sql in _FRAUD.items():
    QUERIES[f"fraud_{_name}"] = lambda s, d, n=_name: checks.fraud(_journal(s, d), [n])
    SQL[f"fraud_{_name}"] = _J + _sql


@query(_J + f"SELECT file, journal_id, amount, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) >= 3 THEN 'CRITICAL' WHEN len(flags) = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM ({_FLAGS}) WHERE len(flags) > 0")
def fraud_journal_flags(s, d):
    return checks.journal_flags(_journal(s, d)).withColumn("flags", F.array_join("flags", ","))


@query(_J + f"SELECT file, count(*) AS n_findings, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 20 ELSE 10 END))::INT AS risk_score FROM ({' UNION ALL '.join('SELECT file, severity FROM (' + x + ')' for x in _FRAUD.values())}) GROUP BY file")
def fraud_risk(s, d):
    return checks.risk(checks.fraud(_journal(s, d)))


_TB = """SELECT concat('tb_', cast(c_nationkey AS varchar(10))) AS file, c_custkey AS row_index, cast(c_custkey AS varchar(20)) AS Account_ID, CASE WHEN c_custkey % 50 = 0 THEN 'CTA plug' ELSE c_name END AS Account_Name,
CASE c_custkey % 6 WHEN 0 THEN 'Asset' WHEN 1 THEN 'Liability' WHEN 2 THEN 'Equity' WHEN 3 THEN 'Revenue' WHEN 4 THEN 'Expense' ELSE 'Memo' END AS Account_Type,
CASE WHEN c_custkey % 10 < 7 THEN '' ELSE CASE c_nationkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'JPY' ELSE 'XXX' END END AS Functional_Currency, CASE WHEN c_custkey % 9 = 0 THEN 'USD' ELSE '' END AS Reporting_Currency,
CASE WHEN c_custkey % 41 = 0 THEN '' ELSE cast(cast(c_acctbal AS decimal(18,2)) AS varchar(30)) END AS Local_Balance,
CASE c_custkey % 8 WHEN 0 THEN '1.092' WHEN 1 THEN '1.0885' WHEN 2 THEN '1.085' WHEN 3 THEN '1.271' WHEN 4 THEN '149.5' WHEN 5 THEN '0.00665' WHEN 6 THEN '0.9158' ELSE 'n/a' END AS FX_Rate,
cast(cast(c_acctbal * CASE c_custkey % 8 WHEN 0 THEN 1.092 WHEN 1 THEN 1.0885 WHEN 2 THEN 1.2 WHEN 3 THEN 1.271 WHEN 4 THEN 149.5 WHEN 5 THEN 0.00665 ELSE 0.9158 END AS decimal(18,2)) AS varchar(30)) AS Translated_Balance FROM customer"""
_R = "(VALUES ('USD',1.0,1.0,1.01394),('EUR',1.0920,1.0850,1.03346),('GBP',1.2710,1.2650,1.23654),('JPY',0.00665,0.00680,0.00661)) AS r(c,cl,op,hi)"
_FX = f"""WITH tb AS ({_TB}), r AS (SELECT c, cl::DOUBLE AS cl, op::DOUBLE AS op, hi::DOUBLE AS hi, round((cl::DOUBLE + op::DOUBLE) / 2, 5) AS av FROM {_R}),
f AS (SELECT *, last_value(nullif(Functional_Currency, '') IGNORE NULLS) OVER w AS fc, last_value(nullif(Reporting_Currency, '') IGNORE NULLS) OVER w AS rc FROM tb WINDOW w AS (PARTITION BY file ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT f.file, f.Account_ID AS account, f.Account_Name LIKE '%CTA%' AS plug, TRY_CAST(Local_Balance AS DOUBLE) AS loc, TRY_CAST(Translated_Balance AS DOUBLE) AS tr, TRY_CAST(FX_Rate AS DOUBLE) AS x, CASE Account_Type WHEN 'Asset' THEN 'closing' WHEN 'Liability' THEN 'closing' WHEN 'Equity' THEN 'historical' ELSE 'average' END AS e,
 a.cl / b.cl AS cl, a.op / b.op AS op, a.av / b.av AS av, a.hi / b.hi AS hi FROM f LEFT JOIN r a ON a.c = fc LEFT JOIN r b ON b.c = rc WHERE TRY_CAST(Local_Balance AS DOUBLE) IS NOT NULL AND TRY_CAST(Translated_Balance AS DOUBLE) IS NOT NULL),
g AS (SELECT *, coalesce(loc <> 0 AND (abs(x * cl - 1) < 0.05 OR abs(x * op - 1) < 0.05 OR abs(x * av - 1) < 0.05), false) AS turned, least(abs(x - cl) / cl, abs(x - op) / op, abs(x - av) / av, abs(x - hi) / hi) AS dif FROM n),
h AS (SELECT *, CASE WHEN dif >= 0.02 OR dif IS NULL THEN NULL WHEN abs(x - cl) / cl = dif THEN 'closing' WHEN abs(x - op) / op = dif THEN 'opening' WHEN abs(x - av) / av = dif THEN 'average' ELSE 'historical' END AS p FROM g),
k AS (SELECT *, NOT turned AND p IS NOT NULL AND p <> e AND p <> 'historical' AS mism, p = 'opening' AND e IN ('closing', 'average') AS st FROM h)
SELECT file, 'INVERTED_RATE' AS type, 'CRITICAL' AS severity, account FROM k WHERE NOT plug AND turned
UNION ALL SELECT file, 'STALE_RATE', 'MEDIUM', account FROM k WHERE NOT plug AND mism AND st UNION ALL SELECT file, 'WRONG_RATE_TYPE', 'HIGH', account FROM k WHERE NOT plug AND mism AND NOT st
UNION ALL SELECT file, 'TRANSLATION_MATH_ERROR', 'HIGH', account FROM k WHERE NOT plug AND x IS NOT NULL AND loc <> 0 AND tr <> 0 AND abs(loc * x - tr) / abs(tr) > 0.01
UNION ALL SELECT file, 'CTA_MISCALCULATION', 'HIGH', '' FROM k GROUP BY file HAVING abs(sum(tr)) > 1"""


@query(_FX)
def fx_findings(s, d):
    return checks.fx(_views(s, d, _TB))


@query(f"SELECT file, count(*) AS n_findings, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 15 ELSE 5 END))::INT AS risk_score FROM ({_FX}) GROUP BY file")
def fx_risk(s, d):
    return checks.risk(checks.fx(_views(s, d, _TB)), checks.FX_WEIGHTS)


_CHART = """SELECT concat('chart_', cast(p_size AS varchar(10))) AS file, CASE p_size % 3 WHEN 0 THEN 'IFRS' WHEN 1 THEN 'US_GAAP' ELSE 'DUAL' END AS standard, cast(p_partkey AS varchar(20)) AS Account_ID,
CASE p_partkey % 11 WHEN 0 THEN 'Inventory - LIFO Reserve' WHEN 1 THEN 'Revaluation Surplus' WHEN 2 THEN 'Capitalized development costs' WHEN 3 THEN 'Operating Lease Expense' WHEN 4 THEN 'Additional Paid-in Capital' WHEN 5 THEN 'Treasury Stock' WHEN 6 THEN 'Share Premium' WHEN 7 THEN 'Investment Property' WHEN 8 THEN 'R&D Expense' ELSE p_name END AS Account_Name,
CASE p_partkey % 4 WHEN 0 THEN 'Expense' ELSE 'Asset' END AS Account_Type, CASE p_partkey % 5 WHEN 0 THEN 'IAS 17' WHEN 1 THEN 'ASC 842' WHEN 2 THEN 'SFAS 13' ELSE '' END AS Standard_Reference,
cast(cast(p_retailprice AS decimal(18,2)) AS varchar(30)) AS GAAP_Balance, '50.00' AS IFRS_Adjustment, cast(cast(p_retailprice + CASE WHEN p_partkey % 6 = 0 THEN 100 ELSE 50 END AS decimal(18,2)) AS varchar(30)) AS IFRS_Balance FROM part"""


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_STD = "WITH c AS (" + _CHART + "), f AS (" + " UNION ALL ".join(
    f"SELECT file, standard, '{ty}' AS type, '{sv}' AS severity, Account_ID AS account, '{rf}' AS reference FROM c WHERE regexp_matches({fd}, '{_re2(pt)}')" + (f" AND standard = '{st}'" if st != "*" else "") + (" AND Account_Type = 'Expense'" if ty == "STANDARD_OPPORTUNITY" else "")
    for st, fd, pt, ty, sv, rf in checks.STANDARD_RULES
) + """ UNION ALL SELECT file, standard, 'RECONCILIATION_ERROR', 'CRITICAL', Account_ID, '' FROM c WHERE standard = 'DUAL' AND abs(round(GAAP_Balance::DOUBLE + IFRS_Adjustment::DOUBLE, 2) - IFRS_Balance::DOUBLE) > 0.01),
m AS (SELECT *, max(type IN ('STANDARD_VIOLATION', 'STANDARD_MISCLASSIFICATION')) OVER (PARTITION BY file, account) AS v, max(type = 'STANDARD_MISCLASSIFICATION') OVER (PARTITION BY file, account) AS mc FROM f)
SELECT file, standard, type, severity, account, reference FROM m WHERE NOT (type IN ('WRONG_STANDARD_REF', 'TERMINOLOGY_MISMATCH') AND v) AND NOT (type = 'STANDARD_VIOLATION' AND mc)"""  # fmt: skip


@query(_STD)
def standards_findings(s, d):
    return checks.standards(_views(s, d, _CHART))


@query(f"SELECT c.file, coalesce(n, 0) AS n_findings, greatest(0, 100 - coalesce(p, 0))::INT AS compliance_score FROM (SELECT DISTINCT file FROM ({_CHART})) c LEFT JOIN (SELECT file, count(*) AS n, sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 2 END) AS p FROM ({_STD}) GROUP BY file) x ON c.file = x.file")
def standards_score(s, d):
    c = _views(s, d, _CHART)
    return checks.compliance(checks.standards(c), c)


def _heads(s: SparkSession, d: str) -> DataFrame:
    lines = _t(s, d, "raw_feed_lines").where("raw_line is not null").groupBy("file_name", "line_no").agg(F.max_by("raw_line", "delivered_at").alias("line"))
    return readers.file_heads(lines.select(F.col("file_name").alias("file"), (F.col("line_no") - 1).cast("long").alias("row_index"), "line"))


@query()
def erp_scores(s, d):
    return checks.source_systems(_heads(s, d))


@query()
def erp_systems(s, d):
    return checks.source_system(checks.source_systems(_heads(s, d)))


# ---- detection ---------------------------------------------------------------

_ROWS = """SELECT severity AS file, cast(row_number() OVER (PARTITION BY severity ORDER BY finding_id, loaded_at, op, row_index, account) - 1 AS bigint) AS row_index, coalesce(account, '') AS Account, coalesce(field, '') AS Account_Type, coalesce(matched_value, '') AS Account_Name,
coalesce(cast(row_index AS varchar(20)), '') AS Amount, coalesce(substr(ts_text, 1, 7), '') AS Period, coalesce(evidence, '') AS Balance FROM grounded_findings"""
_COLS = ["Account", "Account_Type", "Account_Name", "Amount", "Period", "Balance"]
_SCAN = f"""WITH q AS ({_ROWS}), rl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY loaded_at DESC) AS rn FROM detection_rules WHERE rule_id IS NOT NULL) WHERE rn = 1 AND trim(pattern) <> ''),
tg AS (SELECT rule_id, finding_type, pattern, coalesce(confidence, 0.9) AS confidence, CASE WHEN len(list_filter(field_targets, lambda x: trim(x) <> '')) > 0 THEN list_transform(list_filter(field_targets, lambda x: trim(x) <> ''), lambda x: trim(x)) ELSE {_COLS!r} END AS ts FROM rl),
un AS (SELECT rule_id, finding_type, pattern, confidence, unnest(ts) AS f, generate_subscripts(ts, 1) AS i FROM tg),
cells AS (SELECT file, row_index, 'Account' AS f, Account AS v FROM q UNION ALL SELECT file, row_index, 'Account_Type', Account_Type FROM q UNION ALL SELECT file, row_index, 'Account_Name', Account_Name FROM q UNION ALL SELECT file, row_index, 'Amount', Amount FROM q UNION ALL SELECT file, row_index, 'Period', Period FROM q UNION ALL SELECT file, row_index, 'Balance', Balance FROM q)
SELECT file, row_index, rule_id, finding_type, arg_min(cells.f, i) AS field, max(confidence) AS confidence FROM un JOIN cells ON lower(un.f) = lower(cells.f) AND regexp_matches(cells.v, un.pattern) WHERE file IS NOT NULL GROUP BY 1, 2, 3, 4"""


def _scanned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list]:
    rows = _views(s, d, _ROWS).where("file is not null")
    rules = detection.rules_from(_t(s, d, "detection_rules"))
    return rows, detection.scan(rows, rules, _COLS), rules


@query(_SCAN)
def detect_scan(s, d):
    return _scanned(s, d)[1].select("file", "row_index", "rule_id", "finding_type", "field", "confidence")


_SPRT = """WITH e AS (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_index, value > 250 AS hit FROM events),
l AS (SELECT *, sum(CASE WHEN hit THEN ln(10.0) ELSE ln(0.99 / 0.999) END) OVER w AS llr, count(*) OVER w AS seen FROM e WINDOW w AS (PARTITION BY file ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT file, count(*) AS n, min(seen) FILTER (WHERE seen >= 100 AND llr >= ln(0.95 / 0.05)) AS u, min(seen) FILTER (WHERE seen >= 100 AND llr <= ln(0.05 / 0.95)) AS c, arg_max(llr, row_index) AS z FROM l GROUP BY file)
SELECT m.file, CASE WHEN c IS NOT NULL AND (u IS NULL OR c < u) THEN 'clean' WHEN u IS NOT NULL THEN 'anomalous' ELSE 'undecided' END AS decision, CASE WHEN c IS NOT NULL AND (u IS NULL OR c < u) THEN c ELSE n END AS rows_scanned, n AS total_rows,
round(CASE WHEN c IS NOT NULL AND (u IS NULL OR c < u) THEN (SELECT llr FROM l WHERE l.file = m.file AND l.seen = m.c) ELSE z END, 4) AS log_likelihood_ratio FROM m"""
_EVENTS = "SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_index, value > 250 AS hit FROM events"


@query(_SPRT)
def detect_certificates(s, d):
    return detection.certificates(detection.sequential_test(_views(s, d, _EVENTS)))


@query(f"""WITH f AS ({_SCAN}), n AS (SELECT file, row_index, count(*) AS n FROM f GROUP BY 1, 2), q AS (SELECT file, row_index FROM ({_ROWS}) WHERE file IS NOT NULL),
l AS (SELECT q.file, q.row_index, coalesce(n, 0) AS n, sum(CASE WHEN n IS NOT NULL THEN ln(10.0) ELSE ln(0.99 / 0.999) END) OVER w AS llr, count(*) OVER w AS seen, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY q.file ORDER BY q.row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q LEFT JOIN n ON q.file = n.file AND q.row_index = n.row_index WINDOW w AS (PARTITION BY q.file ORDER BY q.row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT file, min(seen) FILTER (WHERE seen >= 100 AND llr >= ln(19.0)) AS u, min(seen) FILTER (WHERE seen >= 100 AND llr <= ln(0.05 / 0.95)) AS c FROM l GROUP BY file)
SELECT f.file, f.row_index, f.rule_id, f.field FROM f JOIN l ON f.file = l.file AND f.row_index = l.row_index JOIN c ON c.file = f.file WHERE b < 500 AND NOT (c.c IS NOT NULL AND (c.u IS NULL OR c.c < c.u) AND l.seen > c.c)""")
def detect_limits(s, d):
    rows, found, _ = _scanned(s, d)
    return detection.within_limits(rows, found).select("file", "row_index", "rule_id", "field")


@query("SELECT rule_id, finding_type, count(*) AS n, count(*) FILTER (WHERE action = 'confirmed') AS confirmed, count(*) FILTER (WHERE action = 'dismissed') AS dismissed FROM feedback_records WHERE trim(rule_id) <> '' GROUP BY 1, 2")
def detect_tallies(s, d):
    return detection.feedback_tallies(_t(s, d, "feedback_records"))


@query("""WITH t AS (SELECT rule_id, finding_type, count(*) FILTER (WHERE action = 'confirmed') AS c, count(*) FILTER (WHERE action = 'dismissed') AS x FROM feedback_records WHERE trim(rule_id) <> '' GROUP BY 1, 2)
SELECT g.finding_id, g.rule_id, g.loaded_at, g.op, CASE WHEN t.rule_id IS NULL THEN g.confidence ELSE round(least(1.0, greatest(0.05, g.confidence + CASE WHEN c - x >= 0 THEN (c - x) * 0.05 ELSE (c - x) * 0.08 END)), 4) END AS confidence
FROM grounded_findings g LEFT JOIN t ON g.rule_id = t.rule_id AND g.finding_type = t.finding_type WHERE NOT coalesce(x > 3 AND c = 0, false)""")
def detect_feedback_threshold(s, d):
    f = _t(s, d, "grounded_findings")
    return detection.apply_feedback(f, detection.feedback_tallies(_t(s, d, "feedback_records"))).select("finding_id", "rule_id", "loaded_at", "op", "confidence")


@query()
def detect_feedback_thompson(s, d):
    return detection.apply_feedback(_t(s, d, "grounded_findings"), detection.feedback_tallies(_t(s, d, "feedback_records")), "thompson", 0.1, 7)


@query("""WITH t AS (SELECT rule_id, finding_type, count(*) AS n, count(*) FILTER (WHERE action = 'confirmed') AS c, count(*) FILTER (WHERE action = 'dismissed') AS x FROM feedback_records WHERE trim(rule_id) <> '' GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS n, sum(c)::BIGINT AS confirmed, sum(x)::BIGINT AS dismissed, count(*) AS patterns, count(*) FILTER (WHERE x > 3 AND c = 0) AS suppressed_patterns, count(*) FILTER (WHERE NOT (x > 3 AND c = 0)) AS active_patterns, round(sum(c) / sum(n), 4) AS confirmation_rate FROM t""")
def detect_feedback_stats(s, d):
    return detection.feedback_stats(_t(s, d, "feedback_records"))


@query("""SELECT 'contradiction' AS monitor, account, field, count(*) AS n FROM grounded_findings GROUP BY account, field HAVING bool_or(finding_type = 'missing_account') AND bool_or(finding_type = 'duplicate_account')
UNION ALL SELECT 'confidence_bounds', NULL, NULL, count(*) FROM grounded_findings WHERE confidence < 0 OR confidence > 1 HAVING count(*) > 0
UNION ALL SELECT 'missing_rule', NULL, NULL, count(*) FROM grounded_findings WHERE coalesce(rule_id, '') = '' HAVING count(*) > 0
UNION ALL SELECT 'duplicate', rule_id, field, count(*) - 1 FROM grounded_findings GROUP BY row_index, rule_id, field HAVING count(*) > 1""")
def detect_monitors(s, d):
    return detection.monitors(_t(s, d, "grounded_findings"))


@query("""WITH l AS (SELECT event_type AS file, event_id AS row_index, 'amount' AS field, value FROM events WHERE value <> 0 UNION ALL SELECT event_type, event_id, 'fx_rate', value / 100 FROM events WHERE value <> 0),
r AS (SELECT file, field, abs(value) AS x, row_number() OVER (PARTITION BY file, field ORDER BY abs(value)) - 1 AS k, count(*) OVER (PARTITION BY file, field) AS n FROM l), m AS (SELECT file, field, x AS med FROM r WHERE n >= 3 AND k = n // 2)
SELECT l.file, l.row_index, l.field, l.value, abs(value) / med AS ratio, CASE WHEN abs(value) / med > 10 AND abs(value) * med > 0.5 AND abs(value) * med < 2 THEN 'sign_reversal' ELSE 'balance_mismatch' END AS finding_type, CASE WHEN abs(value) / med > 10 THEN 'critical' ELSE 'high' END AS severity,
CASE WHEN abs(value) / med > 10 AND abs(value) * med > 0.5 AND abs(value) * med < 2 THEN 0.95::DOUBLE WHEN abs(value) / med > 10 THEN 0.85 ELSE 0.75 END AS confidence FROM l JOIN m ON l.file = m.file AND l.field = m.field WHERE abs(value) / med > 10 OR (abs(value) / med < 0.1 AND l.field = 'fx_rate')""")
def detect_outliers(s, d):
    e = _t(s, d, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("row_index"), F.col("value").alias("amount"), (F.col("value") / 100).alias("fx_rate"))
    return detection.numeric_outliers(e)


_CAND = """SELECT 'all' AS file, row_index, rule_id, finding_type, severity, field, matched_value, account, confidence, cast(row_number() OVER (PARTITION BY row_index ORDER BY finding_id, loaded_at, op, rule_id) AS bigint) AS candidate FROM grounded_findings WHERE row_index IS NOT NULL AND rule_id IS NOT NULL AND field IS NOT NULL AND matched_value IS NOT NULL"""
_TRI = f"""WITH c AS ({_CAND}), e AS (SELECT *, (severity = 'info' AND lower(field) NOT IN ('amount', 'balance')) OR (finding_type = 'custom' AND length(matched_value) <= 20 AND lower(field) IN ('account_name', 'description', 'name')) AS early FROM c),
f AS (SELECT row_index, arg_min(rule_id, candidate) FILTER (WHERE NOT coalesce(early, false)) AS first FROM e GROUP BY 1)
SELECT e.row_index, e.candidate, e.rule_id, CASE WHEN early THEN 'dismiss' WHEN e.rule_id <> first THEN 'dismiss' WHEN severity IN ('critical', 'high') AND lower(field) IN ('amount', 'balance') THEN 'escalate' ELSE 'keep' END AS decision FROM e JOIN f ON e.row_index = f.row_index"""


@query(_TRI)
def detect_triage(s, d):
    return detection.triage(_views(s, d, _CAND), ["Amount", "Balance", "Account_Name"]).select("row_index", "candidate", "rule_id", "decision")


@query()
def detect_and_verify(s, d):
    rows, _, rules = _scanned(s, d)
    return detection.detect_and_verify(rows, rules, _COLS, _t(s, d, "feedback_records"))


# ---- linking -----------------------------------------------------------------


def _mentions(s: SparkSession, d: str) -> DataFrame:
    r = _t(s, d, "detection_rules").groupBy("rule_id").agg(F.max_by(F.struct("*"), "loaded_at").alias("r")).select("r.*")
    return r.select(F.col("rule_id").alias("mention_id"), F.col("kb_source_file").alias("file_path"), F.lit("Report").alias("archetype"), F.col("name").alias("raw_name"), linking.normalized_name(F.col("name")).alias("normalized_name"), F.col("pattern").alias("formula"), F.col("description").alias("business_meaning"), F.col("rule_id").alias("pos"))


@query("SELECT rule_id, loaded_at, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS normalized_name FROM detection_rules")
def link_names(s, d):
    return _t(s, d, "detection_rules").select("rule_id", "loaded_at", linking.normalized_name(F.col("name")).alias("normalized_name"))


@query()
def link_pairs(s, d):
    return linking.link_pairs(linking.capped_mentions(_mentions(s, d)))


@query()
def link_clusters(s, d):
    m = _mentions(s, d)
    return linking.clusters(m, linking.link_pairs(m, 0.85)).drop("label")


@query()
def link_search(s, d):
    m = _mentions(s, d)
    links = cut(linking.link_pairs(m, 0.85))
    return linking.find_entity(linking.clusters(m, links), linking.cluster_members(m, links), "duplicate account check", 5).drop("label")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT mention_a_id AS a, mention_b_id AS b FROM entity_links UNION ALL SELECT mention_b_id, mention_a_id FROM entity_links) WHERE a <> b AND a IS NOT NULL AND b IS NOT NULL),
reach(x, y) USING KEY (x) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION SELECT e.a, min(r.y) FROM reach r JOIN e ON r.x = e.b JOIN recurring.reach c ON c.x = e.a WHERE r.y < c.y GROUP BY e.a) SELECT x AS vertex, y AS label FROM reach""")
def link_components(s, d):
    return graph.star_components(_t(s, d, "entity_links").select(F.col("mention_a_id").alias("u"), F.col("mention_b_id").alias("v")))


# ---- hierarchies of templates ---------------------------------------------------


@query("SELECT template_id, count(*) AS n_nodes, count(*) FILTER (WHERE is_calculated) AS n_calculated, max(level)::INT AS deepest FROM template_hierarchy GROUP BY 1")
def template_index(s, d):
    return _t(s, d, "template_hierarchy").groupBy("template_id").agg(F.count("*").alias("n_nodes"), F.count_if("is_calculated").alias("n_calculated"), F.max("level").alias("deepest"))


@query()
def template_recommend(s, d):
    ix = template_index(s, d)
    cat = F.when(F.col("n_calculated") > 3, "income_statement").otherwise("balance_sheet")
    return templates.recommend(ix.select(F.col("template_id").alias("id"), F.col("template_id").alias("name"), cat.alias("category"), F.when(F.col("deepest") > 7, "manufacturing").otherwise("general").alias("industry"), F.col("n_nodes").alias("hierarchy_count")), "manufacturing", "pl")


# ---- texts, files ----------------------------------------------------------------


@query()
def ingest_text_tables(s, d):
    return readers.parse_tables(_t(s, d, "documents"), "doc_id", "text", "auto")


def _files(s: SparkSession, d: str) -> DataFrame:
    """What a scan would tell of the delivered files, taken as workbooks of one sheet."""
    g = _t(s, d, "raw_feed_lines").groupBy("feed_id", "file_name").agg(F.count("*").alias("total_row_count"), F.sum(F.length("raw_line")).alias("file_size_bytes"))
    sheet = F.struct(F.col("feed_id").alias("name"), F.col("total_row_count").cast("int").alias("row_count"), F.lit(1).alias("col_count"), F.lit(0).alias("formula_count"), F.lit(1).alias("anchor_row"), F.lit(1).alias("anchor_col"), F.lit(False).alias("has_pivot_table"), F.lit(False).alias("is_empty"))
    return g.select(
        "file_name", "file_size_bytes", "total_row_count", F.when(F.col("file_name").endswith(".txt"), "skipped").otherwise("ok").alias("scan_status"), F.lit(1).alias("sheet_count"), F.array("feed_id").alias("sheet_names"), F.array(sheet).alias("sheets"), F.lit(0).cast("long").alias("formula_count"), F.lit(0).alias("named_range_count"),
        *[F.lit(False).alias(c) for c in ("has_macros", "has_pivot_tables", "has_sumif_pattern", "has_vlookup_pattern", "has_if_chain")], F.array().cast("array<string>").alias("dominant_formula_functions"),
    )


@query("""SELECT CASE WHEN skipped THEN 'Unknown' WHEN n > 500 THEN 'Data Extract' WHEN n > 10 THEN 'Reference Data' ELSE 'Academic/Exercise' END AS archetype, count(*) AS n_files
FROM (SELECT file_name, count(*) AS n, file_name LIKE '%.txt' AS skipped FROM raw_feed_lines GROUP BY feed_id, file_name) GROUP BY 1""")
def triage_archetypes(s, d):
    return workbooks.archetype_counts(workbooks.classify(_files(s, d)))


@query("""SELECT count(*) AS total_files, count(*) FILTER (WHERE NOT skipped) AS scanned, 0::BIGINT AS errors, count(*) FILTER (WHERE skipped) AS skipped, count(*) AS total_sheets, 0::BIGINT AS total_formulas, sum(n)::BIGINT AS total_rows, 0::BIGINT AS files_with_macros, 0::BIGINT AS files_with_pivots,
min(z)::BIGINT AS min_file_size, max(z)::BIGINT AS max_file_size, avg(z)::DOUBLE AS avg_file_size, median(z)::DOUBLE AS median_file_size FROM (SELECT count(*) AS n, sum(length(raw_line)) AS z, file_name LIKE '%.txt' AS skipped FROM raw_feed_lines GROUP BY feed_id, file_name)""")
def triage_summary(s, d):
    return workbooks.triage_summary(_files(s, d))


# ---- SQL ---------------------------------------------------------------------------

both("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("sql_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
both("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("sql_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
both("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
both("sql_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
both("sql_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
both("sql_rank", "SELECT o_custkey, o_orderkey, rnk FROM (SELECT o_custkey, o_orderkey, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rnk FROM orders) x WHERE rnk <= 3")
both("sql_lag", "SELECT o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS delta FROM orders")
both("sql_frame", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s4 FROM events")
both("sql_case_agg", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS open_qty, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS done_qty FROM lineitem GROUP BY l_returnflag")
both("sql_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("sql_lateral", "SELECT n_name, x.top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey) x")
both("sql_asof", "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) x", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) x")
both("sql_json", "SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k FROM events", "SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k FROM events")
both("sql_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")
both("sql_unpivot", "SELECT p_partkey, what, v FROM part UNPIVOT (v FOR what IN (p_brand AS brand, p_type AS kind))", "SELECT p_partkey, 'brand' AS what, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'kind', p_type FROM part")

# ---- windows over time ---------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    return incremental.windowed(_t(s, d, "events"), "ts", ["event_type"], "1 hour", value="value").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) - to_hours(o) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1, 2")
def stream_sliding(s, d):
    return incremental.windowed(_t(s, d, "events"), "ts", ["event_type"], "2 hours", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(s, d):
    x = incremental.sessions(_t(s, d, "events"), "ts", ["user_id"], "30 minutes")
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT DISTINCT feedback_id, action FROM feedback_records")
def stream_dedup(s, d):
    return incremental.first_deliveries(_t(s, d, "feedback_records").select("feedback_id", "action", "loaded_at"), "loaded_at", ["feedback_id", "action"]).select("feedback_id", "action")
