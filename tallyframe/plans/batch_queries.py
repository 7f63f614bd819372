"""Queries of roll-ups, summaries, sources, sinks and fixtures, with SQL for the
same results.  Sources and sinks are run as round trips: a table is written to
the shared folder in the format in question, read back, and compared with the
table it came from."""

from __future__ import annotations

import difflib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import sql as tsql
from tallyframe.functions import similarity as sim
from tallyframe.operators import checks, cleaning, detection, fuzzy, history, hierarchy, knowledge, linking, profiling, reconcile, summaries, templates
from tallyframe.plans import reference_queries as rq
from tallyframe.session import checkpoint_dir
from tallyframe.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_t = rq._t


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(s: SparkSession) -> str:
    """A new path in the shared folder; the application's tables go when it ends."""
    return f"{checkpoint_dir(s).rstrip('/')}/tallyframe-{s.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return f"{x!r}::{'DOUBLE' if isinstance(x, float) else 'BIGINT'}"
    return "'" + str(x).replace("'", "''") + "'"


def _values(names: Sequence[str], rows: Sequence[tuple]) -> str:
    """SQL of a fixed table."""
    return " UNION ALL ".join("SELECT " + ", ".join(f"{_literal(v)} AS {n}" for n, v in zip(names, r, strict=True)) for r in rows)


# ---- roll-ups over many files ----------------------------------------------------

_FOUND = rq._J + ", f AS (" + " UNION ALL ".join(f"SELECT file, type, severity FROM ({q})" for q in rq._FRAUD.values()) + ")"
_COUNTS = "SELECT 'type' AS dimension, type AS value, count(*) AS n_findings, count(DISTINCT file) AS n_files FROM f GROUP BY type UNION ALL SELECT 'severity', severity, count(*), count(DISTINCT file) FROM f GROUP BY severity"


def _fraud(s: SparkSession, d: str) -> DataFrame:
    return checks.fraud(rq._journal(s, d))


@query(_FOUND + " " + _COUNTS)
def fraud_batch_counts(s, d):
    return summaries.counts_by(_fraud(s, d))


@query(_FOUND + " SELECT (SELECT count(DISTINCT file) FROM j) AS total_files, count(DISTINCT file) AS files_with_issues, count(*) AS total_findings, round(count(*) / (SELECT count(DISTINCT file) FROM j), 1) AS avg_findings_per_file FROM f")
def fraud_batch_totals(s, d):
    return summaries.batch_totals(rq._journal(s, d), _fraud(s, d))


@query(_FOUND + " SELECT * FROM (SELECT file, count(*) AS n_findings, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 20 ELSE 10 END))::INT AS risk_score FROM f GROUP BY file) WHERE risk_score >= 50 ORDER BY file LIMIT 10")
def fraud_high_risk(s, d):
    return summaries.high_risk_files(checks.risk(_fraud(s, d)))


@query(rq._J + f"SELECT file, flag, count(*) AS n FROM (SELECT file, unnest(flags) AS flag FROM ({rq._FLAGS})) GROUP BY file, flag")
def fraud_flag_distribution(s, d):
    return checks.flag_distribution(checks.journal_flags(rq._journal(s, d)))


@query(rq._J + """, m AS (SELECT file, Journal_ID, Account, amt FROM j WHERE (regexp_matches(lower(Description), 'reclassif|capitaliz') AND Account IN ('1800', '1700', '1600')) OR (Account LIKE '6%' AND amt < 0 AND lower(Description) LIKE '%reclassif%'))
SELECT file, array_to_string(list(Journal_ID ORDER BY Journal_ID, Account, amt)[1:5], ',') AS entries FROM (SELECT DISTINCT * FROM m) GROUP BY file""")
def fraud_first_reclassifications(s, d):
    return checks.capitalization_entries(rq._journal(s, d)).select("file", F.array_join("entries", ",").alias("entries"))


@query(rq._J + "SELECT file, coalesce(bool_and(upper(Approved_By) IN ('CFO', 'CEO')) FILTER (WHERE Approved_By <> ''), true) AS all_exec_approved FROM j WHERE shell GROUP BY file")
def fraud_executive_approvals(s, d):
    return checks.related_party_approvals(rq._journal(s, d)).select("file", "all_exec_approved")


@query(f"WITH f AS (SELECT * FROM ({rq._FX})) {_COUNTS}")
def fx_batch_counts(s, d):
    return summaries.counts_by(checks.fx(rq._views(s, d, rq._TB)))


@query(f"WITH f AS (SELECT * FROM ({rq._FX})), t AS (SELECT DISTINCT file FROM ({rq._TB})) SELECT (SELECT count(*) FROM t) AS total_files, count(DISTINCT file) AS files_with_issues, count(*) AS total_findings, round(count(*) / (SELECT count(*) FROM t), 1) AS avg_findings_per_file FROM f")
def fx_batch_totals(s, d):
    tb = rq._views(s, d, rq._TB)
    return summaries.batch_totals(tb, checks.fx(tb))


@query(f"SELECT file, count(*) AS n_findings, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 15 ELSE 5 END))::INT AS risk_score FROM ({rq._FX}) GROUP BY file ORDER BY file LIMIT 10")
def fx_problem_files(s, d):
    return summaries.problem_files(checks.risk(checks.fx(rq._views(s, d, rq._TB)), checks.FX_WEIGHTS))


@query(f"WITH f AS (SELECT * FROM ({rq._STD})) SELECT 'type' AS dimension, type AS value, count(*) AS n_findings, count(DISTINCT file) AS n_files FROM f GROUP BY type UNION ALL SELECT 'standard', standard, count(*), count(DISTINCT file) FROM f GROUP BY standard")
def standards_batch_counts(s, d):
    return summaries.counts_by(checks.standards(rq._views(s, d, rq._CHART)), ("type", "standard"))


@query(f"""WITH f AS (SELECT file, count(*) AS n, sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 2 END) AS p FROM ({rq._STD}) GROUP BY file),
c AS (SELECT file, min(standard) AS standard FROM ({rq._CHART}) GROUP BY file), s AS (SELECT c.file, standard, coalesce(n, 0) AS n, greatest(0, 100 - coalesce(p, 0)) AS score FROM c LEFT JOIN f ON c.file = f.file),
b AS (SELECT *, standard AS k FROM s UNION ALL SELECT *, 'ALL' FROM s)
SELECT k AS standard, count(*) AS total_files, count(*) FILTER (WHERE n > 0) AS non_compliant_files, sum(n)::BIGINT AS total_findings, round(avg(score), 1) AS avg_compliance_score FROM b GROUP BY k""")
def standards_batch_totals(s, d):
    c = rq._views(s, d, rq._CHART)
    return summaries.standards_totals(checks.compliance(checks.standards(c), c), c)


#: Exports of five source systems and of none, one file for each nation: header and a few lines.
_HEADS = {"SAP": "\t", "Oracle": ",", "NetSuite": ",", "Dynamics365": ",", "Workday": ",", "UNKNOWN": "|"}


def _exports(s: SparkSession, d: str) -> DataFrame:
    systems = list(_HEADS)
    head = F.coalesce(*[F.when(F.col("n_nationkey") % 6 == i, _HEADS[k].join(checks.SYSTEMS[k]["columns"] if k in checks.SYSTEMS else ("color", "shape", "weight"))) for i, k in enumerate(systems)])
    body = F.coalesce(*[F.when(F.col("n_nationkey") % 6 == i, _HEADS[k].join(["red"] * (len(checks.SYSTEMS[k]["columns"]) if k in checks.SYSTEMS else 3))) for i, k in enumerate(systems)])
    lines = F.array(head, body, body)
    return readers.file_heads(_t(s, d, "nation").select(F.lower("n_name").alias("file"), F.posexplode(lines).alias("row_index", "line")).withColumn("row_index", F.col("row_index").cast("long")))


@query("SELECT lower(n_name) AS file, CASE n_nationkey % 6 WHEN 0 THEN 'SAP' WHEN 1 THEN 'Oracle' WHEN 2 THEN 'NetSuite' WHEN 3 THEN 'Dynamics365' WHEN 4 THEN 'Workday' ELSE 'UNKNOWN' END AS system FROM nation")
def erp_known_exports(s, d):
    return checks.source_system(checks.source_systems(_exports(s, d))).select("file", "system")


@query("SELECT CASE n_nationkey % 6 WHEN 0 THEN 'SAP' WHEN 1 THEN 'Oracle' WHEN 2 THEN 'NetSuite' WHEN 3 THEN 'Dynamics365' WHEN 4 THEN 'Workday' ELSE 'UNKNOWN' END AS system, count(*) AS n_files FROM nation GROUP BY 1")
def erp_batch(s, d):
    return summaries.system_distribution(checks.source_system(checks.source_systems(_exports(s, d)))).select("system", "n_files")


# ---- detection and linking summaries -----------------------------------------------


def _scan(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, found, _ = rq._scanned(s, d)
    return rows, found


@query(f"""WITH f AS (SELECT * FROM ({rq._SCAN})), r AS (SELECT file, count(*) AS total_rows FROM ({rq._ROWS}) WHERE file IS NOT NULL GROUP BY file)
SELECT r.file, total_rows, count(f.rule_id) AS total_findings, coalesce(round(avg(f.confidence), 4), 0) AS avg_confidence, count(DISTINCT f.rule_id) AS n_rules FROM r LEFT JOIN f ON r.file = f.file GROUP BY r.file, total_rows""")
def detect_file_summary(s, d):
    rows, found = _scan(s, d)
    return summaries.detection_summary(found, rows)


@query(f"""WITH f AS (SELECT * FROM ({rq._SCAN})), r AS (SELECT file, count(*) AS total_rows FROM ({rq._ROWS}) WHERE file IS NOT NULL GROUP BY file), x AS (SELECT r.file, total_rows, count(f.rule_id) AS n, coalesce(round(avg(f.confidence), 4), 0) AS c FROM r LEFT JOIN f ON r.file = f.file GROUP BY r.file, total_rows)
SELECT count(*) AS total_files, sum(total_rows)::BIGINT AS total_rows, sum(n)::BIGINT AS total_findings, round(sum(c * n) / greatest(sum(n), 1), 4) AS avg_confidence FROM x""")
def detect_batch_totals(s, d):
    rows, found = _scan(s, d)
    return summaries.detection_totals(summaries.detection_summary(found, rows))


@query(f"WITH f AS (SELECT * FROM ({rq._SCAN})) SELECT 'finding_type' AS dimension, finding_type AS value, count(*) AS n_findings, count(DISTINCT file) AS n_files FROM f GROUP BY finding_type UNION ALL SELECT 'field', field, count(*), count(DISTINCT file) FROM f GROUP BY field")
def detect_batch_counts(s, d):
    return summaries.counts_by(_scan(s, d)[1], ("finding_type", "field"))


@query("""WITH t AS (SELECT rule_id, finding_type, count(*) AS n, count(*) FILTER (WHERE action = 'confirmed') AS c, count(*) FILTER (WHERE action = 'dismissed') AS x FROM feedback_records WHERE trim(rule_id) <> '' GROUP BY 1, 2)
SELECT rule_id, finding_type, n, c AS confirmed, x AS dismissed, c - x AS net_score, x > 3 AND c = 0 AS suppressed, c + 1 AS alpha, x + 1 AS beta, round((c + 1) / (c + x + 2), 4) AS expected_theta FROM t ORDER BY n DESC, rule_id, finding_type LIMIT 10""")
def detect_most_reviewed(s, d):
    return summaries.most_reviewed(detection.feedback_tallies(_t(s, d, "feedback_records")))


@query("SELECT finding_id, severity, row_number() OVER (ORDER BY CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END, confidence DESC NULLS LAST, finding_id) - 1 AS place FROM (SELECT DISTINCT finding_id, severity, confidence FROM grounded_findings WHERE finding_id IS NOT NULL AND confidence IS NOT NULL) QUALIFY place < 50")
def detect_by_severity(s, d):
    f = _t(s, d, "grounded_findings").select("finding_id", "severity", "confidence").where("finding_id is not null and confidence is not null").distinct()
    top = summaries.by_severity(f).limit(50)
    order = [summaries.severity_rank(F.col("severity")), F.desc("confidence"), F.col("finding_id")]
    from pyspark.sql import Window

    return top.select("finding_id", "severity", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("place"))


_LABEL = "CASE WHEN length(v) > 120 THEN substr(v, 1, 117) || '...' ELSE v END"


@query(f"SELECT file, row_index, {_LABEL} AS account FROM (SELECT file, row_index, coalesce(nullif(trim(Account_Name), ''), nullif(trim(Account), ''), nullif(trim(Account_Type), ''), nullif(trim(Amount::VARCHAR), ''), nullif(trim(Period::VARCHAR), ''), nullif(trim(Balance::VARCHAR), ''), '') AS v FROM ({rq._ROWS}) WHERE file IS NOT NULL)")
def detect_account_labels(s, d):
    rows, _, _ = rq._scanned(s, d)
    return rows.select("file", "row_index", detection.account_label(rq._COLS).alias("account"))


_FORM = "lower(trim({}))"
_ENTITY = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT {_FORM.format('mention_a_id')} AS a, {_FORM.format('mention_b_id')} AS b, composite_score AS w FROM entity_links WHERE composite_score >= 0.5),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) WHERE a <> b),
reach(x, y) USING KEY (x) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION SELECT e.a, min(r.y) FROM reach r JOIN e ON r.x = e.b JOIN recurring.reach c ON c.x = e.a WHERE r.y < c.y GROUP BY e.a),
m AS (SELECT y AS label, count(*) AS n_mentions FROM reach GROUP BY y), k AS (SELECT y AS label, count(*) AS n_links, round(avg(w), 4) AS avg_score FROM l JOIN reach ON x = a GROUP BY y)"""


def _entity_clusters(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    form = lambda c: F.lower(F.trim(c))
    links = _t(s, d, "entity_links").where("composite_score >= 0.5").select(form("mention_a_id").alias("mention_a_id"), form("mention_b_id").alias("mention_b_id"), "composite_score")
    ids = links.select(F.explode(F.array("mention_a_id", "mention_b_id")).alias("mention_id")).distinct()
    nul = F.lit(None).cast("string")
    mentions = ids.select("mention_id", F.lit("one").alias("file_path"), nul.alias("archetype"), F.col("mention_id").alias("raw_name"), F.col("mention_id").alias("normalized_name"), nul.alias("formula"), nul.alias("business_meaning"), F.lit(0).alias("pos"))
    return linking.clusters(mentions, links), mentions, links


@query(_ENTITY + " SELECT 'cluster_' || substr(sha256(m.label), 1, 12) AS cluster_id, n_mentions, n_links, n_mentions > 100 AS over_limit FROM m JOIN k ON m.label = k.label")
def link_entity_clusters(s, d):
    return _entity_clusters(s, d)[0].select("cluster_id", "n_mentions", "n_links", "over_limit")


@query(_ENTITY + " SELECT count(*) AS total_clusters, sum(n_mentions)::BIGINT AS total_mentions, sum(n_links)::BIGINT AS total_links, 0::BIGINT AS total_conflicts, round(sum(n_mentions) / count(*), 2) AS avg_cluster_size, max(n_mentions) AS largest_cluster_size FROM m JOIN k ON m.label = k.label")
def link_batch_summary(s, d):
    return summaries.link_summary(_entity_clusters(s, d)[0])


@query(_ENTITY + " SELECT 'cluster_' || substr(sha256(label), 1, 12) AS cluster_id, array_to_string(list(x ORDER BY x), ',') AS members FROM m JOIN reach ON y = label GROUP BY label")
def link_entity_map(s, d):
    c, mentions, links = _entity_clusters(s, d)
    path = _folder(s)
    linking.entity_map(c, linking.cluster_members(mentions, links)).write.json(path)
    return s.read.json(path).select("cluster_id", F.array_join(F.transform("mentions", lambda m: m["mention_id"]), ",").alias("members"))


@query(_ENTITY + " SELECT 'cluster_' || substr(sha256(m.label), 1, 12) AS cluster_id, n_mentions FROM m JOIN k ON m.label = k.label ORDER BY n_mentions DESC, m.label LIMIT 1")
def link_largest_cluster(s, d):
    c = _entity_clusters(s, d)[0]
    largest = c.orderBy(F.desc("n_mentions"), "label").select("cluster_id").first()
    return linking.cluster_by_id(c, largest[0] if largest else "").select("cluster_id", "n_mentions")


# ---- reconciliation, cleaning, profiles ----------------------------------------------


@query("""WITH a AS (SELECT id, loaded_at, name, 'a' AS source FROM customers_a x WHERE NOT EXISTS (SELECT 1 FROM customers_b y WHERE x.id IS NOT DISTINCT FROM y.id)),
b AS (SELECT id, loaded_at, name, 'b' AS source FROM customers_b x WHERE NOT EXISTS (SELECT 1 FROM customers_a y WHERE x.id IS NOT DISTINCT FROM y.id))
SELECT source, (SELECT count(*) FROM a) AS total, id::VARCHAR AS id FROM (SELECT * FROM a ORDER BY id, loaded_at LIMIT 10) UNION ALL SELECT source, (SELECT count(*) FROM b), id::VARCHAR FROM (SELECT * FROM b ORDER BY id, loaded_at LIMIT 10)""")
def recon_orphan_details(s, d):
    o = reconcile.orphan_details(*rq._ab(s, d), ["id"], "both", 10, ["id", "loaded_at"])
    return o.select("source", "total", F.get_json_object("row", "$.id").alias("id"))


@query("SELECT feed_id, file_no, line_no, delivered_at, CASE WHEN v IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL ELSE v END AS v FROM (SELECT feed_id, file_no, line_no, delivered_at, trim(list_extract(string_split(raw_line, ','), -1)) AS v FROM raw_feed_lines)")
def clean_missing(s, d):
    v = F.trim(F.element_at(F.split("raw_line", ","), -1))
    return cleaning.na_to_null(_t(s, d, "raw_feed_lines").select("feed_id", "file_no", "line_no", "delivered_at", v.alias("v")))


@query(_values(("table_name", "structure"), [("lineitem", "Fact/Transaction"), ("region", "Dimension/Reference"), ("part", "Dimension/Reference")]))
def profile_structure(s, d):
    return s.createDataFrame([(t, profiling.structure_type(_t(s, d, t))) for t in ("lineitem", "region", "part")], "table_name string, structure string")


@query(_values(("column_name", "change", "safe"), [("c_custkey", "removed", None), ("c_nationkey", "removed", None), ("c_acctbal", "removed", None), ("c_mktsegment", "removed", None), ("name", "same", None), ("id", "added", None), ("email", "added", None), ("city", "added", None), ("balance", "added", None), ("updated_at", "added", None), ("loaded_at", "added", None)]).replace("NULL AS safe", "NULL::BOOLEAN AS safe"))
def drift_tables(s, d):
    old = _t(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_nationkey", "c_acctbal", "c_mktsegment")
    return profiling.drift(old, _t(s, d, "customers_a")).select("column_name", "change", "safe")


@query(_values(("column_name", "change", "old_type", "new_type", "similarity", "safe"), [("k", "type_changed", "int32", "int64", round(difflib.SequenceMatcher(None, "int32", "int64").ratio(), 4), True), ("v", "type_changed", "float64", "int64", round(difflib.SequenceMatcher(None, "float64", "int64").ratio(), 4), False)]))
def drift_types(s, d):
    p = _t(s, d, "part")
    old = p.select(F.col("p_partkey").cast("int").alias("k"), F.col("p_partkey").cast("double").alias("v"))
    return profiling.drift(old, p.select(F.col("p_partkey").cast("long").alias("k"), F.col("p_partkey").cast("long").alias("v"))).select("column_name", "change", "old_type", "new_type", "similarity", "safe")


@query(_values(("name", "source_file", "expectations_count"), [("nation", "nation.parquet", 10), ("region", "region.parquet", 8)]))
def expectations_list(s, d):
    path = _folder(s)
    for t in ("nation", "region"):
        df = _t(s, d, t).select(*[c for c in _t(s, d, t).columns if not c.endswith("comment")])
        profiling.keep_suite(profiling.suite(df), path, t, f"{t}.parquet")
    return profiling.list_suites(s, path)


@query("SELECT count(*) AS total, count(*) AS n_passed FROM range(8)")
def expectations_kept(s, d):
    path = _folder(s)
    df = _t(s, d, "region").select("r_regionkey", "r_name")
    profiling.keep_suite(profiling.suite(df), path, "region")
    return profiling.validation_summary(profiling.validate(df, profiling.read_suite(s, path, "region"))).select("total", "n_passed")


# ---- texts: fixed pairs, with results from the standard library's definitions ----------

_PAIRS = (("hello", "hello"), ("hello", "hallo"), ("hello", ""), ("", ""), ("abc", "xyz"), ("abcdef", "abcxyz"), ("kitten", "sitting"), ("one\ntwo\nthree", "one\n2\nthree"))


def _pairs(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_PAIRS)], "n long, a string, b string")


def _matcher(a: str, b: str) -> difflib.SequenceMatcher:
    return difflib.SequenceMatcher(None, a, b)


@query(_values(("n", "ratio", "quick", "least_bound"), [(i, 1.0 if a == b else 0.0 if not a or not b else _matcher(a, b).ratio(), float(_matcher(a, b).quick_ratio()), float(_matcher(a, b).real_quick_ratio())) for i, (a, b) in enumerate(_PAIRS)]))
def diff_ratios(s, d):
    return _pairs(s).select("n", sim.similarity("a", "b").alias("ratio"), sim.quick_ratio("a", "b").alias("quick"), sim.real_quick_ratio(F.col("a"), F.col("b")).cast("double").alias("least_bound"))


@query(_values(("n", "blocks"), [(i, ",".join(f"{m.a}:{m.b}:{m.size}:{a[m.a : m.a + m.size]}" for m in _matcher(a, b).get_matching_blocks() if m.size)) for i, (a, b) in enumerate(_PAIRS)]))
def diff_blocks(s, d):
    b = F.transform(sim.matching_blocks("a", "b"), lambda x: F.concat_ws(":", x["a_start"], x["b_start"], x["size"], x["content"]))
    return _pairs(s).select("n", F.array_join(b, ",").alias("blocks"))


@query(_values(("n", "ops"), [(i, ",".join(f"{o}:{p}-{q}:{x}-{y}" for o, p, q, x, y in _matcher(a, b).get_opcodes())) for i, (a, b) in enumerate(_PAIRS)]))
def diff_operations(s, d):
    o = F.transform(sim.opcodes("a", "b"), lambda x: F.format_string("%s:%d-%d:%d-%d", x["operation"], x["a_start"], x["a_end"], x["b_start"], x["b_end"]))
    return _pairs(s).select("n", F.array_join(o, ",").alias("ops"))


@query(_values(("n", "unified", "context"), [(i, "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "before", "after", n=1, lineterm="")), "\n".join(difflib.context_diff(a.splitlines(), b.splitlines(), "before", "after", n=1, lineterm=""))) for i, (a, b) in enumerate(_PAIRS)]))
def diff_lines(s, d):
    return _pairs(s).select("n", sim.unified_diff(F.col("a"), F.col("b"), "before", "after", 1).alias("unified"), sim.context_diff(F.col("a"), F.col("b"), "before", "after", 1).alias("context"))


@query(_values(("n", "deltas"), [(i, "\n".join(difflib.ndiff(*((list(a), list(b)) if "\n" not in a + b else (a.splitlines(), b.splitlines()))))) for i, (a, b) in enumerate(_PAIRS)]))
def diff_deltas(s, d):
    return _pairs(s).select("n", sim.ndiff("a", "b").alias("deltas"))


_LISTS = ((["1", "2", "3"], ["2", "3", "4"]), ([], []), (["a", "b"], []), (["x", "y", "z", "x"], ["x", "z"]))


@query(_values(("n", "sequence", "jaccard"), [(i, _matcher(a, b).ratio(), len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0) for i, (a, b) in enumerate(_LISTS)]))
def diff_sequences(s, d):
    df = s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_LISTS)], "n long, a array<string>, b array<string>")
    return df.select("n", sim.sequence_similarity("a", "b").alias("sequence"), sim.jaccard(F.col("a"), F.col("b")).cast("double").alias("jaccard"))


@query(_values(("index", "before", "after", "similarity"), [(0, "hello", "hallo", 0.8), (1, "", "x", 0.0), (2, "same", "same", 1.0)]).replace("0::BIGINT", "0::INT").replace("1::BIGINT", "1::INT").replace("2::BIGINT", "2::INT"))
def diff_paired(s, d):
    df = s.createDataFrame([(["hello", None, "same"], ["hallo", "x", "same", "more"])], "b array<string>, a array<string>")
    return sim.paired_differences(df, "b", "a").select("index", "before", "after", "similarity")


@query("""WITH m AS (SELECT template_id, hierarchy_id, loaded_at, map_keys(flags) AS ks, flags FROM template_hierarchy WHERE flags IS NOT NULL),
w AS (SELECT MAP {'include_flag': true, 'calculation_flag': false, 'other': true} AS want)
SELECT template_id, hierarchy_id, loaded_at, array_to_string(list_sort(list_filter(map_keys(want), lambda k: NOT list_contains(ks, k))), ',') AS added, array_to_string(list_sort(list_filter(ks, lambda k: NOT list_contains(map_keys(want), k))), ',') AS removed,
array_to_string(list_sort(list_filter(ks, lambda k: list_contains(map_keys(want), k) AND flags[k] IS DISTINCT FROM want[k])), ',') AS changed, array_to_string(list_sort(list_filter(ks, lambda k: list_contains(map_keys(want), k) AND flags[k] IS NOT DISTINCT FROM want[k])), ',') AS unchanged FROM m, w""")
def diff_map_keys(s, d):
    x = rq.diff_maps(s, d)
    return x.select("template_id", "hierarchy_id", "loaded_at", *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed", "unchanged")])


@query(_values(("word", "candidate", "similarity", "rank"), [("appel", "apple", 0.8, 1), ("appel", "ape", 0.75, 2)]).replace("1::BIGINT AS rank", "1::INT AS rank").replace("2::BIGINT AS rank", "2::INT AS rank"))
def fuzzy_difflib_fixture(s, d):
    words = s.createDataFrame([("appel",)], "w string")
    return fuzzy.difflib_matches(words, "w", s.createDataFrame([("ape",), ("apple",), ("peach",), ("puppy",)], "c string"), "c", 3, 0.6)


@query("""WITH n AS (SELECT DISTINCT legal_name AS v FROM new_erp_vendors WHERE legal_name IS NOT NULL), o AS (SELECT DISTINCT vendor_name AS v FROM legacy_vendors WHERE vendor_name IS NOT NULL)
SELECT n.v AS value_a, n.v AS value_b, 100.0::DOUBLE AS score FROM n JOIN o ON n.v = o.v""")
def fuzzy_exact(s, d):
    return fuzzy.fuzzy_match(_t(s, d, "new_erp_vendors"), "legal_name", _t(s, d, "legacy_vendors"), "vendor_name", 100)


@query()
def fuzzy_match_default(s, d):
    return fuzzy.fuzzy_match(_t(s, d, "new_erp_vendors"), "legal_name", _t(s, d, "legacy_vendors"), "vendor_name")


@query()
def fuzzy_match_70(s, d):
    return fuzzy.fuzzy_match(_t(s, d, "new_erp_vendors"), "legal_name", _t(s, d, "legacy_vendors"), "vendor_name", 70)


# ---- templates ---------------------------------------------------------------------------

#: The result of a query defined beside the other reference operators.
SQL["template_recommend"] = """WITH x AS (SELECT template_id AS id, count(*) AS n, count(*) FILTER (WHERE is_calculated) AS k, max(level) AS deepest FROM template_hierarchy GROUP BY 1),
y AS (SELECT id, CASE WHEN k > 3 THEN 'income_statement' ELSE 'balance_sheet' END AS category, CASE WHEN deepest > 7 THEN 'manufacturing' ELSE 'general' END AS industry, n FROM x)
SELECT id, id AS name, category, industry, least(100, 50 + CASE industry WHEN 'manufacturing' THEN 30 ELSE 10 END + CASE category WHEN 'income_statement' THEN 30 ELSE 0 END + CASE WHEN n > 10 THEN 10 ELSE 0 END)::INT AS score, industry = 'manufacturing' AS industry_match, category = 'income_statement' AS category_match
FROM y ORDER BY score DESC, id LIMIT 5"""


@query(_values(("hierarchy_id", "parent", "level", "sort_order"), [("a", None, 1, 1), ("b", "a", 2, 2), ("c", "b", 3, 1), ("d", None, 1, 3), ("e", "gone", 2, 1)]).replace("::BIGINT AS sort_order", "::INT AS sort_order"))
def template_from_project(s, d):
    nodes = s.createDataFrame([("a", "A", None, 1), ("b", "B", "a", 2), ("c", "C", "b", 1), ("d", "D", "", 3), ("e", "E", "gone", 1)], "hierarchy_id string, hierarchy_name string, parent_id string, sort_order int")
    return templates.template_rows(nodes).select("hierarchy_id", F.col("parent_id").alias("parent"), "level", "sort_order")


@query(_values(("hierarchy_name", "parent_name", "level"), [("A", None, 1), ("B", "A", 2), ("C", "B", 3)]))
def template_to_project(s, d):
    nodes = s.createDataFrame([("c", "C", "b", 3), ("a", "A", None, 1), ("b", "B", "a", 2)], "hierarchy_id string, hierarchy_name string, parent_id string, level long")
    p = templates.project_rows(nodes, "proj_1")
    up = p.select(F.col("hierarchy_id").alias("parent_id"), F.col("hierarchy_name").alias("parent_name"))
    return p.join(up, "parent_id", "left").select("hierarchy_name", "parent_name", "level")


# ---- sources and sinks: round trips ---------------------------------------------------------

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _customer(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("long"), F.col("c_acctbal").cast("double"), "c_mktsegment")


_TYPED = "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal::DOUBLE AS c_acctbal, c_mktsegment FROM customer"


@query(_TYPED)
def source_csv(s, d):
    path = _folder(s)
    sinks.write_csv(_customer(s, d), path)
    return readers.read_csv(s, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(_TYPED)
def source_tsv(s, d):
    path = _folder(s) + ".tsv"
    _customer(s, d).write.csv(path, header=True, sep="\t")
    return _typed(readers.read_table(s, path))


@query(_TYPED)
def source_json_lines(s, d):
    path = _folder(s) + ".jsonl"
    sinks.append_json(_customer(s, d), path)
    return _typed(readers.read_table(s, path))


@query(_TYPED)
def source_parquet(s, d):
    path = _folder(s) + ".parquet"
    _customer(s, d).write.parquet(path)
    return _typed(readers.read_table(s, path))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def source_json_array(s, d):
    path = _folder(s)
    rows = _t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return readers.read_json(s, path).select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def source_json_lists(s, d):
    path = _folder(s)
    _t(s, d, "region").agg(F.to_json(F.struct(F.collect_list("r_regionkey").alias("r_regionkey"), F.collect_list("r_name").alias("r_name"))).alias("value")).write.text(path)
    return readers.read_json(s, path).select(F.col("r_regionkey").cast("long"), "r_name")


@query("SELECT feed_id || '_' || file_no AS file, count(*) AS n_lines, sum(length(raw_line))::BIGINT AS n_chars FROM raw_feed_lines WHERE regexp_matches(raw_line, '^[ -~]+$') GROUP BY 1")
def source_lines(s, d):
    path = _folder(s)
    lines = _t(s, d, "raw_feed_lines").where(F.col("raw_line").rlike("^[ -~]+$")).select(F.concat_ws("_", "feed_id", "file_no").alias("f"), "raw_line")
    lines.repartition("f").write.partitionBy("f").text(path)
    got = readers.numbered_lines(s, f"{path}/*/*.txt", keep_path=True)
    return got.groupBy(F.regexp_extract("path", "/f=([^/]*)/", 1).alias("file")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("SELECT n_name AS name, n_regionkey::VARCHAR AS region, n_nationkey::BIGINT AS row_index FROM nation")
def source_commented_csv(s, d):
    path = _folder(s)
    body = _t(s, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))), lambda x: F.concat_ws(",", x["n_name"], x["n_regionkey"])), "\n").alias("b"))
    body.select(F.concat(F.lit("# extract\n# of nations\nname,region\n"), "b").alias("value")).write.text(path)
    return readers.read_commented_csv(s, f"{path}/*.txt").select("name", "region", "row_index")


@query("SELECT count(*) AS n_files, 1::BIGINT AS n_named FROM (SELECT DISTINCT n_regionkey FROM nation)")
def source_find_files(s, d):
    path = _folder(s)
    _t(s, d, "nation").repartition("n_regionkey").write.partitionBy("n_regionkey").csv(path, header=True)
    found = readers.find_files(s, [path], "*.csv", most=100)
    return found.agg(F.count("*").alias("n_files"), F.count_distinct(F.col("path").endswith(".csv")).alias("n_named"))


@query("SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def sink_partitioned(s, d):
    path = _folder(s)
    sinks.write_partitioned(_customer(s, d), path, "c_mktsegment")
    return s.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT count(*) AS rows_said, count(*) AS rows_there FROM customer WHERE c_acctbal > 0")
def sink_parquet_export(s, d):
    path = _folder(s)
    _customer(s, d).createOrReplaceTempView("customer")
    said = sinks.export_parquet(s, "SELECT * FROM customer WHERE c_acctbal > 0", path)
    return s.read.parquet(path).agg(F.lit(said["rows"]).cast("long").alias("rows_said"), F.count("*").alias("rows_there"))


@query(f"SELECT * FROM ({rq._SCAN})")
def sink_detections(s, d):
    path = _folder(s)
    sinks.write_partitioned(_scan(s, d)[1].select("file", "row_index", "rule_id", "finding_type", "field", "confidence"), path, "file")
    return s.read.parquet(path).select(F.col("file").cast("string"), "row_index", "rule_id", "finding_type", "field", "confidence")


@query("SELECT c_mktsegment, count(*) AS n, avg(o_totalprice) AS mean FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def sql_over_files(s, d):
    files = {t: f"{d}/{t}.parquet" for t in ("customer", "orders")}
    return tsql.query(s, "SELECT c_mktsegment, count(*) AS n, avg(o_totalprice) AS mean FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1", files)


@query("SELECT 'registered_part' AS name, count(*) AS n_rows FROM part")
def sql_registered(s, d):
    said = tsql.register(s, f"{d}/part.parquet", "registered_part")
    listed = [t for t in tsql.list_tables(s) if t["name"] == "registered_part"]
    return s.createDataFrame([(t["name"], t["rows"] if t["rows"] == said["rows"] else -1) for t in listed], "name string, n_rows long")


@query("SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, count(*) FILTER (WHERE c_name IS NULL) AS name_nulls FROM customer")
def source_load_report(s, d):
    r = readers.load_report(_customer(s, d))
    return s.createDataFrame([(r["rows"], len(r["columns"]), r["null_counts"]["c_name"])], "n_rows long, n_columns long, name_nulls long")


# ---- records of runs -----------------------------------------------------------------------


@query(_values(("rule_id", "finding_type", "n", "confirmed", "dismissed"), [("r1", "custom", 3, 2, 1), ("r2", "custom", 1, 0, 1)]))
def history_feedback(s, d):
    path = _folder(s)
    for i, (rule, yes) in enumerate((("r1", True), ("r1", True), ("r1", False), ("r2", False))):
        history.record_feedback(s, path, f"f{i}", yes, "", rule, "custom")
    return detection.feedback_tallies(s.read.json(path))


@query("SELECT 'orders' AS suite_name, 2::BIGINT AS runs, true AS all_passed")
def history_validation(s, d):
    path = _folder(s)
    df = _t(s, d, "region").select("r_regionkey", "r_name")
    checked = profiling.validate(df, profiling.suite(df))
    for _ in range(2):
        history.keep_validation(checked, path, "orders")
    got = history.latest(s, path, suite_name="orders")
    return got.groupBy("suite_name").agg(F.count("*").alias("runs"), F.bool_and(F.col("n_failed") == 0).alias("all_passed"))


@query(_values(("n", "kept"), [(1, True)]))
def history_counterexamples(s, d):
    path = _folder(s)
    f = _t(s, d, "grounded_findings")
    kept = history.keep_counterexample(f, detection.monitors(f).limit(1), path)
    return s.read.json(path).agg(F.count("*").alias("n")).withColumn("kept", F.lit(kept))


@query(_values(("text", "parsed"), [("```json\n{\"a\": 1}\n```", '{"a":1}'), ("so: {\"b\": [2]} it is", '{"b":[2]}'), ("none here", "{}"), ("", "{}")]))
def text_fenced_json(s, d):
    df = s.createDataFrame([("```json\n{\"a\": 1}\n```",), ("so: {\"b\": [2]} it is",), ("none here",), ("",)], "text string")
    return df.select("text", knowledge.fenced_json(F.col("text")).alias("parsed"))


@query("SELECT rule_id, loaded_at, 1::DOUBLE AS same, 1::DOUBLE AS sales, 0::DOUBLE AS other FROM detection_rules")
def link_synonyms(s, d):
    lit = F.lit
    return _t(s, d, "detection_rules").select("rule_id", "loaded_at", linking.synonym_score(F.concat(lit("x"), "rule_id"), F.concat(lit("X"), "rule_id")).alias("same"), linking.synonym_score(lit("Net Sales"), lit(" turnover ")).alias("sales"), linking.synonym_score(lit("goodwill"), lit("revenue")).alias("other"))


@query(_values(("a", "b", "score"), [("Budget", "Forecast", 1.0), ("Budget", "Dashboard", 0.7), ("Template", "Budget", 0.6), ("Report", "Template", 0.5), ("Budget", "Other", 0.3), ("Data Extract", "Budget", 0.1)]))
def link_archetypes(s, d):
    df = s.createDataFrame([("Budget", "Forecast"), ("Budget", "Dashboard"), ("Template", "Budget"), ("Report", "Template"), ("Budget", "Other"), ("Data Extract", "Budget")], "a string, b string")
    return df.select("a", "b", linking.archetype_score(F.col("a"), F.col("b")).alias("score"))


@query(_values(("text", "standard"), [("prepared under US GAAP", "US_GAAP"), ("IFRS 16 applied", "IFRS"), ("Dual reporting IFRS", "DUAL"), ("J-GAAP", "JGAAP"), ("ASC 842", "US_GAAP"), ("ASC and IFRS", "IFRS"), ("plain", None)]))
def standards_headers(s, d):
    df = s.createDataFrame([(x,) for x in ("prepared under US GAAP", "IFRS 16 applied", "Dual reporting IFRS", "J-GAAP", "ASC 842", "ASC and IFRS", "plain")], "text string")
    return df.select("text", checks.header_standard(F.col("text")).alias("standard"))


_TREE = """WITH RECURSIVE n AS MATERIALIZED (SELECT lower(trim(template_id)) AS t, lower(trim(hierarchy_id)) AS h, arg_max({'p': CASE WHEN parent_id IS NULL OR trim(parent_id) IN ('', '-') THEN NULL ELSE lower(trim(parent_id)) END}, loaded_at).p AS p FROM template_hierarchy WHERE hierarchy_id IS NOT NULL GROUP BY 1, 2),
down AS (SELECT t, h, 1 AS depth FROM n WHERE p IS NULL UNION ALL SELECT n.t, n.h, d.depth + 1 FROM n JOIN down d ON n.t = d.t AND n.p = d.h)"""


@query(_TREE + " SELECT t AS template_id, count(*) AS n_nodes, max(depth)::BIGINT AS deepest FROM down GROUP BY 1")
def template_depths(s, d):
    nodes = hierarchy.links(_t(s, d, "template_hierarchy"), "template_id", "hierarchy_id", "parent_id", "loaded_at", "level")
    ok = hierarchy.resolve(nodes).where("kind = 'ok'")
    return ok.groupBy(F.col("tree").alias("template_id")).agg(F.count("*").alias("n_nodes"), F.max("depth").alias("deepest"))


# ---- fixtures: small tables whose results follow from the definitions ---------------------------


@query("SELECT event_id::VARCHAR AS mention_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id, event_id::VARCHAR) AS r FROM events) WHERE r <= 50")
def link_capped_mentions(s, d):
    m = _t(s, d, "events").select(F.col("event_id").cast("string").alias("mention_id"), F.col("event_type").alias("file_path"), F.col("event_id").alias("pos"))
    return linking.capped_mentions(m, linking.MENTIONS_PER_FILE).select("mention_id")


@query(_values(("a", "b", "ratio"), [("kitten", "sitting", 200 * 4 / 13), ("", "", 100.0), ("abc", "abc", 100.0), ("ab", "cd", 0.0), ("abcd", "acbd", 75.0)]))
def fuzzy_indel_ratios(s, d):
    df = s.createDataFrame([("kitten", "sitting"), ("", ""), ("abc", "abc"), ("ab", "cd"), ("abcd", "acbd")], "a string, b string")
    return df.select("a", "b", sim.indel("a", "b").alias("ratio"))


@query(_values(("value_a", "value_b", "score"), [("apple inc", "appel inc", 200 * 8 / 18), ("zeta", "zeta", 100.0)]))
def fuzzy_best_fixture(s, d):
    a = s.createDataFrame([("apple inc",), ("zeta",), ("nothing like it",), (None,)], "v string")
    b = s.createDataFrame([("appel inc",), ("aple in",), ("zeta",), ("zeta",), ("",)], "v string")
    return fuzzy.fuzzy_match(a, "v", b, "v", 80)


@query(_values(("value", "leader"), [("acme co", "acme co"), ("acme c", "acme co"), ("acme", "acme"), ("zeta", "zeta")]))
def fuzzy_groups_fixture(s, d):
    df = s.createDataFrame([(1, "acme co"), (2, "acme c"), (3, "acme"), (4, "zeta"), (5, "zeta")], "n long, v string")
    return fuzzy.fuzzy_dedupe(df, "v", 90, "n").select("value", "leader")


@query(_values(("n", "explanation"), [(0, "Identical - no changes"), (1, "Similarity: 80.0%\n  Changed: 'e' -> 'a'"), (2, "Removed: 'hello'"), (3, "Identical - no changes"), (4, "Similarity: 0.0%\n  Changed: 'abc' -> 'xyz'"), (5, "Similarity: 50.0%\n  Changed: 'def' -> 'xyz'")]))
def diff_explanations(s, d):
    return _pairs(s).where("n <= 5").select("n", sim.explanation(F.col("a"), F.col("b")).alias("explanation"))


@query(_values(("n", "names"), [(0, "Blue Sky"), (1, "net_sales_total,NetSales"), (2, "")]))
def link_names_in_texts(s, d):
    df = s.createDataFrame([(0, 'the "Blue Sky" of all'), (1, "adds net_sales_total to NetSales"), (2, "nothing here")], "n long, t string")
    return df.select("n", F.array_join(linking.names_in(F.col("t")), ",").alias("names"))


@query(_values(("words", "pattern"), [("sign,reversal,asset", "(?i)\\b(?:sign|reversal|asset)\\b"), ("", None)]))
def knowledge_patterns(s, d):
    df = s.createDataFrame([("The sign reversal of an asset", "sign"), ("of an", "")], "a string, b string")
    k = knowledge.keywords(F.col("a"), F.col("b"))
    return df.select(F.array_join(k, ",").alias("words"), knowledge.any_of(k).alias("pattern"))


@query(_values(("rule_id", "finding_type", "severity", "pattern", "field_targets"), [("rule_a", "sign_reversal", "high", "neg", "amount"), ("rule_b", "rounding_discrepancy", "medium", "(?i)\\b(?:rounding|check)\\b", "account_name,description")]))
def knowledge_rules_fixture(s, d):
    path = _folder(s)
    docs = """{"nodes": [{"id": "a", "type": "rule", "name": "Signs", "properties": {"detection_rule": {"pattern": "neg", "field_targets": ["amount"], "finding_type": "sign_reversal", "severity": "HIGH"}}},
{"id": "b", "type": "standard", "name": "Rounding check"}, {"id": "c", "type": "unknown", "name": "Other"}, {"id": null, "type": "rule", "name": "No id"}]}"""
    s.createDataFrame([(docs.replace("\n", " "),)], "value string").coalesce(1).write.text(path)
    rules = s.read.schema(knowledge.NODES).option("multiLine", True).json(f"{path}/*.txt")
    r = knowledge.knowledge_rules(rules.select(F.lit("one").alias("file"), "nodes"))
    return r.select("rule_id", "finding_type", "severity", "pattern", F.array_join("field_targets", ",").alias("field_targets"))


@query(f"SELECT * FROM ({rq._SCAN})")
def detect_unlimited(s, d):
    rows, _, rules = rq._scanned(s, d)
    return detection.detect(rows, rules, rq._COLS, most=None).select("file", "row_index", "rule_id", "finding_type", "field", "confidence")


@query("SELECT rule_id, coalesce(name, '') AS name, lower(coalesce(severity, 'medium')) AS severity, coalesce(confidence, 0.9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY loaded_at DESC) AS rn FROM detection_rules WHERE rule_id IS NOT NULL) WHERE rn = 1")
def detect_rule_table(s, d):
    rules = detection.rules_from(_t(s, d, "detection_rules"))
    return s.createDataFrame([(r.rule_id, r.name, r.severity, float(r.confidence)) for r in rules], "rule_id string, name string, severity string, confidence double")


_F1, _F2 = "=SUM(A1:A9)", "=SUM(B1:B9)*2"


def _two_mentions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(
        [("m1", "a.xlsx", "Budget", "Revenue", "revenue", _F1, "sum of all sales", 0), ("m2", "b.xlsx", "Forecast", "Net Sales", "net_sales", _F2, "sum of all sales", 0), ("m3", "b.xlsx", "Other", "Headcount", "headcount", "=1", "people", 1)],
        "mention_id string, file_path string, archetype string, raw_name string, normalized_name string, formula string, business_meaning string, pos long",
    )


@query(_values(("mention_a_id", "mention_b_id", "name_similarity", "formula_similarity", "business_meaning", "archetype_compatibility", "composite_score"), [("m1", "m2", 1.0, _matcher(_F1, _F2).ratio(), 1.0, 1.0, round(0.4 + 0.25 * _matcher(_F1, _F2).ratio() + 0.25 + 0.1, 4))]))
def link_pairs_fixture(s, d):
    return linking.link_pairs(_two_mentions(s))


@query(_values(("canonical_name", "score"), [("Revenue", 1.0)]))
def link_search_fixture(s, d):
    m = _two_mentions(s)
    links = linking.link_pairs(m)
    return linking.find_entity(linking.clusters(m, links), linking.cluster_members(m, links), "net sales", 3).select("canonical_name", "score")


@query(_values(("spec", "pages"), [("1-3,7", "1,2,3,7"), ("4", "4"), ("all", "all")]))
def source_page_numbers(s, d):
    out = [(x, "all" if (p := readers.page_numbers(x)) is None else ",".join(map(str, sorted(p)))) for x in ("1-3,7", "4", "all")]
    return s.createDataFrame(out, "spec string, pages string")


@query(_values(("name", "slug"), [("Oil & Gas (Upstream)", "oil_gas_upstream"), ("  P&L 2024 ", "p_l_2024"), ("Ärger", "rger")]))
def template_slugs(s, d):
    return s.createDataFrame([(x, templates.slug(x)) for x in ("Oil & Gas (Upstream)", "  P&L 2024 ", "Ärger")], "name string, slug string")
