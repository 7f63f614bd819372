"""Roll-ups of findings over many files.

Findings of all files are one long table, so a batch is an aggregation, and a
file of its own is a row of it.  Tables that say how many files there were are
given beside the findings: a file without findings counts as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The risk from which a file is of high risk, and the entries of a top list.
HIGH_RISK, TOP = 50, 10
SEVERITY_ORDER = ("critical", "high", "medium", "low", "info")


def counts_by(findings: DataFrame, dimensions: Sequence[str] = ("type", "severity")) -> DataFrame:
    """dimension, value, n_findings, n_files for each value of each dimension,
    in one pass with partial sums; null counts as ``UNKNOWN``."""
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("UNKNOWN")).alias("value")) for c in dimensions])
    long = findings.select("file", F.inline(each)).groupBy("dimension", "value", "file").agg(F.count("*").alias("n"))
    return long.groupBy("dimension", "value").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_files"))


def batch_totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """total_files, files_with_issues, total_findings and their average per file
    (one decimal; 0 for no files).  ``files`` has a row or more for each file."""
    n = findings.groupBy("file").agg(F.count("*").alias("n"))
    g = files.select("file").distinct().join(n, "file", "left").agg(F.count("*").alias("total_files"), F.count("n").alias("files_with_issues"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"))
    return g.withColumn("avg_findings_per_file", F.round(F.col("total_findings") / F.greatest(F.col("total_files"), F.lit(1)), 1))


def high_risk_files(risks: DataFrame, least: int = HIGH_RISK, top: int = TOP) -> DataFrame:
    """The first ``top`` files by name whose ``risk_score`` is at least ``least``."""
    return risks.where(F.col("risk_score") >= least).orderBy("file").limit(top)


def problem_files(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` files by name with findings."""
    return scores.where("n_findings > 0").orderBy("file").limit(top)


def system_distribution(systems: DataFrame) -> DataFrame:
    """system, n_files, avg_confidence (three places) of the files' source systems."""
    return systems.groupBy("system").agg(F.count("*").alias("n_files"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def standards_totals(scores: DataFrame, files: DataFrame) -> DataFrame:
    """standard, total_files, non_compliant_files, total_findings and
    avg_compliance_score (one decimal), by standard and, as ``ALL``, over all.
    ``files`` has file and standard, ``scores`` file, n_findings, compliance_score."""
    one = files.groupBy("file").agg(F.coalesce(F.min("standard"), F.lit("UNKNOWN")).alias("standard")).join(scores, "file")
    both = one.select("n_findings", "compliance_score", F.explode(F.array(F.lit("ALL"), F.col("standard"))).alias("standard"))
    return both.groupBy("standard").agg(F.count("*").alias("total_files"), F.count_if(F.col("n_findings") > 0).alias("non_compliant_files"), F.sum("n_findings").alias("total_findings"), F.round(F.avg("compliance_score"), 1).alias("avg_compliance_score"))


def detection_summary(findings: DataFrame, rows: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """file, total_rows, total_findings, avg_confidence (four places; 0 for
    none), n_rules with findings and, if the unfiltered findings are given, how
    many feedback took away; for every file of ``rows``."""
    n = rows.groupBy("file").agg(F.count("*").alias("total_rows"))
    f = findings.groupBy("file").agg(F.count("*").alias("total_findings"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.count_distinct("rule_id").alias("n_rules"))
    out = n.join(f, "file", "left")
    if raw is not None:
        out = out.join(raw.groupBy("file").agg(F.count("*").alias("n_raw")), "file", "left").withColumn("feedback_suppressed", F.coalesce("n_raw", F.lit(0)) - F.coalesce("total_findings", F.lit(0))).drop("n_raw")
    return out.fillna(0, ["total_findings", "n_rules"]).fillna(0.0, ["avg_confidence"])


def detection_totals(summary: DataFrame) -> DataFrame:
    """total_files, total_rows, total_findings and avg_confidence over the files of ``detection_summary``."""
    g = summary.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("total_findings"), F.lit(0)).alias("total_findings"), F.coalesce(F.sum(F.col("avg_confidence") * F.col("total_findings")), F.lit(0.0)).alias("s"))
    return g.select("total_files", "total_rows", "total_findings", F.round(F.col("s") / F.greatest(F.col("total_findings"), F.lit(1)), 4).alias("avg_confidence"))


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info; 5 for others."""
    return F.coalesce(*[F.when(F.lower(severity) == s, F.lit(i)) for i, s in enumerate(SEVERITY_ORDER)], F.lit(len(SEVERITY_ORDER)))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings, the severest first, then by falling confidence."""
    return findings.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), *[c for c in ("file", "row_index", "rule_id", "finding_id") if c in findings.columns])


def most_reviewed(tallies: DataFrame, suppress_after: int = 3, top: int = TOP) -> DataFrame:
    """The ``top`` patterns (rule and finding type) with most feedback: their
    counts, net score, whether they are suppressed, and the state of their Beta
    distribution (alpha, beta, expected value to four places).  Ties go by rule
    and type."""
    a, b = F.col("confirmed") + 1, F.col("dismissed") + 1
    out = tallies.select(
        "rule_id", "finding_type", "n", "confirmed", "dismissed", (F.col("confirmed") - F.col("dismissed")).alias("net_score"), ((F.col("dismissed") > suppress_after) & (F.col("confirmed") == 0)).alias("suppressed"),
        a.alias("alpha"), b.alias("beta"), F.round(a / (a + b), 4).alias("expected_theta"),
    )
    return out.orderBy(F.desc("n"), "rule_id", "finding_type").limit(top)


def link_summary(clusters: DataFrame) -> DataFrame:
    """total_clusters, total_mentions, total_links, total_conflicts,
    avg_cluster_size (two places) and largest_cluster_size."""
    return clusters.agg(
        F.count("*").alias("total_clusters"), F.coalesce(F.sum("n_mentions"), F.lit(0)).alias("total_mentions"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("total_links"), F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).cast("long").alias("total_conflicts"),
        F.round(F.coalesce(F.sum("n_mentions"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 2).alias("avg_cluster_size"), F.coalesce(F.max("n_mentions"), F.lit(0)).alias("largest_cluster_size"),
    )


def cluster_domains(clusters: DataFrame) -> DataFrame:
    """domain, n_clusters, n_mentions."""
    return clusters.groupBy("domain").agg(F.count("*").alias("n_clusters"), F.sum("n_mentions").alias("n_mentions"))
