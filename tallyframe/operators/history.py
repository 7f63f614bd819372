"""Records that runs leave behind: feedback, validation results, counterexamples."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.sinks import append_json

FEEDBACK = "finding_id string, action string, notes string, rule_id string, finding_type string, account string"


def record_feedback(spark: SparkSession, path: str, finding_id: str, confirmed: bool, notes: str = "", rule_id: str = "", finding_type: str = "", account: str = "") -> str:
    """Adds one judgement to a folder of JSON lines; returns its id, a hash of what it says."""
    now = datetime.now(timezone.utc).isoformat()
    row = spark.createDataFrame([(finding_id, "confirmed" if confirmed else "dismissed", notes, rule_id, finding_type, account)], FEEDBACK)
    row = row.withColumn("timestamp", F.lit(now)).withColumn("feedback_id", F.concat(F.lit("fb_"), F.substring(F.sha2(F.concat_ws("\u0001", "finding_id", "action", "notes", "timestamp"), 256), 1, 12)))
    append_json(row, path)
    return row.first().feedback_id


def keep_validation(validated: DataFrame, path: str, suite_name: str) -> None:
    """Adds a validation's summary, with its failures, under the suite's name and the time."""
    from tallyframe.operators.profiling import validation_summary

    failed = [r.asDict() for r in validated.where("not passed").select("expectation", "column_name", "observed").collect()]
    s = validation_summary(validated).withColumn("suite_name", F.lit(suite_name)).withColumn("run_at", F.lit(datetime.now(timezone.utc).isoformat()))
    spark = validated.sparkSession
    rows = spark.createDataFrame(failed, "expectation string, column_name string, observed string").agg(F.collect_list(F.struct("expectation", "column_name", "observed")).alias("failures"))
    append_json(s.withColumn("failures", F.lit(None).cast("string")) if not failed else s.join(rows.withColumn("suite_name", F.lit(suite_name)), "suite_name"), path)


def latest(spark: SparkSession, path: str, by: str = "run_at", limit: int = 10, **where: str) -> DataFrame:
    """Records of a folder that have the values given, newest first."""
    df = spark.read.json(path)
    for k, v in where.items():
        if v:
            df = df.where(F.col(k) == v)
    return df.orderBy(F.desc(by)).limit(limit)


def keep_counterexample(findings: DataFrame, warnings: DataFrame, path: str, most: int = 20) -> bool:
    """Keeps up to ``most`` findings with the monitors' warnings if there are any, for a later replay."""
    said = [r.asDict() for r in warnings.collect()]
    if not said:
        return False
    one = findings.orderBy("row_index", "rule_id").limit(most).agg(F.to_json(F.collect_list(F.struct("*"))).alias("findings"))
    append_json(one.withColumn("warnings", F.lit(str(said))).withColumn("run_at", F.lit(datetime.now(timezone.utc).isoformat())), path)
    return True
