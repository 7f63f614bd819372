"""Command line: ``python -m tallyframe.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import sql
from tallyframe.functions import similarity
from tallyframe.operators import checks, cleaning, detection, fuzzy, linking, profiling, reconcile, workbooks
from tallyframe.session import build_session
from tallyframe.sources import readers, sinks


def _show(df: DataFrame, n: int) -> None:
    for r in df.limit(n).collect():
        print(json.dumps(r.asDict(True), default=str, ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyframe")
    p.add_argument("--limit", type=int, default=20, help="rows to print")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, /, *args: str, **options: dict) -> None:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for k, v in options.items():
            s.add_argument(f"--{k.replace('_', '-')}", **v)

    add("profile", "file")
    add("compare", "a", "b", keys={"required": True}, columns={"default": ""})
    add("merge", "a", "b", keys={"required": True}, how={"default": "inner"}, output={"default": ""})
    add("fuzzy", "a", "b", column={"required": True}, column_b={"default": ""}, threshold={"type": float, "default": 80})
    add("dedupe", "file", column={"required": True}, threshold={"type": float, "default": 90})
    add("diff", "a", "b")
    add("drift", "old", "new")
    add("transform", "file", column={"required": True}, op={"required": True}, output={"default": ""})
    add("find", "directory", pattern={"default": "*.csv"}, name={"default": ""})
    add("triage", "directory", output={"default": ""})
    add("parse", "file", delimiter={"default": "auto"})
    add("erp-detect", "path")
    add("fraud-detect", "path", checks={"default": ""})
    add("fx-validate", "path")
    add("standards-check", "path", standard={"default": ""})
    add("detect", "path", "rules")
    add("link-entities", "path", threshold={"type": float, "default": linking.THRESHOLD})
    add("expect", "file", output={"required": True})
    add("validate", "file", suite={"required": True})
    add("query", "sql", register={"action": "append", "default": []})
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    n, cmd = a.limit, a.command
    read = lambda f: readers.read_table(spark, f)
    if cmd == "profile":
        df = read(a.file)
        print(profiling.structure_type(df))
        _show(profiling.column_profile(df), n)
        _show(profiling.duplicate_rows(df), n)
    elif cmd == "compare":
        keys, cols = a.keys.split(","), [c for c in a.columns.split(",") if c]
        _show(reconcile.compare(read(a.a), read(a.b), keys, cols), n)
        _show(reconcile.conflicts(read(a.a), read(a.b), keys, cols), n)
    elif cmd == "merge":
        m = reconcile.merge(read(a.a), read(a.b), a.keys.split(","), a.how)
        sinks.write_csv(m, a.output) if a.output else _show(m, n)
    elif cmd == "fuzzy":
        _show(fuzzy.fuzzy_match(read(a.a), a.column, read(a.b), a.column_b or a.column, a.threshold).orderBy(F.desc("score"), "value_a"), n)
    elif cmd == "dedupe":
        _show(fuzzy.fuzzy_dedupe(read(a.file), a.column, a.threshold), n)
    elif cmd == "diff":
        one = spark.createDataFrame([(Path(a.a).read_text(), Path(a.b).read_text())], "a string, b string")
        print(one.select(similarity.unified_diff("a", "b")).first()[0])
    elif cmd == "drift":
        _show(profiling.drift(read(a.old), read(a.new)).where("change != 'same'"), n)
    elif cmd == "transform":
        sinks.write_csv(cleaning.clean(read(a.file), a.column, a.op), a.output) if a.output else _show(cleaning.clean_preview(read(a.file), a.column, a.op), n)
    elif cmd == "find":
        _show(readers.find_files(spark, [a.directory], a.pattern, a.name, n), n)
    elif cmd == "triage":
        files = workbooks.classify(workbooks.scan_directory(spark, a.directory)).cache()
        files.write.mode("overwrite").json(a.output) if a.output else _show(files.select("file_name", "scan_status", "archetype", "archetype_confidence"), n)
        _show(workbooks.triage_summary(files), n)
    elif cmd == "parse":
        texts = spark.createDataFrame([(1, Path(a.file).read_text())], "id long, text string")
        _show(readers.parse_tables(texts, "id", "text", a.delimiter), n)
    elif cmd == "erp-detect":
        _show(checks.source_system(checks.source_systems(readers.file_heads(readers.numbered_lines(spark, a.path)))), n)
    elif cmd == "fraud-detect":
        f = checks.fraud(readers.read_commented_csv(spark, a.path), [c for c in a.checks.split(",") if c]).cache()
        _show(f, n)
        _show(checks.risk(f), n)
    elif cmd == "fx-validate":
        f = checks.fx(readers.read_commented_csv(spark, a.path, ("#",), True)).cache()
        _show(f, n)
        _show(checks.risk(f, checks.FX_WEIGHTS), n)
    elif cmd == "standards-check":
        rows = readers.read_commented_csv(spark, a.path, ("#",), True)
        rows = rows.withColumn("standard", F.lit(a.standard) if a.standard else F.coalesce(checks.header_standard(F.col("comments")), F.lit("UNKNOWN")))
        f = checks.standards(rows).cache()
        _show(f, n)
        _show(checks.compliance(f, rows), n)
    elif cmd == "detect":
        rows = readers.read_commented_csv(spark, a.path, ("#",), True)
        cols = [c for c in rows.columns if c not in ("file", "row_index", "comments")]
        _show(detection.detect_and_verify(rows, detection.rules_from(read(a.rules)), cols), n)
    elif cmd == "link-entities":
        m = linking.mentions_from_dna(spark.read.json(a.path, multiLine=True))
        _show(linking.clusters(m, linking.link_pairs(m, a.threshold)), n)
    elif cmd == "expect":
        profiling.suite(read(a.file)).coalesce(1).write.mode("overwrite").json(a.output)
    elif cmd == "validate":
        v = profiling.validate(read(a.file), spark.read.schema(profiling.SUITE).json(a.suite)).cache()
        _show(v.where("not passed"), n)
        _show(profiling.validation_summary(v), n)
    elif cmd == "query":
        _show(sql.query(spark, a.sql, dict(x.split("=", 1) for x in a.register)), n)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    run(build_session("tallyframe", a.master), a)


if __name__ == "__main__":
    main()
