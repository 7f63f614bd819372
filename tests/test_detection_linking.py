import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import detection, linking
from tallyframe.operators.detection import Rule


def test_scan(spark, rows):
    df = spark.createDataFrame([("f", 0, "Misc cost", "12", None), ("f", 1, None, "9999", "x  y"), ("f", 2, "ok", "1", "")], "file string, row_index long, Account_Name string, Amount string, Note string")
    rules = [Rule("r1", "(?i)misc", ("account_name",)), Rule("r2", r"^\d{4}$", ("Amount", "Note")), Rule("r3", r"\s{2,}"), Rule("r4", "[", ()), Rule("r5", "x", ("gone",)), Rule("r6", "ok", (), confidence=0.1)]
    got = rows(detection.scan(df, rules, ["Account_Name", "Amount", "Note"], 0.5), "row_index", "rule_id", "field", "matched_value", "account")
    assert got == [(0, "r1", "Account_Name", "Misc", "Misc cost"), (1, "r2", "Amount", "9999", "9999"), (1, "r3", "Note", "  ", "9999")]
    assert rows(detection.scan(df, [], ["Amount"])) == [] and rows(detection.scan(df.limit(0), rules, ["Amount"])) == []
    long = df.withColumn("Account_Name", F.lit("y" * 130))
    assert detection.scan(long, [Rule("a", "1")], ["Account_Name", "Amount"]).first().account == "y" * 117 + "..."


def certificate(spark, hits):
    df = spark.createDataFrame([("f", i, h) for i, h in enumerate(hits)], "file string, row_index long, hit boolean")
    return detection.certificates(detection.sequential_test(df)).first()


def test_sequential_test(spark):
    assert tuple(certificate(spark, [False] * 1000))[1:4] == ("clean", 326, 1000)
    assert certificate(spark, [True] * 5 + [False] * 995).decision == "anomalous"
    assert certificate(spark, [True] * 5).decision == "undecided"  # too few rows
    assert certificate(spark, [False] * 400 + [True] * 50).decision == "clean"


def test_running_sums_do_not_depend_on_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(f, i, (i * 7) % 5) for f in "ab" for i in range(57)], "file string, row_index long, n long")
    for block in (1_000_000, 10):
        monkeypatch.setattr(detection, "BLOCK_ROWS", block)
        for r in detection.running_sums(df, {"s": F.col("n"), "k": F.lit(1)}).collect():
            assert (r.s, r.k) == (sum((i * 7) % 5 for i in range(r.row_index + 1)), r.row_index + 1)


def test_limits(spark):
    data = spark.createDataFrame([("f", i) for i in range(400)], "file string, row_index long")
    found = data.where("row_index < 300").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    kept = detection.within_limits(data, found.select("file", "row_index"), 500)
    assert kept.agg(F.max("row_index")).first()[0] == 166  # 167 rows of three findings pass five hundred
    none = data.where("row_index in (330, 350)").select("file", "row_index")
    assert detection.within_limits(data, none).count() == 0  # certified clean at row 326


def test_feedback(spark, rows):
    fb = spark.createDataFrame([("r1", "t", "dismissed")] * 4 + [("r2", "t", "confirmed")] * 3 + [("r3", "t", "dismissed")] * 2 + [("", "t", "confirmed"), (None, "t", "confirmed")], "rule_id string, finding_type string, action string")
    f = spark.createDataFrame([("r1", "t", 0.9), ("r2", "t", 0.9), ("r3", "t", 0.1), ("r4", "t", 0.7), (None, None, 0.5)], "rule_id string, finding_type string, confidence double")
    t = detection.feedback_tallies(fb)
    assert rows(detection.apply_feedback(f, t), "rule_id", "confidence") == [(None, 0.5), ("r2", 1.0), ("r3", 0.05), ("r4", 0.7)]
    a, b = (rows(detection.apply_feedback(f, t, "thompson", 0.5, 3)) for _ in "ab")
    assert a == b and ("r2", "t", 1.0) in a
    assert detection.feedback_stats(fb).first().suppressed_patterns == 1
    assert detection.feedback_stats(fb.limit(0)).first().confirmation_rate is None
    with pytest.raises(ValueError, match="unknown strategy"):
        detection.apply_feedback(f, t, "nope")


def test_monitors(spark, rows):
    f = spark.createDataFrame([("a", "x", "missing_account", 0.5, "r", 1), ("a", "x", "duplicate_account", 1.5, "", 2), ("b", "y", "custom", 0.5, "r", 3), ("b", "y", "custom", 0.5, "r", 3)], "account string, field string, finding_type string, confidence double, rule_id string, row_index long")
    assert rows(detection.monitors(f)) == [("confidence_bounds", None, None, 1), ("contradiction", "a", "x", 2), ("duplicate", "r", "y", 1), ("missing_rule", None, None, 1)]
    assert rows(detection.monitors(f.limit(0))) == []


def test_outliers_against_brute_force(spark):
    rnd = random.Random(5)
    vals = [rnd.choice(["0", "x", None, "1,000", "2", "2", "3.5", "-40", "0.05", "77"]) for _ in range(300)]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(vals)], "file string, row_index long, fx_rate string")
    xs = [(i, float(v.replace(",", ""))) for i, v in enumerate(vals) if v not in (None, "x", "0")]
    med = sorted(abs(v) for _, v in xs)[len(xs) // 2]
    want = {i: ("sign_reversal" if abs(v) / med > 10 and 0.5 < abs(v) * med < 2 else "balance_mismatch") for i, v in xs if abs(v) / med > 10 or abs(v) / med < 0.1}
    assert {r.row_index: r.finding_type for r in detection.numeric_outliers(df).collect()} == want
    assert detection.numeric_outliers(df.limit(2)).count() == 0


def test_verification_passes(spark, rows):
    f = spark.createDataFrame([
        ("f", 0, 1, "r1", "custom", "info", "note", "abc", "A", 0.9), ("f", 1, 1, "r1", "custom", "high", "account_name", "misc", "A", 0.9), ("f", 1, 2, "r2", "x", "high", "amount", "9", "A", 0.9),
        ("f", 1, 3, "r3", "x", "low", "amount", "9", "A", 0.9), ("f", 2, 1, "r1", "x", "high", "fx_rate", "1.1", "B", 0.5), ("f", 3, 1, "r1", "x", "high", "fx_rate", "500", "B", 0.2), ("f", 4, 1, "r1", "x", "low", "note", "z", "B", 0.2),
    ], "file string, row_index long, candidate int, rule_id string, finding_type string, severity string, field string, matched_value string, account string, confidence double")
    t = detection.triage(f, ["Amount", "FX_Rate", "Account_Name"])
    assert rows(t, "row_index", "candidate", "decision") == [(0, 1, "dismiss"), (1, 1, "dismiss"), (1, 2, "escalate"), (1, 3, "dismiss"), (2, 1, "escalate"), (3, 1, "escalate"), (4, 1, "keep")]
    v = detection.verify(t)
    assert rows(v, "row_index", "adjusted") == [(1, 1.0), (2, 0.4), (3, 1.0)]
    o = spark.createDataFrame([("f", 3, "fx_rate", 1.0, 9.0, "balance_mismatch", "critical", 0.8), ("f", 9, "amount", 1.0, 9.0, "balance_mismatch", "critical", 0.8)], "file string, row_index long, field string, value double, ratio double, finding_type string, severity string, confidence double")
    assert rows(detection.reconcile_findings(v, o), "row_index", "source") == [(1, "rules"), (2, "rules"), (3, "rules"), (9, "numbers")]


def score(spark, expr, *args):
    return spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(expr(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]


def test_scores(spark):
    assert score(spark, linking.synonym_score, "Revenue ", "net sales") == 1.0 and score(spark, linking.synonym_score, "revenue", "expense") == 0.0
    assert score(spark, linking.normalized_name, "Total Q1 Revenue") == "total_q1_revenue"
    assert score(spark, linking.archetype_score, "Budget", "Forecast") == 1.0 and score(spark, linking.archetype_score, "Budget", "Report") == 0.7 and score(spark, linking.archetype_score, "Data Extract", "???") == 0.3
    assert score(spark, linking.name_score, "Turnover", "turnover", "Revenue", "revenue") == 1.0 and score(spark, linking.name_score, "x", "", "y", "y") == 0.0


def test_links_and_clusters(spark):
    cols = "mention_id string, file_path string, archetype string, raw_name string, normalized_name string, formula string, business_meaning string, pos int"
    m = spark.createDataFrame([
        ("m1", "a", "Report", "Revenue", "revenue", "SUM(A1:A5)", "total revenue", 0), ("m2", "b", "Report", "Revenue", "revenue", "-B7", "total revenue", 0), ("m3", "b", "Report", "Payroll", "payroll", "", "wages", 1), ("m4", "a", None, None, None, None, None, 1),
    ], cols)
    for blocked in (True, False):
        links = linking.link_pairs(m, 0.5, blocked).cache()
        assert [(r.mention_a_id, r.mention_b_id) for r in links.collect()] == [("m1", "m2")]
    c = linking.clusters(m, links).first()
    assert (c.canonical_name, c.domain, c.n_mentions, c.n_files, sorted(c.conflicts)) == ("Revenue", "revenue", 2, 2, ["formula_mismatch", "sign_reversal"])
    assert [r.over_limit for r in linking.clusters(m, links, 1).collect()] == [True] and linking.clusters(m, links, 1, drop_larger=True).count() == 0 and linking.link_pairs(m.limit(0)).count() == 0
    assert linking.find_entity(linking.clusters(m, links), m.select(F.lit("m1").alias("label"), "raw_name").limit(1), "revenu").count() == 1
    assert linking.capped_mentions(m, 1).count() == 2


def test_mentions_from_documents(spark):
    dna = spark.createDataFrame([("f", "Budget", [("A1", "SUM(B:B)", 'The "Total West" of Gross_Sales'), ("A2", "C1", "something plain")], [("feeds NetIncome of the year", "A1", "B2")])], "file_path string, archetype string, formula_intents array<struct<cell_ref:string,raw_formula:string,business_meaning:string>>, cross_references array<struct<relationship:string,source_cell:string,target_cell:string>>")
    got = {r.raw_name for r in linking.mentions_from_dna(dna).collect()}
    assert {"Total West", "Gross_Sales", "something plain", "NetIncome"} <= got
    assert linking.mentions_from_dna(dna, 1).count() == 1
