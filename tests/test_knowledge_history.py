import json

from tallyframe.operators import detection, history, knowledge, profiling


def test_rules_of_knowledge(spark, tmp_path):
    node = lambda id_, type_, name="Missing Balance of the Ledger", tags=None, **props: {"id": id_, "type": type_, "name": name, "tags": tags, "properties": props}
    nodes = [
        node("n1", "note", detection_rule={"pattern": r"^\d+$", "field_targets": ["Amount"], "finding_type": "Rounding", "severity": "HIGH"}),
        node("n2", "gap", gap_id="G1", severity="low"), node("n3", "gap"), node("n4", "hierarchy_type", sheet_name_patterns=["P&L", "B.S."]), node("n5", "formula_domain", functions=["SUM"]),
        node("n6", "fact", category="gap"), node("n7", "fact", category="x"), node("n8", "rule", pattern="abc", detection_field="Memo"), node("n9", "standard", tags=["naming"], name="The one"), node("n10", "terminology"), node("n11", "complexity_pattern", name="the and"), node(None, "rule"),
    ]
    (tmp_path / "kb.json").write_text(json.dumps({"nodes": nodes}))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "list.json").write_text("[]")
    got = {r.rule_id: r for r in knowledge.load_rules(spark, str(tmp_path)).collect()}
    assert set(got) == {f"rule_n{i}" for i in (1, 2, 4, 5, 6, 8)}
    assert (got["rule_n1"].finding_type, got["rule_n1"].severity, got["rule_n1"].field_targets) == ("rounding_discrepancy", "high", ["Amount"])
    assert got["rule_n2"].pattern == r"(?i)\b(?:missing|balance|ledger)\b" and got["rule_n2"].severity == "low"
    assert got["rule_n4"].pattern == r"(?i)\b(?:P&L|B\.S\.)\b" and got["rule_n8"].field_targets == ["Memo"] and got["rule_n8"].finding_type == "missing_account"
    more = knowledge.load_rules(spark, str(tmp_path), (*knowledge.NODE_TYPES, "terminology"))
    assert more.count() == 7
    rules = detection.rules_from(more)
    rows = spark.createDataFrame([("f", 0, "P&L total"), ("f", 1, "12")], "file string, row_index long, Amount string")
    assert {r.rule_id for r in detection.scan(rows, rules, ["Amount"]).collect()} == {"rule_n1"}


def test_history(spark, tmp_path):
    fb = str(tmp_path / "fb")
    ids = {history.record_feedback(spark, fb, f"f{i}", i > 0, rule_id="r", finding_type="t") for i in range(2)}
    assert len(ids) == 2
    t = detection.feedback_tallies(spark.read.json(fb)).first()
    assert (t.n, t.confirmed, t.dismissed) == (2, 1, 1)
    df = spark.createDataFrame([(1,), (None,)], "a long")
    for d in (df, df.dropna()):
        history.keep_validation(profiling.validate(d, profiling.suite(df.dropna())), str(tmp_path / "v"), "s")
    h = history.latest(spark, str(tmp_path / "v"), suite_name="s").collect()
    assert [r.n_failed > 0 for r in h] == [False, True] and history.latest(spark, str(tmp_path / "v"), suite_name="none").count() == 0
    f = spark.createDataFrame([("a", "x", "custom", 2.0, "r", 1)], "account string, field string, finding_type string, confidence double, rule_id string, row_index long")
    assert history.keep_counterexample(f, detection.monitors(f), str(tmp_path / "c")) and not history.keep_counterexample(f, detection.monitors(f.limit(0)), str(tmp_path / "c"))
    assert history.latest(spark, str(tmp_path / "c")).count() == 1
