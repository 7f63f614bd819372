import difflib
import random

import pytest

from tallyframe.functions import similarity as sim
from tallyframe.operators import fuzzy, profiling, reconcile, summaries, templates
from tallyframe.sources import readers


def test_counts_totals_and_top_lists(spark, rows):
    f = spark.createDataFrame([("a", "X", "HIGH", "v"), ("a", "X", None, "v"), ("b", "Y", "LOW", "v")], "file string, type string, severity string, value string")
    assert rows(summaries.counts_by(f)) == [("severity", "HIGH", 1, 1), ("severity", "LOW", 1, 1), ("severity", "UNKNOWN", 1, 1), ("type", "X", 2, 1), ("type", "Y", 1, 1)]
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "file string")
    assert summaries.batch_totals(files, f).first()[:] == (3, 2, 3, 1.0)
    assert summaries.batch_totals(files.limit(0), f.limit(0)).first()[:] == (0, 0, 0, 0.0)
    assert summaries.counts_by(f.limit(0)).count() == 0
    risks = spark.createDataFrame([(f"f{i:02}", 40 + i) for i in range(30)], "file string, risk_score int")
    assert [r.file for r in summaries.high_risk_files(risks).collect()] == [f"f{i}" for i in range(10, 20)]


def test_detection_summary_counts_every_file(spark, rows):
    r = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "file string, row_index long")
    f = spark.createDataFrame([("a", 0, "r1", 0.5), ("a", 1, "r1", 0.75)], "file string, row_index long, rule_id string, confidence double")
    s = summaries.detection_summary(f.limit(1), r, f)
    assert rows(s) == [("a", 2, 1, 0.5, 1, 1), ("b", 1, 0, 0.0, 0, 0)]
    assert summaries.detection_totals(s).first()[:] == (2, 3, 1, 0.5)
    assert summaries.detection_totals(s.limit(0)).first()[:] == (0, 0, 0, 0.0)


def test_quartiles_against_brute_force(spark):
    rnd = random.Random(2)
    data = [(rnd.choice([None, 0.0, 1.0, rnd.gauss(0, 1), 10 ** rnd.uniform(-3, 9)]), 5.0, None) for _ in range(800)] + [(float("nan"), 5.0, None), (float("inf"), 5.0, None)]
    got = {r.column_name: r for r in profiling.describe_numbers(spark.createDataFrame(data, "x double, same double, none double")).collect()}
    v = sorted(x for x, *_ in data if x is not None and x == x)

    def quantile(q):
        at = q * (len(v) - 1)
        lo = int(at)
        return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)

    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert got["x"][name] == pytest.approx(quantile(q)) and got["same"][name] == 5.0 and got["none"][name] is None
    assert got["none"].n == 0 and got["same"].n == len(data)


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1, -0.0, [1], None), (2, 0.0, [1], None), (2, None, None, None)], "k long, v double, a array<int>, n string")
    got = {r.column_name: (r.n_rows, r.n_null, r.n_distinct) for r in profiling.column_profile(df).collect()}
    assert got == {"k": (3, 0, 2), "v": (3, 1, 1), "a": (3, 1, 1), "n": (3, 3, 0)}
    assert {r.n_rows for r in profiling.column_profile(df.limit(0)).collect()} == {0}
    near = {r.column_name: r.n_distinct for r in profiling.column_profile(df, approximate=True).collect()}
    assert near == {"k": 2, "v": 1, "a": 1, "n": 0}


def test_similar_pairs_at_every_threshold(spark):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 18))) for _ in range(70)})
    df = spark.createDataFrame([(w,) for w in words], "v string")
    for threshold in (55, 70, 80, 92):
        want = {(a, b) for a in words for b in words if sim.indel_ratio(a, b) >= threshold}
        assert {(r.a, r.b) for r in fuzzy.similar_pairs(df, df, threshold).collect()} == want


def test_close_matches_as_in_the_standard_library(spark):
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9))) for _ in range(40)]
    pool = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9))) for _ in range(60)})
    got = {}
    for r in fuzzy.difflib_matches(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(p,) for p in pool], "c string"), "c", 4, 0.6).orderBy("rank").collect():
        got.setdefault(r.word, []).append(r.candidate)
    for w in words:
        assert got.get(w, []) == difflib.get_close_matches(w, pool, 4, 0.6)


def test_orphan_details_by_source(spark):
    a = spark.createDataFrame([(i, "x") for i in range(20)], "id long, v string")
    b = spark.createDataFrame([(5, "y"), (99, None), (None, "z")], "id long, v string")
    d = reconcile.orphan_details(a, b, ["id"], "both", 3)
    assert [(r.source, r.total) for r in d.orderBy("source").collect()] == [("a", 19)] * 3 + [("b", 2)] * 2
    assert reconcile.orphan_details(a, b, ["id"], "b", None).count() == 2 and reconcile.orphan_details(a, a, ["id"], "a").count() == 0
    with pytest.raises(ValueError):
        reconcile.orphan_details(a, b, ["id"], "c")


def test_template_levels_and_loops(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "gone")], "hierarchy_id string, parent_id string")
    assert {r.hierarchy_id: r.level for r in templates.template_rows(nodes).collect()} == {"a": 1, "b": 2, "x": None, "y": None, "z": 2}
    assert templates.template_rows(nodes.limit(0)).count() == 0


def test_catalogue_texts_prompts_and_index(tmp_path):
    c = templates.Catalogue(str(tmp_path), "skills")
    c.save("s1", {"name": "One", "prompt_file": "p.md", "patterns": {"a": 1}})
    (tmp_path / "skills" / "p.md").write_text("do it")
    assert c.text("s1", "prompt_file") == "do it" and c.text("s1", "documentation_file") is None and c.text("none", "prompt_file") is None
    c.save("s2", {"prompt_file": "../../secret"})
    assert c.text("s2", "prompt_file") is None
    assert c.set_field("s1", "patterns", {"b": 2})["patterns"] == {"a": 1, "b": 2}
    assert len(c.add_prompt("s1", {"text": "hi"})["prompts"]) == 1
    assert {x["id"]: x["prompt_count"] for x in c.index()} == {"s1": 1, "s2": 0}


def test_lines_of_large_and_small_files(spark, tmp_path):
    for name, n in (("a.txt", 5), ("b.txt", 20_000)):
        (tmp_path / name).write_text("\ufeff" + "\n".join(f"line {i}" for i in range(n)) + "\n")
    (tmp_path / "c.txt").write_bytes("caf\u00e9\n".encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {}
        for r in readers.numbered_lines(spark, str(tmp_path), whole_up_to=1000).collect():
            got.setdefault(r.file, []).append((r.row_index, r.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: sorted(v) for k, v in got.items()} == {"a.txt": [(i, f"line {i}") for i in range(5)], "b.txt": [(i, f"line {i}") for i in range(20_000)], "c.txt": [(0, "caf\u00e9")]}
