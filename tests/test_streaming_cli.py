import json
import os
from unittest import mock

import pytest

from tallyframe import cli, notify
from tallyframe.operators import detection, profiling
from tallyframe.streaming import incremental

EVENTS = "event_id long, user_id long, ts timestamp, value double"


def stream(spark, tmp_path, batches, schema, run, mode="append"):
    """Feeds JSON files one by one; the results as rows."""
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    df = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out")


def event(i, minute, user=1):
    return {"event_id": i, "user_id": user, "ts": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00Z", "value": 1.0}


def test_windows_on_a_stream_drop_late_rows(spark, tmp_path):
    out = stream(spark, tmp_path, [[event(1, 1), event(2, 2)], [event(3, 300)], [event(6, 310)], [event(4, 3), event(5, 600)]], EVENTS, lambda df: incremental.windowed(df, "ts", ["user_id"], "1 hour", late="10 minutes", value="value"))
    assert {(str(r.window_start), r.n) for r in out.collect()} >= {("2024-01-01 00:00:00", 2)}


def test_duplicates_on_a_stream(spark, tmp_path):
    out = stream(spark, tmp_path, [[event(1, 1), event(1, 1)], [event(1, 2), event(2, 3)]], EVENTS, lambda df: incremental.first_deliveries(df, "ts", ["event_id"]))
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def test_sequential_test_keeps_its_state(spark, tmp_path):
    batches = [[{"file": "f", "row_index": i, "hit": False} for i in range(a, a + 200)] for a in (0, 200)] + [[{"file": "g", "row_index": i, "hit": i < 5} for i in range(150)]]
    out = stream(spark, tmp_path, batches, "file string, row_index long, hit boolean", incremental.sequential_test_stream, "update")
    last = {r.file: r for r in out.orderBy("seen").collect()}
    assert (last["f"].seen, last["f"].decision, last["g"].decision) == (400, "clean", "anomalous")


def test_tallies_follow_a_feedback_folder(spark, tmp_path):
    (tmp_path / "fb").mkdir()
    (tmp_path / "fb" / "1.json").write_text('{"rule_id": "r", "finding_type": "t", "action": "confirmed"}\n{bad\n')
    q = incremental.running_tallies(incremental.feedback_stream(spark, str(tmp_path / "fb"))).writeStream.format("memory").queryName("tallies").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.rule_id, r.n, r.confirmed) for r in spark.table("tallies").where("rule_id is not null").collect()] == [("r", 1, 1)]


def test_batches_are_validated(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"a": 1}\n{"a": null}\n')
    suite = profiling.suite(spark.createDataFrame([(1,), (2,)], "a long"))
    s = spark.readStream.schema("a long").json(str(tmp_path / "in"))
    incremental.validate_batches(s, suite, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    r = spark.read.json(str(tmp_path / "out")).collect()
    assert len(r) == 1 and r[0].n_failed == 1


def test_sessions_and_batch_windows(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:10:00"), (3, 1, "2024-01-01 02:00:00")], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t as timestamp) ts")
    assert sorted(r.n for r in incremental.sessions(df, "ts", ["user_id"], "30 minutes").collect()) == [1, 2]
    assert incremental.windowed(df.limit(0), "ts", ["user_id"], "1 hour").count() == 0
    assert detection.LEAST_ROWS == 100


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,Ann\n2,Bob\n")
    (tmp_path / "b.csv").write_text("id,name\n1,Ann\n2,Rob\n3,Cy\n")
    (tmp_path / "r.txt").write_text("x\ty\n1\t2\n")
    return tmp_path


@pytest.mark.parametrize("args,want", [
    (["profile", "a.csv"], '"potential_key": true'), (["compare", "a.csv", "b.csv", "--keys", "id"], '"conflicts": 1'), (["merge", "a.csv", "b.csv", "--keys", "id"], '"name_b": "Rob"'),
    (["fuzzy", "a.csv", "b.csv", "--column", "name", "--threshold", "60"], '"value_b": "Ann"'), (["dedupe", "b.csv", "--column", "name", "--threshold", "60"], '"leader"'), (["diff", "a.csv", "b.csv"], "+3,Cy"),
    (["drift", "a.csv", "r.txt"], '"change": "removed"'), (["transform", "a.csv", "--column", "name", "--op", "upper"], '"after": "ANN"'), (["find", "."], "a.csv"), (["parse", "r.txt"], '"value": "2"'),
    (["query", "SELECT count(*) AS n FROM b", "--register", "b=b.csv"], '"n": 3'), (["fraud-detect", "a.csv"], ""), (["fx-validate", "a.csv"], ""), (["standards-check", "a.csv"], '"compliance_score": 100'), (["erp-detect", "a.csv"], '"system": "Oracle"'),
])
def test_commands(spark, files, capsys, monkeypatch, args, want):
    monkeypatch.chdir(files)
    a = cli.parser().parse_args([str(files / x) if x.endswith((".csv", ".txt")) and "=" not in x else f"b={files / 'b.csv'}" if x.startswith("b=") else str(files) if x == "." else x for x in args])
    cli.run(spark, a)
    assert want in capsys.readouterr().out


def test_suites_by_command(spark, files, capsys):
    cli.run(spark, cli.parser().parse_args(["expect", str(files / "a.csv"), "--output", str(files / "suite")]))
    cli.run(spark, cli.parser().parse_args(["validate", str(files / "b.csv"), "--suite", str(files / "suite")]))
    assert '"n_failed"' in capsys.readouterr().out


def test_notices():
    report = {"matches": 950, "conflicts": 3, "orphans_left": 1, "orphans_right": 2, "source_a": "x", "source_b": "y"}
    assert "950 matches" in notify.reconciliation_text(report)
    with mock.patch("urllib.request.urlopen") as opened:
        opened.return_value.__enter__.return_value.read.return_value = b"ok"
        assert notify.ChatNotifier("http://hook").send_reconciliation(report) == "ok"
        sent = json.loads(opened.call_args[0][0].data)
        assert "950 matches" in sent["text"] and opened.call_args[0][0].full_url == "http://hook"
        opened.return_value.__enter__.return_value.read.return_value = b'{"a": 1}'
        assert notify.HttpClient("http://api/").get("/x") == {"a": 1}
