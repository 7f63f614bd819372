import pytest

from pyspark.sql import functions as F

from tallyframe.operators import cleaning, profiling, reconcile

COLS = "id long, name string, email string, city string, balance double"
A = [(1, "Ann", "a@x", "Rome", 10.0), (2, "Bob", "b@x", "Oslo", 20.0), (3, "Cy", "c@x", "Bonn", 30.0), (4, "Di", "d@x", "Lyon", 40.0), (5, "Ed", "e@x", "Graz", 50.0), (6, "Flo", "f@x", "Kiel", 60.0), (7, "Gus", "g@x", "Linz", 70.0), (8, "Hal", "h@x", "Metz", 80.0), (9, "Ida", "i@x", "Nice", 90.0), (10, "Jo", "j@x", "Pisa", 100.0)]
B = [A[0], (2, "Bob", "b@x", "Oslo", 25.0), (3, "Cyril", "c@x", "Bonn", 30.0), (4, "Di", "d@x", "Lille", 40.0), A[4], A[5], A[6], A[7], (11, "Kim", "k@x", "Ulm", 5.0)]


@pytest.fixture
def ab(spark):
    return spark.createDataFrame(A, COLS), spark.createDataFrame(B, COLS)


def test_compare(ab, rows):
    assert rows(reconcile.compare(*ab, ["id"])) == [(2, 1, 3, 3, 5, 62.5, 72.73)]
    assert rows(reconcile.orphans(*ab, ["id"]), "id") == [(10,), (9,)]
    assert rows(reconcile.conflicts(*ab, ["id"]), "id", "column_name") == [(2, "balance"), (3, "name"), (4, "city")]
    with pytest.raises(ValueError, match="not found"):
        reconcile.compare(*ab, ["nope"])


def test_compare_without_rows(ab, rows):
    a, b = ab
    assert rows(reconcile.compare(a.limit(0), b.limit(0), ["id"])) == [(0, 0, 0, 0, 0, None, None)]
    assert rows(reconcile.compare(a, b.limit(0), ["id"])) == [(10, 0, 10, 0, 0, None, 0.0)]


def test_null_keys_meet_and_the_last_row_holds(spark, rows):
    a = spark.createDataFrame([(None, 1, 1), (1, 1, 1), (1, 2, 2)], "k int, v int, o int")
    b = spark.createDataFrame([(None, 1, 1), (1, 2, 1)], "k int, v int, o int")
    assert rows(reconcile.compare(a, b, ["k"], ["v"], ["o"]), "exact_matches", "conflicts") == [(2, 0)]


@pytest.mark.parametrize("how,n", [("inner", 8), ("left", 10), ("right", 9), ("outer", 11)])
def test_merge(ab, how, n):
    m = reconcile.merge(*ab, ["id"], how)
    assert m.count() == n
    assert m.columns == ["id", "name_a", "email_a", "city_a", "balance_a", "name_b", "email_b", "city_b", "balance_b"]
    assert m.where("id is null").count() == 0


def test_row_hash_keeps_values_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c")], "x string, y string").select(reconcile.row_hash(["x", "y"]).alias("h"))
    h = [r.h for r in df.collect()]
    assert len(set(h)) == 3 and all(len(x) == 16 for x in h)


def test_cleaning(spark, rows):
    df = spark.createDataFrame([("  a  b\t", 1), (None, 2), ("", 3), ("É-1!", 4)], "s string, i int")
    got = {op: [r[0] for r in cleaning.clean(df, "s", op).orderBy("i").select("s").collect()] for op in ("upper", "strip", "trim_spaces", "remove_special")}
    assert got == {"upper": ["  A  B\t", None, "", "É-1!"], "strip": ["a  b", None, "", "É-1!"], "trim_spaces": ["a b", None, "", "É-1!"], "remove_special": ["  a  b\t", None, "", "1"]}
    with pytest.raises(ValueError, match="unknown operation"):
        cleaning.clean(df, "s", "nope")
    with pytest.raises(ValueError, match="not found"):
        cleaning.clean(df, "nope", "upper")
    na = spark.createDataFrame([("NA", "x"), ("n/a", None)], "a string, b string")
    assert rows(cleaning.na_to_null(na)) == [(None, None), (None, "x")]


def test_profile(ab):
    a, _ = ab
    p = {r.column_name: r for r in profiling.column_profile(a).collect()}
    assert p["id"].potential_key and p["id"].n_rows == 10 and len(p) == 5
    assert profiling.duplicate_rows(a.unionByName(a.limit(1))).first().n_duplicates == 1
    assert profiling.structure_type(a) == "Dimension/Reference"
    empty = {r.column_name: r for r in profiling.column_profile(a.limit(0)).collect()}
    assert empty["id"].cardinality is None and empty["id"].null_pct is None
    assert profiling.duplicate_rows(a.limit(0)).first().duplicate_pct is None


def test_drift(ab, spark):
    a, b = ab
    assert profiling.drift(a, b).where("change != 'same'").count() == 0
    other = spark.createDataFrame([(1, "x", "d", 1.0)], "id string, name string, department string, salary double")
    got = {r.column_name: r.change for r in profiling.drift(a, other).collect()}
    assert got == {"id": "type_changed", "name": "same", "email": "removed", "city": "removed", "balance": "removed", "department": "added", "salary": "added"}
    assert profiling.drift(a, other).where("change = 'type_changed'").first().safe


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id long, name string, value long")
    suite = profiling.suite(df)
    assert suite.count() == 11 and suite.where("expectation = 'row_count'").first()[2:4] == (1.0, 4.0)
    assert profiling.validation_summary(profiling.validate(df, suite)).first() == (11, 11, 0, 100.0)
    drifted = spark.createDataFrame([(1, 5, "x"), (2, None, "x")], "id long, value long, extra string")
    failed = {(r.expectation, r.column_name) for r in profiling.validate(drifted, suite).where("not passed").collect()}
    assert failed == {("columns_exist", None), ("not_null", "name"), ("unique", "name"), ("type", "name"), ("not_null", "value")}
    assert profiling.validate(drifted, suite.limit(0)).count() == 0
    assert profiling.suite(df.limit(0)).where("expectation = 'row_count'").count() == 0


def test_describe(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "a"), (None, None)], "x double, s string")
    r = profiling.describe_numbers(df).first()
    assert (r.n, r["min"], r.q50, r["max"]) == (3, 1.0, 2.0, 4.0)
    t = profiling.describe_texts(df).first()
    assert (t.n, t.n_unique, t.top, t.freq) == (3, 2, "a", 2)
    assert profiling.describe_texts(df.limit(0)).first().n == 0
    assert profiling.describe_numbers(df.select("s")).count() == 0


def test_invariant_to_partitions(ab, rows):
    a, b = ab
    want = rows(reconcile.compare(a, b, ["id"]))
    assert rows(reconcile.compare(a.repartition(7), b.repartition(3, F.col("city")), ["id"])) == want
