import datetime as dt
import random

import pytest

from tallyframe.operators import copy_diff
from tallyframe.operators.copy_diff import Compared, cell_positions, diff_copies, element_hash, peel

SCHEMA = "id long, name string, email string, city string, balance double, updated_at timestamp_ntz, kind string, value_a string"
FIELDS = (Compared("name"), Compared("email", "folded"), Compared("city"), Compared("balance", "number", 0.005))


def row(i, name="n", email="e@x", city="c", balance=1.0, day=1, kind="own", value_a="own"):
    return (i, name, email, city, balance, dt.datetime(2024, 1, day), kind, value_a)


def diff(spark, a, b):
    return sorted((r["id"], r["kind"]) for r in diff_copies(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["id"], FIELDS, ["updated_at"]).select("id", "kind").collect())


def test_hashes_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    pairs = [(random.randint(-(2**63), 2**63 - 1), random.randint(-(2**63), 2**63 - 1)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("e", F.xxhash64("a", "b"))
    for r in df.withColumn("p", copy_diff._cell_column(F.col("e"), 192)).collect():
        assert element_hash(r.a, r.b) == r.e
        assert cell_positions(r.e, 192) == list(r.p)


def test_peeling_gives_all_or_says_so():
    rnd = random.Random(1)
    for n in (0, 1, 40, 96, 400):
        elements = [(rnd.randint(-(2**62), 2**62), rnd.randint(-(2**62), 2**62), rnd.choice((1, -1))) for _ in range(n)]
        cells = {}
        for k, r, s in elements:
            e = element_hash(k, r)
            for c in cell_positions(e, 192):
                v = cells.setdefault(c, [0, 0, 0, 0])
                v[0] += s
                v[1] ^= k
                v[2] ^= r
                v[3] ^= e
        out, clean = peel(cells, 192)
        assert clean == (n < 400)
        if clean:
            assert sorted(out) == sorted((k, s) for k, _, s in elements)


def test_fields_missing_rows_and_notation(spark):
    a = [row(1), row(2, name=" Zoé "), row(3, email="A@X"), row(4, city=" "), row(5, balance=1.0), row(6, balance=None), row(7), row(None, name="x"), row(9, balance=2.0), row(10, city="C")]
    b = [row(1), row(2, name="Zoé"), row(3, email="a@x "), row(4, city=None), row(5, balance=1.0049), row(6, balance=0.0), row(8), row(None, name="y"), row(9, balance=2.005), row(10, city="c")]
    assert diff(spark, a, b) == [(6, "balance"), (7, "only_in_a"), (8, "only_in_b"), (9, "balance"), (10, "city")]


def test_latest_row_holds_and_repeats_count_once(spark):
    a = [row(1, name="old", day=1), row(1, name="new", day=2), row(1, name="new", day=2)]
    b = [row(1, name="new", day=1), row(2, name=None), row(2, name=None)]
    assert diff(spark, a, b) == [(2, "only_in_b")]


@pytest.mark.parametrize("n", [3, 600])
def test_empty_copies_and_long_texts(spark, n):
    a = [row(i, name="x" * 100_000 if i == 0 else "n", balance=float("nan") if i == 1 else 1.0) for i in range(n)]
    assert diff(spark, a, a) == []
    assert diff(spark, [], []) == []
    assert diff(spark, a, []) == sorted((i, "only_in_a") for i in range(n))
    assert diff(spark, [], a) == sorted((i, "only_in_b") for i in range(n))


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    a = {i: row(i, balance=float(rnd.randint(0, 3)), name=rnd.choice("ab")) for i in range(3000) if rnd.random() < 0.9}
    b = {i: (r if rnd.random() < 0.8 else row(i, balance=float(rnd.randint(0, 3)), name=rnd.choice("ab"))) for i, r in a.items()}
    b |= {i: row(i) for i in range(3000, 3100)}
    want = [(i, "only_in_a") for i in a if i not in b] + [(i, "only_in_b") for i in b if i not in a]
    want += [(i, f) for i in a if i in b for f, k in (("name", 1), ("balance", 4)) if a[i][k] != b[i][k]]
    assert diff(spark, list(a.values()), list(b.values())) == sorted(want)
    # too small an estimate leaves buckets unpeeled; their keys are compared one by one
    monkeypatch.setattr(copy_diff, "estimate_difference", lambda e: 1)
    assert diff(spark, list(a.values()), list(b.values())) == sorted(want)
