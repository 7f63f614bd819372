import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import similarity as sim
from tallyframe.operators import fuzzy, graph


def one(spark, expr, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(expr(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize("a,b,want", [("hello", "hello", 1.0), ("", "", 1.0), ("hello", "", 0.0), ("hello", "hallo", 0.8), ("tide", "diet", 0.25), ("diet", "tide", 0.5), (None, "x", None)])
def test_ratio(spark, a, b, want):
    assert one(spark, sim.similarity, a, b) == want


def test_indel_ratio():
    assert sim.indel_ratio("Salesforce 48 Inc.", "Salesforce 48") == pytest.approx(83.87096774193549)
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in "ab")
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        want = 100.0 if not a and not b else 200.0 * m[-1][-1] / (len(a) + len(b))
        assert sim.indel_ratio(a, b) == pytest.approx(want)


def test_blocks_and_opcodes(spark):
    assert one(spark, sim.matching_blocks, "abcdef", "abcxyz")[0].content == "abc"
    ops = one(spark, sim.opcodes, "abcdef", "abxdef")
    assert [(o.operation, o.a_content, o.b_content) for o in ops] == [("equal", "ab", "ab"), ("replace", "c", "x"), ("equal", "def", "def")]
    assert one(spark, sim.explanation, "a", "a") == "Identical - no changes" and one(spark, sim.explanation, "", "x") == "Added: 'x'"
    assert one(spark, sim.real_quick_ratio, "ab", "abcd") == pytest.approx(difflib.SequenceMatcher(None, "ab", "abcd").real_quick_ratio())
    assert "-a" in one(spark, sim.unified_diff, "a\nb", "b") and "! " not in one(spark, sim.ndiff, "ab", "ac")


def test_lists_and_maps(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4], {"a": 1, "b": 2}, {"b": 3, "c": 4}), ([], [], {}, {})], "a array<int>, b array<int>, m map<string,int>, n map<string,int>")
    r = df.select(sim.list_difference(F.col("a"), F.col("b")).alias("l"), sim.map_difference(F.col("m"), F.col("n")).alias("m")).collect()
    assert (r[0].l.added, r[0].l.removed, r[0].l.common, r[0].l.jaccard) == ([4], [1], [2, 3], 0.5)
    assert (r[0].m.added, r[0].m.removed, r[0].m.changed, r[0].m.unchanged) == (["c"], ["a"], ["b"], [])
    assert r[1].l.jaccard == 1.0


def words(n, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 14))) for _ in range(n)]
    return base + [w[:3] + rnd.choice("xyz") + w[4:] for w in base[: n // 2]]


@pytest.mark.parametrize("threshold", [50, 75, 80, 90, 100])
def test_similar_pairs_against_brute_force(spark, threshold):
    a, b = words(40, 1), words(40, 1)[::-1] + words(20, 2)
    df = lambda w: spark.createDataFrame([(x, "own") for x in w] + [(None, "own")], "v string, a string").select("v")
    got = {(r.a, r.b) for r in fuzzy.similar_pairs(df(a), df(b), threshold).collect()}
    assert got == {(x, y) for x in a for y in b if sim.indel_ratio(x, y) >= threshold}


def test_best_match_and_close_matches(spark, rows):
    a = spark.createDataFrame([("apple inc",), ("zzz",), (None,)], "x string")
    b = spark.createDataFrame([("apple ink",), ("apple inx",), ("apple",)], "y string")
    assert rows(fuzzy.fuzzy_match(a, "x", b, "y", 80), "value_a", "value_b") == [("apple inc", "apple ink")]
    assert [(r.candidate, r["rank"]) for r in fuzzy.close_matches(a, "x", b, "y", 2, 60).orderBy("rank").collect()] == [("apple ink", 1), ("apple inx", 2)]
    assert fuzzy.fuzzy_match(a.limit(0), "x", b, "y").count() == 0


def test_dedupe_is_greedy_in_order(spark):
    w = words(60, 3)
    df = spark.createDataFrame(list(enumerate(w)), "i long, w string")
    got = {r.value: r.leader for r in fuzzy.fuzzy_dedupe(df, "w", 70, "i").collect()}
    leaders, want = [], {}
    for x in dict.fromkeys(w):
        lead = next((y for y in leaders if sim.indel_ratio(y, x) >= 70), None)
        if lead is None:
            leaders.append(x)
        want[x] = lead if lead is not None else x
    assert got == want


def test_star_components(spark, rows):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("x", "x"), (None, "y")] + [(f"p{i}", f"p{i + 1}") for i in range(20)], "u string, v string")
    got = dict((r.vertex, r.label) for r in graph.star_components(e).collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", **{f"p{i}": "p0" for i in range(21)}}
    assert rows(graph.star_components(e.limit(0))) == []


def firms(n, seed):
    rnd = random.Random(seed)
    part = lambda: "".join(rnd.choice(["del", "mar", "to", "sal", "ost", "pel", "mun", "zan", "thu", "hes", "bra", "fro"]) for _ in range(3)).title()
    return [f"{part()} {part()} {rnd.choice(['Foods', 'Logistics', 'Electrical', 'Manufacturing', 'Equipment'])} {rnd.choice(['GmbH', 'Ltd', 'Inc.', 'B.V.'])}" for _ in range(n)]


def best(texts, others, threshold):
    got = {x: min(((-sim.indel_ratio(x, y), y) for y in others), default=(0, None)) for x in texts}
    return {(x, y, -s) for x, (s, y) in got.items() if y is not None and -s >= threshold}


@pytest.mark.parametrize("threshold", [70, 80, 90])
def test_best_matches_of_blocks_compare_few_pairs(monkeypatch, threshold):
    right = firms(600, 1)
    left = [x[:4] + x[5:] for x in right[:200]] + firms(100, 2) + ["", "é" * 80]
    letters, seen, plain = {}, [], fuzzy.ratios
    a, bs = fuzzy.Block(left, letters), [fuzzy.Block(right[i : i + 100], letters) for i in range(0, 600, 100)] + [fuzzy.Block([""], letters)]
    monkeypatch.setattr(fuzzy, "ratios", lambda *x: seen.append(len(x[3])) or plain(*x))
    assert set(fuzzy.best_of(a, bs, threshold, len(letters))) == best(left, [*right, ""], threshold)
    assert sum(seen) < 0.2 * len(left) * len(right)


@pytest.mark.parametrize("threshold", [70, 80, 90])
def test_best_match_against_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(fuzzy, "BLOCK", 16)
    monkeypatch.setattr(fuzzy, "PART", 64)
    right = firms(150, 1) + words(30, 4) + ["x" * 70, "a" * 300]
    left = [x[:4] + x[5:] for x in right[:60]] + words(20, 5) + words(30, 4)[:9] + ["", "x" * 68 + "y"]
    df = lambda w: spark.createDataFrame([(x,) for x in w] + [(None,)], "v string")
    match = fuzzy.fuzzy_match(df(left), "v", df(right), "v", threshold)
    assert {(r.value_a, r.value_b, r.score) for r in match.collect()} == best(left, right, threshold)
    assert "CartesianProduct" in match._jdf.queryExecution().executedPlan().toString()  # no table of blocks at the driver


@pytest.mark.parametrize("threshold", [70, 80])
def test_best_matches_carry_over_parts_and_spare_pairs(monkeypatch, threshold):
    left, other = firms(200, 1), firms(400, 2)
    near = [x[:4] + x[5:] for x in left]
    letters, seen, plain = {}, [], fuzzy.ratios
    a, first, second = (fuzzy.Block(x, letters) for x in (left, near, other))
    monkeypatch.setattr(fuzzy, "ratios", lambda *x: seen.append(len(x[3])) or plain(*x))

    def compared(*parts):
        top, who = [float(threshold)] * len(left), [None] * len(left)
        top = fuzzy.np.array(top)
        for part in parts:
            seen.clear()
            fuzzy.better(a, [part], top, who, len(letters))
        return sum(seen), {(x, y, s) for x, y, s in zip(left, who, top, strict=True) if y is not None}

    alone, _ = compared(second)
    after, found = compared(first, second)
    assert found == best(left, [*near, *other], threshold)
    assert after < 0.5 * alone
