import datetime as dt
import random

from pyspark.sql import functions as F

from tallyframe.operators import hierarchy, orphan_refs

D = lambda n: dt.datetime(2024, 1, n)


def orphans(spark, refs, parents, arrays=False):
    t = "array<string>" if arrays else "string"
    r = spark.createDataFrame(refs, f"rid string, target {t}, at timestamp_ntz, target_id string, state string")
    p = spark.createDataFrame(parents, "pid string, at timestamp_ntz, op string, deleted string")
    long = orphan_refs.references(r, "refs", "rid", "parents", "target", "at")
    return orphan_refs.find_orphans(long, orphan_refs.targets(p, "parents", "pid", "at", F.col("op") == "delete"))


def test_states_of_references(spark, rows):
    refs = [("r1", " P1 ", D(5)), ("r2", "p2", D(5)), ("r3", "p3", D(5)), ("r4", "n/a", D(5)), ("r5", None, D(5)), ("r6", " ", D(5)), ("r7", "gone", D(5)), ("r7", "GONE", D(6)), ("r8", "p3", D(9)), ("r9", "p4", None), (None, "nix", D(3)), (None, "nix", D(2))]
    parents = [("p1", D(1), "insert"), ("P2 ", D(1), "insert"), ("p2", D(2), "delete"), ("p3", D(8), "insert"), ("p3", D(8), "insert"), ("p4", D(9), None), (None, D(1), "insert")]
    out = orphans(spark, [(*r, "x", "y") for r in refs], [(*p, "z") for p in parents])
    assert rows(out, "record_id", "target_id", "state", "period") == [(None, "nix", "missing", "2024-01"), ("r2", "p2", "deleted", "2024-01"), ("r3", "p3", "late", "2024-01"), ("r7", "gone", "missing", "2024-01")]


def test_arrays_repeats_and_empty_tables(spark, rows):
    refs = [("r1", ["a", "A ", None, "b", "-"], D(2), "", ""), ("r1", None, D(1), "", ""), ("r2", [], D(1), "", "")]
    out = orphans(spark, refs, [("b", D(1), "insert", ""), ("b", D(1), "delete", "")], arrays=True)
    assert rows(out, "record_id", "target_id", "state") == [("r1", "a", "missing"), ("r1", "b", "deleted")]
    assert rows(orphan_refs.orphan_counts(out), "state", "n_refs") == [("deleted", 1), ("missing", 1)]
    assert rows(orphans(spark, [], [])) == []
    assert len(rows(orphans(spark, refs, [], arrays=True))) == 2


def links(spark, data):
    df = spark.createDataFrame([(*r, "own", "own", "own") for r in data], "t string, h string, p string, l int, at timestamp_ntz, kind string, depth string, root string")
    return hierarchy.links(df, "t", "h", "p", "at", "l")


def test_faults_of_hierarchies(spark, rows):
    data = [("x", "A", None, 1), ("x", "B", " a ", 2), ("x", "C", "B", 9), ("x", "D", "D", None), ("x", "E", "d", 1), ("x", "F", "E", 1), ("x", "M", "nope", 1), ("x", "N", "M", 2), ("x", "R", "-", 3), ("x", "S", " ", None), ("x", "P", "Q", 1), ("x", "Q", "P", 1), ("y", "B", "A", 1), (None, "A", None, 1), ("x", None, "A", 1), ("x", "", "A", 1)]
    n = links(spark, [(*r, D(1)) for r in data])
    got = rows(hierarchy.faults(n, hierarchy.resolve(n)))
    assert got == [("x", "C", "wrong_level"), ("x", "D", "cycle"), ("x", "E", "below_cycle"), ("x", "F", "below_cycle"), ("x", "M", "missing_parent"), ("x", "N", "below_missing"), ("x", "P", "cycle"), ("x", "Q", "cycle"), ("x", "R", "wrong_level"), ("y", "B", "missing_parent")]


def test_paths_and_descendants(spark, rows):
    n = links(spark, [("x", "A", None, 1, D(1)), ("x", "B", "A", 2, D(1)), ("x", "C", "B", 3, D(2)), ("x", "C", "A", 3, D(1)), ("x", "Z", "Z", 1, D(1))])
    p = hierarchy.paths(n, hierarchy.resolve(n))
    assert rows(hierarchy.full_hierarchy(p)) == [("x", "A", "A", 1, "A", 2), ("x", "B", "A > B", 2, "A", 1), ("x", "C", "A > B > C", 3, "A", 0)]
    assert rows(hierarchy.descendants(p)) == [("x", "A", "B", 1), ("x", "A", "C", 2), ("x", "B", "C", 1)]
    e = links(spark, [])
    r = hierarchy.resolve(e)
    assert rows(hierarchy.faults(e, r)) == [] and rows(hierarchy.paths(e, r)) == []


def test_deep_chain_and_long_loop_against_brute_force(spark):
    rnd = random.Random(3)
    parent = {f"N{i}": f"N{i - 1}" if i else None for i in range(150)}
    parent |= {f"L{i}": f"L{(i + 1) % 37}" for i in range(37)} | {f"T{i}": f"T{i - 1}" if i else "L5" for i in range(50)}
    parent |= {f"X{i}": rnd.choice([f"X{j}" for j in range(60)] + [None, "missing"]) for i in range(60)}
    n = links(spark, [("t", k, v, None, D(1)) for k, v in parent.items()])
    got = {r.node: (r.kind, r.depth) for r in hierarchy.resolve(n).collect()}

    def brute(x):
        seen, at, depth = [x], parent[x], 1
        while at is not None:
            if at not in parent:
                return ("missing_parent" if depth == 1 else "below_missing", None)
            if at in seen:
                return ("cycle" if at == x else "below_cycle", None)
            seen.append(at)
            at, depth = parent[at], depth + 1
        return ("ok", depth)

    assert got == {k.lower(): brute(k) for k in parent}


def test_subtree_sizes_against_brute_force(spark):
    rnd = random.Random(11)
    parent = {0: None} | {i: rnd.choice([None, i - 1, i - 1, rnd.randrange(i)]) for i in range(1, 200)}
    below = dict.fromkeys(parent, 0)
    for i in parent:
        p = parent[i]
        while p is not None:
            below[p] += 1
            p = parent[p]
    nodes = spark.createDataFrame([("t", str(i), None if p is None else str(p)) for i, p in parent.items()], "tree string, node string, parent string")
    assert {int(r.node): r.n_descendants for r in hierarchy.subtree_sizes(nodes).collect()} == below
    assert hierarchy.subtree_sizes(nodes.limit(0)).count() == 0
