import random

import pytest

from tallyframe.llm import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((find(x), x) for x in root)


def run(spark, edges):
    return sorted((r.group_id, r.member) for r in components.groups(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect())


SHAPES = {
    "none": [], "selfs": [("a", "a"), (None, "b"), ("c", None)], "pair": [("b", "a"), ("a", "b")],
    "path": [(f"p{i:03}", f"p{i + 1:03}") for i in range(70)],
    "ring": [(f"r{i:03}", f"r{(i + 1) % 41:03}") for i in range(41)],
    "star": [("hub", f"s{i:03}") for i in range(60)],
    "handles": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "e"), ("e", "c"), ("d", "x"), ("x", "y"), ("y", "z"), ("z", "d"), ("q", "r")],
    "clique": [(f"k{i}", f"k{j}") for i in range(7) for j in range(i)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    assert run(spark, SHAPES[shape]) == brute(SHAPES[shape])


@pytest.mark.parametrize("n,m", [(200, 150), (200, 260)])
def test_random_graphs(spark, n, m):
    rnd = random.Random(m)
    edges = [(f"v{rnd.randrange(n):03}", f"v{rnd.randrange(n):03}") for _ in range(m)]
    assert run(spark, edges) == brute(edges)


def test_mentions(spark, rows):
    links = spark.createDataFrame([("l1", " M_B ", "m_a", 0.5, "x"), ("l2", "m_b", "M_C", 0.4, "x"), ("l3", "m_c", "m_d", None, "x"), ("l4", "m_e", "m_e", 0.9, "x"), ("l5", "", "m_a", 0.9, "x")], "link_id string, mention_a_id string, mention_b_id string, composite_score double, group_id string")
    conflicts = spark.createDataFrame([("c1", "K1", ["m_c", None, ""]), ("c2", " k1", ["M_D "]), ("c3", " ", ["m_x", "m_y"]), ("c4", None, ["m_x", "m_y"]), ("c5", "k2", None), ("c6", "k3", ["m_z"])], "conflict_id string, cluster_id string, mention_ids array<string>")
    assert rows(components.mention_groups(links, conflicts)) == [("m_a", "m_b"), ("m_c", "m_d")]
    assert rows(components.mention_groups(links.limit(0), conflicts.limit(0))) == []
