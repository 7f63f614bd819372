"""Parent-child rows to full hierarchies by pointer doubling.

Every node points to its parent; each round a node takes over its pointer's
pointer, so the distance covered doubles and a tree of depth d is resolved in
log2(d) rounds.  Nodes that never arrive hang on a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut, release

_T = ["tree", "node"]


def links(df: DataFrame, tree: str, node: str, parent: str, loaded: str | None = None, level: str | None = None) -> DataFrame:
    """One row per node, the one loaded last: tree, node, parent (comparable
    forms; parent null for roots), node_id (as written, trimmed), level."""
    form = lambda c: F.lower(F.trim(F.col(f"`{c}`").cast("string")))
    no_parent = F.coalesce(form(parent), F.lit("")).isin("", "-")
    picked = df.select(
        F.coalesce(form(tree), F.lit("")).alias("tree"), form(node).alias("node"),
        F.struct(
            (F.col(f"`{loaded}`") if loaded else F.lit(0)).alias("at"),
            F.when(~no_parent, form(parent)).alias("parent"),
            (F.col(f"`{level}`").cast("long") if level else F.lit(None).cast("long")).alias("level"),
            F.trim(F.col(f"`{node}`").cast("string")).alias("node_id"), F.trim(F.col(f"`{tree}`").cast("string")).alias("tree_id"),
        ).alias("row"),
    ).where("node is not null and node != ''")
    return picked.groupBy(*_T).agg(F.max("row").alias("row")).select(*_T, "row.parent", "row.node_id", "row.tree_id", "row.level")


def _start(nodes: DataFrame, path: bool) -> DataFrame:
    """done: null while under way, else how the chain ends (root, missing)."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    s = nodes.join(known, ["tree", "parent"], "left")
    done = F.when(F.col("parent").isNull(), "root").when(F.col("known").isNull(), "missing")
    cols = [*_T, done.alias("done"), F.when(done.isNull(), F.col("parent")).alias("ptr"), F.when(done.isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("hops"), F.when(done.isNotNull(), F.col("node")).alias("end")]
    return s.select(*cols, *([F.array("node_id").alias("path")] if path else []))


def _double(state: DataFrame, path: bool) -> DataFrame:
    ahead = state.select("tree", F.col("node").alias("ptr"), F.col("done").alias("d2"), F.col("ptr").alias("p2"), F.col("hops").alias("h2"), F.col("end").alias("e2"), *([F.col("path").alias("s2")] if path else []))
    moved = state.where("done is null").join(ahead, ["tree", "ptr"]).select(
        *_T, F.col("d2").alias("done"), F.col("p2").alias("ptr"), (F.col("hops") + F.col("h2")).alias("hops"), F.col("e2").alias("end"),
        *([F.concat("s2", "path").alias("path")] if path else []),
    )
    return state.where("done is not null").unionByName(moved)


def resolve(nodes: DataFrame) -> DataFrame:
    """tree, node, kind, depth, root for every node of ``links``.

    kind: ``ok``, ``missing_parent`` (its parent is no node of its tree),
    ``below_missing``, ``cycle`` (on a loop, its own parent included) or
    ``below_cycle``; depth (root = 1) and root only where ``ok``.  Each round
    collects two counts.  The rounds end when all nodes have arrived, or when a
    round neither lets a node arrive nor shrinks the set of nodes pointed to by
    the rest; that set is then exactly the nodes on loops: a node that hangs on
    a loop at distance m from its last descendant stops being pointed to once
    the distance covered exceeds m, and if any such node were left one round
    would have removed one.
    """
    state = cut(_start(nodes, False))
    before = None
    while True:
        now = tuple(state.where("done is null").agg(F.count("*"), F.count_distinct("tree", "ptr")).first())
        if now[0] == 0 or now == before:
            break
        before, old, state = now, state, cut(_double(state, False))
        release(old)
    open_ = state.where("done is null")
    loops = open_.select("tree", F.col("ptr").alias("node")).distinct().withColumn("loop", F.lit(True))
    arrived = state.where("done is not null")
    kind = F.when(F.col("done") == "root", "ok").when(F.col("end") == F.col("node"), "missing_parent").otherwise("below_missing")
    ok = F.col("done") == "root"
    return arrived.select(*_T, kind.alias("kind"), F.when(ok, F.col("hops") + 1).alias("depth"), F.when(ok, F.col("end")).alias("root")).unionByName(
        open_.join(loops, _T, "left").select(*_T, F.when(F.col("loop"), "cycle").otherwise("below_cycle").alias("kind"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("root"))
    )


def faults(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """tree_id, node_id, kind of nodes without a path to a root, and
    ``wrong_level`` for those whose level is not null and not their depth."""
    both = nodes.join(resolved, _T)
    kind = F.when(F.col("kind") != "ok", F.col("kind")).when(F.col("level") != F.col("depth"), "wrong_level")
    return both.select("tree_id", "node_id", kind.alias("kind")).where("kind is not null")


def paths(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """tree_id, node_id, path (ids from root to node), depth, root of the nodes
    that reach a root.  Path segments are joined by doubling as well, over these
    nodes only, so loops cannot grow paths."""
    good = nodes.join(resolved.where("kind = 'ok'").select(*_T), _T, "left_semi")
    state = cut(_start(good, True))
    while state.where("done is null").limit(1).count():
        old, state = state, cut(_double(state, True))
        release(old)
    return state.join(nodes.select(*_T, "tree_id", "node_id"), _T).select("tree_id", "node_id", "path", F.size("path").alias("depth"), F.element_at("path", 1).alias("root"))


def descendants(path_rows: DataFrame) -> DataFrame:
    """tree_id, ancestor, descendant, distance for every pair (itself left out)."""
    up = path_rows.select("tree_id", F.col("node_id").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor"))
    return up.where("i < n - 1").select("tree_id", "ancestor", "descendant", (F.col("n") - 1 - F.col("i")).alias("distance"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """tree, node, n_descendants of nodes (tree, node, parent) that form trees.

    Sums double along with pointers: what stands less than 2^k below a node is
    what stands less than 2^(k-1) below it and below those 2^(k-1) beneath it.
    So a round moves a row per node, where listing all pairs of ancestor and
    descendant would grow with nodes times depth."""
    state = cut(_start(nodes.withColumn("node_id", F.col("node")), False).select(*_T, "done", "ptr", "hops", "end"))
    sizes = cut(nodes.select(*_T, F.lit(1).cast("long").alias("n")))
    while state.where("done is null").limit(1).count():
        beneath = state.where("done is null").join(sizes, _T).groupBy("tree", F.col("ptr").alias("node")).agg(F.sum("n").alias("more"))
        grown = cut(sizes.join(beneath, _T, "left").select(*_T, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        moved = cut(_double(state, False))
        release(sizes)
        release(state)
        sizes, state = grown, moved
    return sizes.select(*_T, (F.col("n") - 1).alias("n_descendants"))


def full_hierarchy(path_rows: DataFrame, sep: str = " > ") -> DataFrame:
    """Path as text, depth, root and number of descendants of each node."""
    path_rows = cut(path_rows)
    n = subtree_sizes(path_rows.select(F.col("tree_id").alias("tree"), F.col("node_id").alias("node"), F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent")))
    n = n.withColumnsRenamed({"tree": "tree_id", "node": "node_id"})
    return path_rows.join(n, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.array_join("path", sep).alias("path"), "depth", "root", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))
