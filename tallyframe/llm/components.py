"""Groups from pairwise links, over any number of links.

The graph is reduced before it is solved.  Rake: vertices with one link are
taken off and remember their neighbour.  Compress: every chain of vertices with
two links is ranked from both of its ends by pointer doubling, replaced by one
link between the ends, and its vertices remember an end; a closed chain is
ranked to its smallest vertex.  What no longer shrinks, the core, is solved by
alternating large-star and small-star steps.  Labels then go back to the
vertices taken off, layer by layer in reverse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.graph import star_components
from tallyframe.session import cut, release

#: The reduction goes on while a round takes off more than this share of the links; below it a round costs more than it saves the stars.
WORTHWHILE = 0.2


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _degrees(edges: DataFrame) -> DataFrame:
    return _both_ways(edges).groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def rake(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links left, and a table (u, v, vertex, parent) of the vertices with one
    link.  Of two that have only each other the smaller stays."""
    leaf = _degrees(edges).where("d = 1").select(F.least("u", "lo").alias("u"), F.greatest("u", "lo").alias("v"), F.col("u").alias("x"))
    off = cut(leaf.groupBy("u", "v").agg(F.max("x").alias("vertex")).select("u", "v", "vertex", F.when(F.col("vertex") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("parent")))
    return edges.join(off, ["u", "v"], "left_anti"), off


def rank_chains(chain: DataFrame) -> DataFrame:
    """Both ends of the chains that vertices with two links (u, lo, hi) form:
    (vertex, a, b), a <= b; on closed chains both are the smallest vertex.

    An item is a vertex with a direction; pointers double from item to item."""
    items = chain.select("u", F.col("lo").alias("to"), "lo", "hi").unionByName(chain.select("u", F.col("hi").alias("to"), "lo", "hi")).select("u", "to")
    ahead = chain.select(F.col("u").alias("to"), "lo", "hi")
    state = items.join(ahead, "to", "left").select(
        "u", "to", F.when(F.col("lo").isNull(), F.col("to")).alias("end"), F.when(F.col("lo").isNotNull(), F.col("to")).alias("nu"),
        F.when(F.col("lo") == F.col("u"), F.col("hi")).otherwise(F.col("lo")).alias("nto"), F.col("u").alias("least"), F.lit(True).alias("moved"),
    )
    state = cut(state)
    before = None
    while True:
        open_, moved = state.where("end is null").agg(F.count("*"), F.count(F.when(F.col("moved"), 1))).first()
        # only closed chains are left, and their windows cover them whole
        if open_ == 0 or (open_ == before and moved == 0):
            break
        before = open_
        nxt = state.select(F.col("u").alias("nu"), F.col("to").alias("nto"), F.col("end").alias("e2"), F.col("nu").alias("n2"), F.col("nto").alias("t2"), F.col("least").alias("l2"))
        on = state.where("end is null").join(nxt, ["nu", "nto"]).select(
            "u", "to", F.col("e2").alias("end"), F.col("n2").alias("nu"), F.col("t2").alias("nto"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("moved"),
        )
        done, state = state, cut(state.where("end is not null").unionByName(on))
        release(done)
    end = F.coalesce("end", "least")
    return state.groupBy(F.col("u").alias("vertex")).agg(F.min(end).alias("a"), F.max(end).alias("b"))


def compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table of the links left, and a table (vertex, parent, a, b) of the
    vertices with two links."""
    chain = cut(_degrees(edges).where("d = 2").select("u", "lo", "hi"))
    ranked = cut(rank_chains(chain).withColumn("parent", F.col("a")))
    inner = chain.select("u")
    rest = edges.join(inner, "u", "left_anti").join(inner.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v")
    short = ranked.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    left = cut(rest.unionByName(short).distinct())
    release(chain)
    return left, ranked


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, label) for every vertex of a link between different vertices;
    vertices of one connected group share the label, one of its vertices.

    Nulls on either side, self-links, repeats and direction play no part.  No
    links, no rows.  Tables of a round are deleted with it, but for the
    vertices taken off, which go once their labels are restored."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    edges = cut(links.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (F.col("u") != F.col("v"))).distinct())
    layers: list[DataFrame] = []
    size = edges.count()
    while size:
        left, off = rake(edges)
        raked = cut(left)
        left, inner = compress(raked)
        layers += [off, inner]
        release(edges)
        release(raked)
        edges = left
        now = edges.count()
        shrunk, size = size - now, now
        if shrunk <= WORTHWHILE * (shrunk + size):
            break
    labels = cut(star_components(edges).where("vertex != label") if size else edges.select(F.col("u").alias("vertex"), F.col("v").alias("label")))
    release(edges)
    while layers:
        # the two layers of a round in one job
        own, before = [layers.pop() for _ in range(min(2, len(layers)))], labels
        for layer in own:
            up = labels.withColumnRenamed("vertex", "parent")
            taken = layer.where("vertex != parent").select("vertex", "parent")
            labels = labels.unionByName(taken.join(up, "parent", "left").select("vertex", F.coalesce("label", "parent").alias("label")))
        labels = cut(labels)
        for table in (before, *own):
            release(table)
    roots = labels.select("label").distinct().select(F.col("label").alias("vertex"), "label")
    return labels.where("vertex != label").unionByName(roots)


def groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(group_id, member) for every linked vertex; group_id is the smallest of
    the group.  Nulls, self-links and repeats as in ``connected_components``."""
    c = cut(connected_components(links, a, b))
    least = c.groupBy("label").agg(F.min("vertex").alias("group_id"))
    return c.join(least, "label").select("group_id", F.col("vertex").alias("member"))


def memberships(df: DataFrame, cluster: str, members: str, prefix: str) -> DataFrame:
    """Links (a, b) between each member of an array and its cluster, a vertex of
    its own whose id has ``prefix``; null or blank clusters and members give none."""
    form = lambda c: F.lower(F.trim(c))
    rows = df.select(form(F.col(f"`{cluster}`")).alias("c"), F.explode(F.col(f"`{members}`")).alias("m"))
    return rows.select(form(F.col("m")).alias("a"), F.col("c").alias("b")).where("a != '' and b != ''").select("a", F.concat(F.lit(prefix), "b").alias("b"))


def mention_groups(links: DataFrame, conflicts: DataFrame, least_score: float = 0.5) -> DataFrame:
    """(group_id, mention_id) of mentions joined by links of at least
    ``least_score`` or by one cluster of conflict rows, directly or through
    others; group_id, the smallest mention of the group (ids trimmed, lower
    case), has no row of its own.  A null score is no link."""
    form = lambda c: F.lower(F.trim(F.col(c)))
    # A mention's vertex sorts before any cluster's.
    direct = links.where(F.col("composite_score") >= least_score).select(form("mention_a_id").alias("a"), form("mention_b_id").alias("b")).where("a != '' and b != ''")
    shared = memberships(conflicts, "cluster_id", "mention_ids", "1")
    vertex = lambda c: F.concat(F.lit("0"), c)
    pairs = direct.select(vertex("a").alias("a"), vertex("b").alias("b")).unionByName(shared.select(vertex("a").alias("a"), "b"))
    g = groups(pairs, "a", "b").where("member like '0%' and group_id != member")
    return g.select(F.substring("group_id", 2, 1 << 30).alias("group_id"), F.substring("member", 2, 1 << 30).alias("mention_id"))
