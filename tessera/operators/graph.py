"""Graph algorithms over edges (_from, _to, ...) and trees over (id, parent).

Iterative ones keep their state as DataFrames and cut lineage by checkpoint in
shared storage; the driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.positions import sums_before
from tessera.operators.shared import cut


def neighbors(edges: DataFrame, node) -> DataFrame:
    """The other endpoints of a node's edges, distinct."""
    out = edges.where(F.col("_from") == node).select(F.col("_to").alias("node"))
    return out.union(edges.where(F.col("_to") == node).select(F.col("_from").alias("node"))).distinct()


def out_edges(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("_from") == node)


def in_edges(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("_to") == node)


def traverse(edges: DataFrame, start, lo: int = 1, hi: int = 1) -> DataFrame:
    """(node, hops) of walks of lo to hi steps from a node; duplicates are kept."""
    steps = edges.select("_from", "_to")
    walk, out = steps.where(F.col("_from") == start).select(F.col("_to").alias("node")), []
    for n in range(1, hi + 1):
        if n >= lo:
            out.append(walk.withColumn("hops", F.lit(n)))
        if n < hi:
            walk = walk.join(steps, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"))
    df = out[0]
    for x in out[1:]:
        df = df.unionAll(x)
    return df


def transitive_closure(edges: DataFrame, seed=None) -> DataFrame:
    """(_from, _to) of all pairs with a path; from ``seed`` alone if given.

    Frontier by frontier: what a step reaches anew is joined on, what is known
    is removed by an anti join, so cycles end.
    """
    steps = edges.select("_from", "_to").distinct()
    front = steps.where(F.col("_from") == seed) if seed is not None else steps
    front = seen = cut(front)
    while not front.isEmpty():
        nxt = front.select("_from", F.col("_to").alias("m")).join(steps.withColumnsRenamed({"_from": "m", "_to": "t"}), "m").select("_from", F.col("t").alias("_to")).distinct()
        front = cut(nxt.join(seen, ["_from", "_to"], "left_anti"))
        seen = seen.unionAll(front)  # each frontier is written once
    return seen


def shortest_path(edges: DataFrame, source, target=None, weight: str | None = None) -> DataFrame:
    """(node, distance) from a source by rounds of relaxation; no negative cycles."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    steps = edges.select("_from", "_to", w.alias("w")).groupBy("_from", "_to").agg(F.min("w").alias("w"))
    front = best = cut(edges.sparkSession.createDataFrame([(source, 0.0)], f"node {dict(edges.dtypes)['_from']}, distance double"))
    while not front.isEmpty():
        reached = front.join(steps, F.col("node") == F.col("_from")).groupBy(F.col("_to").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        front = cut(reached.join(best, "node", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("node", F.col("new").alias("distance")))
        best = cut(best.unionAll(front).groupBy("node").agg(F.min("distance").alias("distance")))
    return best.where(F.col("node") == target) if target is not None else best


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component, by alternating stars."""
    edge = edges.select(F.least("_from", "_to").alias("u"), F.greatest("_from", "_to").alias("v"))
    alone = edge.where("u = v").select("u").distinct()
    now = cut(edge.where("u <> v").distinct())
    marks = (F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))"))
    mark = now.agg(*marks).first()
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and m < v").select(F.col("m").alias("u"), "v")
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        nxt = large.join(small, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).unionAll(small.select(F.col("m").alias("u"), "v"))
        nxt = cut(nxt.distinct())
        after = nxt.agg(*marks).first()
        if after == mark:
            break
        now, mark = nxt, after
    ends = now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    rest = alone.select(F.col("u").alias("node")).join(ends, "node", "left_anti").select("node", F.col("node").alias("component"))
    return ends.unionAll(rest)


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): colours flow forward, and a component is what reaches
    its colour's root backward inside the colour; found ones leave the graph."""
    live = cut(edges.select("_from", "_to").distinct())
    nodes = cut(live.select(F.col("_from").alias("node")).union(live.select(F.col("_to").alias("node"))).distinct())
    done = None
    while not nodes.isEmpty():
        color = cut(nodes.select("node", F.col("node").alias("c")))
        while True:
            sent = live.join(color, F.col("_from") == F.col("node")).groupBy(F.col("_to").alias("node")).agg(F.min("c").alias("n"))
            nxt = cut(color.join(sent, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            color = nxt.select("node", "c")
            if not moved:
                break
        found = front = cut(color.where("node = c"))
        inner = live.join(color.withColumnsRenamed({"node": "_from", "c": "a"}), "_from").join(color.withColumnsRenamed({"node": "_to", "c": "b"}), "_to").where("a = b").select("_from", "_to", "a")
        inner = cut(inner)
        while not front.isEmpty():
            back = inner.join(front, (F.col("_to") == F.col("node")) & (F.col("a") == F.col("c"))).select(F.col("_from").alias("node"), "c").distinct()
            front = cut(back.join(found, ["node", "c"], "left_anti"))
            found = cut(found.unionAll(front))
        got = found.select("node", F.col("c").alias("component"))
        done = got if done is None else done.unionAll(got)
        nodes = cut(nodes.join(found, "node", "left_anti"))
        live = cut(live.join(nodes.withColumnRenamed("node", "_from"), "_from", "left_semi").join(nodes.withColumnRenamed("node", "_to"), "_to", "left_semi"))
    return done if done is not None else edges.select(F.col("_from").alias("node"), F.col("_from").alias("component")).limit(0)


def topological_sort(edges: DataFrame) -> DataFrame:
    """(node, level): longest path from a source, by peeling sources; a cycle is an error."""
    live = cut(edges.select("_from", "_to").distinct())
    nodes = cut(live.select(F.col("_from").alias("node")).union(live.select(F.col("_to").alias("node"))).distinct())
    out, level = None, 0
    while not nodes.isEmpty():
        ready = cut(nodes.join(live.select(F.col("_to").alias("node")), "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        part = ready.withColumn("level", F.lit(level))
        out = part if out is None else out.unionAll(part)
        nodes = cut(nodes.join(ready, "node", "left_anti"))
        live = cut(live.join(ready.withColumnRenamed("node", "_from"), "_from", "left_anti"))
        level += 1
    return out


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """(node, rank), ranks summing to 1; dangling rank is spread evenly."""
    steps = edges.select("_from", "_to")
    out = steps.groupBy("_from").agg(F.count("*").alias("n"))
    links = cut(steps.join(out, "_from"))
    nodes = cut(steps.select(F.col("_from").alias("node")).union(steps.select(F.col("_to").alias("node"))).distinct())
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(iterations):
        sent = links.join(rank, F.col("_from") == F.col("node")).groupBy(F.col("_to").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        dangling = rank.join(out.withColumnRenamed("_from", "node"), "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        rank = cut(nodes.join(sent, "node", "left").select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + dangling / n)).alias("rank")))
    return rank


# trees: rows (id, parent); a root has a null parent


def children(tree: DataFrame, node) -> DataFrame:
    return tree.where(F.col("parent") == node).select("id")


def parent(tree: DataFrame, node) -> DataFrame:
    return tree.where(F.col("id") == node).select(F.col("parent").alias("id"))


def ancestors(tree: DataFrame, node) -> DataFrame:
    """(id, level) upward; the parent is level 1."""
    return _levels(tree, node, up=True)


def descendants(tree: DataFrame, node) -> DataFrame:
    """(id, level) downward; children are level 1."""
    links = cut(tree.where("id is not null and parent is not null").select("id", F.col("parent").alias("up"), F.lit(0).alias("w")))
    if not _single(links):
        return _levels(tree, node, up=False)
    found = _climb(links.where(F.col("id") != node)).where(F.col("up") == node).select("id", "level")
    _apart(found, links, node)
    return found


def _single(links: DataFrame) -> bool:
    """Whether no node has two rows; with two, walks are followed one by one."""
    return links.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _apart(found: DataFrame, links: DataFrame, node) -> None:
    """An error if the node's own parent is among what was found below it."""
    own = links.where(F.col("id") == node).select("up").first()
    if own is not None and (own["up"] == node or not found.where(F.col("id") == own["up"]).isEmpty()):
        raise ValueError("the parents have a cycle")


def _climb(rows: DataFrame, below: bool = False) -> DataFrame:
    """Rows (id, up, w, ...) with the top of each node as ``up`` and its ``level`` under it.

    ``w`` becomes its sum on the way up, the top left out, or with ``below`` over
    the node and all below it.  Pointers double, so there is a round for each
    binary digit of the depth, over all rows.  What still moves after as many
    rounds as their number has digits is on a cycle or below one, and left out.
    """
    rest = [c for c in rows.columns if c not in ("id", "up", "w")]
    now, span = cut(rows.withColumns({"level": F.lit(1), "live": F.lit(True)})), 1
    n = now.count()
    while span <= n and not now.where("live").isEmpty():
        live, far = now.where("live"), now.select(*(F.col(c).alias(f"far_{c}") for c in ("id", "up", "w", "level", "live")))
        w = F.col("w") if below else F.col("w") + F.coalesce("far_w", F.lit(0))
        moved = live.join(far, F.col("up") == F.col("far_id"), "left").select("id", F.coalesce("far_up", "up").alias("up"), w.alias("w"), *rest, (F.col("level") + F.coalesce("far_level", F.lit(0))).alias("level"), F.coalesce("far_live", F.lit(False)).alias("live"))
        nxt = moved.unionByName(now.where("not live"))
        if below:  # those that moved point at the node 2^k above, which has counted what is nearer
            more = live.groupBy(F.col("up").alias("far_id")).agg(F.sum("w").alias("far_w"))
            nxt = nxt.join(more, F.col("id") == F.col("far_id"), "left").withColumn("w", F.col("w") + F.coalesce("far_w", F.lit(0))).drop("far_id", "far_w")
        now, span = cut(nxt), 2 * span
    return now.where("not live").drop("live")


def _levels(tree: DataFrame, node, up: bool) -> DataFrame:
    near, far = ("id", "parent") if up else ("parent", "id")
    steps = tree.select(F.col(near).alias("__a"), F.col(far).alias("__b")).where("__b is not null")
    front = cut(steps.where(F.col("__a") == node).select(F.col("__b").alias("id"), F.lit(1).alias("level")))
    out, level = front, 1
    while not front.isEmpty():
        _same(out, node)
        level += 1
        front = cut(front.join(steps, F.col("id") == F.col("__a")).select(F.col("__b").alias("id"), F.lit(level).alias("level")))
        if not front.join(out.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("the parents have a cycle, or a node has two")
        out = out.unionAll(front)
    return out


def _same(found: DataFrame, node) -> None:
    if not found.where(F.col("id") == node).isEmpty():
        raise ValueError("the parents have a cycle")


def depth(tree: DataFrame, node) -> DataFrame:
    return ancestors(tree, node).agg(F.coalesce(F.max("level"), F.lit(0)).alias("depth"))


def path_to_root(tree: DataFrame, node) -> DataFrame:
    up = ancestors(tree, node).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "id"))), lambda x: x["id"]).alias("path"))
    return up.select(F.array_prepend("path", F.lit(node)).alias("path"))


def lowest_common_ancestor(tree: DataFrame, a, b) -> DataFrame:
    own = lambda n: ancestors(tree, n).unionAll(tree.where(F.col("id") == n).select("id", F.lit(0).alias("level")))
    return own(a).join(own(b).withColumnRenamed("level", "other"), "id").orderBy("level", "other").limit(1).select("id")


def _placed(tree: DataFrame, root) -> DataFrame | None:
    """(id, level, pre, size) of a subtree: place in preorder and number of nodes;
    the root's size is left at 0.  None where a node has two rows.

    A node comes after its parent and what is below earlier siblings, so its
    place is the sum of such offsets on its way up.
    """
    links = cut(tree.where("parent is not null").select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("w")))
    top = cut(tree.where(F.col("id") == root).select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("pre"), F.lit(0).cast("long").alias("size")))
    tops = top.count()
    if tops == 0:
        return top
    if tops > 1 or not _single(links):
        return None
    below = _climb(links.where(~F.col("id").eqNullSafe(F.lit(root))).withColumn("parent", F.col("up")), below=True).where(F.col("up") == root)
    _apart(below, links, root)
    placed = cut(sums_before(below.select("id", "parent", F.col("w").alias("size")), [F.col("parent"), F.col("id")], "size", "before"))
    first = placed.groupBy(F.col("parent").alias("up")).agg(F.min("before").alias("first"))
    offsets = placed.join(first, F.col("parent") == F.col("up")).select("id", "up", (F.col("before") - F.col("first") + 1).alias("w"), "size")
    return top.unionByName(_climb(offsets).select("id", "level", F.col("w").alias("pre"), "size"))


def _paths(tree: DataFrame, root) -> DataFrame:
    """(id, level, path) of a subtree; paths are arrays of ids from the root."""
    steps = tree.where("parent is not null").select(F.col("id").alias("__b"), F.col("parent").alias("__a"))
    front = cut(tree.where(F.col("id") == root).select("id", F.lit(0).alias("level"), F.array("id").alias("path")))
    out, level = front, 0
    while not front.isEmpty():
        level += 1
        front = cut(front.join(steps, F.col("id") == F.col("__a")).select(F.col("__b").alias("id"), F.lit(level).alias("level"), F.array_append("path", F.col("__b")).alias("path"), F.array_contains("path", F.col("__b")).alias("again")))
        if not front.where("again").isEmpty():
            raise ValueError("the parents have a cycle")
        front = front.drop("again")
        out = out.unionAll(front)
    return out


def preorder(tree: DataFrame, root) -> DataFrame:
    placed = _placed(tree, root)
    rows = placed.orderBy("pre") if placed is not None else _paths(tree, root).orderBy("path")
    return rows.select("id", "level")


def postorder(tree: DataFrame, root) -> DataFrame:
    """Children first: a node comes after all below it and before its ancestors."""
    placed = _placed(tree, root)
    if placed is not None:
        return placed.orderBy(F.col("level") == 0, F.col("pre") + F.col("size") - F.col("level")).select("id", "level")
    last = F.array_append(F.transform("path", lambda x: F.struct(F.lit(0).alias("end"), x.alias("id"))), F.struct(F.lit(1).alias("end"), F.lit(None).cast(dict(tree.dtypes)["id"]).alias("id")))
    return _paths(tree, root).orderBy(last).select("id", "level")


def level_order(tree: DataFrame, root) -> DataFrame:
    placed = _placed(tree, root)
    rows = placed.orderBy("level", "pre") if placed is not None else _paths(tree, root).orderBy("level", "path")
    return rows.select("id", "level")
