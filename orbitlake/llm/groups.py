"""Problem 4: consolidating pairwise matches into groups, by seed-tree pruning.

Each round, every vertex tells its neighbourhood the smallest vertex in it. A vertex that nobody chose as the smallest
drops out and becomes a child in the propagation forest; the chosen ones go on, linked to each other where a vertex heard
of several. At the end the forest is walked from the last round to the first, and the seeds' identifiers flow down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.operators.skew import hot_keys, lookup, split
from orbitlake.runtime import Scratch

KEY = ["scope", "u"]


def _with_least(rows: DataFrame, value: str, hot: DataFrame | None) -> DataFrame:
    """rows (scope, u, ..) with m, the least value of its vertex. One shuffle by vertex; the rows of hot vertices stay where they are."""
    cold = rows if hot is None else split(rows, hot, KEY)[1]
    out = cold.repartition(*KEY).distinct().withColumn("m", F.min(value).over(Window.partitionBy(*KEY)))
    if hot is None:
        return out
    warm = split(rows, hot, KEY)[0].distinct()
    return out.unionByName(warm.join(F.broadcast(warm.groupBy(*KEY).agg(F.min(value).alias("m"))), KEY))


def _round(arcs: DataFrame, hot: DataFrame | None) -> DataFrame:
    """kind, scope, x, y: the edges (x, y) of the next round, and as kind ``tree`` the dropped vertices x and their parents y.

    arcs hold both directions of each edge. A vertex that chose itself has a row of itself among the choices.
    """
    seen = _with_least(arcs, "v", hot)
    least = F.least("u", "m")
    own = F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u").alias("u"), least.alias("b"))))
    choices = seen.select("scope", F.explode(F.concat(F.array(F.struct(F.col("v").alias("u"), least.alias("b"))), F.coalesce(own, F.array().cast("array<struct<u:bigint,b:bigint>>")))).alias("c")).select("scope", "c.u", "c.b")
    cold = choices if hot is None else split(choices, hot, KEY)[1]
    over = Window.partitionBy(*KEY)
    heard = cold.repartition(*KEY).distinct().withColumns({"m": F.min("b").over(over), "kept": F.max(F.col("b") == F.col("u")).over(over)})
    if hot is not None:
        warm = split(choices, hot, KEY)[0].distinct()
        heard = heard.unionByName(warm.join(F.broadcast(warm.groupBy(*KEY).agg(F.min("b").alias("m"), F.max(F.col("b") == F.col("u")).alias("kept"))), KEY))
    tree = F.col("b") == F.col("m")
    return heard.where(~tree | ~F.col("kept")).select(F.when(tree, "tree").otherwise("edge").alias("kind"), "scope", F.when(tree, F.col("u")).otherwise(F.col("m")).alias("x"), F.col("b").alias("y"))


def seed_tree(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Component seeds of the vertices of edges: scope, node, root, where root is the least vertex of its component.

    edges: scope, u, v; links never leave their scope. Direction, repeats and self-links do not matter; rows with a null
    are no links. A vertex that is a root itself, or has no link, has no row: its root is itself. A round is two jobs: one
    counts the rows of each hash bucket, to find hot vertices, the other reads the edges, shuffles them twice and writes
    the next edges and the dropped vertices. max_rounds guards against endless loops: more raise an error.
    """
    real = edges.where("scope is not null and u is not null and v is not null and u != v").select("scope", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    graph = scratch.put(real)
    trees: list[DataFrame] = []
    while True:
        arcs = graph.select("scope", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("a")).select("scope", "a.u", "a.v")
        hot, n = hot_keys(arcs, KEY, scratch)
        if not n:
            break
        if len(trees) == max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        after = scratch.put(_round(arcs, hot), by="kind")
        if not trees:
            scratch.drop(graph)
        trees.append(after.where("kind = 'tree'").select("scope", F.col("x").alias("node"), F.col("y").alias("parent")))
        graph = after.where("kind = 'edge'").select("scope", F.col("x").alias("u"), F.col("y").alias("v"))
    if not trees:
        return real.select("scope", F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    labels = [trees[-1].select("scope", "node", F.col("parent").alias("root"))]
    for tree in reversed(trees[:-1]):
        above = labels[0]
        for more in labels[1:]:
            above = above.unionAll(more)
        above = above.select("scope", F.col("node").alias("parent"), F.col("root").alias("higher"))
        hot, _ = hot_keys(tree, ["scope", "parent"], scratch)
        flowed = lookup(tree, above, ["scope", "parent"], hot).select("scope", "node", F.coalesce("higher", "parent").alias("root"))
        labels.append(scratch.put(flowed))
    out = labels[0]
    for more in labels[1:]:
        out = out.unionAll(more)
    return out


def atom_groups(atoms: DataFrame, bonds: DataFrame, scratch: Scratch) -> DataFrame:
    """frame_id, atom_id, group_id: one row for every atom (frame_id, id), group_id being the smallest id in its group.

    The smallest atom of a molecule stands for the molecule, so that no pairs within molecules are made; a root is the
    smallest vertex of its component and so the smallest atom of the group. An atom whose rows name several molecules
    links these. Rows with a null frame or id are no atoms; a molecule that is null or not above 0 is none.
    """
    rows = atoms.where("frame_id is not null and id is not null").select(F.col("frame_id").alias("scope"), F.col("id").cast("long").alias("id"), F.when(F.col("molecule_id") > 0, F.col("molecule_id")).alias("mol"))
    bound = rows.where("mol is not null")
    hot, _ = hot_keys(bound, ["scope", "mol"], scratch)
    member = lookup(bound, bound.groupBy("scope", "mol").agg(F.min("id").alias("head")), ["scope", "mol"], hot, "inner").select("scope", "id", "head")
    held = member.unionByName(rows.where("mol is null").select("scope", "id", F.lit(None).cast("long").alias("head"))).groupBy("scope", "id").agg(F.min("head").alias("low"), F.max("head").alias("high"))
    known = scratch.put(held.select("scope", "id", F.coalesce("low", "id").alias("u"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("torn")))
    ends = known.select("scope", "id", "u")
    links = bonds.select(F.col("frame_id").alias("scope"), F.col("atom_i").cast("long").alias("i"), F.col("atom_j").cast("long").alias("j")).where("scope is not null and i is not null and j is not null and i != j")
    for end, vertex in (("i", "u"), ("j", "v")):
        hot, _ = hot_keys(links, ["scope", end], scratch)
        links = lookup(links, ends.select("scope", F.col("id").alias(end), F.col("u").alias(vertex)), ["scope", end], hot, "inner")
    links = links.select("scope", "u", "v")
    if known.where("torn").limit(1).count():
        links = links.unionByName(member.join(known.where("torn"), ["scope", "id"]).where("head != u").select("scope", "u", F.col("head").alias("v")))
    roots = seed_tree(links, scratch)
    hot, _ = hot_keys(ends, ["scope", "u"], scratch)
    return lookup(ends, roots.withColumnRenamed("node", "u"), ["scope", "u"], hot).select(F.col("scope").alias("frame_id"), F.col("id").alias("atom_id"), F.coalesce("root", "u").alias("group_id"))
