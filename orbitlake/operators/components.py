"""Connected components of neighbour and bond graphs, by alternating stars.

Edges are first sorted by place and contracted where they lie: the links of at most ``LOCAL`` vertices become stars in one
pass, so that the rounds start from what links those. A large star connects every greater neighbour of a vertex to the least vertex around it, a small star does so with the
lesser ones. Both keep the components, and end in stars around their least vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.operators.skew import hot_keys, lookup
from orbitlake.runtime import Scratch


#: Vertices that a contraction holds at once.
LOCAL = 100_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars with the same components as edges (scope, u, v): each vertex but the least of its run of rows, and that least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, up, out = None, {}, ([], [], [])

        def root(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        def stars() -> None:
            for x in up:
                if (r := root(x)) != x:
                    for col, value in zip(out, (scope, x, r)):
                        col.append(value)
            up.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["scope", "u", "v"])
            for col in out:
                col.clear()
            return made

        for part in batches:
            kinds = part.schema.types
            for s, u, v in zip(*(c.to_pylist() for c in part.columns)):
                if s != scope or len(up) >= LOCAL:
                    stars()
                    scope = s
                u, v = (root(up.setdefault(x, x)) for x in (u, v))
                if u != v:
                    up[max(u, v)] = min(u, v)
            if len(out[0]) >= LOCAL:
                yield batch()
        stars()
        if out[0]:
            yield batch()

    near = edges.repartitionByRange("scope", "v", "u").sortWithinPartitions("scope", "v", "u")
    return near.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema))


def _star(arcs: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """arcs: scope, u, v, where v is what u sees. The vertex u and what it sees are joined to the least of them."""
    hot, _ = hot_keys(arcs, ["scope", "u"], scratch)
    least = arcs.groupBy("scope", "u").agg(F.min("v").alias("low")).select("scope", "u", F.least("u", "low").alias("m"))
    seen = lookup(arcs, least, ["scope", "u"], hot, "inner")
    if large:
        out = seen.where("v > u").select("scope", F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select("scope", F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")
    return out.distinct()


def _state(graph: DataFrame) -> tuple:
    h = F.xxhash64("scope", "u", "v")
    return graph.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """scope, node, root: the least vertex of the component of each vertex that is not the least itself.

    edges: scope, u, v. Direction, repeats and self-links do not matter; rows with a null are no links. A vertex without a
    row is its own root. The number of rounds grows with the logarithm of the size; max_rounds only guards against endless loops.
    """
    real = edges.where("scope is not null and u is not null and v is not null and u != v")
    rows = scratch.put(real.select("scope", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    graph = scratch.put(_contracted(rows))
    scratch.drop(rows)
    before = _state(graph)
    for _ in range(max_rounds):
        both = graph.unionAll(graph.select("scope", F.col("v").alias("u"), F.col("u").alias("v")))
        wide = scratch.put(_star(both, scratch, True))
        turned = wide.select("scope", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        after = scratch.put(_star(turned, scratch, False))
        scratch.drop(graph, wide)
        graph = after
        state = _state(graph)
        if state == before:
            return graph.select("scope", F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"no end after {max_rounds} rounds")
