"""Graphs of computations: nodes with named inputs, each computed once.

A node is a function of tables to a table. What several nodes read is written once to the shared folder; everything else stays
one lazy plan, which the optimizer sees as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from orbitlake.runtime import Scratch


class Compute(Protocol):
    """A set of parameters with one operation. ``finalize`` turns what can be summed over frames into the result; it is idempotent."""

    def compute(self, *inputs: DataFrame) -> DataFrame: ...


class ComputeError(RuntimeError):
    """A fault of a node, which its text names."""


@dataclass(frozen=True)
class Slot:
    name: str


@dataclass
class Graph:
    """Nodes in the order they were added, which is an order in which they can run, as a node's inputs must be there before it."""

    nodes: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = field(default_factory=dict)
    inputs: set[str] = field(default_factory=set)

    def input(self, name: str) -> Slot:
        self.inputs.add(name)
        return Slot(name)

    def add(self, name: str, op: Callable[..., DataFrame] | Compute, *deps: Slot) -> Slot:
        if name in self.nodes or name in self.inputs:
            raise ValueError(f"{name} is there already")
        for d in deps:
            if d.name not in self.nodes and d.name not in self.inputs:
                raise ValueError(f"{name} needs {d.name}, which is not there")
        self.nodes[name] = (getattr(op, "compute", op), tuple(d.name for d in deps))
        return Slot(name)

    def order(self) -> list[str]:
        """Names of the nodes, each after what it needs."""
        left, out = {n: {d for d in deps if d in self.nodes} for n, (_, deps) in self.nodes.items()}, []
        while left:
            ready = [n for n, d in left.items() if not d]
            if not ready:
                raise ValueError("the nodes need each other in a circle")
            for n in ready:
                out.append(n)
                del left[n]
            for d in left.values():
                d.difference_update(ready)
        return out

    def run(self, spark: SparkSession, **inputs: DataFrame) -> dict[str, DataFrame]:
        """The tables of all nodes. An input that is missing raises, as does a fault in a node, with the node's name."""
        missing = self.inputs - inputs.keys()
        if missing:
            raise ComputeError(f"no input {min(missing)}")
        readers: dict[str, int] = {}
        for _, deps in self.nodes.values():
            for d in deps:
                readers[d] = readers.get(d, 0) + 1
        scratch, store = Scratch(spark, "graph"), dict(inputs)
        for name in self.order():
            op, deps = self.nodes[name]
            try:
                store[name] = op(*[store[d] for d in deps])
                if readers.get(name, 0) > 1:
                    store[name] = scratch.put(store[name])
            except Exception as e:
                raise ComputeError(f"node {name}: {e}") from e
        return store
