"""Graphs that several steps of a run share, read and staged once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import patterns as pt
from skein.operators.graph import nodes_of
from skein.plans.staging import stage


class GraphCache:
    """Edges (src, dst), nodes and labels of graphs by name; ``read`` is called once a name, and what is derived is staged once."""

    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        self.read = read
        self.found: dict[tuple[str, str], DataFrame] = {}

    def _once(self, name: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
        if (name, what) not in self.found:
            self.found[name, what] = stage(make(), what)
        return self.found[name, what]

    def edges(self, name: str) -> DataFrame:
        """Distinct edges, loops kept."""
        return self._once(name, "edges", lambda: self.read(name).select("src", "dst").distinct())

    def nodes(self, name: str) -> DataFrame:
        return self._once(name, "nodes", lambda: nodes_of(self.edges(name)))

    def labels(self, name: str) -> DataFrame:
        """(node, outs, ins): distinct neighbours each way."""
        return self._once(name, "labels", lambda: pt.labels(self.edges(name).select(F.lit(name).alias("graph"), "src", "dst")).drop("graph"))
