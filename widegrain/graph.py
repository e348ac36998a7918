"""The graph of foreign keys: tens to hundreds of nodes, walked on the driver."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from .types import Catalog, Edge, Step


@dataclass
class SchemaGraph:
    catalog: Catalog
    _out: dict[str, list[Edge]] = field(default_factory=lambda: defaultdict(list))
    _in: dict[str, list[Edge]] = field(default_factory=lambda: defaultdict(list))

    @staticmethod
    def build(catalog: Catalog) -> SchemaGraph:
        graph = SchemaGraph(catalog)
        for e in catalog.edges:
            if catalog.table(e.child) and catalog.table(e.parent):
                graph._out[e.child.lower()].append(e)
                graph._in[e.parent.lower()].append(e)
        return graph

    def outgoing(self, table: str) -> list[Edge]:
        return self._out.get(table.lower(), [])

    def incoming(self, table: str) -> list[Edge]:
        return self._in.get(table.lower(), [])

    def parents(self, table: str, max_hops: int) -> list[tuple[str, tuple[Step, ...]]]:
        """Tables reached along keys, nearest first, each with its path.

        A path never comes back to its start nor takes an edge twice, so two
        ways to one table stay two."""
        found, front = [], [(table, ())]
        for _ in range(max_hops):
            ahead = []
            for at, path in front:
                for e in self.outgoing(at):
                    if e.parent.lower() == table.lower() or any(s.edge.key == e.key for s in path):
                        continue
                    ahead.append((e.parent, (*path, Step(e))))
            found += ahead
            front = ahead
        return found

    def children(self, table: str) -> list[tuple[str, Step]]:
        """Tables whose rows point here, one entry for each key; a table's own hierarchy is left out."""
        return [(e.child, Step(e, forward=False)) for e in self.incoming(table) if e.child.lower() != table.lower()]

    def key_columns(self, table: str) -> set[str]:
        return {c.lower() for e in self.outgoing(table) for c in e.child_cols}

    def reachable(self, table: str, max_hops: int = 8) -> set[str]:
        return {t.lower() for t in self.walk(table, max_hops)}

    def walk(self, table: str, max_hops: int) -> list[str]:
        """Names of the tables reached along keys, each once."""
        seen, front = [], [table]
        for _ in range(max_hops):
            front = [p for p in dict.fromkeys(e.parent for t in front for e in self.outgoing(t)) if p.lower() != table.lower() and p.lower() not in {s.lower() for s in seen}]
            seen += front
        return seen
