"""What has to be joined for a set of fields: one plan, from which DataFrames and SQL text are both made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..graph import SchemaGraph
from ..types import FieldKind, LogicalField, LogicalModel, Step
from .sqlscan import QueryError

AGGREGATES = ("count", "sum", "avg", "min", "max")
_SIDE = re.compile(r"\{([LR])\}\.`?(\w+)`?")


@dataclass(frozen=True)
class Predicate:
    """SQL with {0}, {1}.. for its columns; where they are: "src" or a dimension's alias."""

    template: str
    columns: tuple[tuple[str, str], ...]


@dataclass
class Hop:
    alias: str
    parent: str
    step: Step


@dataclass
class Child:
    """A child folded to one row for each key before it is joined."""

    alias: str
    parent: str
    step: Step
    aggregates: list[tuple[str, str, str]] = field(default_factory=list)  # field, function, column
    predicates: list[Predicate] = field(default_factory=list)
    dimensions: dict[str, Step] = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        e = self.step.edge
        return e.parent_cols if e.key_exprs else e.child_cols


@dataclass
class JoinPlan:
    model: LogicalModel
    base: str
    hops: list[Hop] = field(default_factory=list)
    children: list[Child] = field(default_factory=list)
    outputs: list[tuple[str, str, str]] = field(default_factory=list)  # alias, column, field
    axis: list[Hop] = field(default_factory=list)  # link first; the query groups by outputs
    distinct: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)  # field, columns of the base counted

    @property
    def joins(self) -> int:
        return len(self.hops) + len(self.children) + len(self.axis)


def _key(columns) -> str:
    return "_".join(c.lower() for c in columns)


def path_alias(path: tuple[Step, ...]) -> str:
    """Keyed by the whole path, so two keys to one table stay two joins."""
    return "j_" + "__".join(f"{s.target.lower()}_{_key(s.edge.child_cols)}" for s in path)


def child_alias(step: Step) -> str:
    return f"agg_{step.target.lower()}_{_key(step.edge.child_cols)}"


def dimension_alias(step: Step) -> str:
    return f"dim_{step.target.lower()}_{_key(step.edge.child_cols)}"


def available_joins(model: LogicalModel) -> int:
    """Joins that the whole model would take."""
    paths = set()
    for f in model.fields:
        if f.source.kind is FieldKind.JOINED:
            paths.update(path_alias(f.source.path[:k]) for k in range(1, len(f.source.path) + 1))
        elif f.source.kind is FieldKind.AGGREGATED:
            paths.add(child_alias(f.source.path[0]))
    return len(paths)


def make_plan(model: LogicalModel, graph: SchemaGraph, fields: list[LogicalField], pushed: list[tuple[LogicalField, Predicate]] = ()) -> JoinPlan:
    """The joins that the fields need; a pushed predicate goes inside its child's aggregate."""
    if any(f.source.kind is FieldKind.GROUPED for f in fields):
        return _grouped(model, graph, fields, pushed)
    plan = JoinPlan(model, model.base)
    hops: dict[str, Hop] = {}
    children: dict[str, Child] = {}

    def child_of(step: Step) -> Child:
        if step.edge.condition is not None:
            raise QueryError(f"{step.target} is joined by a non-equi condition and cannot be pre-aggregated to the grain of {model.base}")
        alias = child_alias(step)
        return children.setdefault(alias, Child(alias, "base", step))

    for f in fields:
        s = f.source
        if s.kind is FieldKind.BASE:
            plan.outputs.append(("base", s.column, f.name))
        elif s.kind is FieldKind.JOINED:
            for k in range(1, len(s.path) + 1):
                alias = path_alias(s.path[:k])
                hops.setdefault(alias, Hop(alias, path_alias(s.path[: k - 1]) if k > 1 else "base", s.path[k - 1]))
            plan.outputs.append((path_alias(s.path), s.column, f.name))
        elif not f.filter_only:
            if s.aggregate not in AGGREGATES:
                raise QueryError(f"unsupported aggregate: {s.aggregate}")
            child = child_of(s.path[0])
            child.aggregates.append((f.name, s.aggregate, s.column))
            plan.outputs.append((child.alias, f.name, f.name))
    for f, predicate in pushed:
        child = child_of(f.source.path[0])
        for step in f.source.path[1:]:
            child.dimensions[dimension_alias(step)] = step
        child.predicates.append(predicate)
    if not plan.outputs:
        # a query that only counts rows: the key is enough
        table = graph.catalog.table(model.base)
        plan.outputs = [("base", c, c) for c in table.primary_key or table.column_names[:1]]
    plan.hops = [hops[a] for a in sorted(hops)]
    plan.children = [children[a] for a in sorted(children)]
    return plan


def _grouped(model: LogicalModel, graph: SchemaGraph, fields: list[LogicalField], pushed) -> JoinPlan:
    """One row for each value of a link table's other side: anchors are counted once."""
    links = {child_alias(f.source.path[0]): f.source.path[0] for f in fields if f.source.kind is FieldKind.GROUPED}
    if len(links) > 1:
        raise QueryError(f"query groups through more than one child table: {', '.join(sorted(links))}")
    base = graph.catalog.table(model.base)
    keys = {c.lower() for c in base.primary_key} | graph.key_columns(base.name)
    if pushed or any(f.source.kind is FieldKind.AGGREGATED for f in fields):
        raise QueryError("cannot mix grouped fields with aggregates of a child")
    for f in fields:
        if f.source.kind is FieldKind.BASE and base.column(f.source.column).is_numeric and f.source.column.lower() not in keys:
            raise QueryError(f"cannot project numeric column {f.name} beside grouped fields: it would repeat for each link")
    plan = JoinPlan(model, model.base)
    (alias, link), *_ = links.items()
    if link.edge.condition is not None:
        raise QueryError(f"{link.target} is joined by a non-equi condition and cannot be a group")
    plan.axis.append(Hop(alias, "base", link))
    hops: dict[str, Hop] = {}
    for f in fields:
        s = f.source
        if s.kind is FieldKind.BASE:
            plan.outputs.append(("base", s.column, f.name))
        elif s.kind is FieldKind.JOINED:
            for k in range(1, len(s.path) + 1):
                a = path_alias(s.path[:k])
                hops.setdefault(a, Hop(a, path_alias(s.path[: k - 1]) if k > 1 else "base", s.path[k - 1]))
            plan.outputs.append((path_alias(s.path), s.column, f.name))
        elif s.aggregate == "count_distinct":
            plan.distinct.append((f.name, base.primary_key or link.edge.parent_cols))
        else:
            at = alias
            for step in s.path[1:]:
                nxt = f"{at}__{step.target.lower()}_{_key(step.edge.child_cols)}"
                if all(h.alias != nxt for h in plan.axis):
                    plan.axis.append(Hop(nxt, at, step))
                at = nxt
            plan.outputs.append((at, s.column, f.name))
    plan.hops = [hops[a] for a in sorted(hops)]
    return plan


def condition_columns(condition: str) -> tuple[set[str], set[str]]:
    """Columns of the child and of the parent in a join condition."""
    found = _SIDE.findall(condition)
    return {c for side, c in found if side == "L"}, {c for side, c in found if side == "R"}


def bind_condition(condition: str, left, right) -> str:
    """A condition with its columns named by two functions."""
    return _SIDE.sub(lambda m: (left if m[1] == "L" else right)(m[2]), condition)
