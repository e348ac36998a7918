"""DataFrames of join plans.

Only columns that a plan needs are read, under names that carry the alias of
their table, so nothing is ambiguous.  A child is folded by its key before it is
joined, which keeps the base's rows apart and shuffles one row for each key and
task; which joins are broadcast is left to the optimiser and its size limits."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joinplan import Child, JoinPlan, bind_condition, condition_columns
from ..plans.sqlscan import QueryError
from ..types import Catalog, Step


def _name(alias: str, column: str) -> str:
    return f"{alias}__{column.lower()}"


def _col(alias: str, column: str):
    return F.col(f"`{_name(alias, column)}`")


class _Frames:
    """Tables of a plan, each projected to what is asked of it."""

    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog
        self.columns: dict[str, dict[str, None]] = defaultdict(dict)
        self.exprs: dict[str, dict[str, str]] = defaultdict(dict)

    def need(self, alias: str, *columns: str) -> None:
        for c in columns:
            self.columns[alias][c.lower()] = None

    def need_step(self, child: str, parent: str, step: Step) -> None:
        """Columns for a join along an edge, whose many side is child."""
        e = step.edge
        if e.condition is not None:
            left, right = condition_columns(e.condition)
            self.need(child, *left)
            self.need(parent, *right)
            return
        self.need(parent, *e.parent_cols)
        if e.key_exprs:
            for k, x in enumerate(e.key_exprs):
                self.exprs[child][f"{child}__key{k}_{e.parent.lower()}"] = x
        else:
            self.need(child, *e.child_cols)

    def on(self, child: str, parent: str, step: Step):
        e = step.edge
        if e.condition is not None:
            return F.expr(bind_condition(e.condition, lambda c: f"`{_name(child, c)}`", lambda c: f"`{_name(parent, c)}`"))
        left = [F.col(f"`{child}__key{k}_{e.parent.lower()}`") for k in range(len(e.key_exprs))] or [_col(child, c) for c in e.child_cols]
        if not left:
            raise QueryError(f"join of {e.child} and {e.parent} has no key columns")
        return reduce(lambda a, b: a & b, (x == _col(parent, p) for x, p in zip(left, e.parent_cols, strict=True)))

    def frame(self, alias: str, table: str) -> DataFrame:
        df = self.catalog.table(table).frame(self.spark)
        return df.select(*(F.col(f"`{c}`").alias(_name(alias, c)) for c in self.columns[alias]), *(F.expr(x).alias(n) for n, x in self.exprs[alias].items()))


_AGGREGATE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def fold_child(spark: SparkSession, catalog: Catalog, child: Child) -> DataFrame:
    """One row for each key of a child that passes the pushed predicates."""
    step = child.step
    frames = _Frames(spark, catalog)
    e = step.edge
    if e.key_exprs:
        keys = [(f"src__key{k}", p) for k, p in enumerate(e.parent_cols)]
        for (n, _), x in zip(keys, e.key_exprs, strict=True):
            frames.exprs["src"][n] = x
    else:
        frames.need("src", *e.child_cols)
        keys = [(_name("src", c), c) for c in e.child_cols]
    for _, how, column in child.aggregates:
        if how != "count":
            frames.need("src", column)
    for p in child.predicates:
        for alias, column in p.columns:
            frames.need(alias, column)
    for alias, s in child.dimensions.items():
        frames.need_step("src", alias, s)
    df = frames.frame("src", step.target)
    for alias, s in child.dimensions.items():
        df = df.join(frames.frame(alias, s.target), frames.on("src", alias, s), "inner")
    for p in child.predicates:
        df = df.where(F.expr(p.template.format(*(f"`{_name(a, c)}`" for a, c in p.columns))))
    aggregates = [F.count(F.lit(1)).alias(_name(child.alias, n)) if how == "count" else _AGGREGATE[how](_col("src", c)).alias(_name(child.alias, n)) for n, how, c in child.aggregates]
    grouped = df.groupBy(*(F.col(f"`{n}`").alias(_name(child.alias, f"on_{c}")) for n, c in keys))
    return grouped.agg(*aggregates) if aggregates else grouped.agg(F.lit(1).alias(_name(child.alias, "met")))


def build(spark: SparkSession, catalog: Catalog, plan: JoinPlan) -> DataFrame:
    frames = _Frames(spark, catalog)
    for alias, column, _ in plan.outputs:
        if not any(c.alias == alias for c in plan.children):
            frames.need(alias, column)
    for _, columns in plan.distinct:
        frames.need("base", *columns)
    for h in plan.hops:
        frames.need_step(h.parent, h.alias, h.step)
    for k, h in enumerate(plan.axis):
        frames.need_step(h.alias, h.parent, h.step) if not k else frames.need_step(h.parent, h.alias, h.step)
    for c in plan.children:
        frames.need("base", *c.step.edge.parent_cols)
    df = frames.frame("base", plan.base)
    for h in plan.hops:
        df = df.join(frames.frame(h.alias, h.step.target), frames.on(h.parent, h.alias, h.step), "left")
    for c in plan.children:
        folded = fold_child(spark, catalog, c)
        on = reduce(lambda a, b: a & b, (_col("base", p) == _col(c.alias, f"on_{k}") for p, k in zip(c.step.edge.parent_cols, c.keys, strict=True)))
        # a childless row stays with nulls, unless a condition on the child asked for rows
        df = df.join(folded, on, "inner" if c.predicates else "left")
    if plan.axis:
        return _group(df, frames, plan)
    return df.select(*(_col(a, c).alias(n) for a, c, n in plan.outputs))


def _group(df: DataFrame, frames: _Frames, plan: JoinPlan) -> DataFrame:
    link, *rest = plan.axis
    df = df.join(frames.frame(link.alias, link.step.target), frames.on(link.alias, "base", link.step), "inner")
    for h in rest:
        df = df.join(frames.frame(h.alias, h.step.target), frames.on(h.parent, h.alias, h.step), "left")
    counts = [F.countDistinct(*(_col("base", c) for c in columns)).alias(n) for n, columns in plan.distinct]
    groups = [_col(a, c).alias(n) for a, c, n in plan.outputs]
    return df.groupBy(*groups).agg(*counts) if counts else df.select(*groups).distinct()
