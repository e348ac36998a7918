"""Columns of one table that always say the same, and the fields that can go for it."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from ..naming import without_suffix
from ..plans.compose import is_noise
from ..types import Catalog, Layer
from .probe import distinct_widths, mutually_determined

MIN_ROWS = 8


@dataclass(frozen=True)
class Equivalent:
    table: str
    columns: tuple[str, ...]  # the representative first


def find_equivalents(spark: SparkSession, catalog: Catalog) -> tuple[Equivalent, ...]:
    """Groups of key-like columns that determine each other; thin tables prove nothing.

    Only columns of equal width can, so one scan for all widths comes first."""
    out = []
    for t in catalog.tables:
        pk = {c.lower() for c in t.primary_key}
        names = [c.name for c in t.columns if not is_noise(c.name) and (c.name.lower() in pk or without_suffix(c.name))]
        if len(names) < 2:
            continue
        df = t.frame(spark)
        row = distinct_widths(df, names).first()
        if row["row_count"] < MIN_ROWS:
            continue
        cohorts = defaultdict(list)
        for n in names:
            if row[n] > 1:
                cohorts[row[n]].append(n)
        for cohort in cohorts.values():
            rest = cohort
            while len(rest) > 1:
                head, *others = rest
                same = [o for o in others if mutually_determined(df, head, o)]
                if same:
                    out.append(Equivalent(t.name, (head, *same)))
                rest = [o for o in others if o not in same]
    return tuple(out)


def dedupe_fields(layer: Layer, groups: tuple[Equivalent, ...]) -> Layer:
    """Of equivalent columns a model keeps the representative's field, which says so; nothing goes without it."""
    head = {(g.table.lower(), c.lower()): g.columns[0].lower() for g in groups for c in g.columns[1:]}
    models = []
    for m in layer.models:
        at = {(f.source.table.lower(), f.source.column.lower(), f.source.path, f.filter_only) for f in m.fields}
        said, kept = defaultdict(list), []
        for f in m.fields:
            table = f.source.table.lower()
            first = head.get((table, f.source.column.lower()))
            key = (table, first, f.source.path, f.filter_only)
            if first is not None and key in at and f.source.aggregate is None:
                said[key].append(f.source.column)
            else:
                kept.append(f)
        models.append(replace(m, fields=tuple(replace(f, description=(f.description + " " if f.description else "") + "(same value as " + ", ".join(said[k]) + ")") if said.get(k := (f.source.table.lower(), f.source.column.lower(), f.source.path, f.filter_only)) else f for f in kept)))
    return replace(layer, models=tuple(models))
