"""Virtual tables: a period dimension, monthly roll-ups, and one table for the parts of a partitioned one.

A virtual table is a lazily built DataFrame; what it reads is pruned with the query."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import SchemaGraph
from ..types import Catalog, ColumnDef, Edge, TableDef

# Fixed values.
PERIOD_TABLE, MONTH_KEY, YEAR = "V_PERIOD", "YYYYMM", "YYYY"
MONTH_NAMES = frozenset("yyyymm yyyy_mm base_yyyymm std_yyyymm".split())
DAY_NAMES = frozenset("yyyymmdd yyyy_mm_dd base_yyyymmdd std_yyyymmdd".split())
PARTITION_NAMES = (("day", r"(.+)_(\d{8})", "SNAPSHOT_YYYYMMDD"), ("month", r"(.+)_(\d{6})", "SNAPSHOT_YYYYMM"), ("year", r"(.+)_((?:18|19|20)\d{2})", "SNAPSHOT_YYYY"))
SNAPSHOT_OVERLAP, ROW_COUNT = 0.9, "ROW_CNT"


def grain_of(c: ColumnDef) -> str | None:
    """"month" or "day" for a text column with a period's name."""
    name = c.name.lower()
    return None if not c.is_textual else "day" if name in DAY_NAMES else "month" if name in MONTH_NAMES else None


def period_columns(catalog: Catalog) -> list[tuple[TableDef, ColumnDef, str]]:
    """The first period column of each table that bears one; months come before days."""
    out = []
    for t in catalog.tables:
        found = sorted(((grain_of(c), c) for c in t.columns if grain_of(c)), key=lambda x: x[0] == "day")
        if found:
            out.append((t, found[0][1], found[0][0]))
    return out


def month_of(grain: str, column: str) -> str:
    return f"`{column}`" if grain == "month" else f"SUBSTRING(`{column}`, 1, 6)"


def add_period_anchor(catalog: Catalog, name: str = PERIOD_TABLE) -> Catalog:
    """A dimension of all months that any table speaks of; days join by their first six digits."""
    bearers = [x for x in period_columns(catalog) if not x[0].is_virtual]
    owned = any(len(t.primary_key) == 1 and grain_of(t.column(t.primary_key[0])) for t in catalog.tables if t.primary_key and t.column(t.primary_key[0]))
    if len(bearers) < 2 or owned or catalog.table(name) is not None:
        return catalog

    def rows(spark: SparkSession) -> DataFrame:
        spine = None
        for t, c, grain in bearers:
            part = t.frame(spark).select(F.expr(month_of(grain, c.name)).alias(MONTH_KEY)).where(f"{MONTH_KEY} IS NOT NULL").distinct()
            spine = part if spine is None else spine.union(part)
        return spine.distinct().withColumn(YEAR, F.substring(MONTH_KEY, 1, 4))

    sql = " UNION ".join(f"SELECT {month_of(g, c.name)} AS {MONTH_KEY} FROM {t.reference()} WHERE `{c.name}` IS NOT NULL" for t, c, g in bearers)
    table = TableDef(name, (ColumnDef(MONTH_KEY, T.StringType(), False), ColumnDef(YEAR, T.StringType())), (MONTH_KEY,), supplier=rows, sql=f"SELECT {MONTH_KEY}, SUBSTRING({MONTH_KEY}, 1, 4) AS {YEAR} FROM ({sql})", is_virtual=True)
    edges = [Edge(t.name, (c.name,), name, (MONTH_KEY,), key_exprs=() if grain == "month" else (f"SUBSTRING({c.name}, 1, 6)",)) for t, c, grain in bearers]
    return catalog.with_tables([table]).with_edges(edges)


def monthly(df: DataFrame, month: str, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums and row count for each month and key; month is a SQL expression."""
    return df.groupBy(F.expr(month).alias(MONTH_KEY), *(F.col(f"`{k}`") for k in keys)).agg(*(F.sum(f"`{m}`").alias(m) for m in measures), F.count(F.lit(1)).alias(ROW_COUNT))


def add_monthly_summaries(catalog: Catalog, exclude: frozenset[str] = frozenset(), max_measures: int | None = None) -> Catalog:
    """V_<fact>_MON for each table with a period, keys and measures; balances are excluded, as they don't add up over months.

    max_measures, if given, takes only the first so many measures of each."""
    graph = SchemaGraph.build(catalog)
    tables, edges = [], []
    for t, c, grain in period_columns(catalog):
        own = [e for e in graph.outgoing(t.name) if not e.condition]
        name = f"V_{t.name}_MON"
        if t.name in exclude or t.is_virtual and t.supplier is None or not graph.outgoing(t.name) or catalog.table(name) is not None:
            continue
        keys = list(dict.fromkeys(k for e in own for k in e.child_cols if k.lower() != c.name.lower()))
        hidden = {k.lower() for k in (*keys, *t.primary_key, c.name)}
        measures = [m for m in t.columns if m.is_numeric and m.name.lower() not in hidden][:max_measures]
        if not measures:
            continue
        columns = (ColumnDef(MONTH_KEY, T.StringType()), *(t.column(k) for k in keys), *(replace(m, dtype=T.LongType() if isinstance(m.dtype, T.IntegralType) else m.dtype) for m in measures), ColumnDef(ROW_COUNT, T.LongType()))
        month, names = month_of(grain, c.name), [m.name for m in measures]

        def rows(spark: SparkSession, t=t, month=month, keys=keys, names=names) -> DataFrame:
            return monthly(t.frame(spark), month, keys, names)

        group = ", ".join([month, *(f"`{k}`" for k in keys)])
        picks = ", ".join([f"{month} AS {MONTH_KEY}", *(f"`{k}`" for k in keys), *(f"SUM(`{m}`) AS `{m}`" for m in names), f"COUNT(*) AS {ROW_COUNT}"])
        tables.append(TableDef(name, columns, (), comment=t.comment, supplier=rows, sql=f"SELECT {picks} FROM {t.reference()} GROUP BY {group}", is_virtual=True))
        for e in own:
            if any(k.lower() == c.name.lower() for k in e.child_cols):
                edges.append(Edge(name, (MONTH_KEY,), e.parent, e.parent_cols))
            else:
                edges.append(replace(e, child=name))
    return catalog.with_tables(tables).with_edges(edges)


@dataclass(frozen=True)
class Consolidation:
    name: str
    members: tuple[str, ...]
    kept_edges: int
    dropped_edges: int
    dropped_incoming: int
    overlap: float | None = None

    @property
    def snapshot_like(self) -> bool | None:
        return None if self.overlap is None else self.overlap >= SNAPSHOT_OVERLAP


def partition_of(name: str) -> tuple[str, str, str, str] | None:
    """(stem, kind, value, column for the value) of a name that ends with a period."""
    for kind, pattern, column in PARTITION_NAMES:
        found = re.fullmatch(pattern, name)
        if found:
            return found[1], kind, found[2], column
    return None


def _shape(t: TableDef) -> tuple:
    return tuple((c.name.lower(), c.join_class) for c in t.columns)


def consolidate(catalog: Catalog, spark: SparkSession | None = None) -> tuple[Catalog, tuple[Consolidation, ...]]:
    """Tables that are parts of one by period become one, with the period as a column.

    It has no key (parts may repeat one); an edge stays if all parts agree on
    it.  With a session the two smallest parts tell balances from movements."""
    groups: dict[tuple, list[tuple[str, TableDef]]] = {}
    for t in catalog.tables:
        p = partition_of(t.name)
        if p and not t.is_virtual:
            groups.setdefault((p[0], p[1], p[3], _shape(t)), []).append((p[2], t))
    tables, edges, reports = list(catalog.tables), list(catalog.edges), []
    for (stem, _, column, _), members in groups.items():
        if len(members) < 2:
            continue
        names = {t.name.lower() for _, t in members}
        name = next(n for n in (stem, f"{stem}_ALL", f"{stem}_ALL_X") if all(t.name.lower() != n.lower() for t in tables))

        def rows(spark: SparkSession, members=tuple(members), column=column) -> DataFrame:
            parts = [t.frame(spark).withColumn(column, F.lit(value)) for value, t in members]
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            return whole

        first = members[0][1]
        sql = " UNION ALL ".join(f"SELECT {', '.join(f'`{c}`' for c in first.column_names)}, '{value}' AS {column} FROM {t.reference()}" for value, t in members)
        targets = [{(tuple(c.lower() for c in e.child_cols), e.parent.lower()): e for e in edges if e.child.lower() == t.name.lower()} for _, t in members]
        common = set(targets[0]).intersection(*targets[1:])
        everything = {k for found in targets for k in found}
        incoming = [e for e in edges if e.parent.lower() in names]
        kept = [replace(targets[0][k], child=name) for k in targets[0] if k in common]
        edges = [e for e in edges if e.child.lower() not in names and e.parent.lower() not in names] + kept
        at = next(i for i, t in enumerate(tables) if t.name.lower() in names)
        tables = [t for t in tables if t.name.lower() not in names]
        tables.insert(at, TableDef(name, (*first.columns, ColumnDef(column, T.StringType())), (), comment=first.comment, supplier=rows, sql=sql, is_virtual=True))
        share = overlap(spark, [t for _, t in members]) if spark is not None else None
        reports.append(Consolidation(name, tuple(t.name for _, t in members), len(kept), len(everything - common), len(incoming), share))
    return Catalog(tuple(tables), tuple(edges)), tuple(reports)


def key_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """common and either: keys that two parts share, and keys of any of them."""
    seen = a.distinct().withColumn("__a", F.lit(1)).unionByName(b.distinct().withColumn("__a", F.lit(0)))
    both = seen.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("__n"))
    return both.agg(F.count_if(F.col("__n") == 2).alias("common"), F.count(F.lit(1)).alias("either"))


def overlap(spark: SparkSession, members: list[TableDef]) -> float | None:
    """How far the keys of the two smallest parts, without their period, are the same."""
    key = [c for c in members[0].primary_key if not grain_of(members[0].column(c))]
    if not key:
        return None
    small = sorted(members, key=lambda t: (t.rows is None, t.rows or 0))[:2]
    r = key_overlap(*(t.frame(spark).select(*(F.col(f"`{c}`") for c in key)) for t in small)).first()
    return r["common"] / r["either"] if r["either"] else None
