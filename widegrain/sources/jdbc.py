"""Catalogues of databases over JDBC; their tables become lazily read DataFrames.

The driver's jar must be on Spark's class path.  Assembling is separate from
reading, so it can be tested on plain rows."""

from __future__ import annotations

import os
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from ..types import Catalog, ColumnDef, Edge, TableDef, parse_type

# Catalogue queries in each database's own terms.  Columns: (table, column, type, nullable, comment), (table, column)
# by place in the key, (constraint, child, column, parent, column) by place, (table, rows, comment).
QUERIES = {
    "postgresql": {
        "columns": "SELECT c.relname, a.attname, format_type(a.atttypid, a.atttypmod), NOT a.attnotnull, col_description(c.oid, a.attnum) FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid WHERE n.nspname = '{schema}' AND c.relkind IN ('r', 'p', 'v', 'm') AND a.attnum > 0 AND NOT a.attisdropped ORDER BY c.relname, a.attnum",
        "keys": "SELECT c.relname, a.attname FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN LATERAL unnest(k.conkey) WITH ORDINALITY u(attnum, place) ON true JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = u.attnum WHERE k.contype = 'p' AND n.nspname = '{schema}' ORDER BY c.relname, u.place",
        "edges": "SELECT k.conname, c.relname, a.attname, p.relname, b.attname FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_class p ON p.oid = k.confrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN LATERAL unnest(k.conkey, k.confkey) WITH ORDINALITY u(x, y, place) ON true JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = u.x JOIN pg_attribute b ON b.attrelid = p.oid AND b.attnum = u.y WHERE k.contype = 'f' AND n.nspname = '{schema}' ORDER BY k.conname, u.place",
        "tables": "SELECT c.relname, CASE WHEN c.reltuples >= 0 THEN c.reltuples::bigint END, obj_description(c.oid) FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = '{schema}' AND c.relkind IN ('r', 'p', 'v', 'm')",
    },
    "sqlserver": {
        "columns": "SELECT o.name, c.name, CONCAT(t.name, CASE WHEN t.name IN ('nvarchar', 'nchar') AND c.max_length > 0 THEN CONCAT('(', c.max_length / 2, ')') WHEN t.name IN ('varchar', 'char') AND c.max_length > 0 THEN CONCAT('(', c.max_length, ')') WHEN t.name IN ('decimal', 'numeric') THEN CONCAT('(', c.precision, ',', c.scale, ')') ELSE '' END), c.is_nullable, CAST(e.value AS nvarchar(4000)) FROM sys.objects o JOIN sys.schemas s ON s.schema_id = o.schema_id JOIN sys.columns c ON c.object_id = o.object_id JOIN sys.types t ON t.user_type_id = c.user_type_id LEFT JOIN sys.extended_properties e ON e.major_id = c.object_id AND e.minor_id = c.column_id AND e.name = 'MS_Description' WHERE s.name = '{schema}' AND o.type IN ('U', 'V')",
        "keys": "SELECT o.name, c.name FROM sys.indexes i JOIN sys.objects o ON o.object_id = i.object_id JOIN sys.schemas s ON s.schema_id = o.schema_id JOIN sys.index_columns x ON x.object_id = i.object_id AND x.index_id = i.index_id JOIN sys.columns c ON c.object_id = x.object_id AND c.column_id = x.column_id WHERE i.is_primary_key = 1 AND s.name = '{schema}'",
        "edges": "SELECT f.name, o.name, c.name, p.name, d.name FROM sys.foreign_keys f JOIN sys.foreign_key_columns k ON k.constraint_object_id = f.object_id JOIN sys.objects o ON o.object_id = f.parent_object_id JOIN sys.schemas s ON s.schema_id = o.schema_id JOIN sys.objects p ON p.object_id = f.referenced_object_id JOIN sys.columns c ON c.object_id = o.object_id AND c.column_id = k.parent_column_id JOIN sys.columns d ON d.object_id = p.object_id AND d.column_id = k.referenced_column_id WHERE s.name = '{schema}'",
        "tables": "SELECT o.name, SUM(p.rows), MAX(CAST(e.value AS nvarchar(4000))) FROM sys.objects o JOIN sys.schemas s ON s.schema_id = o.schema_id LEFT JOIN sys.partitions p ON p.object_id = o.object_id AND p.index_id IN (0, 1) LEFT JOIN sys.extended_properties e ON e.major_id = o.object_id AND e.minor_id = 0 AND e.name = 'MS_Description' WHERE s.name = '{schema}' AND o.type IN ('U', 'V') GROUP BY o.name",
    },
    "oracle": {
        "columns": "SELECT c.table_name, c.column_name, c.data_type || CASE WHEN c.data_type = 'NUMBER' AND c.data_precision IS NOT NULL THEN '(' || c.data_precision || ',' || NVL(c.data_scale, 0) || ')' WHEN c.data_type LIKE '%CHAR%' THEN '(' || c.char_length || ')' ELSE '' END, CASE c.nullable WHEN 'Y' THEN 1 ELSE 0 END, m.comments FROM all_tab_columns c LEFT JOIN all_col_comments m ON m.owner = c.owner AND m.table_name = c.table_name AND m.column_name = c.column_name WHERE c.owner = UPPER('{schema}')",
        "keys": "SELECT k.table_name, x.column_name FROM all_constraints k JOIN all_cons_columns x ON x.owner = k.owner AND x.constraint_name = k.constraint_name WHERE k.constraint_type = 'P' AND k.owner = UPPER('{schema}')",
        "edges": "SELECT k.constraint_name, k.table_name, x.column_name, r.table_name, y.column_name FROM all_constraints k JOIN all_constraints r ON r.owner = k.r_owner AND r.constraint_name = k.r_constraint_name JOIN all_cons_columns x ON x.owner = k.owner AND x.constraint_name = k.constraint_name JOIN all_cons_columns y ON y.owner = r.owner AND y.constraint_name = r.constraint_name AND y.position = x.position WHERE k.constraint_type = 'R' AND k.owner = UPPER('{schema}')",
        "tables": "SELECT t.table_name, s.num_rows, t.comments FROM all_tab_comments t LEFT JOIN all_tables s ON s.owner = t.owner AND s.table_name = t.table_name WHERE t.owner = UPPER('{schema}')",
    },
}
#: Environment variables of a SQL Server connection.
ENV = {k: f"WIDEGRAIN_MSSQL_{k}" for k in ("HOST", "PORT", "USER", "PASSWORD", "DB")}


class SourceUnavailable(RuntimeError):
    """A database that can't be read as things stand."""


def sqlserver_from_env(env=os.environ) -> dict[str, str]:
    """JDBC options; nothing is made up for what is missing."""
    missing = [v for k, v in ENV.items() if k != "PORT" and not env.get(v)]
    if missing:
        raise SourceUnavailable(f"set {', '.join(missing)}")
    return {"url": f"jdbc:sqlserver://{env[ENV['HOST']]}:{env.get(ENV['PORT'], '1433')};databaseName={env[ENV['DB']]}", "user": env[ENV["USER"]], "password": env[ENV["PASSWORD"]]}


def assemble(columns, keys, edges, tables, *, frame=None) -> Catalog:
    """A catalogue of rows as the catalogue queries give them."""
    by_table: dict[str, list[ColumnDef]] = defaultdict(list)
    for table, column, declared, nullable, comment in columns:
        by_table[table].append(ColumnDef(column, parse_type(declared), bool(nullable), comment or ""))
    primary: dict[str, list[str]] = defaultdict(list)
    for table, column in keys:
        primary[table].append(column)
    about = {t: (int(n) if n is not None and n >= 0 else None, c or "") for t, n, c in tables}
    pairs: dict[tuple[str, str, str], list[tuple[str, str]]] = defaultdict(list)
    for name, child, column, parent, target in edges:
        pairs[name, child, parent].append((column, target))
    made = [TableDef(t, tuple(cs), tuple(primary[t]), rows=about.get(t, (None, ""))[0], comment=about.get(t, (None, ""))[1], supplier=frame(t) if frame else None) for t, cs in by_table.items()]
    links = [Edge(c, tuple(x for x, _ in cols), p, tuple(y for _, y in cols)) for (_, c, p), cols in pairs.items() if c in by_table and p in by_table]
    return Catalog(tuple(made), tuple(links))


def read_jdbc(spark: SparkSession, kind: str, options: dict[str, str], schema: str) -> Catalog:
    """The catalogue of one schema; kind is a key of QUERIES."""
    if kind not in QUERIES:
        raise SourceUnavailable(f"unknown database {kind}; known: {', '.join(QUERIES)}")
    if not schema.replace("_", "").isalnum():
        raise ValueError(f"not a schema name: {schema}")
    rows = {n: [tuple(r) for r in spark.read.format("jdbc").options(**options, query=q.format(schema=schema)).load().collect()] for n, q in QUERIES[kind].items()}

    def frame(table: str):
        return lambda s: _load(s, options, f"{schema}.{table}")

    return assemble(rows["columns"], rows["keys"], rows["edges"], rows["tables"], frame=frame)


def _load(spark: SparkSession, options: dict[str, str], table: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options, dbtable=table).load()
