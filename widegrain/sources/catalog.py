"""Catalogues of parquet folders and of a session's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..types import Catalog, ColumnDef, Edge, TableDef


def table_of(name: str, df: DataFrame, primary_key: tuple[str, ...] = (), *, supplier=None, rows: int | None = None, comment: str = "", is_virtual: bool = False) -> TableDef:
    columns = tuple(ColumnDef(f.name, f.dataType, f.nullable, (f.metadata or {}).get("comment", "")) for f in df.schema)
    return TableDef(name, columns, tuple(primary_key), comment=comment, rows=rows, supplier=supplier or (lambda _: df), is_virtual=is_virtual)


def from_frames(frames: dict[str, DataFrame], keys: dict[str, tuple[str, ...]] | None = None, edges: tuple[Edge, ...] = ()) -> Catalog:
    return Catalog(tuple(table_of(n, df, (keys or {}).get(n, ())) for n, df in frames.items()), tuple(edges))


def from_dir(spark: SparkSession, path: str, names: list[str], keys: dict[str, tuple[str, ...]] | None = None, edges: tuple[Edge, ...] = (), *, file_format: str = "parquet", **options: str) -> Catalog:
    """Tables <path>/<name>.<format> in any format that Spark reads (parquet, orc, csv, json); of parquet and orc only footers are read here."""
    return from_frames({n: spark.read.options(**options).format(file_format).load(f"{path}/{n}.{file_format}") for n in names}, keys, edges)


def from_session(spark: SparkSession, database: str | None = None, keys: dict[str, tuple[str, ...]] | None = None) -> Catalog:
    """Tables that the session's catalogue lists."""
    names = [t.name for t in spark.catalog.listTables(database)]
    return from_frames({n: spark.table(f"{database}.{n}" if database else n) for n in names}, keys)


def with_row_counts(spark: SparkSession, catalog: Catalog) -> Catalog:
    """Row counts; of parquet they come from the footers."""
    from dataclasses import replace

    return replace(catalog, tables=tuple(replace(t, rows=t.frame(spark).count()) for t in catalog.tables))


# Keys of the star schema that the queries run on; its files carry none.
STAR_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",)}
STAR_EDGES = (
    Edge("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    Edge("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    Edge("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    Edge("orders", ("o_custkey",), "customer", ("c_custkey",)),
    Edge("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    Edge("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    Edge("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
)


def star_schema(spark: SparkSession, path: str) -> Catalog:
    return from_dir(spark, path, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"], STAR_KEYS, STAR_EDGES)
