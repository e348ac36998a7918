"""How much information columns carry, and how much of it a layer keeps.

A column's bits are log2 of its different values, plus one."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.probe import distinct_widths
from ..types import Catalog, Layer

#: Columns counted in one query.
COLUMNS_AT_ONCE = 80


def column_bits(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_distinct and bits for each column."""
    columns = columns or df.columns
    one = distinct_widths(df, columns)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_distinct")) for c in columns)))
    return one.select(pairs.alias("x")).select("x.*").withColumn("bits", F.log2(F.greatest(F.col("n_distinct"), F.lit(1))) + 1)


def table_bits(spark: SparkSession, catalog: Catalog) -> dict[tuple[str, str], float]:
    """Bits of (table, column); of wide tables some columns at a time."""
    out = {}
    for t in catalog.tables:
        for k in range(0, len(t.columns), COLUMNS_AT_ONCE):
            for r in column_bits(t.frame(spark), list(t.column_names[k : k + COLUMNS_AT_ONCE])).collect():
                out[t.name.lower(), r["column_name"].lower()] = r["bits"]
    return out


@dataclass(frozen=True)
class Information:
    source_bits: float
    exposed_bits: float
    field_bits: float
    unmeasured: tuple[str, ...]

    @property
    def retention(self) -> float:
        return self.exposed_bits / self.source_bits if self.source_bits else 0.0

    @property
    def duplication(self) -> float:
        """Bits of all fields for each bit that is exposed at all."""
        return self.field_bits / self.exposed_bits if self.exposed_bits else 0.0


def measure(layer: Layer, catalog: Catalog, bits: dict[tuple[str, str], float]) -> Information:
    shown = [(f.source.table.lower(), f.source.column.lower()) for m in layer.models for f in m.fields]
    return Information(math.fsum(bits.values()), math.fsum(bits.get(p, 0) for p in set(shown)), math.fsum(bits.get(p, 0) for p in shown), ())
