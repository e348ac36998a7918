"""The engine's front: a layer of wide models that answers SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .graph import SchemaGraph
from .operators.build import build
from .plans.compose import ComposeOptions, compose
from .plans.expand import Expansion, answer, expand
from .plans.joinplan import make_plan
from .types import Catalog, FieldKind, Layer


@dataclass(frozen=True)
class WideLayer:
    spark: SparkSession
    layer: Layer
    graph: SchemaGraph

    def expand(self, sql: str, dialect: str = "spark") -> Expansion:
        return expand(self.spark, sql, self.layer, self.graph, dialect)

    def query(self, sql: str, args: dict[str, object] | None = None) -> DataFrame:
        """The query's rows; args has the values of :name marks."""
        return answer(self.spark, self.expand(bind(sql, args) if args else sql), self.graph)

    def frame(self, model: str, *fields: str) -> DataFrame:
        """A model, or some of its fields, as a DataFrame."""
        m = self.layer.model(model)
        names = {f.lower() for f in fields}
        chosen = [f for f in m.fields if not f.filter_only and (f.name.lower() in names if fields else f.source.kind is not FieldKind.GROUPED)]
        return build(self.spark, self.graph.catalog, make_plan(m, self.graph, chosen))


_MARK = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::)|:([A-Za-z_]\w*)", re.S)


def literal(value: object) -> str:
    """A value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"DOUBLE('{value}')"
    if isinstance(value, (int, decimal.Decimal)):
        return f"{value}"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


def bind(sql: str, args: dict[str, object]) -> str:
    """A query with its :name marks replaced by literals; texts, quoted names and comments are left alone."""

    def put(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        if m[2] not in args:
            raise KeyError(f"no value for :{m[2]}")
        return literal(args[m[2]])

    return _MARK.sub(put, sql)


def wide_layer(spark: SparkSession, catalog: Catalog, anchors: list[str], **options) -> WideLayer:
    """A layer with one model, named like its table, for each anchor."""
    graph = SchemaGraph.build(catalog)
    return WideLayer(spark, compose([(a, a) for a in anchors], graph, ComposeOptions(**options)), graph)
