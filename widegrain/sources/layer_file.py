"""Layers as JSON or YAML, with all they need to be used again."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..types import Edge, FieldKind, FieldSource, Layer, LogicalField, LogicalModel, Step

VERSION = 1


def _step(s: Step) -> dict:
    e = s.edge
    return {"child": e.child, "child_cols": list(e.child_cols), "parent": e.parent, "parent_cols": list(e.parent_cols), "forward": s.forward, "inferred": e.inferred, "confidence": e.confidence, "key_exprs": list(e.key_exprs), "condition": e.condition}


def _dtype(text: str) -> T.DataType:
    """A type from its JSON: a struct with it as its only field reads it back."""
    return T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": json.loads(text), "nullable": True, "metadata": {}}]})["x"].dataType


def to_dict(layer: Layer) -> dict:
    field = lambda f: {"name": f.name, "type": f.dtype.json(), "description": f.description, "filter_only": f.filter_only, "kind": f.source.kind.value, "table": f.source.table, "column": f.source.column, "aggregate": f.source.aggregate, "path": [_step(s) for s in f.source.path]}
    return {"version": VERSION, "table_count": layer.table_count, "covered_count": layer.covered_count, "stop_reason": layer.stop_reason, "selector": layer.selector, "notes": list(layer.notes), "models": [{"name": m.name, "base": m.base, "absorbed": list(m.absorbed), "description": m.description, "fields": [field(f) for f in m.fields]} for m in layer.models]}


def from_dict(raw: dict) -> Layer:
    if raw.get("version") != VERSION:
        raise ValueError(f"layer version {raw.get('version')} isn't {VERSION}")

    def field(f: dict) -> LogicalField:
        path = tuple(Step(Edge(s["child"], tuple(s["child_cols"]), s["parent"], tuple(s["parent_cols"]), s["inferred"], s["confidence"], tuple(s["key_exprs"]), s["condition"]), s["forward"]) for s in f["path"])
        return LogicalField(f["name"], _dtype(f["type"]), FieldSource(FieldKind(f["kind"]), f["table"], f["column"], path, f["aggregate"]), f["description"], f["filter_only"])

    models = tuple(LogicalModel(m["name"], m["base"], tuple(map(field, m["fields"])), tuple(m["absorbed"]), m["description"]) for m in raw["models"])
    return Layer(models, raw["table_count"], raw["covered_count"], raw["stop_reason"], raw["selector"], tuple(raw["notes"]))


def to_json(layer: Layer) -> str:
    return json.dumps(to_dict(layer), indent=2, ensure_ascii=False)


def from_json(text: str) -> Layer:
    return from_dict(json.loads(text))


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML needs PyYAML; JSON does not") from e
    return yaml


def to_yaml(layer: Layer) -> str:
    return _yaml().safe_dump(to_dict(layer), allow_unicode=True, sort_keys=False)


def from_yaml(text: str) -> Layer:
    return from_dict(_yaml().safe_load(text))


def load(path: str) -> Layer:
    text = Path(path).read_text()
    return from_yaml(text) if path.endswith((".yml", ".yaml")) else from_json(text)


def fields_frame(spark: SparkSession, layer: Layer) -> DataFrame:
    """All fields as rows."""
    from ..reports.quality import lineage

    rows = [(*row, m) for row, m in zip(lineage(layer), (f.dtype.simpleString() for x in layer.models for f in x.fields), strict=True)]
    return spark.createDataFrame(rows, "model string, field string, kind string, source string, path string, type string")
